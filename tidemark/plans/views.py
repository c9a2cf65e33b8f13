"""The relational views over the lineage tables.

Every function takes a dict of DataFrames (see operators.lineage.TABLES, each with project_id) and returns a DataFrame that
keeps project_id. Joins are equi-joins on project_id and ids; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import cut, drop_cut

Tables = dict[str, DataFrame]
VIEWS: dict[str, Callable[[Tables], DataFrame]] = {}
RELATIONS = ("table", "view", "cte")
FLOWS = ("data_flow", "derivation")
#: Steps that a column's closure follows.
DEPTH = 50
#: Rows of a closure's frontier up to which it is broadcast.
SMALL = 10_000


def view(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    VIEWS[f.__name__] = f
    return f


def _ends(t: Tables) -> DataFrame:
    """Edges with both ends in the edge's own statement, their parts as f and t, and the statement as s."""
    side = lambda name: t["nodes"].select("project_id", "statement_id", F.col("id").alias(f"{name}_id"), F.struct("node_type", "label", "qualified_name").alias(name))
    e = t["edges"].withColumnsRenamed({"from_node_id": "f_id", "to_node_id": "t_id"})
    return e.join(side("f"), ["project_id", "statement_id", "f_id"]).join(side("t"), ["project_id", "statement_id", "t_id"])


def _with_statement(df: DataFrame, t: Tables, how: str = "inner") -> DataFrame:
    s = t["statements"].select("project_id", F.col("id").alias("statement_id"), F.struct("source_name", "statement_index", "statement_type", "complexity_score").alias("s"))
    return df.join(s, ["project_id", "statement_id"], how)


@view
def column_lineage(t: Tables) -> DataFrame:
    e = _with_statement(_ends(t).where(F.col("edge_type").isin(*FLOWS) & (F.col("f.node_type") == "column") & (F.col("t.node_type") == "column")), t)
    return e.select(
        "project_id", F.col("id").alias("edge_id"), "s.source_name", "s.statement_index", F.col("f.qualified_name").alias("source_table"), F.col("f.label").alias("source_column"),
        F.col("t.qualified_name").alias("target_table"), F.col("t.label").alias("target_column"), F.col("expression").alias("transformation"), "operation", "is_approximate",
    )


@view
def table_dependencies(t: Tables) -> DataFrame:
    e = _with_statement(_ends(t).where(F.col("f.node_type").isin(*RELATIONS) & F.col("t.node_type").isin(*RELATIONS)), t)
    return e.select("project_id", "s.source_name", F.col("f.qualified_name").alias("source_table"), F.col("t.qualified_name").alias("target_table"), "edge_type").distinct()


def closure(edges: DataFrame, start: str, end: str, depth: int = DEPTH, paths: bool = True) -> DataFrame:
    """(project_id, start, end, depth, expression): every path of up to depth edges, one row a path.

    Without paths, every (start, end, depth) once and no expression: as many paths as meet again are one, so a level never
    has more rows than there are pairs, in a graph full of diamonds and around a cycle too. The frontier of each length
    is written to the shared folder and joined with the edges once more, until it's empty; the plan never grows with the
    depth but for the levels it reads. Only a frontier of up to SMALL rows is broadcast: the size of a file says little
    about its rows in memory, so the larger ones, and the columns' names, are merged.
    """
    flows = edges.where(F.col("edge_type").isin(*FLOWS))
    once = (lambda df: df) if paths else (lambda df: df.drop("expression").distinct())
    step = cut(once(flows.select("project_id", F.col(start).alias("_at"), F.col(end).alias("_next"), "expression")))
    last = ["expression"] if paths else []
    frontier = cut(step.select("project_id", F.col("_at").alias("start"), F.col("_next").alias("end"), F.lit(1).alias("depth"), *last))
    levels = [frontier]
    while len(levels) < depth and (size := frontier.count()):
        near = F.broadcast(frontier.drop("expression")) if size <= SMALL else frontier.drop("expression").hint("merge")
        beyond = step.withColumnRenamed("_at", "end")
        more = near.join(beyond if size <= SMALL else beyond.hint("merge"), ["project_id", "end"]).select("project_id", "start", F.col("_next").alias("end"), (F.col("depth") + 1).alias("depth"), *last)
        frontier = cut(more if paths else more.distinct())
        levels.append(frontier)
    drop_cut(step)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def _named_closure(t: Tables, start: str, end: str, far: str, paths: bool = True) -> DataFrame:
    columns = t["nodes"].where("node_type = 'column'")
    # a flow that leaves a column only ever meets columns: flows between relations need not be followed
    own = columns.select("project_id", F.col("id").alias("from_node_id")).distinct().hint("merge")
    c = closure(t["edges"].join(own, ["project_id", "from_node_id"], "left_semi"), start, end, paths=paths)
    here = columns.select("project_id", F.col("id").alias("start"), F.col("qualified_name").alias("column_table"), F.col("label").alias("column_name")).hint("merge")
    there = columns.select("project_id", F.col("id").alias("end"), F.col("qualified_name").alias(f"{far}_table"), F.col("label").alias(f"{far}_column")).hint("merge")
    j = c.join(here, ["project_id", "start"]).join(there, ["project_id", "end"])
    return j.select("project_id", "column_table", "column_name", f"{far}_table", f"{far}_column", "depth", *([F.col("expression").alias("transformation")] if paths else []))


@view
def column_ancestors(t: Tables) -> DataFrame:
    return _named_closure(t, "to_node_id", "from_node_id", "ancestor")


@view
def column_descendants(t: Tables) -> DataFrame:
    return _named_closure(t, "from_node_id", "to_node_id", "descendant")


@view
def node_details(t: Tables) -> DataFrame:
    a = t["aggregations"].select("project_id", "statement_id", F.col("node_id").alias("id"), "is_grouping_key", F.col("function").alias("aggregation_function"), F.col("is_distinct").alias("aggregation_distinct"))
    n = _with_statement(t["nodes"], t, "left").join(a, ["project_id", "statement_id", "id"], "left")
    return n.select("project_id", "id", "statement_id", "node_type", "label", "qualified_name", "expression", "resolution_source", "s.statement_index", "s.source_name", "s.statement_type", "is_grouping_key", "aggregation_function", "aggregation_distinct")


@view
def edge_details(t: Tables) -> DataFrame:
    j = t["joins"].select("project_id", "statement_id", F.col("node_id").alias("f_id"), "join_type", "join_condition")
    e = _with_statement(_ends(t).join(j, ["project_id", "statement_id", "f_id"], "left"), t, "left")
    ends = [F.col(f"{a}.{c}").alias(f"{name}_{short}") for a, name in (("f", "from"), ("t", "to")) for c, short in (("node_type", "type"), ("label", "label"), ("qualified_name", "qualified_name"))]
    return e.select("project_id", "id", "edge_type", "operation", "expression", "is_approximate", *ends, "join_type", "join_condition", "s.statement_index", "s.source_name")


@view
def join_graph(t: Tables) -> DataFrame:
    n = t["nodes"].select("project_id", "statement_id", F.col("id").alias("node_id"), F.col("qualified_name").alias("table_name"), F.col("label").alias("table_label"))
    j = _with_statement(t["joins"].join(n, ["project_id", "statement_id", "node_id"]), t, "left")
    return j.select("project_id", "s.source_name", "s.statement_index", "join_type", "join_condition", "table_name", "table_label")


@view
def node_filters(t: Tables) -> DataFrame:
    n = t["nodes"].select("project_id", "statement_id", F.col("id").alias("node_id"), F.col("qualified_name").alias("table_name"), F.col("label").alias("node_label"), "node_type")
    f = _with_statement(t["filters"].join(n, ["project_id", "statement_id", "node_id"]), t, "left")
    return f.select("project_id", "table_name", "node_label", "node_type", "predicate", "filter_type", "s.source_name", "s.statement_index")


@view
def complexity_by_statement(t: Tables) -> DataFrame:
    key = ["project_id", "statement_id"]
    of = lambda kind: F.countDistinct(F.when(F.col("node_type") == kind, F.col("id")))
    n = t["nodes"].groupBy(*key).agg(of("table").alias("table_count"), of("column").alias("column_count"))
    e = t["edges"].groupBy(*key).agg(F.countDistinct("id").alias("edge_count"))
    s = t["statements"].withColumnRenamed("id", "statement_id").join(n, key, "left").join(e, key, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("table_count", "column_count", "edge_count")]
    return s.select("project_id", "source_name", "statement_index", "statement_type", "complexity_score", "join_count", *counts)


@view
def issues_summary(t: Tables) -> DataFrame:
    return _with_statement(t["issues"], t, "left").select("project_id", "severity", "code", "message", "s.source_name", "s.statement_index", "s.statement_type", "span_start", "span_end")


def _degrees(t: Tables, kinds: tuple[str, ...], group: list[str]) -> DataFrame:
    """Nodes grouped, with the different edges into and out of them; each side is joined and counted on its own."""
    n = t["nodes"].where(F.col("node_type").isin(*kinds))
    ids = n.select("project_id", "id", *[c for c in group if c != "id"]).distinct()
    key = ["project_id", *group]

    def side(end: str, name: str) -> DataFrame:
        e = t["edges"].select("project_id", F.col(end).alias("_node"), F.col("id").alias("_edge")).distinct()
        on = (ids["project_id"] == e["project_id"]) & (ids["id"] == e["_node"])
        return ids.join(e, on).groupBy(*[ids[c].alias(f"_{name}_{c}") for c in key]).agg(F.countDistinct("_edge").alias(name))

    out = n.groupBy(*key).agg(F.countDistinct("statement_id").alias("statement_count"))
    for end, name in (("to_node_id", "incoming"), ("from_node_id", "outgoing")):
        d = side(end, name)
        match: Column = F.lit(True)
        for c in key:
            match = match & out[c].eqNullSafe(d[f"_{name}_{c}"])
        out = out.join(d, match, "left").drop(*[f"_{name}_{c}" for c in key])
    return out.na.fill(0, ["incoming", "outgoing"])


@view
def table_usage(t: Tables) -> DataFrame:
    d = _degrees(t, RELATIONS, ["qualified_name", "node_type", "resolution_source"])
    return d.select("project_id", F.col("qualified_name").alias("table_name"), "node_type", "resolution_source", "statement_count", F.col("incoming").alias("incoming_edges"), F.col("outgoing").alias("outgoing_edges"))


@view
def column_connectivity(t: Tables) -> DataFrame:
    d = _degrees(t, ("column",), ["id", "qualified_name", "label"]).withColumn("total_connections", F.col("incoming") + F.col("outgoing")).where("total_connections > 0")
    out = d.select("project_id", F.col("qualified_name").alias("table_name"), F.col("label").alias("column_name"), F.col("incoming").alias("upstream_count"), F.col("outgoing").alias("downstream_count"), "total_connections")
    return out.orderBy(F.desc("total_connections"))


@view
def statements_with_issues(t: Tables) -> DataFrame:
    count = lambda kind: F.count_if(F.col("severity") == kind).alias(f"{kind}_count")
    i = t["issues"].groupBy("project_id", "statement_id").agg(count("error"), count("warning"), count("info"))
    return _with_statement(i, t).select("project_id", "s.source_name", "s.statement_index", "s.statement_type", "s.complexity_score", "error_count", "warning_count", "info_count")


@view
def data_flow_paths(t: Tables) -> DataFrame:
    e = _with_statement(_ends(t).where(F.col("edge_type").isin(*FLOWS)), t)
    return e.select(
        "project_id", "s.source_name", "s.statement_index", F.col("f.qualified_name").alias("source_table"), F.col("f.label").alias("source_column"), F.col("expression").alias("transformation"), "operation",
        F.col("t.qualified_name").alias("target_table"), F.col("t.label").alias("target_column"), F.when(F.col("is_approximate"), "APPROXIMATE").otherwise("EXACT").alias("lineage_confidence"),
    )


@view
def columns_by_source_table(t: Tables) -> DataFrame:
    d = _named_closure(t, "from_node_id", "to_node_id", "descendant", paths=False)
    return d.select("project_id", F.col("column_table").alias("source_table"), F.col("column_name").alias("source_column"), F.col("descendant_table").alias("affected_table"), F.col("descendant_column").alias("affected_column"), F.col("depth").alias("distance")).distinct()


@view
def transformation_audit(t: Tables) -> DataFrame:
    a = t["aggregations"].select("project_id", "statement_id", F.col("node_id").alias("t_id"), F.col("function").alias("aggregation_applied"))
    e = _with_statement(_ends(t).join(a, ["project_id", "statement_id", "t_id"], "left").where("expression IS NOT NULL OR aggregation_applied IS NOT NULL"), t)
    return e.select(
        "project_id", "s.source_name", "s.statement_index", F.col("f.qualified_name").alias("input_table"), F.col("f.label").alias("input_column"), F.col("expression").alias("transformation_expression"),
        F.col("operation").alias("transformation_type"), F.col("t.qualified_name").alias("output_table"), F.col("t.label").alias("output_column"), "aggregation_applied",
    )


@view
def cross_statement_flow(t: Tables) -> DataFrame:
    """Relations that one statement writes and a later one reads: the last writer before each reader.

    An edge never spans statements in these tables, so a join of edges with both ends' statements would always be empty.
    A relation's statements are put in order once and the last writer runs along; no pair of a writer and a reader is built.
    """
    key = ["project_id", "statement_id", "id"]
    relations = t["nodes"].where(F.col("node_type").isin("table", "view")).dropna(subset=key).select(*key, "qualified_name").distinct()
    target = t["edges"].where(F.col("edge_type") == "data_flow").select("project_id", "statement_id", F.col("to_node_id").alias("id")).distinct().withColumn("_writes", F.lit(True))
    along = W.partitionBy("project_id", "id").orderBy("statement_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.max(F.when(F.col("_writes"), F.col("statement_id"))).over(along)
    # what a statement writes it doesn't read
    seen = relations.join(target, key, "left").withColumn("writer", last).where("_writes IS NULL AND writer IS NOT NULL")
    pairs = seen.select("project_id", "qualified_name", F.col("statement_id").alias("reader"), "writer")
    s = lambda role: t["statements"].select("project_id", F.col("id").alias(role), F.col("source_name").alias(f"{role}_source"), F.col("statement_index").alias(f"{role}_statement"))
    j = pairs.join(s("writer"), ["project_id", "writer"]).join(s("reader"), ["project_id", "reader"])
    return j.select("project_id", F.col("writer_source").alias("from_source"), F.col("writer_statement").alias("from_statement"), F.col("reader_source").alias("to_source"), F.col("reader_statement").alias("to_statement"), F.col("qualified_name").alias("shared_object"), F.lit("cross_statement").alias("edge_type"))


@view
def schema_coverage(t: Tables) -> DataFrame:
    """Schema tables with the statements whose relations have the table's name as a part of theirs.

    The names of a project are few next to its statements: names are made distinct first and only those compared.
    """
    n = t["nodes"].where(F.col("node_type").isin("table", "view")).select("project_id", "qualified_name", "statement_id").distinct()
    names = n.select("project_id", "qualified_name").distinct()
    st = t["schema_tables"]
    like = F.expr("qualified_name LIKE concat('%', name, '%')")
    hit = st.select("project_id", F.col("id").alias("_id"), "name").join(names, "project_id").where(like).select("project_id", "_id", "qualified_name")
    refs = hit.join(n, ["project_id", "qualified_name"]).groupBy("project_id", F.col("_id").alias("id")).agg(F.countDistinct("statement_id").alias("n"))
    out = st.join(refs, ["project_id", "id"], "left")
    return out.select("project_id", "catalog", "schema_name", F.col("name").alias("table_name"), "resolution_source", F.col("n").isNotNull().alias("is_referenced"), F.coalesce("n", F.lit(0)).alias("reference_count"))


__all__ = ["VIEWS", "closure", "cut", "drop_cut"]
