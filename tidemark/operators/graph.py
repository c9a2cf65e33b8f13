"""Traversal, filters and matrices over node and edge tables (project_id, id / from_node_id, to_node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import cut, drop_cut


#: Levels that a traversal reads one by one before they are written together.
LEVELS = 24


def reach(edges: DataFrame, starts: DataFrame, downstream: bool = True, max_depth: int | None = None) -> DataFrame:
    """(project_id, id, depth): nodes that the starts (project_id, id) reach, at their least depth; starts have depth 0.

    Breadth first: each frontier meets the edges in one equi-join and loses what is known already in an anti-join, so
    cycles end. Only the frontier is written to the shared folder each step; every LEVELS steps the levels are put
    together, so that neither the plan nor the work grows with the depth.
    """
    a, b = ("from_node_id", "to_node_id") if downstream else ("to_node_id", "from_node_id")
    step = cut(edges.select("project_id", F.col(a).alias("id"), F.col(b).alias("_next")).distinct())
    frontier = cut(starts.select("project_id", "id").distinct().withColumn("depth", F.lit(0)))
    levels, depth = [frontier], 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        if len(levels) > LEVELS:
            old, levels = levels, [cut(_together(levels))]
            drop_cut(*old[:-1])  # the last one is the frontier
        found = frontier.join(step, ["project_id", "id"]).select("project_id", F.col("_next").alias("id")).distinct()
        frontier = cut(found.join(_together(levels), ["project_id", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        levels.append(frontier)
    drop_cut(step)
    return _together(levels)


def _together(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def connected(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(project_id, id): upstream and downstream of the starts together; not the undirected component."""
    return reach(edges, starts, True).union(reach(edges, starts, False)).select("project_id", "id").distinct()


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are there."""
    ids = nodes.select("project_id", "id").distinct()
    for end in ("from_node_id", "to_node_id"):
        there = ids.withColumnRenamed("id", end)
        edges = edges.join(there, ["project_id", end], "left_semi")
    return edges


def restrict(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the kept nodes (project_id, id)."""
    n = nodes.join(keep.select("project_id", "id").distinct(), ["project_id", "id"], "left_semi")
    return n, prune_dangling(n, edges)


def search(nodes: DataFrame, edges: DataFrame, term: str, columns: bool = False) -> DataFrame:
    """(project_id, id) of nodes whose label holds term, without regard to case. With columns, a relation that matches brings all of its own."""
    hits = nodes.where(F.lower("label").contains(term.lower())).select("project_id", "id")
    if not columns:
        return hits.distinct()
    owned = edges.where("edge_type = 'ownership'").join(hits.withColumnRenamed("id", "from_node_id"), ["project_id", "from_node_id"], "left_semi")
    return hits.union(owned.select("project_id", F.col("to_node_id").alias("id"))).distinct()


def namespace(nodes: DataFrame, edges: DataFrame, schemas: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph of nodes whose qualified name stands under one of the schemas, and of those without a schema."""
    parts = F.split(F.coalesce("qualified_name", "label"), r"\.")
    depth = F.when(F.col("node_type") == "column", F.size(parts) - 1).otherwise(F.size(parts))
    schema = F.when(depth >= 2, F.element_at(parts, (depth - 1).cast("int")))
    kept = nodes.where(schema.isNull() | schema.isin(*schemas))
    return kept, prune_dangling(kept, edges)


def column_owner(edges: DataFrame) -> DataFrame:
    """(project_id, column_id, owner_id)."""
    return edges.where("edge_type = 'ownership'").select("project_id", F.col("to_node_id").alias("column_id"), F.col("from_node_id").alias("owner_id")).distinct()


def script_tables(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, source_name, table_name, writes, reads): a script writes what data flows into, and reads the rest that it names."""
    relations = t["nodes"].where(F.col("node_type").isin("table", "view"))
    into = t["edges"].where(F.col("edge_type") == "data_flow").select("project_id", "statement_id", F.col("to_node_id").alias("id"), F.lit(True).alias("in")).distinct()
    out = t["edges"].where(F.col("edge_type").isin("data_flow", "join_dependency")).select("project_id", "statement_id", F.col("from_node_id").alias("id"), F.lit(True).alias("out")).distinct()
    key = ["project_id", "statement_id", "id"]
    s = t["statements"].select("project_id", F.col("id").alias("statement_id"), "source_name")
    n = relations.join(into, key, "left").join(out, key, "left").join(s, ["project_id", "statement_id"])
    writes = F.col("in").isNotNull()
    return n.groupBy("project_id", "source_name", F.coalesce("qualified_name", "label").alias("table_name")).agg(
        F.bool_or(writes).alias("writes"), F.bool_or(F.col("out").isNotNull() | ~writes).alias("reads")
    )


def script_dependencies(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, producer, consumer, tables): scripts of which one writes what the other reads."""
    s = script_tables(t)
    w = s.where("writes").select("project_id", "table_name", F.col("source_name").alias("producer"))
    r = s.where("reads").select("project_id", "table_name", F.col("source_name").alias("consumer"))
    pairs = w.join(r, ["project_id", "table_name"]).where("producer <> consumer")
    return pairs.groupBy("project_id", "producer", "consumer").agg(F.sort_array(F.collect_set("table_name")).alias("tables"))


def dependency_matrix(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """(project_id, row, column, cell) of every pair of items: - on the diagonal, w where row writes to column, r where it reads from it.

    pairs: project_id and two names, data going from source to target. Writing goes before reading. A project's grid
    has as many cells as it has items squared, which is what a matrix is; items are joined within their project only.
    """
    p = pairs.select("project_id", F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b").distinct()
    items = p.select("project_id", F.col("a").alias("item")).union(p.select("project_id", "b")).distinct()
    grid = items.withColumnRenamed("item", "row").join(items.withColumnRenamed("item", "column"), "project_id")
    w = p.select("project_id", F.col("a").alias("row"), F.col("b").alias("column"), F.lit(True).alias("w"))
    r = p.select("project_id", F.col("b").alias("row"), F.col("a").alias("column"), F.lit(True).alias("r"))
    j = grid.join(w, ["project_id", "row", "column"], "left").join(r, ["project_id", "row", "column"], "left")
    cell = F.when(F.col("row") == F.col("column"), "-").when(F.col("w"), "w").when(F.col("r"), "r").otherwise("")
    return j.select("project_id", "row", "column", cell.alias("cell"))


def top_by_degree(pairs: DataFrame, source: str, target: str, n: int) -> DataFrame:
    """(project_id, item, degree): the n items of each project with most partners, by degree and then name."""
    from pyspark.sql import Window as W

    p = pairs.select("project_id", F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b").distinct()
    both = p.select("project_id", F.col("a").alias("item"), "b").union(p.select("project_id", "b", "a"))
    d = both.groupBy("project_id", "item").agg(F.count("*").alias("degree"))
    return d.withColumn("_r", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("degree"), "item"))).where(F.col("_r") <= n).drop("_r")


def merge_statements(nodes: DataFrame, joins: DataFrame, filters: DataFrame) -> DataFrame:
    """One row for each node of a project over all its statements: type, label, first known join, and all filters."""
    n = nodes.groupBy("project_id", "id").agg(
        F.first("node_type", True).alias("node_type"), F.first("label", True).alias("label"), F.first("qualified_name", True).alias("qualified_name"), F.countDistinct("statement_id").alias("statements")
    )
    j = joins.groupBy("project_id", F.col("node_id").alias("id")).agg(F.min(F.struct("statement_id", "join_type", "join_condition")).alias("j"))
    f = filters.groupBy("project_id", F.col("node_id").alias("id")).agg(F.sort_array(F.collect_set("predicate")).alias("filters"))
    out = n.join(j, ["project_id", "id"], "left").join(f, ["project_id", "id"], "left")
    return out.select("project_id", "id", "node_type", "label", "qualified_name", "statements", "j.join_type", "j.join_condition", F.coalesce("filters", F.array().cast("array<string>")).alias("filters"))


def merged_statement(statements: DataFrame) -> DataFrame:
    """(project_id, statements, joins, complexity): a project's statements as one, joins summed, complexity that of the worst."""
    return statements.groupBy("project_id").agg(F.count("*").alias("statements"), F.sum("join_count").alias("joins"), F.max("complexity_score").alias("complexity"))


def matrix_metrics(cells: DataFrame) -> DataFrame:
    """(project_id, item, writes, reads, degree) of a dependency matrix's rows."""
    out = cells.groupBy("project_id", F.col("row").alias("item")).agg(F.count_if(F.col("cell") == "w").alias("writes"), F.count_if(F.col("cell") == "r").alias("reads"))
    return out.withColumn("degree", F.col("writes") + F.col("reads"))


def column_names(nodes: DataFrame) -> DataFrame:
    """(project_id, name): the different names of columns."""
    return nodes.where("node_type = 'column'").select("project_id", F.col("label").alias("name")).distinct()


def table_info(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, label, qualified_name, node_type, columns): relations with the names of all columns that some statement gives them, in order."""
    key = ["project_id", "statement_id"]
    own = t["edges"].where("edge_type = 'ownership'").select(*key, F.col("from_node_id").alias("id"), F.col("to_node_id").alias("column_id"))
    names = t["nodes"].where("node_type = 'column'").select(*key, F.col("id").alias("column_id"), F.col("label").alias("column"))
    r = t["nodes"].where(F.col("node_type").isin("table", "view", "cte")).select(*key, "id", "label", "qualified_name", "node_type")
    j = r.join(own.join(names, [*key, "column_id"]), [*key, "id"], "left")
    return j.groupBy("project_id", "label", "qualified_name", "node_type").agg(F.array_join(F.sort_array(F.collect_set("column")), "; ").alias("columns"))


def table_dependencies_detailed(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, source, target, column_count, columns, expressions): pairs of relations between which columns flow, and which."""
    key = ["project_id", "statement_id"]
    own = t["edges"].where("edge_type = 'ownership'").select(*key, F.col("to_node_id").alias("column_id"), F.col("from_node_id").alias("id"))
    r = t["nodes"].where(F.col("node_type").isin("table", "view", "cte")).select(*key, "id", F.coalesce("qualified_name", "label").alias("relation"))
    owned = own.join(r, [*key, "id"]).select(*key, "column_id", "relation")
    names = t["nodes"].where("node_type = 'column'").select(*key, F.col("id").alias("column_id"), "label")
    side = lambda end, relation, label: owned.join(names, [*key, "column_id"]).select(*key, F.col("column_id").alias(end), F.col("relation").alias(relation), F.col("label").alias(label))
    e = t["edges"].where(F.col("edge_type").isin("data_flow", "derivation")).select(*key, "from_node_id", "to_node_id", "expression")
    j = e.join(side("from_node_id", "source", "a"), [*key, "from_node_id"]).join(side("to_node_id", "target", "b"), [*key, "to_node_id"]).where("source <> target")
    pair = F.concat(F.col("a"), F.lit(" -> "), F.col("b"))
    return j.groupBy("project_id", "source", "target").agg(F.countDistinct("a", "b").alias("column_count"), F.array_join(F.sort_array(F.collect_set(pair)), "; ").alias("columns"), F.countDistinct("expression").alias("expressions"))


def script_matrix(t: dict[str, DataFrame]) -> DataFrame:
    """The dependency matrix of scripts."""
    return dependency_matrix(script_dependencies(t), "producer", "consumer")


def hybrid_graph(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, source, target, edge_type): scripts to the tables that they write, and tables to the scripts that read them."""
    s = script_tables(t)
    w = s.where("writes").select("project_id", F.col("source_name").alias("source"), F.col("table_name").alias("target"), F.lit("writes").alias("edge_type"))
    return w.union(s.where("reads").select("project_id", "table_name", "source_name", F.lit("reads")))


def flow_edges(t: dict[str, DataFrame], columns: bool = False) -> DataFrame:
    """(project_id, source_id, target_id, edge_type, statements): the edges to draw, each once over all statements.

    Between relations, or with columns between columns too; ownership isn't drawn.
    """
    kinds = ("table", "view", "cte", "output", "column") if columns else ("table", "view", "cte", "output")
    n = t["nodes"].where(F.col("node_type").isin(*kinds)).select("project_id", "id").distinct()
    e = t["edges"].where("edge_type <> 'ownership' AND from_node_id <> to_node_id")
    for end in ("from_node_id", "to_node_id"):
        e = e.join(n.withColumnRenamed("id", end), ["project_id", end], "left_semi")
    return e.groupBy("project_id", F.col("from_node_id").alias("source_id"), F.col("to_node_id").alias("target_id"), "edge_type").agg(F.countDistinct("statement_id").alias("statements"))


def filter_tables(t: dict[str, DataFrame], labels: list[str], direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that the tables of some labels, with their columns, reach downstream, upstream or both; none, if no label is there."""
    hit = t["nodes"].where(F.col("node_type").isin("table", "view", "cte") & F.col("label").isin(*labels)).select("project_id", "id").distinct()
    own = column_owner(t["edges"]).withColumnRenamed("owner_id", "id")
    starts = hit.union(own.join(hit, ["project_id", "id"], "left_semi").select("project_id", F.col("column_id").alias("id")))
    flows = t["edges"].where("edge_type <> 'ownership' AND from_node_id <> to_node_id")
    found = [reach(flows, starts, down).select("project_id", "id") for down in (True, False) if direction == "both" or direction == ("downstream" if down else "upstream")]
    keep = found[0] if len(found) == 1 else found[0].union(found[1])
    owners = own.join(keep.withColumnRenamed("id", "column_id"), ["project_id", "column_id"], "left_semi").select("project_id", "id")
    return restrict(t["nodes"], t["edges"], keep.union(owners))


def neighbours(edges: DataFrame) -> DataFrame:
    """(project_id, id, downstream, upstream): for each node the nodes next to it, in order."""
    e = edges.where("edge_type <> 'ownership' AND from_node_id <> to_node_id").select("project_id", "from_node_id", "to_node_id").distinct()
    both = e.select("project_id", F.col("from_node_id").alias("id"), F.col("to_node_id").alias("down"), F.lit(None).cast("string").alias("up"))
    both = both.union(e.select("project_id", "to_node_id", F.lit(None).cast("string"), "from_node_id"))
    return both.groupBy("project_id", "id").agg(F.sort_array(F.collect_list("down")).alias("downstream"), F.sort_array(F.collect_list("up")).alias("upstream"))


def analysis_key(scripts: DataFrame) -> DataFrame:
    """(project_id, key): a digest of a project's scripts, dialect and schema, under which a result may be kept."""
    part = F.sha2(F.concat_ws("\x1f", F.col("ord").cast("string"), "name", "content", "dialect", "schema"), 256)
    return scripts.groupBy("project_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(part)), ""), 256).alias("key"))


def created_relations(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, statement_id, id): what a CREATE statement makes; the relation that its data flows into, or else its only one."""
    made = t["statements"].where(F.col("statement_type").startswith("CREATE_")).select("project_id", F.col("id").alias("statement_id"))
    n = t["nodes"].where(F.col("node_type").isin("table", "view")).join(made, ["project_id", "statement_id"]).select("project_id", "statement_id", "id")
    into = t["edges"].where("edge_type = 'data_flow'").select("project_id", "statement_id", F.col("to_node_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    j = n.join(into, ["project_id", "statement_id", "id"], "left")
    per = j.groupBy("project_id", "statement_id").agg(F.count("*").alias("_n"), F.count("_in").alias("_into"))
    return j.join(per, ["project_id", "statement_id"]).where("_in OR _into = 0 AND _n = 1").select("project_id", "statement_id", "id")


def foreign_keys(t: dict[str, DataFrame]) -> DataFrame:
    """(project_id, table, column, referenced_table, referenced_column): declared keys, and those that joins imply, once each."""
    c = t["schema_constraints"].where(F.col("constraint_type").isin("FOREIGN_KEY", "IMPLIED_FOREIGN_KEY"))
    pair = F.explode(F.arrays_zip("columns", "referenced_columns"))
    return c.select("project_id", "table", "referenced_table", (F.col("constraint_type") == "IMPLIED_FOREIGN_KEY").alias("implied"), pair.alias("p")).groupBy(
        "project_id", "table", F.col("p.columns").alias("column"), "referenced_table", F.col("p.referenced_columns").alias("referenced_column")
    ).agg(F.min("implied").alias("implied"))
