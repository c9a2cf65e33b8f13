"""Views, traversals and extracts: over the sample graph with SQL to compare, and over a SQL project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, QUERIES, query
from tidemark.operators import graph as G
from tidemark.operators.lineage import Lineage, analyze, scripts_of
from tidemark.plans import expected, sample
from tidemark.plans.view_sql import ENDS, SAMPLE
from tidemark.plans.views import VIEWS

def _register(name: str, view) -> None:
    def run(spark, sf):
        return view(sample.graph(spark, sf))

    QUERIES[f"view_{name}"] = run
    ORACLES[f"view_{name}"] = sample.oracle(SAMPLE[name], ", p AS" in SAMPLE[name])


for _name, _view in VIEWS.items():
    _register(_name, _view)


def _starts(t):
    return t["nodes"].where("id IN ('c77', 'c130')").select("project_id", "id")


def _walk(a: str, b: str, seed: str) -> str:
    return f"{seed} AS (SELECT id, 0 AS depth FROM nodes WHERE id IN ('c77', 'c130') UNION SELECT e.{b}, w.depth + 1 FROM {seed} w JOIN edges e ON e.{a} = w.id WHERE w.depth < 30)"


@query(sample.oracle(f", {_walk('from_node_id', 'to_node_id', 'w')} SELECT 'main' AS project_id, id, min(depth) AS depth FROM w GROUP BY id", True))
def graph_downstream(spark, sf):
    t = sample.graph(spark, sf)
    loops = t["edges"].where("from_node_id <> to_node_id")
    return G.reach(loops, _starts(t), True)


@query(sample.oracle(f", {_walk('to_node_id', 'from_node_id', 'w')} SELECT 'main' AS project_id, id, min(depth) AS depth FROM w GROUP BY id", True))
def graph_upstream(spark, sf):
    t = sample.graph(spark, sf)
    return G.reach(t["edges"], _starts(t), False)


@query(sample.oracle(f", {_walk('to_node_id', 'from_node_id', 'u')}, {_walk('from_node_id', 'to_node_id', 'd')} SELECT 'main' AS project_id, id FROM u UNION SELECT 'main', id FROM d", True))
def graph_connected(spark, sf):
    t = sample.graph(spark, sf)
    return G.connected(t["edges"], _starts(t))


@query(sample.oracle(""", h AS (SELECT id FROM nodes WHERE contains(lower(label), 'brand#1')) SELECT 'main' AS project_id, id FROM h UNION SELECT 'main', to_node_id FROM edges WHERE edge_type = 'ownership' AND from_node_id IN (SELECT id FROM h)"""))
def graph_search(spark, sf):
    t = sample.graph(spark, sf)
    return G.search(t["nodes"], t["edges"], "BRAND#1", columns=True)


@query(sample.oracle(""", k AS (SELECT DISTINCT id FROM nodes WHERE node_type <> 'column' OR label LIKE '%ring%') SELECT e.* FROM edges e WHERE from_node_id IN (SELECT id FROM k) AND to_node_id IN (SELECT id FROM k)"""))
def graph_prune(spark, sf):
    t = sample.graph(spark, sf)
    kept = t["nodes"].where("node_type <> 'column' OR label LIKE '%ring%'")
    return G.prune_dangling(kept, t["edges"])


@query(sample.oracle(""", k AS (SELECT * FROM nodes WHERE NOT (node_type = 'column' AND len(string_split(qualified_name, '.')) >= 3)) SELECT project_id, id, statement_id, node_type, label FROM k"""))
def graph_namespace(spark, sf):
    t = sample.graph(spark, sf)
    return G.namespace(t["nodes"], t["edges"], ["public"])[0].select("project_id", "id", "statement_id", "node_type", "label")


@query(sample.oracle(f""", p AS (SELECT DISTINCT f.qualified_name AS a, t.qualified_name AS b FROM {ENDS} WHERE edge_type = 'data_flow' AND f.node_type <> 'column' AND t.node_type <> 'column' AND f.qualified_name <> t.qualified_name),
  i AS (SELECT a AS item FROM p UNION SELECT b FROM p)
  SELECT 'main' AS project_id, r.item AS row, c.item AS column, CASE WHEN r.item = c.item THEN '-' WHEN EXISTS (SELECT 1 FROM p WHERE a = r.item AND b = c.item) THEN 'w' WHEN EXISTS (SELECT 1 FROM p WHERE b = r.item AND a = c.item) THEN 'r' ELSE '' END AS cell FROM i r, i c"""))
def graph_dependency_matrix(spark, sf):
    return G.dependency_matrix(VIEWS["table_dependencies"](sample.graph(spark, sf)), "source_table", "target_table")


@query(sample.oracle(f""", p AS (SELECT DISTINCT f.qualified_name AS a, t.qualified_name AS b FROM {ENDS} WHERE edge_type = 'data_flow' AND f.node_type <> 'column' AND t.node_type <> 'column' AND f.qualified_name <> t.qualified_name)
  SELECT 'main' AS project_id, item, count(*) AS degree FROM (SELECT a AS item, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY item ORDER BY degree DESC, item LIMIT 5"""))
def graph_top_by_degree(spark, sf):
    return G.top_by_degree(VIEWS["table_dependencies"](sample.graph(spark, sf)), "source_table", "target_table", 5)


@query(sample.oracle(""", r AS (SELECT n.*, source_name, EXISTS (SELECT 1 FROM edges e WHERE e.statement_id = n.statement_id AND e.to_node_id = n.id AND edge_type = 'data_flow') AS i,
    EXISTS (SELECT 1 FROM edges e WHERE e.statement_id = n.statement_id AND e.from_node_id = n.id AND edge_type IN ('data_flow', 'join_dependency')) AS o
    FROM nodes n JOIN statements s ON s.id = n.statement_id WHERE node_type IN ('table', 'view')),
  x AS (SELECT source_name, qualified_name, bool_or(i) AS w, bool_or(o OR NOT i) AS rd FROM r GROUP BY ALL)
  SELECT 'main' AS project_id, a.source_name AS producer, b.source_name AS consumer, list_sort(list(DISTINCT a.qualified_name)) AS tables FROM x a JOIN x b ON a.qualified_name = b.qualified_name AND a.w AND b.rd AND a.source_name <> b.source_name GROUP BY 2, 3"""))
def graph_script_dependencies(spark, sf):
    return G.script_dependencies(sample.graph(spark, sf))


@query(sample.oracle(" SELECT DISTINCT 'main' AS project_id, to_node_id AS column_id, from_node_id AS owner_id FROM edges WHERE edge_type = 'ownership'"))
def graph_column_owner(spark, sf):
    return G.column_owner(sample.graph(spark, sf)["edges"])


def project(spark) -> Lineage:
    return analyze(scripts_of(spark, sample.SCRIPTS, "postgres", sample.SCHEMA))


@query("""SELECT * FROM (VALUES ('01_staging.sql', 0, 'CREATE_TABLE_AS', 0), ('01_staging.sql', 1, 'CREATE_VIEW', 0), ('02_model.sql', 2, 'CREATE_TABLE_AS', 1), ('03_report.sql', 3, 'INSERT', 0), ('03_report.sql', 4, 'SELECT', 0),
  ('04_clean.sql', 5, 'MERGE', 0), ('04_clean.sql', 6, 'DELETE', 0), ('04_clean.sql', 7, 'ALTER_TABLE', 0), ('04_clean.sql', 8, 'DROP', 0), ('04_clean.sql', 9, 'UNKNOWN', 0)) v(source_name, statement_index, statement_type, join_count)""")
def lineage_statements(spark, sf):
    return project(spark).statements.select("source_name", "statement_index", "statement_type", "join_count")


@query("""SELECT * FROM (VALUES ('01_staging.sql', 'raw_orders', 'stg_orders', 'data_flow'), ('01_staging.sql', 'raw_users', 'stg_users', 'data_flow'), ('02_model.sql', 'stg_orders', 'paid', 'data_flow'),
  ('02_model.sql', 'stg_users', 'user_totals', 'data_flow'), ('02_model.sql', 'paid', 'user_totals', 'data_flow'), ('03_report.sql', 'user_totals', 'report', 'data_flow'), ('04_clean.sql', 'stg_users', 'dim_users', 'data_flow'),
  ('04_clean.sql', 'dim_users', 'report', 'data_flow'), ('04_clean.sql', 'report', 'old_report', 'data_flow')) v(source_name, source, target, edge_type)""")
def lineage_table_dependencies(spark, sf):
    t = project(spark).tables
    e = t["edges"].where("edge_type = 'data_flow'")
    on = ["project_id", "statement_id"]
    kinds = t["nodes"].where(F.col("node_type").isin("table", "view", "cte")).select("project_id", "statement_id", "id", "label")
    j = e.join(kinds.withColumnsRenamed({"id": "from_node_id", "label": "source"}), [*on, "from_node_id"]).join(kinds.withColumnsRenamed({"id": "to_node_id", "label": "target"}), [*on, "to_node_id"])
    s = t["statements"].select("project_id", F.col("id").alias("statement_id"), "source_name")
    return j.join(s, on).select("source_name", "source", "target", "edge_type").distinct()


@query("""SELECT * FROM (VALUES ('raw_orders.id', 'stg_orders.order_id', NULL), ('raw_orders.user_id', 'stg_orders.user_id', NULL), ('raw_orders.amount', 'stg_orders.cents', 'amount * 100'), ('raw_orders.status', 'stg_orders.status', NULL),
  ('raw_users.id', 'stg_users.user_id', NULL), ('raw_users.email', 'stg_users.email', 'lower(email)'), ('raw_users.region', 'stg_users.region', NULL), ('stg_orders.user_id', 'paid.user_id', NULL),
  ('stg_orders.cents', 'paid.total', 'sum(cents)'), ('stg_orders.order_id', 'paid.orders', 'count(DISTINCT order_id)'), ('stg_users.user_id', 'user_totals.user_id', NULL), ('stg_users.email', 'user_totals.email', NULL),
  ('stg_users.region', 'user_totals.region', NULL), ('paid.total', 'user_totals.total', NULL), ('paid.orders', 'user_totals.orders', NULL), ('user_totals.region', 'report.region', NULL),
  ('user_totals.total', 'report.revenue', 'sum(total)')) v(source, target, transformation)""")
def lineage_column_mappings(spark, sf):
    c = VIEWS["column_lineage"](project(spark).tables)
    return c.select(F.col("source_table").alias("source"), F.col("target_table").alias("target"), "transformation").distinct()


@query("""SELECT * FROM (VALUES ('cross_statement', 8), ('derivation', 5)) v(edge_type, n)""")
def lineage_edge_counts(spark, sf):
    e = project(spark).global_edges.where(F.col("edge_type").isin("cross_statement", "derivation"))
    return e.groupBy("edge_type").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('error', 'PARSE_ERROR', 9), ('info', 'APPROXIMATE_LINEAGE', 4)) v(severity, code, statement_index)""")
def lineage_issues(spark, sf):
    return VIEWS["issues_summary"](project(spark).tables).select("severity", "code", "statement_index")


@query("""SELECT * FROM (VALUES ('raw_orders', 'status <> ''void''', 'where'), ('raw_orders', 'amount > 0', 'where'), ('user_totals', 'sum(total) > 10', 'having'),
  ('report', 'report.region = dim_users.region', 'where'), ('dim_users', 'report.region = dim_users.region', 'where')) v(table_name, predicate, filter_type)""")
def lineage_filters(spark, sf):
    return VIEWS["node_filters"](project(spark).tables).select("table_name", "predicate", "filter_type")


@query("""SELECT * FROM (VALUES ('paid.user_id', true, NULL, false), ('paid.total', false, 'SUM', false), ('paid.orders', false, 'COUNT', true), ('report.region', true, NULL, false), ('report.revenue', false, 'SUM', false)) v(qualified_name, is_grouping_key, function, is_distinct)""")
def lineage_aggregations(spark, sf):
    t = project(spark).tables
    n = t["nodes"].select("project_id", "statement_id", F.col("id").alias("node_id"), "qualified_name")
    return t["aggregations"].join(n, ["project_id", "statement_id", "node_id"]).select("qualified_name", "is_grouping_key", "function", "is_distinct")


@query("""SELECT * FROM (VALUES ('01_staging.sql', '02_model.sql', 'stg_orders,stg_users'), ('02_model.sql', '03_report.sql', 'user_totals'), ('01_staging.sql', '04_clean.sql', 'stg_users'),
  ('03_report.sql', '04_clean.sql', 'report'), ('04_clean.sql', '03_report.sql', 'report')) v(producer, consumer, tables)""")
def lineage_script_dependencies(spark, sf):
    return G.script_dependencies(project(spark).tables).select("producer", "consumer", F.array_join("tables", ",").alias("tables"))


@query("""SELECT 10 AS statements, 1 AS joins, 9 AS tables, 1 AS errors""")
def lineage_summary(spark, sf):
    from tidemark.sources.export import summary

    return summary(project(spark).tables).select(F.col("statements").cast("int").alias("statements"), F.col("joins").cast("int").alias("joins"), F.col("tables").cast("int").alias("tables"), F.col("errors").cast("int").alias("errors"))


@query("""SELECT * FROM (VALUES ('raw_orders', 'amount', 'stg_orders', 'cents', 'derivation'), ('raw_users', 'email', 'stg_users', 'email', 'derivation'), ('stg_orders', 'cents', 'paid', 'total', 'derivation'),
  ('stg_orders', 'order_id', 'paid', 'orders', 'derivation'), ('user_totals', 'total', 'report', 'revenue', 'derivation')) v(source_table, source_column, target_table, target_column, edge_type)""")
def lineage_export_mappings(spark, sf):
    from tidemark.sources.export import column_mappings

    return column_mappings(project(spark).tables).where("edge_type = 'derivation'").drop("project_id", "expression").distinct()


@query("""SELECT * FROM (VALUES ('raw_orders', 'imported', 4), ('raw_users', 'imported', 3), ('stg_users', 'implied', 3), ('user_totals', 'implied', 5), ('dim_users', 'implied', 2), ('report', 'implied', 1)) v(name, resolution_source, columns)""")
def lineage_resolved_schema(spark, sf):
    p = project(spark)
    c = p.schema_columns.groupBy("project_id", F.col("table_id").alias("id")).agg(F.count("*").cast("int").alias("columns"))
    return p.schema_tables.join(c, ["project_id", "id"]).select("name", "resolution_source", "columns")


@query("""SELECT * FROM (VALUES (0, 'stg_orders'), (1, 'stg_users'), (2, 'user_totals')) v(statement_id, label)""")
def lineage_created_relations(spark, sf):
    t = project(spark).tables
    n = t["nodes"].select("project_id", "statement_id", "id", "label")
    return G.created_relations(t).join(n, ["project_id", "statement_id", "id"]).select("statement_id", "label")


@query(sample.oracle(""", j AS (SELECT node_id AS id, min({'a': statement_id, 'b': join_type, 'c': join_condition}) AS j FROM joins GROUP BY ALL),
  f AS (SELECT node_id AS id, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS filters FROM filters GROUP BY ALL)
  SELECT 'main' AS project_id, n.id, min(node_type) AS node_type, count(DISTINCT statement_id) AS statements, any_value(j.j.b) AS join_type, any_value(j.j.c) AS join_condition, coalesce(any_value(f.filters), '') AS filters
  FROM nodes n LEFT JOIN j ON j.id = n.id LEFT JOIN f ON f.id = n.id GROUP BY n.id"""))
def graph_merge_statements(spark, sf):
    t = sample.graph(spark, sf)
    m = G.merge_statements(t["nodes"], t["joins"], t["filters"])
    return m.select("project_id", "id", "node_type", "statements", "join_type", "join_condition", F.array_join("filters", ",").alias("filters"))


@query(sample.oracle(f""", p AS (SELECT DISTINCT f.qualified_name AS a, t.qualified_name AS b FROM {ENDS} WHERE edge_type = 'data_flow' AND f.node_type <> 'column' AND t.node_type <> 'column' AND f.qualified_name <> t.qualified_name),
  i AS (SELECT a AS item FROM p UNION SELECT b FROM p)
  SELECT 'main' AS project_id, item, (SELECT count(*) FROM p WHERE a = item) AS writes, (SELECT count(*) FROM p WHERE b = item AND NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a)) AS reads,
    (SELECT count(*) FROM p WHERE a = item) + (SELECT count(*) FROM p WHERE b = item AND NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a)) AS degree FROM i"""))
def graph_matrix_metrics(spark, sf):
    return G.matrix_metrics(G.dependency_matrix(VIEWS["table_dependencies"](sample.graph(spark, sf)), "source_table", "target_table"))


def many(spark, hide_ctes: bool = False) -> Lineage:
    rows = [(p, 0, "f.sql", sql, dialect, schema) for p, dialect, schema, sql in sample.MANY]
    return analyze(spark.createDataFrame(rows, "project_id string, ord int, name string, content string, dialect string, schema string"), hide_ctes=hide_ctes)


def _flows(t) -> DataFrame:
    key = ["project_id", "statement_id"]
    n = t["nodes"].select(*key, "id", F.coalesce("qualified_name", "label").alias("name"))
    e = t["edges"].where("edge_type <> 'ownership'")
    e = e.join(n.withColumnsRenamed({"id": "from_node_id", "name": "source"}), [*key, "from_node_id"]).join(n.withColumnsRenamed({"id": "to_node_id", "name": "target"}), [*key, "to_node_id"])
    return e.select("project_id", F.col("statement_id").alias("statement_index"), "edge_type", "source", "target", "expression", "operation", "is_approximate")


@query(expected.sql("statements"))
def lineage_many_statements(spark, sf):
    return many(spark).statements.select("project_id", "statement_index", "statement_type", "join_count", "complexity_score")


@query(expected.sql("flows"))
def lineage_many_flows(spark, sf):
    return _flows(many(spark).tables)


@query(expected.sql("hidden"))
def lineage_hidden_ctes(spark, sf):
    return _flows(many(spark, True).tables).where("project_id = 'infer' OR project_id = 'star' AND statement_index = 1")


@query(expected.sql("issues"))
def lineage_many_issues(spark, sf):
    return VIEWS["issues_summary"](many(spark).tables).select("project_id", "statement_index", "severity", "code")


@query(expected.sql("constraints"))
def lineage_many_constraints(spark, sf):
    c = many(spark).schema_constraints
    return c.select("project_id", F.col("table").alias("table_name"), "constraint_type", F.array_join("columns", ",").alias("columns"), "referenced_table", F.array_join("referenced_columns", ",").alias("referenced_columns"))


@query(expected.sql("filters"))
def lineage_many_filters(spark, sf):
    t = many(spark).tables
    n = t["nodes"].select("project_id", "statement_id", F.col("id").alias("node_id"), F.coalesce("qualified_name", "label").alias("relation"))
    return t["filters"].join(n, ["project_id", "statement_id", "node_id"]).select("project_id", F.col("statement_id").alias("statement_index"), "relation", "predicate")


@query("""SELECT * FROM (VALUES ('keys', 'INNER', 'o.u_id = u.id', 'u'), ('keys', 'INNER', 'z.o_id = o.id', 'z'), ('star', 'INNER', 'NATURAL', 'b'), ('star', 'LEFT', 'l.id = r.id', 'c')) v(project_id, join_type, join_condition, table_name)""")
def lineage_many_joins(spark, sf):
    return VIEWS["join_graph"](many(spark).tables).select("project_id", "join_type", "join_condition", "table_name")


@query("""SELECT * FROM (VALUES ('keys', 'o', 'u_id', 'u', 'id', false), ('keys', 'u', 'id', 'o', 'u_id', true), ('keys', 'z', 'o_id', 'o', 'id', true), ('keys', 'o', 'id', 'z', 'o_id', true),
  ('star', 'a', 'id', 'c', 'id', true), ('star', 'c', 'id', 'a', 'id', true)) v(project_id, table_name, column_name, referenced_table, referenced_column, implied)""")
def lineage_foreign_keys(spark, sf):
    return G.foreign_keys(many(spark).tables).select("project_id", F.col("table").alias("table_name"), F.col("column").alias("column_name"), "referenced_table", "referenced_column", "implied")


@query(sample.oracle(" SELECT DISTINCT 'main' AS project_id, label AS name FROM nodes WHERE node_type = 'column'"))
def graph_column_names(spark, sf):
    return G.column_names(sample.graph(spark, sf)["nodes"])


@query(sample.oracle(""" SELECT 'main' AS project_id, n.label, n.qualified_name, n.node_type, coalesce(string_agg(DISTINCT c.label, '; ' ORDER BY c.label), '') AS columns FROM nodes n
  LEFT JOIN edges e ON e.edge_type = 'ownership' AND e.from_node_id = n.id AND e.statement_id = n.statement_id LEFT JOIN nodes c ON c.id = e.to_node_id AND c.statement_id = e.statement_id AND c.node_type = 'column'
  WHERE n.node_type IN ('table', 'view', 'cte') GROUP BY n.label, n.qualified_name, n.node_type"""))
def graph_table_info(spark, sf):
    return G.table_info(sample.graph(spark, sf))


@query(sample.oracle(""", o AS (SELECT e.statement_id, e.to_node_id AS id, r.qualified_name AS relation, c.label FROM edges e JOIN nodes r ON r.id = e.from_node_id AND r.statement_id = e.statement_id AND r.node_type <> 'column'
    JOIN nodes c ON c.id = e.to_node_id AND c.statement_id = e.statement_id WHERE e.edge_type = 'ownership')
  SELECT 'main' AS project_id, a.relation AS source, b.relation AS target, count(DISTINCT (a.label, b.label)) AS column_count, string_agg(DISTINCT a.label || ' -> ' || b.label, '; ' ORDER BY a.label || ' -> ' || b.label) AS columns, count(DISTINCT e.expression) AS expressions
  FROM edges e JOIN o a ON a.id = e.from_node_id AND a.statement_id = e.statement_id JOIN o b ON b.id = e.to_node_id AND b.statement_id = e.statement_id
  WHERE e.edge_type IN ('data_flow', 'derivation') AND a.relation <> b.relation GROUP BY a.relation, b.relation"""))
def graph_table_dependencies_detailed(spark, sf):
    return G.table_dependencies_detailed(sample.graph(spark, sf))


_SCRIPTS = """, r AS (SELECT n.*, source_name, EXISTS (SELECT 1 FROM edges e WHERE e.statement_id = n.statement_id AND e.to_node_id = n.id AND edge_type = 'data_flow') AS i,
    EXISTS (SELECT 1 FROM edges e WHERE e.statement_id = n.statement_id AND e.from_node_id = n.id AND edge_type IN ('data_flow', 'join_dependency')) AS o
    FROM nodes n JOIN statements s ON s.id = n.statement_id WHERE node_type IN ('table', 'view')),
  x AS (SELECT source_name, qualified_name, bool_or(i) AS w, bool_or(o OR NOT i) AS rd FROM r GROUP BY ALL)"""


@query(sample.oracle(_SCRIPTS + """, p AS (SELECT DISTINCT a.source_name AS a, b.source_name AS b FROM x a JOIN x b ON a.qualified_name = b.qualified_name AND a.w AND b.rd AND a.source_name <> b.source_name), i AS (SELECT a AS item FROM p UNION SELECT b FROM p)
  SELECT 'main' AS project_id, r.item AS row, c.item AS column, CASE WHEN r.item = c.item THEN '-' WHEN EXISTS (SELECT 1 FROM p WHERE a = r.item AND b = c.item) THEN 'w' WHEN EXISTS (SELECT 1 FROM p WHERE b = r.item AND a = c.item) THEN 'r' ELSE '' END AS cell FROM i r, i c"""))
def graph_script_matrix(spark, sf):
    return G.script_matrix(sample.graph(spark, sf))


@query(sample.oracle(_SCRIPTS + " SELECT 'main' AS project_id, source_name AS source, qualified_name AS target, 'writes' AS edge_type FROM x WHERE w UNION ALL SELECT 'main', qualified_name, source_name, 'reads' FROM x WHERE rd"))
def graph_hybrid(spark, sf):
    return G.hybrid_graph(sample.graph(spark, sf))


_DRAWN = "e.edge_type <> 'ownership' AND e.from_node_id <> e.to_node_id"


@query(sample.oracle(f""" SELECT 'main' AS project_id, from_node_id AS source_id, to_node_id AS target_id, edge_type, count(DISTINCT statement_id) AS statements FROM edges e
  WHERE {_DRAWN} AND from_node_id IN (SELECT id FROM nodes WHERE node_type <> 'column') AND to_node_id IN (SELECT id FROM nodes WHERE node_type <> 'column') GROUP BY ALL"""))
def graph_flow_tables(spark, sf):
    return G.flow_edges(sample.graph(spark, sf))


@query(sample.oracle(f""" SELECT 'main' AS project_id, from_node_id AS source_id, to_node_id AS target_id, edge_type, count(DISTINCT statement_id) AS statements FROM edges e
  WHERE {_DRAWN} AND from_node_id IN (SELECT id FROM nodes) AND to_node_id IN (SELECT id FROM nodes) GROUP BY ALL"""))
def graph_flow_columns(spark, sf):
    return G.flow_edges(sample.graph(spark, sf), True)


@query(sample.oracle(""", s AS (SELECT id FROM nodes WHERE label = 'Brand#3' AND node_type <> 'column' UNION SELECT to_node_id FROM edges WHERE edge_type = 'ownership' AND from_node_id IN (SELECT id FROM nodes WHERE label = 'Brand#3' AND node_type <> 'column')),
  f AS (SELECT from_node_id AS a, to_node_id AS b FROM edges WHERE edge_type <> 'ownership' AND from_node_id <> to_node_id),
  k AS (SELECT id FROM s UNION SELECT f.b FROM k JOIN f ON f.a = k.id), o AS (SELECT id FROM k UNION SELECT from_node_id FROM edges WHERE edge_type = 'ownership' AND to_node_id IN (SELECT id FROM k))
  SELECT DISTINCT 'main' AS project_id, n.id, n.label FROM nodes n JOIN o ON o.id = n.id""", True))
def graph_filter_tables(spark, sf):
    return G.filter_tables(sample.graph(spark, sf), ["Brand#3"], "downstream")[0].select("project_id", "id", "label").distinct()


@query(sample.oracle(f""", e2 AS (SELECT DISTINCT from_node_id AS a, to_node_id AS b FROM edges e WHERE {_DRAWN})
  SELECT 'main' AS project_id, id, coalesce(string_agg(d, ',' ORDER BY d), '') AS downstream, coalesce(string_agg(u, ',' ORDER BY u), '') AS upstream FROM (SELECT a AS id, b AS d, NULL AS u FROM e2 UNION ALL SELECT b, NULL, a FROM e2) GROUP BY id"""))
def graph_neighbours(spark, sf):
    n = G.neighbours(sample.graph(spark, sf)["edges"])
    return n.select("project_id", "id", F.array_join("downstream", ",").alias("downstream"), F.array_join("upstream", ",").alias("upstream"))


@query(sample.oracle(" SELECT 'main' AS project_id, count(*) AS statements, sum(join_count)::BIGINT AS joins, max(complexity_score) AS complexity FROM statements"))
def graph_merged_statement(spark, sf):
    return G.merged_statement(sample.graph(spark, sf)["statements"])


@query(sample.oracle(""" SELECT 'main' AS project_id, least(100, greatest(1, 5 * count(DISTINCT CASE WHEN node_type IN ('table', 'view') THEN id END) + 8 * count(DISTINCT CASE WHEN node_type = 'cte' THEN id END)
  + 10 * (SELECT sum(join_count) FROM statements) + 2 * (SELECT count(*) FROM filters)))::BIGINT AS complexity FROM nodes"""))
def graph_complexity(spark, sf):
    from tidemark.sources.export import summary

    return summary(sample.graph(spark, sf)).select("project_id", "complexity")
