import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.functions.catalog import ABSENT, spark_sql
from tidemark.operators import graph as G
from tidemark.plans import sample
from tidemark.sources import export, scripts

SF = "/root/testdata/sf0.001"
CHECKED = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    import os

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expect = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(expect.columns)
    text = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(tuple(r) for r in got.select(*columns).collect()) == text(expect.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def shop(spark):
    from tidemark.operators.lineage import analyze

    return analyze(scripts.scripts_of(spark, sample.SCRIPTS, "postgres", sample.SCHEMA)).tables


def test_exports(spark, shop, tmp_path):
    text = export.mermaid(shop, "shop")
    assert text.startswith("flowchart LR") and 'raw_orders["raw_orders"] --> stg_orders["stg_orders"]' in text
    assert "writes" in export.mermaid(shop, "shop", "all") and "<h2>summary</h2>" in export.report(shop, "shop")
    script = export.sql_script(shop, "shop", "lin")
    c = duckdb.connect()
    c.execute(script)
    assert c.sql("select count(*) from lin.statements").fetchall()[0][0] == 10
    with pytest.raises(ValueError):
        export.sql_script(shop, "shop", "select")
    export.write_csv(shop, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).first()["errors"] == "1"
    import io
    import zipfile

    assert len(zipfile.ZipFile(io.BytesIO(export.csv_zip(shop, "shop"))).namelist()) == 7
    export.write_xlsx(shop, "shop", str(tmp_path / "x.xlsx"))
    sheet = zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet8.xml").decode()
    assert "raw_orders" in sheet and ">w<" in sheet
    export.duckdb_file(shop, "shop", str(tmp_path / "x.duckdb"))
    assert duckdb.connect(str(tmp_path / "x.duckdb")).sql("select count(*) from edges").fetchall()[0][0] > 20
    assert export.file_name("my shop!", "2024-01-01T10:00", "csv") == "my-shop-2024-01-01T10-00.csv"


def test_folder_models_and_schemas(spark, tmp_path):
    from tidemark.operators.lineage import analyze

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.sql").write_text("-- a model\nselect a.x from {{ ref('up') }} a;\n")
    t = analyze(scripts.models(scripts.folder(spark, str(tmp_path)))).tables
    assert [r.statement_type for r in t["statements"].collect()] == ["CREATE_TABLE_AS"]
    assert {r.qualified_name for r in t["nodes"].where("node_type = 'table'").collect()} == {"m", "up"}
    made = scripts.schema_from_ddl(spark, "create table s.t (a int, b text)")
    assert '"s.t"' in made and '"dataType": "text"' in made


def test_traversal_ends_on_cycles(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("q", "a", "z")], "project_id string, from_node_id string, to_node_id string")
    starts = spark.createDataFrame([("p", "a")], "project_id string, id string")
    assert {(r.id, r.depth) for r in G.reach(edges, starts).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.id, r.depth) for r in G.reach(edges, starts, False, 1).collect()} == {("a", 0), ("c", 1)}


def test_function_names(spark):
    assert spark_sql("ARG_MAX", "a", "b") == "max_by(a, b)" and spark_sql("upper", "x") == "upper(x)"
    with pytest.raises(ValueError):
        spark_sql(next(iter(ABSENT)), "x")
    with pytest.raises(ValueError):
        spark_sql("no_such_function", "x")
    assert spark_sql("array_concat", "a", "b", "c") == "concat(a, b, c)" and spark_sql("generate_series", "1", "9", "2") == "sequence(1, 9, 2)"
    for name, args in (("str_position", "abc"), ("str_position", "a"), ("generate_series", "abcd"), ("json_extract", "abc"), ("standard_hash", "abc")):
        with pytest.raises(ValueError):
            spark_sql(name, *args)


def test_watch_folder(spark, tmp_path):
    from tidemark.operators.lineage import SCRIPT_BYTES
    from tidemark.streaming.watch import current, watch_scripts

    run = lambda: watch_scripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "in" / "p").mkdir(parents=True)
    (tmp_path / "in" / "p" / "a.sql").write_text("create table t as select x from s")
    for _ in range(2):
        run()
    assert current(spark, str(tmp_path / "out")).statements.count() == 1
    # a project that a later batch touches is analyzed over all its files, once
    (tmp_path / "in" / "p" / "b.sql").write_text("select x from t")
    (tmp_path / "in" / "q").mkdir()
    (tmp_path / "in" / "q" / "big.sql").write_text("select 1 -- " + "x" * SCRIPT_BYTES)
    run()
    now = current(spark, str(tmp_path / "out"))
    assert sorted(r.statement_type for r in now.statements.collect()) == ["CREATE_TABLE_AS", "SELECT"]
    assert now.global_edges.where("edge_type = 'cross_statement'").count() == 1
    assert [(r.project_id, r.code) for r in now.issues.collect()] == [("q", "PAYLOAD_SIZE")]


def test_closures_end_on_cycles_and_count_diamonds_once(spark):
    from tidemark.plans.views import closure

    rows = [("p", "data_flow", f"{k}{a}", f"{k + 1}{b}", "e") for k in range(12) for a in "xy" for b in "xy"] + [("c", "data_flow", "a", "b", None), ("c", "data_flow", "b", "a", None)]
    edges = spark.createDataFrame(rows, "project_id string, edge_type string, from_node_id string, to_node_id string, expression string")
    diamonds = closure(edges.where("project_id = 'p'"), "from_node_id", "to_node_id", paths=False)
    assert diamonds.where("start = '0x' and end = '12y'").count() == 1 and diamonds.count() == sum(4 * (13 - d) for d in range(1, 13))
    loop = closure(edges.where("project_id = 'c'"), "from_node_id", "to_node_id", depth=9, paths=False)
    assert loop.count() == 18 and closure(edges.where("project_id = 'c'"), "from_node_id", "to_node_id", depth=5).count() == 10


def test_as_of_join_without_keys_or_times(spark):
    from tidemark.operators.relational import as_of_join

    left = spark.createDataFrame([(1, 5), (None, 5), (1, None), (2, 5), (1, 0)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (None, 1, "null key"), (1, None, "null time"), (2, 9, "late"), (1, 5, "b"), (1, 5, "c")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in as_of_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {(1, 5): "c", (None, 5): None, (1, None): None, (2, 5): None, (1, 0): None}


def test_sqlite_schema(tmp_path):
    import json
    import sqlite3

    with sqlite3.connect(tmp_path / "a.db") as c:
        c.execute("create table u (id integer primary key, mail text)")
        c.execute("create table o (id integer primary key, u_id integer references u(id))")
    made = {t["name"]: t["columns"] for t in json.loads(scripts.schema_from_sqlite(str(tmp_path / "a.db")))["tables"]}
    assert [c["name"] for c in made["u"]] == ["id", "mail"] and made["u"][0]["isPrimaryKey"] and made["o"][1]["foreignKey"] == {"table": "u", "column": "id"}


def test_rules_and_custom_functions(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import catalog, custom

    assert catalog.spark_sql("timestamp_add", "t", "3", "HOUR") == "timestampadd(HOUR, 3, t)" and catalog.spark_sql("timestamp_add", "t", "INTERVAL 3 HOURS") == "(t + INTERVAL 3 HOURS)"
    assert catalog.spark_sql("greatest_ignore_nulls", "a", "b") == "greatest(a, b)" and catalog.spark_sql("lax_int64", "x") == "try_cast(x AS bigint)"
    row = spark.sql("""SELECT '{"a": {"b": [1, null]}, "c": null}' AS j, 'abc' AS t, array('x', 'y') AS w, 48.85 AS la, 2.35 AS lo, '10.0.0.1' AS ip""")
    got = row.select(
        custom.call("json_set", F.col("j"), F.lit("$.a.d"), F.lit("5")).alias("s"), custom.call("json_remove", F.col("j"), F.lit("$.a")).alias("r"), custom.call("json_strip_nulls", F.col("j")).alias("n"),
        custom.call("json_keys_at_depth", F.col("j"), F.lit(2)).alias("k"), custom.call("from_base32", custom.call("to_base32", F.col("t").cast("binary"))).cast("string").alias("b"), custom.call("normalize", F.lit("é"), F.lit("NFC")).alias("u"),
        custom.call("decompress_string", custom.call("compress", F.col("t").cast("binary"))).alias("z"), custom.call("parse_ip", F.col("ip")).alias("ip"), custom.call("code_points_to_string", custom.call("to_code_points", F.col("t"))).alias("cp"),
        custom.haversine(F.col("la"), F.col("lo"), F.lit(51.5), F.lit(-0.12)).alias("d"), custom.similarity(custom.minhash(F.col("w")), custom.minhash(F.reverse("w"))).alias("sim"), F.expr(catalog.spark_sql("json_extract_scalar", "j", "'$.a.b[0]'")).alias("e"),
        F.expr(catalog.spark_sql("sech", "0")).alias("h"), F.expr(catalog.spark_sql("is_ascii", "t")).alias("asc"),
    ).first()
    assert '"d": 5' in got.s and got.r == '{"c": null}' and got.n == '{"a": {"b": [1, null]}}' and got.k == ["a", "a.b", "c"] and got.b == got.z == got.cp == "abc"
    assert got.u == "é" and got.ip == "10.0.0.1" and 340_000 < got.d < 347_000 and got.sim == 1 and got.e == "1" and got.h == 1 and got.asc
    frame = catalog.coverage(spark, ["upper", "arg_max", "coth", "json_set", "ai_agg", "sum"])
    assert {r.name: r.spark is not None for r in frame.collect()} == {"upper": True, "arg_max": True, "coth": True, "json_set": True, "ai_agg": False, "sum": True}


def test_aggregates_that_keep_values_hold_a_part_of_a_group_at_once(spark, tmp_path, monkeypatch):
    from tidemark.functions import queries

    monkeypatch.setattr(queries, "PART", 3)
    rows = [(i, i % 7 if i % 5 else None, float(i % 50 + 1), 0.01 * (i % 8), ("A", "B", None)[i % 3]) for i in range(100)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.fn_aggregate_names(spark, str(tmp_path))
    holds = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list(l_linenumber" in x]
    assert holds and all("part#" in x for x in holds)
    for r in out.collect():
        lines = [n for _, n, _, _, flag in rows if flag == r.l_returnflag]
        there = [n for n in lines if n is not None]
        assert (r.n, r.ag, r.cc, r.gc, r.ja) == (len(lines), len(there), 2 * len(lines), len(there), len(there))
        assert r.ua == r.un == ",".join(map(str, sorted(set(there))))


def test_running_totals_over_frames_in_any_order(spark, tmp_path):
    from tidemark.streaming import queries

    day = [(7, 1704067200000000 + (i * 7919) % 20000 * 1000003) for i in range(20000)] + [(8, 1704067200123457), (8, 1704153600123456), (8, None), (9, None), (None, 1704067200000001), (None, 1704067200000004)]
    events = spark.createDataFrame(day, "user_id long, us long").selectExpr("user_id", "timestamp_micros(us) AS ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.user_id: (r.events, r.longest_gap) for r in queries.stream_stateful(spark, str(tmp_path)).collect()}
    assert found == {7: (20000, 1.000003), 8: (3, 86399.999999), 9: (1, 0.0), None: (2, 0.000003)}


def test_cross_statement_flow_builds_no_pairs_of_writers_and_readers(spark):
    from tidemark.plans.views import cross_statement_flow

    n = 400  # statements 0, 1, 4, 5, ... write a table that the others read
    nodes = [("p", "t", i, "table", "t") for i in range(n)] + [("p", "t", 2, "view", "v"), ("p", "t", None, "table", "t"), ("p", None, 9, "table", "t"), ("q", "t", 3, "table", "t")]
    edges = [("p", "data_flow", i, "s", "t") for i in range(n) if i % 4 < 2] + [("p", "ownership", 3, "s", "t")]
    t = {
        "nodes": spark.createDataFrame(nodes, "project_id string, id string, statement_id int, node_type string, qualified_name string"),
        "edges": spark.createDataFrame(edges, "project_id string, edge_type string, statement_id int, from_node_id string, to_node_id string"),
        "statements": spark.createDataFrame([("p", i, i, f"f{i}") for i in range(n)], "project_id string, id int, statement_index int, source_name string"),
    }
    out = cross_statement_flow(t)
    assert not any(" > " in x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    found = sorted((r.from_statement, r.to_statement, r.shared_object) for r in out.collect())
    assert found == sorted([(i - i % 4 + 1, i, "t") for i in range(n) if i % 4 > 1] + [(1, 2, "v")])


def test_user_aggregate_never_holds_a_group(spark):
    from tidemark.functions import custom

    rows = [("a", 1, 2.0)] * 15000 + [("a", 1, 8.0)] * 15000 + [("a", 1, None), ("a", 1, -3.0), ("a", None, 5.0), (None, 2, 7.0), ("b", 3, 0.0)]
    out = custom.geometric_mean(spark.createDataFrame(rows, "k string, j long, v double").coalesce(1), ["k", "j"], "v", "g")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan
    found = {(r.k, r.j): r.g and round(r.g, 9) for r in out.collect()}
    assert found == {("a", 1): 4.0, ("a", None): 5.0, (None, 2): 7.0, ("b", 3): None}


def test_closures_broadcast_no_more_than_a_bound(spark, tmp_path, monkeypatch):
    from tidemark.plans import views

    plans = []
    cut = views.cut
    monkeypatch.setattr(views, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    monkeypatch.setattr(views, "SMALL", 2, raising=False)
    spark.createDataFrame([("p", c, "column", f"t.{c}", c) for c in "abcd"] + [("p", "t", "table", "t", "t")], "project_id string, id string, node_type string, qualified_name string, label string").write.parquet(f"{tmp_path}/nodes")
    flows = [("p", x, y, "derivation", f"{x}{y}") for x, y in ("ab", "ac", "bd", "cd")] + [("p", "t", "a", "data_flow", None)]
    spark.createDataFrame(flows, "project_id string, from_node_id string, to_node_id string, edge_type string, expression string").write.parquet(f"{tmp_path}/edges")
    t = {"nodes": spark.read.parquet(f"{tmp_path}/nodes"), "edges": spark.read.parquet(f"{tmp_path}/edges")}
    paths = [*flows[:4], ("p", "a", "d", None, "bd"), ("p", "a", "d", None, "cd")]
    for view, start, end, last in ((views.column_descendants, 1, 2, ("bd", "cd")), (views.column_ancestors, 2, 1, ("ab", "ac"))):
        out = view(t)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        expected = [(p[start], p[end], 1, p[4]) for p in paths[:4]] + [("ad"[start - 1], "ad"[end - 1], 2, x) for x in last]
        assert sorted((r[2], r[4], r.depth, r.transformation) for r in out.collect()) == sorted(expected)
    wide = [p for p in plans if "Broadcast" in p]
    assert len(wide) == 2  # the two frontiers of two rows, one of each view
