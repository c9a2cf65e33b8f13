"""Scripts and schemas as Spark inputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import SCRIPT_BYTES, Lineage, analyze, scripts_of

def folder(spark: SparkSession, path: str, dialect: str = "generic", schema: str | None = None, project: str | None = None) -> DataFrame:
    """(project_id, ord, name, content, dialect, schema, bytes) of all .sql files under path. A file's project is its folder, or project.

    Files over SCRIPT_BYTES come without content, which analyze() turns into an issue. Order within a project is by path.
    """
    return scripts_in(spark, [path], dialect, schema, project)


def scripts_in(spark: SparkSession, paths: list[str], dialect: str = "generic", schema: str | None = None, project: str | None = None, recursive: bool = True) -> DataFrame:
    """folder() of several folders, with or without those below them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    parts = F.split("path", "/")
    owner = F.lit(project) if project else F.element_at(parts, -2)
    # the filter on length keeps large files from being read
    fits, large = files.where(F.col("length") <= SCRIPT_BYTES), files.where(F.col("length") > SCRIPT_BYTES)
    pick = lambda df, content: df.select(owner.alias("project_id"), F.lit(0).alias("ord"), F.col("path").alias("name"), content.alias("content"), F.lit(dialect).alias("dialect"), F.lit(schema).cast("string").alias("schema"), F.col("length").alias("bytes"))
    return pick(fits, F.col("content").cast("string")).union(pick(large, F.lit(None).cast("string")))


def inline(spark: SparkSession, sql: str, name: str | None = None, dialect: str = "generic", schema: str | None = None) -> DataFrame:
    return scripts_of(spark, [("inline", name or "inline", sql)], dialect, schema)


def models(scripts: DataFrame) -> DataFrame:
    """Model scripts, whose content is one query, as statements that create what the file is named after."""
    stem = F.regexp_extract("name", r"([^/]+?)(\.sql)?$", 1)
    bare = F.lower(F.ltrim(F.regexp_replace("content", r"(?s)^(\s|--[^\n]*\n|/\*.*?\*/|\{\{.*?\}\}|\{%.*?%\})*", ""))).rlike("^(select|with)\\b")
    return scripts.withColumn("content", F.when(bare, F.concat(F.lit("CREATE TABLE "), stem, F.lit(" AS\n"), F.rtrim(F.regexp_replace("content", r";\s*$", "")))).otherwise(F.col("content")))


def schema_json(tables: dict[str, list[tuple[str, str | None]]], default_schema: str | None = None, allow_implied: bool = True) -> str:
    """The schema that analyze() takes, from {table: [(column, type)]}."""
    out = {"allowImplied": allow_implied, "tables": [{"name": n, "columns": [{"name": c, "dataType": t} for c, t in cs]} for n, cs in tables.items()]}
    return json.dumps(out | ({"defaultSchema": default_schema} if default_schema else {}))


def schema_from_ddl(spark: SparkSession, ddl: str, dialect: str = "generic") -> str:
    """The schema that a DDL script makes."""
    found: Lineage = analyze(inline(spark, ddl, "schema.sql", dialect))
    t = found.schema_tables.select("project_id", F.col("id").alias("table_id"), F.concat_ws(".", "catalog", "schema_name", "name").alias("table"))
    c = found.schema_columns.select("project_id", "table_id", F.col("id").alias("place"), F.col("name").alias("column"), "data_type")
    rows = t.join(c, ["project_id", "table_id"]).groupBy("table").agg(F.sort_array(F.collect_list(F.struct("place", "column", "data_type"))).alias("cs")).collect()
    return schema_json({r["table"]: [(x["column"], x["data_type"]) for x in r["cs"]] for r in rows})


def schema_from_catalog(spark: SparkSession, database: str | None = None) -> str:
    """The schema of the session's catalog: its tables and temporary views."""
    tables = {}
    for t in spark.catalog.listTables(database):
        tables[t.name] = [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{t.database}.{t.name}")]
    return schema_json(tables)


def schema_from_jdbc(spark: SparkSession, url: str, schema: str | None = None, **options: str) -> str:
    """The schema of a database with an information_schema, over JDBC; the driver must be on the class path."""
    sql = "SELECT table_schema, table_name, column_name, data_type, ordinal_position FROM information_schema.columns"
    own = F.col("table_schema") == schema if schema else ~F.col("table_schema").isin("information_schema", "pg_catalog", "mysql", "sys", "performance_schema")
    rows = spark.read.format("jdbc").options(url=url, query=sql, **options).load().where(own).orderBy("table_schema", "table_name", "ordinal_position").collect()
    tables: dict[str, list[tuple[str, str | None]]] = {}
    for r in rows:
        tables.setdefault(f"{r['table_schema']}.{r['table_name']}", []).append((r["column_name"], r["data_type"]))
    return schema_json(tables)


def schema_from_sqlite(path: str) -> str:
    """The schema of a SQLite file, with primary and foreign keys; the standard library's client reads it."""
    import sqlite3

    tables = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall():
            keys = {r[3]: {"table": r[2], "column": r[4] or r[3]} for r in c.execute("SELECT * FROM pragma_foreign_key_list(?)", (name,))}
            columns = [{"name": r[1], "dataType": r[2] or None, "isPrimaryKey": bool(r[5]), "foreignKey": keys.get(r[1])} for r in c.execute("SELECT * FROM pragma_table_info(?) ORDER BY cid", (name,))]
            tables.append({"name": name, "columns": columns})
    return json.dumps({"allowImplied": True, "tables": tables})
