"""The analyzer as a Spark operator: scripts in, the lineage tables out."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import cut

#: The lineage tables; each also has project_id in front.
TABLES = {
    "statements": "id INT, statement_index INT, statement_type STRING, source_name STRING, span_start INT, span_end INT, join_count INT, complexity_score INT",
    "nodes": "id STRING, statement_id INT, node_type STRING, label STRING, qualified_name STRING, expression STRING, span_start INT, span_end INT, resolution_source STRING",
    "edges": "id STRING, statement_id INT, edge_type STRING, from_node_id STRING, to_node_id STRING, expression STRING, operation STRING, is_approximate BOOLEAN",
    "joins": "id INT, node_id STRING, statement_id INT, join_type STRING, join_condition STRING",
    "filters": "id INT, node_id STRING, statement_id INT, predicate STRING, filter_type STRING",
    "aggregations": "node_id STRING, statement_id INT, is_grouping_key BOOLEAN, function STRING, is_distinct BOOLEAN",
    "issues": "statement_id INT, severity STRING, code STRING, message STRING, span_start INT, span_end INT",
    "schema_tables": "id INT, catalog STRING, schema_name STRING, name STRING, resolution_source STRING",
    "schema_columns": "id INT, table_id INT, name STRING, data_type STRING, is_nullable BOOLEAN, is_primary_key BOOLEAN",
    "schema_constraints": "table STRING, constraint_type STRING, columns ARRAY<STRING>, referenced_table STRING, referenced_columns ARRAY<STRING>",
    "global_nodes": "id STRING, node_type STRING, label STRING, canonical_catalog STRING, canonical_schema STRING, canonical_name STRING, canonical_column STRING, resolution_source STRING",
    "global_edges": "id STRING, from_node_id STRING, to_node_id STRING, edge_type STRING",
    "global_node_statement_refs": "id INT, global_node_id STRING, statement_index INT, local_node_id STRING",
}
#: Scripts larger than this are not read (bytes).
SCRIPT_BYTES = 10 << 20


class Lineage:
    """The tables of many projects. Each is a DataFrame with project_id, read from one partitioned scratch table."""

    def __init__(self, records: DataFrame):
        self.records = records

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        row = F.from_json("row", f"STRUCT<{TABLES[name]}>".replace(" INT", ": INT").replace(" STRING", ": STRING").replace(" BOOLEAN", ": BOOLEAN").replace(" ARRAY", ": ARRAY"))
        return self.records.where(F.col("kind") == name).select("project_id", row.alias("r")).select("project_id", "r.*")

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}


def analyze(scripts: DataFrame, keep: bool = True, hide_ctes: bool = False, template: str = "dbt", context: dict | None = None) -> Lineage:
    """Lineage of scripts: columns project_id, ord, name, content, and optionally dialect, schema (JSON) and bytes.

    A project's statements depend on those before them, so a project is analyzed in one task, scripts in order of ord
    and then name; projects run side by side. Scripts over SCRIPT_BYTES, by their content or by bytes, give an issue instead. A project's dialect and
    schema are those of its first script that has one. Null content is an empty script. With hide_ctes, what flows through
    CTEs joins its sources and targets directly. Templates are worked out by template (raw, jinja or dbt) with the
    context's variables; a script whose template fails gives an issue.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = scripts.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for c in ("dialect", "schema"):
        if c not in scripts.columns:
            scripts = scripts.withColumn(c, F.lit(None).cast("string"))
    if "bytes" not in scripts.columns:
        scripts = scripts.withColumn("bytes", F.lit(0).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.lineage.analyzer import Project
        from tidemark.lineage.templates import TemplateError, render

        pdf = pdf.sort_values(["ord", "name"], kind="stable", na_position="last")
        first = lambda c: next((v for v in pdf[c] if isinstance(v, str) and v), None)
        given = json.loads(first("schema") or "{}")
        project = Project(first("dialect") or "generic", given.get("tables"), given.get("defaultSchema"), given.get("defaultCatalog"),
                          [p.get("schema") for p in given.get("searchPath") or []], given.get("allowImplied", True), hide_ctes)
        files = []
        for name, content, size in zip(pdf["name"], pdf["content"], pdf["bytes"], strict=True):
            if size > SCRIPT_BYTES or isinstance(content, str) and len(content.encode()) > SCRIPT_BYTES:
                project.issue(None, "error", "PAYLOAD_SIZE", f"{name} is larger than {SCRIPT_BYTES} bytes")
            elif isinstance(content, str):
                try:
                    files.append((name, render(content, context, template)))
                except TemplateError as e:
                    project.issue(None, "error", "TEMPLATE_ERROR", f"{name}: {e}")
        rows = project.run(files).rows()
        out = [(kind, json.dumps(r)) for kind, rs in rows.items() for r in rs]
        return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "kind": [k for k, _ in out], "row": [r for _, r in out]})

    records = scripts.select("project_id", "ord", "name", "content", "dialect", "schema", F.coalesce("bytes", F.lit(0)).alias("bytes")).groupBy("project_id").applyInPandas(run, "project_id string, kind string, row string")
    return Lineage(cut(records, "kind") if keep else records)


def scripts_of(spark: SparkSession, files: list[tuple[str, str, str]], dialect: str = "generic", schema: str | None = None) -> DataFrame:
    """(project_id, ord, name, content, dialect, schema) from (project, name, content) in order."""
    rows = [(p, i, n, c, dialect, schema) for i, (p, n, c) in enumerate(files)]
    return spark.createDataFrame(rows, "project_id string, ord int, name string, content string, dialect string, schema string")
