"""The command line: python -m tidemark FILES, or a script on standard input.

Small inputs are analyzed here without Spark; formats that are made of the lineage tables start a local session.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from tidemark.lineage import api
from tidemark.lineage.dialects import DIALECTS
from tidemark.lineage.templates import TemplateError
from tidemark.operators.lineage import SCRIPT_BYTES

FORMATS = "table json mermaid html sql csv xlsx duckdb parquet".split()
#: Formats that are files and need a name.
BINARY = {"csv", "xlsx", "duckdb", "parquet"}
SUFFIX = {"csv": "zip", "table": "txt", "mermaid": "md"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Lineage of SQL scripts")
    p.add_argument("files", nargs="*", help="SQL files; standard input without any")
    p.add_argument("-d", "--dialect", default="generic", choices=DIALECTS)
    p.add_argument("-f", "--format", default="table", choices=FORMATS)
    p.add_argument("-s", "--schema", help="a DDL or JSON file with the tables' columns")
    p.add_argument("--metadata-url", help="sqlite:PATH or a JDBC URL to read the schema from")
    p.add_argument("--metadata-schema", help="the schema of that database")
    p.add_argument("-o", "--output", help="a file instead of standard output")
    p.add_argument("--project-name", default="lineage")
    p.add_argument("--export-schema", help="a schema for the tables of the sql format")
    p.add_argument("-v", "--view", default="table", choices=["table", "script", "column", "hybrid", "all"], help="detail of the mermaid format")
    p.add_argument("-q", "--quiet", action="store_true", help="no issues")
    p.add_argument("-c", "--compact", action="store_true", help="JSON on one line")
    p.add_argument("--template", default="raw", choices=["raw", "jinja", "dbt"])
    p.add_argument("--template-var", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--hide-ctes", action="store_true")
    p.add_argument("--serve", action="store_true", help="answer over HTTP instead")
    p.add_argument("--port", type=int, default=3000)
    p.add_argument("--watch", action="append", default=[], metavar="DIR", help="folders whose scripts the server offers")
    return p


def variables(pairs: list[str]) -> dict[str, Any]:
    out = {}
    for pair in pairs:
        key, sep, value = pair.partition("=")
        if not sep or not key:
            raise ValueError(f"{pair!r} isn't KEY=VALUE")
        out[key] = value
    return {**out, "vars": out}


def read_files(paths: list[str]) -> list[tuple[str | None, str]]:
    if not paths:
        return [(None, sys.stdin.read())]
    out: list[tuple[str | None, str]] = []
    for path in paths:
        if os.path.getsize(path) > SCRIPT_BYTES:
            raise ValueError(f"{path} is larger than {SCRIPT_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            out.append((path, f.read()))
    return out


def schema_of(path: str | None, dialect: str, url: str | None = None, name: str | None = None) -> dict[str, Any]:
    """The schema that a DDL or JSON file gives, or a database."""
    if url:
        from tidemark.sources import scripts

        if url.startswith("sqlite:"):
            return json.loads(scripts.schema_from_sqlite(url.removeprefix("sqlite:").removeprefix("//")))
        return json.loads(scripts.schema_from_jdbc(session(), url if url.startswith("jdbc:") else f"jdbc:{url}", name))
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        return json.loads(text)
    rows = api.analyze_sql(text, dialect)
    columns: dict[int, list[dict]] = {}
    for c in rows["schema_columns"]:
        columns.setdefault(c["table_id"], []).append({"name": c["name"], "dataType": c["data_type"], "isPrimaryKey": c["is_primary_key"]})
    return {"tables": [{"catalog": t["catalog"], "schema": t["schema_name"], "name": t["name"], "columns": columns.get(t["id"], [])} for t in rows["schema_tables"]]}


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def tables_of(files: list[tuple[str | None, str]], dialect: str, schema: dict[str, Any], project: str, template: str = "raw", context: dict | None = None, hide_ctes: bool = False):
    """The lineage tables as DataFrames, for the exports."""
    from tidemark.operators.lineage import analyze, scripts_of

    scripts = scripts_of(session(), [(project, n or "stdin", text) for n, text in files], dialect, json.dumps(schema) if schema else None)
    return analyze(scripts, hide_ctes=hide_ctes, template=template, context=context).tables


def export(kind: str, t, project: str, view: str = "table", schema: str | None = None, path: str | None = None) -> str | bytes | None:
    """A project in a format, as text or bytes; formats that are files are written to path."""
    from tidemark.sources import export as E

    if kind == "mermaid":
        return E.mermaid(t, project, view) + "\n"
    if kind == "html":
        return E.report(t, project)
    if kind == "sql":
        return E.sql_script(t, project, schema)
    if kind == "csv":
        return E.csv_zip(t, project)
    if path is None:
        raise ValueError(f"{kind} needs a file")
    {"xlsx": E.write_xlsx, "duckdb": E.duckdb_file, "parquet": lambda t, _, p: E.write_parquet(t, p)}[kind](t, project, path)
    return None


def main(argv: list[str] | None = None) -> int:
    """0; 1 if the analysis found errors; 2 where it can't be done."""
    a = parser().parse_args(argv)
    try:
        context = variables(a.template_var)
        schema = schema_of(a.schema, a.dialect, a.metadata_url, a.metadata_schema)
        if a.serve:
            from tidemark.server import serve

            serve(a.port, a.dialect, schema, a.watch, a.template, context)
            return 0
        files = read_files(a.files)
        rows = api.analyze_files(files, a.dialect, schema, a.template, context, a.hide_ctes)
        errors = sum(i["severity"] == "error" for i in rows["issues"])
        path = a.output or (f"{a.project_name}.{SUFFIX.get(a.format, a.format)}" if a.format in BINARY else None)
        if a.format == "json":
            out: str | bytes | None = json.dumps(rows, indent=None if a.compact else 2) + "\n"
        elif a.format == "table":
            from tidemark.sources.export import text_table

            out = text_table(rows, a.quiet)
        else:
            out = export(a.format, tables_of(files, a.dialect, schema, a.project_name, a.template, context, a.hide_ctes), a.project_name, a.view, a.export_schema, path)
    except (OSError, ValueError, TemplateError) as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return 2
    if out is not None and path:
        with open(path, "wb") as f:
            f.write(out if isinstance(out, bytes) else out.encode())
    elif out is not None:
        sys.stdout.write(out if isinstance(out, str) else out.decode())
    if not a.quiet and a.format != "table":
        for i in rows["issues"]:
            print(f"{i['severity']}: {i['code']}: {i['message']}", file=sys.stderr)
    return 1 if errors else 0
