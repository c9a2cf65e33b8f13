"""Sinks of the lineage tables: JSON, CSV bundle, Parquet, SQL script, Mermaid and HTML.

Table-shaped sinks are written by Spark. Script, diagram and report are texts of one project for a reader, so its rows come
to the driver; ask for one project at a time.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import script_tables, table_info
from tidemark.operators.lineage import TABLES
from tidemark.plans.view_sql import create_view
from tidemark.plans.views import VIEWS

Tables = dict[str, DataFrame]
_RESERVED = set("all and as create database default delete drop from group index insert into join order public schema select table union update user values view where".split()) - {"public"}


def write_parquet(t: Tables, path: str) -> None:
    for name, df in t.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(t: Tables, path: str) -> None:
    for name, df in t.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def column_mappings(t: Tables) -> DataFrame:
    """Flows between columns with their owners; a column that nothing owns belongs to Output."""
    own = t["edges"].where("edge_type = 'ownership'").select("project_id", "statement_id", F.col("to_node_id").alias("id"), F.col("from_node_id").alias("owner"))
    label = t["nodes"].select("project_id", "statement_id", F.col("id").alias("owner"), F.coalesce("qualified_name", "label").alias("owner_name"))
    owners = own.join(label, ["project_id", "statement_id", "owner"]).select("project_id", "statement_id", "id", "owner_name")
    columns = t["nodes"].where("node_type = 'column'").select("project_id", "statement_id", "id", "label").join(owners, ["project_id", "statement_id", "id"], "left")
    side = lambda name: columns.select("project_id", "statement_id", F.col("id").alias(f"{name}_node_id"), F.coalesce("owner_name", F.lit("Output")).alias(f"{name}_table"), F.col("label").alias(f"{name}_column"))
    e = t["edges"].where(F.col("edge_type").isin("data_flow", "derivation"))
    return e.join(side("from"), ["project_id", "statement_id", "from_node_id"]).join(side("to"), ["project_id", "statement_id", "to_node_id"]).select(
        "project_id", F.col("from_table").alias("source_table"), F.col("from_column").alias("source_column"), F.col("to_table").alias("target_table"), F.col("to_column").alias("target_column"), "expression", "edge_type"
    )


def summary(t: Tables) -> DataFrame:
    """One row a project: statements, tables, columns, joins and issues by severity."""
    key = "project_id"
    n = t["nodes"].groupBy(key).agg(
        F.countDistinct(F.when(F.col("node_type").isin("table", "view", "cte"), F.col("id"))).alias("tables"), F.countDistinct(F.when(F.col("node_type") == "column", F.col("id"))).alias("columns")
    )
    s = t["statements"].groupBy(key).agg(F.count("*").alias("statements"), F.sum("join_count").alias("joins"), F.max("complexity_score").alias("max_complexity"))
    i = t["issues"].groupBy(key).agg(*[F.count_if(F.col("severity") == k).alias(f"{k}s") for k in ("error", "warning", "info")])
    # the whole project's complexity: its different relations, all joins and all filters
    kinds = lambda *k: F.countDistinct(F.when(F.col("node_type").isin(*k), F.col("id")))
    c = t["nodes"].groupBy(key).agg((5 * kinds("table", "view") + 8 * kinds("cte")).alias("_relations"))
    f = t["filters"].groupBy(key).agg(F.count("*").alias("_filters"))
    out = s.join(n, key, "left").join(i, key, "left").join(c, key, "left").join(f, key, "left").na.fill(0)
    score = F.least(F.lit(100), F.greatest(F.lit(1), F.col("_relations") + 10 * F.col("joins") + 2 * F.col("_filters")))
    return out.withColumn("complexity", score).drop("_relations", "_filters")


def bundle(t: Tables) -> Tables:
    """The seven tables of the CSV bundle."""
    scripts = script_tables(t).groupBy("project_id", "source_name").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("reads"), F.col("table_name")))), "; ").alias("reads"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("writes"), F.col("table_name")))), "; ").alias("writes")
    )
    schema = t["schema_tables"].join(t["schema_columns"].select("project_id", F.col("table_id").alias("id"), F.col("name").alias("column"), "data_type"), ["project_id", "id"], "left")
    return {"scripts": scripts, "tables": table_info(t), "column_mappings": column_mappings(t), "table_dependencies": VIEWS["table_dependencies"](t), "summary": summary(t), "issues": VIEWS["issues_summary"](t), "resolved_schema": schema}


def write_csv(t: Tables, path: str) -> None:
    for name, df in bundle(t).items():
        df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/{name}")


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


#: Version of the tables' form, for those who read an export.
SCHEMA_VERSION = 1


def _ddl(prefix: str) -> list[str]:
    out = [f"CREATE TABLE {prefix}_meta (key VARCHAR PRIMARY KEY, value VARCHAR);"]
    for name, columns in TABLES.items():
        ddl = columns.replace("STRING", "VARCHAR").replace("ARRAY<VARCHAR>", "VARCHAR")
        out.append(f"CREATE TABLE {prefix}{name} ({ddl.replace('table VARCHAR', 'table_name VARCHAR')});")
    return out


def _meta(project: str, stamp: str | None) -> dict[str, str]:
    from tidemark import __version__

    return {"schema_version": str(SCHEMA_VERSION), "version": __version__, "project": project} | ({"exported_at": stamp} if stamp else {})


def _plain(t: Tables, name: str, project: str) -> DataFrame:
    """A project's rows of a table, arrays as text."""
    df = t[name].where(F.col("project_id") == project).drop("project_id")
    return df.select(*[F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])


def sql_script(t: Tables, project: str, schema: str | None = None, stamp: str | None = None) -> str:
    """Tables, what the export is, rows and the views of a project as SQL. schema, if given, must be a plain name of at most 63 characters."""
    if schema is not None and (not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", schema) or schema.lower() in _RESERVED):
        raise ValueError(f"{schema!r} can't name a schema")
    prefix = f"{schema}." if schema else ""
    out = [f"CREATE SCHEMA IF NOT EXISTS {schema};"] if schema else []
    out += _ddl(prefix)
    out += [f"INSERT INTO {prefix}_meta VALUES ({_literal(k)}, {_literal(v)});" for k, v in _meta(project, stamp).items()]
    for name in TABLES:
        for r in _plain(t, name, project).toLocalIterator():
            out.append(f"INSERT INTO {prefix}{name} VALUES ({', '.join(map(_literal, r))});")
    return "\n".join(out + [create_view(v, prefix) for v in VIEWS]) + "\n"


def _mermaid_id(name: str) -> str:
    return re.sub(r"\W", "_", name) or "_"


def mermaid(t: Tables, project: str, view: str = "table") -> str:
    """A flowchart of a project: view is table, script, column, hybrid or all."""
    if view == "all":
        return "\n\n".join(mermaid(t, project, v) for v in ("script", "hybrid", "table", "column"))
    only = {k: df.where(F.col("project_id") == project) for k, df in t.items()}
    if view == "table":
        d = VIEWS["table_dependencies"](only).select(F.coalesce("source_table", F.lit("?")).alias("a"), F.coalesce("target_table", F.lit("?")).alias("b"), F.lit("").alias("x")).distinct()
    elif view == "column":
        d = column_mappings(only).select(F.concat_ws(".", "source_table", "source_column").alias("a"), F.concat_ws(".", "target_table", "target_column").alias("b"), F.coalesce("expression", F.lit("")).alias("x")).distinct()
    elif view in ("hybrid", "script"):
        s = script_tables(only)
        w, r = s.where("writes").select("source_name", "table_name"), s.where("reads").select("source_name", "table_name")
        if view == "hybrid":
            d = w.select(F.col("source_name").alias("a"), F.col("table_name").alias("b"), F.lit("writes").alias("x")).union(r.select("table_name", "source_name", F.lit("reads")))
        else:
            d = w.withColumnRenamed("source_name", "a").join(r.withColumnRenamed("source_name", "b"), "table_name").where("a <> b").groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ", ").alias("x"))
    else:
        raise ValueError(f"no view {view!r}")
    lines = ["flowchart LR"]
    for e in d.orderBy("a", "b", "x").toLocalIterator():
        quote = lambda s: s.replace('"', "'")
        arrow = f'-->|"{quote(e.x)}"|' if e.x else "-->"
        lines.append(f'    {_mermaid_id(e.a)}["{quote(e.a)}"] {arrow} {_mermaid_id(e.b)}["{quote(e.b)}"]')
    return "\n".join(lines)


def report(t: Tables, project: str, title: str | None = None) -> str:
    """An HTML page with a project's summary, scripts, dependencies, mappings and issues."""
    only = {k: df.where(F.col("project_id") == project) for k, df in t.items()}
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title or project)}</title><h1>{html.escape(title or project)}</h1>"]
    for name, df in bundle(only).items():
        df = df.drop("project_id")
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.orderBy(*df.columns).toLocalIterator())
        parts.append(f"<h2>{html.escape(name.replace('_', ' '))}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)


def file_name(project: str, stamp: str, kind: str) -> str:
    """project-stamp.kind with what file systems dislike replaced."""
    clean = re.sub(r"[^A-Za-z0-9._-]+", "-", project).strip("-.") or "lineage"
    return f"{clean}-{re.sub(r'[^0-9A-Za-z]+', '-', stamp)}.{kind}"


def csv_zip(t: Tables, project: str) -> bytes:
    """The bundle of one project as a zip of CSV files."""
    import csv
    import io
    import zipfile

    only = {k: df.where(F.col("project_id") == project) for k, df in t.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in bundle(only).items():
            df = df.drop("project_id")
            text = io.StringIO()
            rows = csv.writer(text)
            rows.writerow(df.columns)
            # a cell that a spreadsheet would run as a formula gets a quote in front
            rows.writerows([("'" + v if isinstance(v, str) and v[:1] in "=+-@" else v) for v in r] for r in df.orderBy(*df.columns).toLocalIterator())
            z.writestr(f"{name}.csv", text.getvalue())
    return out.getvalue()


def matrix(t: Tables) -> DataFrame:
    """The dependency matrix of tables: one row an item, one column an item."""
    from tidemark.operators.graph import dependency_matrix

    cells = dependency_matrix(VIEWS["table_dependencies"](t), "source_table", "target_table")
    return cells.groupBy("project_id", "row").pivot("column").agg(F.first("cell"))


def write_xlsx(t: Tables, project: str, path: str) -> None:
    """A workbook of one project with a sheet for each table of the bundle and the dependency matrix; plain cells only."""
    import zipfile

    only = {k: df.where(F.col("project_id") == project) for k, df in t.items()}
    sheets = {**bundle(only), "dependency_matrix": matrix(only)}
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    clean = lambda v: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", str(v))[:32767]

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(clean(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')  # fmt: skip
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}">' + "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n[:31]}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        for i, df in enumerate(sheets.values()):
            df = df.drop("project_id")
            rows = ["".join(map(cell, df.columns)), *("".join(map(cell, r)) for r in df.orderBy(*df.columns).toLocalIterator())]
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")


def duckdb_file(t: Tables, project: str, path: str, stamp: str | None = None) -> None:
    """One project's tables and views in a DuckDB file; needs the duckdb client, to which the rows go as Arrow."""
    import duckdb

    with duckdb.connect(path) as c:
        c.execute("\n".join(_ddl("")))
        c.executemany("INSERT INTO _meta VALUES (?, ?)", list(_meta(project, stamp).items()))
        for name in TABLES:
            rows = _plain(t, name, project).toArrow()
            c.register("rows_", rows)
            c.execute(f"INSERT INTO {name} SELECT * FROM rows_")
            c.unregister("rows_")
        for v in VIEWS:
            c.execute(create_view(v))


def text_table(rows: dict[str, list[dict]], quiet: bool = False) -> str:
    """A project's result for a terminal: files, counts, what flows where by relation, and issues unless quiet."""
    kind = lambda *kinds: {n["id"]: n for n in rows["nodes"] if n["node_type"] in kinds}
    relations = kind("table", "view", "cte", "output")
    name = lambda n: n["qualified_name"] or n["label"]
    flows = sorted({(name(relations[e["from_node_id"]]), name(relations[e["to_node_id"]])) for e in rows["edges"] if e["edge_type"] in ("data_flow", "join_dependency") and e["from_node_id"] in relations and e["to_node_id"] in relations})
    files = sorted({s["source_name"] for s in rows["statements"] if s["source_name"]})
    out = ["Lineage", "=" * 50, *([f"Files: {', '.join(files)}"] if files else [])]
    out.append(f"{len(rows['statements'])} statements, {len(kind('table', 'view'))} tables, {len(kind('column'))} columns, {sum(s['join_count'] for s in rows['statements'])} joins")
    if flows:
        wide = max(len(a) for a, _ in flows)
        out += ["", "Flows:", *[f"  {a:<{wide}} -> {b}" for a, b in flows]]
    if rows["issues"] and not quiet:
        out += ["", "Issues:", *[f"  {i['severity']:<7} {i['code']}: {i['message']}" for i in rows["issues"]]]
    return "\n".join(out) + "\n"
