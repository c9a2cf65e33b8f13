import io
import json
import threading
import urllib.request

import pytest

from tidemark import cli, server
from tidemark.lineage import api, templates
from tidemark.lineage.lexer import statements

SQL = "create table t as select a.x, b.y from a join b on a.id = b.id; select y from t where x = null"


@pytest.fixture
def script(tmp_path):
    (tmp_path / "s.sql").write_text(SQL)
    (tmp_path / "ddl.sql").write_text("create table a (id int, x int); create table b (id int, y text)")
    return tmp_path


def test_formats(script, capsys, monkeypatch):
    f, ddl = str(script / "s.sql"), str(script / "ddl.sql")
    assert cli.main([f, "-s", ddl]) == 0
    out = capsys.readouterr().out
    assert "2 statements, 3 tables" in out and "a -> t" in out and "TYPE_MISMATCH" in out
    assert cli.main([f, "-f", "json", "-c", "-q"]) == 0
    rows = json.loads(capsys.readouterr().out)
    assert len(rows["statements"]) == 2 and rows["statements"][0]["source_name"] == f
    assert cli.main([f, "-f", "mermaid", "-q"]) == 0 and 'a["a"] --> t["t"]' in capsys.readouterr().out
    assert cli.main([f, "-f", "sql", "-q", "--export-schema", "lin", "-o", str(script / "o.sql")]) == 0
    import duckdb

    c = duckdb.connect()
    c.execute((script / "o.sql").read_text())
    assert c.sql("select value from lin._meta where key = 'schema_version'").fetchall() == [("1",)]
    views = [r[0] for r in c.sql("select view_name from duckdb_views() where schema_name = 'lin'").fetchall()]
    assert len(views) == 18
    for v in views:
        c.sql(f"select count(*) from lin.{v}").fetchall()
    got = c.sql("select statement_index, source_table, source_column, target_table, target_column from lin.column_lineage").fetchall()
    assert sorted(got) == [(0, "a.x", "x", "t.x", "x"), (0, "b.y", "y", "t.y", "y"), (1, "t.y", "y", "Output (2).y", "y")]
    monkeypatch.setattr("sys.stdin", io.StringIO("selec 1"))
    assert cli.main(["-q"]) == 1
    assert cli.main([str(script / "none.sql")]) == 2 and cli.main([f, "--template-var", "x"]) == 2


def test_templates_and_schemas(script, capsys):
    (script / "m.sql").write_text("select * from {{ ref('up') }} {% if is_incremental() %}join gone{% endif %} where d = '{{ var(\"day\") }}'")
    assert cli.main([str(script / "m.sql"), "--template", "dbt", "--template-var", "day=1", "-f", "json", "-q"]) == 0
    rows = json.loads(capsys.readouterr().out)
    assert {n["label"] for n in rows["nodes"] if n["node_type"] == "table"} == {"up"} and rows["filters"][0]["predicate"] == "d = '1'"
    assert cli.main([str(script / "m.sql"), "--template", "jinja", "-q", "-f", "json"]) == 1
    assert json.loads(capsys.readouterr().out)["issues"][0]["code"] == "TEMPLATE_ERROR"
    import sqlite3

    with sqlite3.connect(script / "d.db") as c:
        c.execute("create table a (id integer, x integer)")
    assert [t["name"] for t in cli.schema_of(None, "sqlite", f"sqlite:{script / 'd.db'}")["tables"]] == ["a"]


def test_http(script):
    s = server.server(server.App("generic", {"tables": [{"name": "a", "columns": [{"name": "x"}]}]}, [str(script)]), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}/api"

    def ask(path, body=None):
        r = urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None)
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.loads(f.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health")[1]["status"] == "ok" and ask("/config")[1]["has_schema"]
        assert [f["name"] for f in ask("/files")[1]] == ["ddl.sql", "s.sql"]
        assert len(ask("/analyze", {"sql": SQL})[1]["statements"]) == 2
        assert [x["text"] for x in ask("/split", {"sql": "select 1; select 2"})[1]["statements"]] == ["select 1", "select 2"]
        assert ask("/completion", {"sql": "select  from a", "cursor_offset": 7})[1]["items"][0]["label"] == "x"
        assert ask("/export/json", {"sql": "select 1"})[0] == 200
        assert ask("/nothing")[0] == 404 and ask("/split", {})[0] == 400
    finally:
        s.shutdown()


def test_editor_calls():
    sql = "select x from 😀t; with k as (select 1 as v) select v from k"
    rows = api.analyze_sql("create table t as select x from a; select é from t where y = null")
    assert api.hover(rows, 13)[0]["name"] == "t" and api.lenses(rows)[0]["title"].startswith("CREATE_TABLE_AS: 2 tables")
    assert "TYPE_MISMATCH" in [d["code"] for d in api.diagnostics(rows, "create table t as select x from a; select é from t where y = null")]
    from tidemark.lineage.lexer import utf16_offset

    assert utf16_offset(sql, 15) == 16
    assert json.loads(api.split_json('{"sql": "select 1; select 2"}'))["statements"][1]["text"] == "select 2"
    assert json.loads(api.complete_json('{"sql": "select ", "cursorOffset": 7}'))["items"] and json.loads(api.context_json('{"sql": "select ", "cursorOffset": 7}'))["clause"] == "select"


def test_routines_stay_whole():
    proc = "create procedure p() as begin insert into x select 1; if a then delete from y; end if; select case when 1 = 1 then 2 end; end; select 1"
    assert len(statements(proc)) == 2
    assert len(statements("create function f() as begin select 1; select 2")) == 2  # a block that stays open: semicolons count
    assert len(statements("begin; select 1; commit")) == 3


@pytest.mark.parametrize(
    "text, value",
    [
        ("{% for c in ['a', 'b'] %}{{ c }}{% if not loop.last %}, {% endif %}{% endfor %}", "a, b"), ("{% set x = {'k': [1, 2]} %}{{ x.k[1] + 1 }} {{ x['k'] | length }}", "3 2"), ("{{ 'a' if false else 'b' }}", "b"),
        ("{% macro m(a, b=2) %}{{ a }}-{{ b }}{% endmacro %}{{ m(1) }} {{ m(1, b='z') }}", "1-2 1-z"), ("{{ dbt_utils.star('t') }} {{ unknown('c') }} {{ other() }}", "t c __other__"), ("a {%- if true -%} b {%- endif -%} c", "abc"),
        ("{% snapshot s %}select 1{% endsnapshot %}{% test x(m) %}no{% endtest %}", "select 1"), ("{% raw %}{{ x }}{% endraw %}{# gone #}", "{{ x }}"), ("{{ source('a', 'b').schema }} {{ env_var('HOME') }}", "a __ENV_VAR_HOME__"),
        ("{% if execute %}x{% elif 2 > 1 and 'a' in ['a'] %}y{% else %}z{% endif %}", "y"), ("{% for a, b in zip([1, 2], ['x', 'y']) %}{{ a }}{{ b }}{% endfor %}{% for r in run_query('q') %}!{% else %}none{% endfor %}", "1x2ynone"),
        ("{{ [3, 1, 2] | sort | join('+') }} {{ 'AbC' | lower }} {{ missing | default('d') }}", "1+2+3 abc d"), ("{% for i in range(6) if i % 2 %}{{ i }}{% endfor %}", "135"), ("{% set q %}select {{ 1 }}{% endset %}{{ q }}", "select 1"),
    ],
)
def test_template_language(text, value):
    assert templates.render(text) == value


@pytest.mark.parametrize("text", ["{{ x }}", "{{ f() }}", "{{ x.y }}"])
def test_strict_templates(text):
    with pytest.raises(templates.TemplateError):
        templates.render(text, {}, "jinja")
    assert templates.render("{{ x }}", {"x": "v"}, "jinja") == "v" and templates.render(text, {}, "raw") == text


@pytest.mark.parametrize("text", ["{% if a %}", "{% endif %}", "{{ 1 + }}", "{% for i in range(400) %}{% for j in range(400) %}x{% endfor %}{% endfor %}", "{% macro m() %}{{ m() }}{% endmacro %}{{ m() }}", "{{ zip_strict([1], []) }}", "{{ 1 // 0 }}", "{% nothing %}"])
def test_templates_that_fail(text):
    with pytest.raises(templates.TemplateError):
        templates.render(text)
