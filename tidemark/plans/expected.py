"""What the statements of sample.MANY do to the graph, checked by hand: rows to compare, by table."""

from __future__ import annotations

COLUMNS = {
    "statements": "project_id, statement_index, statement_type, join_count, complexity_score", "flows": "project_id, statement_index, edge_type, source, target, expression, operation, is_approximate", "issues": "project_id, statement_index, severity, code",
    "constraints": "project_id, table_name, constraint_type, columns, referenced_table, referenced_columns", "filters": "project_id, statement_index, relation, predicate", "hidden": "project_id, statement_index, edge_type, source, target, expression, operation, is_approximate",
}

ROWS: dict[str, list[tuple]] = {
    "statements": [
        ("dml", 0, "UPDATE", 0, 14),
        ("dml", 1, "INSERT", 0, 10),
        ("dml", 2, "CREATE_TABLE", 0, 5),
        ("dml", 3, "COPY", 0, 5),
        ("dml", 4, "DELETE", 0, 16),
        ("fold", 0, "CREATE_TABLE_AS", 0, 10),
        ("fold", 1, "SELECT", 0, 5),
        ("infer", 0, "CREATE_TABLE_AS", 0, 18),
        ("keys", 0, "CREATE_TABLE", 0, 5),
        ("keys", 1, "CREATE_TABLE", 0, 5),
        ("keys", 2, "SELECT", 2, 35),
        ("load", 0, "COPY", 0, 5),
        ("load", 1, "UNLOAD", 0, 5),
        ("proc", 0, "CREATE_PROCEDURE", 0, 1),
        ("proc", 1, "SELECT", 0, 5),
        ("star", 0, "CREATE_TABLE_AS", 0, 10),
        ("star", 1, "CREATE_TABLE_AS", 0, 18),
        ("star", 2, "CREATE_VIEW", 0, 19),
        ("star", 3, "CREATE_TABLE_AS", 1, 25),
        ("star", 4, "SELECT", 0, 5),
        ("star", 5, "CREATE_TABLE_AS", 1, 25),
        ("warn", 0, "SELECT", 0, 7),
        ("warn", 1, "SELECT", 0, 7),
        ("warn", 2, "SELECT", 0, 11),
    ],
    "flows": [
        ("dml", 0, "data_flow", "b", "a", None, None, False),
        ("dml", 1, "data_flow", "a", "c", None, None, False),
        ("dml", 1, "data_flow", "a.id", "c.id", None, "INSERT", False),
        ("dml", 1, "data_flow", "a.x", "c.x", None, "INSERT", False),
        ("dml", 4, "data_flow", "a", "c", None, None, False),
        ("fold", 0, "data_flow", "SRC", "T1", None, None, False),
        ("fold", 0, "data_flow", "SRC.Id", "T1.Id", None, None, False),
        ("fold", 0, "data_flow", "SRC.Id", "T1.q", None, None, False),
        ("fold", 1, "data_flow", "T1.ID", "Output (2).ID", None, None, False),
        ("fold", 1, "data_flow", "T1.Q", "Output (2).Q", None, None, False),
        ("infer", 0, "data_flow", "k", "w", None, None, False),
        ("infer", 0, "data_flow", "k.p", "w.p", None, None, False),
        ("infer", 0, "data_flow", "raw", "k", None, None, True),
        ("infer", 0, "data_flow", "raw.p", "k.p", None, None, True),
        ("infer", 0, "data_flow", "raw.v", "k.v", None, None, True),
        ("infer", 0, "derivation", "k.v", "w.v2", "k.v + 1", None, False),
        ("keys", 2, "data_flow", "o.id", "Output (3).id", None, None, False),
        ("keys", 2, "data_flow", "u.mail", "Output (3).mail", None, None, False),
        ("keys", 2, "join_dependency", "z", "Output (3)", "z.o_id = o.id", "INNER_JOIN", False),
        ("load", 1, "data_flow", "lake.id", "Output.id", None, None, False),
        ("star", 0, "data_flow", "a", "s1", None, None, False),
        ("star", 0, "data_flow", "a.id", "s1.id", None, None, False),
        ("star", 0, "data_flow", "a.x", "s1.x", None, None, False),
        ("star", 1, "data_flow", "d", "s2", None, None, False),
        ("star", 1, "data_flow", "d.id", "s2.id", None, None, False),
        ("star", 1, "data_flow", "d.total", "s2.total", None, None, False),
        ("star", 1, "data_flow", "s1", "d", None, None, False),
        ("star", 1, "data_flow", "s1.id", "d.id", None, None, False),
        ("star", 1, "derivation", "s1.x", "d.total", "x * 2", None, False),
        ("star", 2, "data_flow", "b", "s3", None, None, False),
        ("star", 2, "data_flow", "b.y", "s3.y", None, None, False),
        ("star", 2, "data_flow", "s1", "s3", None, None, False),
        ("star", 2, "data_flow", "s1.id", "s3.id", None, None, False),
        ("star", 2, "data_flow", "s1.x", "s3.x", None, None, False),
        ("star", 3, "data_flow", "a", "s4", None, None, False),
        ("star", 3, "data_flow", "a.id", "s4.id", None, None, False),
        ("star", 3, "data_flow", "b", "s4", None, "INNER_JOIN", False),
        ("star", 3, "data_flow", "b.y", "s4.y", None, None, False),
        ("star", 4, "data_flow", "nowhere", "Output (5)", None, None, True),
        ("star", 5, "data_flow", "a", "s5", None, None, False),
        ("star", 5, "data_flow", "a.id", "s5.id", None, None, False),
        ("star", 5, "data_flow", "c", "s5", None, "LEFT_JOIN", False),
        ("star", 5, "data_flow", "c.z", "s5.z", None, None, False),
        ("warn", 0, "data_flow", "t.a", "Output.n", None, None, False),
        ("warn", 0, "derivation", "t.n", "Output.m", "n + 1", None, False),
        ("warn", 1, "data_flow", "t.a", "Output (2).g", None, None, False),
    ],
    "issues": [
        ("infer", 0, "info", "APPROXIMATE_LINEAGE"),
        ("star", 4, "info", "APPROXIMATE_LINEAGE"),
        ("star", 4, "warning", "UNRESOLVED_REFERENCE"),
        ("warn", 0, "warning", "TYPE_MISMATCH"),
        ("warn", 0, "warning", "UNSUPPORTED_SYNTAX"),
        ("warn", 1, "warning", "UNSUPPORTED_SYNTAX"),
        ("warn", 1, "warning", "UNSUPPORTED_SYNTAX"),
        ("warn", 2, "warning", "TYPE_MISMATCH"),
        ("warn", 2, "warning", "TYPE_MISMATCH"),
    ],
    "constraints": [
        ("keys", "o", "FOREIGN_KEY", "u_id", "u", "id"),
        ("keys", "o", "IMPLIED_FOREIGN_KEY", "id", "z", "o_id"),
        ("keys", "o", "IMPLIED_FOREIGN_KEY", "u_id", "u", "id"),
        ("keys", "u", "IMPLIED_FOREIGN_KEY", "id", "o", "u_id"),
        ("keys", "u", "PRIMARY_KEY", "id", None, ""),
        ("keys", "z", "IMPLIED_FOREIGN_KEY", "o_id", "o", "id"),
        ("star", "a", "IMPLIED_FOREIGN_KEY", "id", "c", "id"),
        ("star", "c", "IMPLIED_FOREIGN_KEY", "id", "a", "id"),
    ],
    "filters": [
        ("dml", 0, "a", "a.id = b.a_id"),
        ("dml", 0, "b", "a.id = b.a_id"),
        ("dml", 4, "a", "a.x > 3"),
        ("dml", 4, "a", "c.id = a.id"),
        ("dml", 4, "c", "c.id = a.id"),
        ("star", 2, "b", "s.id = b.a_id"),
        ("star", 2, "s1", "s.id = b.a_id"),
        ("warn", 0, "t", "a = NULL"),
        ("warn", 1, "t", "k > 1"),
        ("warn", 2, "t", "CAST(a AS INT) = 'x'"),
        ("warn", 2, "t", "CAST(b AS DATE) < CAST(c AS TIMESTAMP)"),
        ("warn", 2, "t", "true * 2 > 1"),
    ],
    "hidden": [
        ("infer", 0, "data_flow", "raw", "w", None, None, False),
        ("infer", 0, "data_flow", "raw.p", "w.p", None, None, False),
        ("infer", 0, "derivation", "raw.v", "w.v2", "k.v + 1", None, False),
        ("star", 1, "data_flow", "s1", "s2", None, None, False),
        ("star", 1, "data_flow", "s1.id", "s2.id", None, None, False),
        ("star", 1, "derivation", "s1.x", "s2.total", None, None, False),
    ],
}


def sql(name: str) -> str:
    """The rows as a query."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(map(say, r))})" for r in ROWS[name])
    return f"SELECT * FROM (VALUES {rows}) v({COLUMNS[name]})"
