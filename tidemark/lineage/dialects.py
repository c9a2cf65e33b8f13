"""What dialects differ in: how names fold, which clauses see aliases, which names date functions take as units.

Fixed values throughout.
"""

from __future__ import annotations

#: How unquoted names fold; the rest compare without case, in lower case.
FOLD = {"ansi": "upper", "snowflake": "upper", "postgres": "lower", "clickhouse": "exact", "mysql": "exact"}
DIALECTS = "generic ansi bigquery clickhouse databricks duckdb hive mssql mysql postgres redshift snowflake sqlite".split()
GROUP_BY_ALIAS = set("bigquery clickhouse databricks duckdb hive mysql redshift sqlite".split())
HAVING_ALIAS = GROUP_BY_ALIAS
LATERAL_ALIAS = set("bigquery clickhouse databricks duckdb hive redshift snowflake".split())
BRACKETS = {"mssql", "sqlite", "generic"}
#: Arguments, from 0, that are a unit of time and not a column, by function (without underscores) and dialect.
UNITS = {
    "datediff": {"mssql": 0, "redshift": 0, "snowflake": 0},
    "dateadd": {"mssql": 0, "snowflake": 0},
    "datepart": {"postgres": 0, "redshift": 0, "snowflake": 0},
    "datetrunc": {"bigquery": 1, "databricks": 0, "duckdb": 0, "postgres": 0, "redshift": 0, "snowflake": 0},
    "timestampadd": {"bigquery": 1, "snowflake": 0},
    "timestampsub": {"bigquery": 1},
}

#: Aggregates that mark an output column as aggregated.
AGGREGATES = set(
    """agg_func ai_agg ai_summarize_agg any_value approximate_similarity approx_distinct approx_quantile approx_quantiles approx_top_k
    approx_top_k_accumulate approx_top_k_combine approx_top_sum arg_max arg_min array_agg array_concat_agg array_union_agg array_unique_agg avg
    bitmap_construct_agg bitmap_or_agg bitwise_and_agg bitwise_or_agg bitwise_xor_agg logical_and logical_or boolxor_agg combined_agg_func
    combined_parameterized_agg corr count count_if covar_pop covar_samp first grouping grouping_id group_concat hll jsonb_object_agg json_object_agg last
    max median min minhash minhash_combine object_agg parameterized_agg quantile skewness stddev stddev_pop stddev_samp sum sum_if variance
    variance_pop""".split()
)

CANONICAL = {
    "INTEGER": "int int4 integer int64 bigint smallint tinyint int2 int8",
    "FLOAT": "float float4 float8 double real decimal numeric number",
    "TEXT": "varchar char text string nvarchar nchar character",
    "BOOLEAN": "bool boolean",
    "TIMESTAMP": "timestamp timestamptz datetime timestamp_ntz timestamp_ltz timestamp_tz",
    "DATE": "date",
    "TIME": "time timetz",
    "BINARY": "binary varbinary bytea blob bytes",
    "JSON": "json jsonb variant object",
    "ARRAY": "array",
}
_BY_NAME = {n: k for k, names in CANONICAL.items() for n in names.split()}
#: Return types of functions known to have one.
RETURNS = {
    "count": "INTEGER", "row_number": "INTEGER", "rank": "INTEGER", "dense_rank": "INTEGER", "ntile": "INTEGER", "avg": "FLOAT", "concat": "TEXT", "concat_ws": "TEXT",
    "lower": "TEXT", "upper": "TEXT", "trim": "TEXT", "replace": "TEXT", "substring": "TEXT", "current_date": "DATE", "current_timestamp": "TIMESTAMP", "now": "TIMESTAMP",
    "date_trunc": "TIMESTAMP", "left": "TEXT", "right": "TEXT", "ltrim": "TEXT", "rtrim": "TEXT", "chr": "TEXT", "initcap": "TEXT", "getdate": "TIMESTAMP", "sysdate": "TIMESTAMP",
    "timeofday": "TIMESTAMP", "curdate": "DATE", "today": "DATE",
}
#: Functions whose type is that of their first argument.
LIKE_FIRST = {"sum", "min", "max", "any_value", "lag", "lead", "first_value", "last_value"}
NUMBERS = {"INTEGER", "FLOAT"}
#: Dialects in which a boolean compares with an integer.
LOOSE_BOOLEANS = {"mysql", "mssql", "sqlite", "generic"}


def comparable(a: str, b: str, dialect: str) -> bool:
    """Whether values of two canonical types may be compared: of one type, both numbers, or both points in time."""
    if a == b or {a, b} <= NUMBERS or {a, b} == {"DATE", "TIMESTAMP"}:
        return True
    return {a, b} == {"BOOLEAN", "INTEGER"} and dialect in LOOSE_BOOLEANS


def number_like(kind: str) -> bool:
    """Whether a canonical type is a number. No other type becomes a FLOAT by itself."""
    return kind in NUMBERS


def canonical_type(name: str | None) -> str | None:
    if not name:
        return None
    head = name.strip().lower().split("(")[0].split("<")[0].split()
    return _BY_NAME.get(head[0].rstrip("[]")) if head else None


def strip(part: str) -> tuple[str, bool]:
    """A name without its quotes, and whether it had some."""
    if len(part) >= 2 and part[0] in "\"`['" and part[-1] in "\"`]'":
        return part[1:-1].replace('""', '"').replace("``", "`"), True
    return part, False


def fold(part: str, dialect: str) -> str:
    name, quoted = strip(part)
    how = FOLD.get(dialect, "insensitive")
    if how == "exact" or quoted and how in ("upper", "lower"):
        return name
    return name.upper() if how == "upper" else name.lower()
