"""Names of SQL functions in many dialects, and how Spark says them.

A name that Spark knows stands for itself; RENAMED has the others as Spark SQL over $1, $2 and so on. Names that nothing in
Spark corresponds to (external services, placeholders, sequences) are in ABSENT: lineage knows them, nothing runs them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.lineage.dialects import AGGREGATES

WINDOWS = set("row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value percentile_cont percentile_disc".split())

_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
#: A time cut down to a whole number of strides from an origin, in microseconds.
_BIN = "timestamp_micros(unix_micros({t}) - pmod(unix_micros({t}) - unix_micros({o}), unix_micros(" + _EPOCH + " + {s}) - unix_micros(" + _EPOCH + ")))"
_WORDS = "filter(split(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def _unquoted(arg: str) -> str:
    return arg.strip().strip("'\"")


def _standard_hash(value: str, method: str) -> str:
    how = _unquoted(method).lower().replace("-", "")
    if how not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        raise ValueError(f"standard_hash knows no {method}")
    return f"{how}({value})" if how in ("md5", "sha1") else f"sha2({value}, {how[3:]})"


def _approx_quantiles(value: str, parts: str) -> str:
    n = int(parts)
    return f"percentile_approx({value}, array({', '.join(str(i / n) for i in range(n + 1))}))"


def _time_slice(at: str, length: str, unit: str) -> str:
    u = _unquoted(unit).upper()
    if u not in ("SECOND", "MINUTE", "HOUR", "DAY"):
        raise ValueError(f"time_slice by {u} has no fixed length")
    return _BIN.format(s=f"make_dt_interval({', '.join(length if u == x else '0' for x in ('DAY', 'HOUR', 'MINUTE', 'SECOND'))})", t=at, o=_EPOCH)


def _convert(a: str, b: str) -> str:
    """convert(type, value) or convert(value, type)."""
    kind = re.compile(r"(?:(?:big|small|tiny)?int|integer|long|short|byte|float|double|string|boolean|date|timestamp|binary|decimal|numeric|varchar|char)(?:\s*\([\d, ]+\))?", re.I)
    if kind.fullmatch(a.strip()):
        a, b = b, a
    return f"cast({a} AS {b})"


def _case(*args: str) -> str:
    """CASE of tests and values in turn, and perhaps what else."""
    pairs = [f"WHEN {args[i]} THEN {args[i + 1]}" for i in range(0, len(args) - 1, 2)]
    return f"CASE {' '.join(pairs)}{f' ELSE {args[-1]}' if len(args) % 2 else ''} END"


def _justify(days: bool) -> str:
    """Hours as days, which taking an interval apart does by itself, and perhaps days as months of 30."""
    part = lambda p: f"extract({p} FROM $1)"
    month = f"{part('MONTH')} + cast({part('DAY')} / 30 AS int)" if days else part("MONTH")
    return f"make_interval({part('YEAR')}, {month}, 0, {part('DAY')}{' % 30' if days else ''}, {part('HOUR')}, {part('MINUTE')}, {part('SECOND')})"


def _file(kind: str):
    return lambda path: f"{kind}.`{_unquoted(path)}`"


#: dialects' names and Spark's expression for each.
RENAMED = {
    "approx_distinct": "approx_count_distinct($1)", "approx_quantile": "percentile_approx($1, $2)", "arg_max": "max_by($1, $2)", "arg_min": "min_by($1, $2)",
    "array_concat_agg": "flatten(collect_list($1))", "array_union_agg": "array_distinct(flatten(collect_list($1)))", "array_unique_agg": "collect_set($1)", "bitwise_and_agg": "bit_and($1)",
    "bitwise_or_agg": "bit_or($1)", "bitwise_xor_agg": "bit_xor($1)", "logical_and": "bool_and($1)", "logical_or": "bool_or($1)", "group_concat": {1: "array_join(collect_list(cast($1 as string)), ',')", 2: "array_join(collect_list(cast($1 as string)), $2)"},
    "hll": "approx_count_distinct($1)", "object_agg": "to_json(map_from_entries(collect_list(struct($1, $2))))", "json_object_agg": "to_json(map_from_entries(collect_list(struct($1, $2))))",
    "quantile": "percentile($1, $2)", "variance_pop": "var_pop($1)", "sum_if": "sum(CASE WHEN $2 THEN $1 END)", "boolxor_agg": "(count_if($1) % 2) = 1",
    "array_concat": "concat($*)", "array_length": "size($1)", "array_first": "element_at($1, 1)", "array_last": "element_at($1, -1)", "array_reverse": "reverse($1)", "array_sum": "aggregate($1, 0D, (a, x) -> a + x)",
    "array_to_string": "array_join($1, $2)", "array_contains_all": "size(array_except($2, $1)) = 0", "array_any": "exists($1, x -> x)", "array_all": "forall($1, x -> x)", "bitwise_and": "($1 & $2)", "bitwise_or": "($1 | $2)",
    "bitwise_xor": "($1 ^ $2)", "bitwise_not": "(~$1)", "bitwise_left_shift": "shiftleft($1, $2)", "bitwise_right_shift": "shiftright($1, $2)", "booland": "($1 AND $2)", "boolor": "($1 OR $2)",
    "cosine_distance": "(1 - aggregate(zip_with($1, $2, (a, b) -> a * b), 0D, (s, x) -> s + x) / sqrt(aggregate($1, 0D, (s, x) -> s + x * x) * aggregate($2, 0D, (s, x) -> s + x * x)))",
    "date_from_parts": "make_date($1, $2, $3)", "timestamp_from_parts": "make_timestamp($1, $2, $3, $4, $5, $6)", "date_str_to_date": "to_date($1)", "day_of_month": "dayofmonth($1)", "day_of_week": "dayofweek($1)",
    "day_of_year": "dayofyear($1)", "week_of_year": "weekofyear($1)", "datetime_add": {2: "($1 + $2)", 3: "timestampadd($3, $2, $1)"}, "datetime_diff": {2: "timestampdiff(DAY, $2, $1)", 3: "timestampdiff($3, $2, $1)"}, "generate_series": {2: "sequence($1, $2)", 3: "sequence($1, $2, $3)"},
    "generate_date_array": {2: "sequence($1, $2)", 3: "sequence($1, $2, $3)"}, "is_inf": "(abs($1) = double('infinity'))", "is_nan": "isnan($1)", "json_extract": "get_json_object($1, $2)", "json_extract_scalar": "get_json_object($1, $2)",
    "json_format": "to_json($1)", "parse_json": "parse_json($1)", "length": "char_length($1)", "str_position": "instr($1, $2)", "starts_with": "startswith($1, $2)", "ends_with": "endswith($1, $2)", "contains": "contains($1, $2)",
    "string_to_array": "split($1, $2)", "str_to_map": "str_to_map($1)", "str_to_time": "to_timestamp($1, $2)", "time_to_str": "date_format($1, $2)", "unix_to_time": "timestamp_seconds($1)", "time_to_unix": "unix_timestamp($1)",
    "safe_divide": "try_divide($1, $2)", "safe_add": "try_add($1, $2)", "safe_subtract": "try_subtract($1, $2)", "safe_multiply": "try_multiply($1, $2)", "regexp_i_like": "rlike($1, concat('(?i)', $2))", "md5_digest": "unhex(md5($1))",
    "sha": "sha1($1)", "sha2_digest": "unhex(sha2($1, 256))", "square": "($1 * $1)", "int_div": "($1 DIV $2)", "nullif0": "nullif($1, 0)", "zeroifnull": "coalesce($1, 0)", "nvl2": "nvl2($1, $2, $3)",
    "approx_quantiles": _approx_quantiles, "bitwise_count": "bit_count($1)", "byte_length": "octet_length($1)", "day_of_week_iso": "(weekday($1) + 1)", "exploding_generate_series": {2: "explode(sequence($1, $2))", 3: "explode(sequence($1, $2, $3))"}, "format": "format_string($*)",
    "from_base": "conv($1, $2, 10)", "stuff": "overlay($1, $4, $2, $3)", "is_ascii": "rlike($1, '^[\\\\x00-\\\\x7F]*$')", "lower_hex": "lower(hex($1))", "object_insert": "map_concat($1, map($2, $3))", "previous_day": "(next_day($1, $2) - 7)",
    "range_bucket": "size(filter($2, b -> b <= $1))", "regexp_full_match": "rlike($1, concat('^(?:', $2, ')$'))", "regexp_split": "split($1, $2)", "rtrimmed_length": "char_length(rtrim($1))", "safe_negate": "try_subtract(0, $1)",
    "standard_hash": {1: "sha1($1)", 2: _standard_hash}, "to_map": "map_from_arrays($1, $2)", "star_map": "map_from_arrays($1, $2)", "week": "weekofyear($1)", "search": "(size(array_except(" + _WORDS.format("$2") + ", " + _WORDS.format("$1") + ")) = 0)", "match_against": "arrays_overlap(" + _WORDS.format("$1") + ", " + _WORDS.format("$2") + ")", "list": "array($*)", "to_array": "array($*)",
    "time_from_parts": "date_format(make_timestamp(1970, 1, 1, $1, $2, $3), 'HH:mm:ss')", "number_to_str": "format_number($1, $2)", "unnest": "explode($1)", "convert_to_charset": "decode(encode($1, $2), $2)", "array_construct_compact": "array_compact(array($*))", "date_bin": {2: _BIN.format(s="$1", t="$2", o="TIMESTAMP '1970-01-01 00:00:00'"), 3: _BIN.format(s="$1", t="$2", o="$3")}, "time_slice": {2: _BIN.format(s="$2", t="$1", o="TIMESTAMP '1970-01-01 00:00:00'"), 3: _time_slice},
    "regr_valx": "CASE WHEN $1 IS NOT NULL THEN $2 END", "regr_valy": "CASE WHEN $2 IS NOT NULL THEN $1 END", "generate_timestamp_array": "sequence($1, $2, $3)", "get_extract": "element_at($1, $2)", "safe_convert_bytes_to_string": "try_validate_utf8(cast($1 as string))",
    "is_null_value": "is_variant_null($1)", "exists": "exists($1, $2)", "apply": "transform($1, $2)", "xml_element": "to_xml(struct($1))", "decode_case": "decode($*)", "range_n": "(floor(($1 - $2) / $3) + 1)",
    "last_day": "last_day($1)", "months_between": "months_between($1, $2)", "to_days": "(datediff($1, DATE '0001-01-01') + 366)", "var_map": "map_from_arrays($1, $2)", "struct_extract": "$1.$2", "unicode": "ascii($1)", "chr": "decode(unhex(lpad(hex($1), 8, '0')), 'UTF-32')", "hex_string": "hex($1)",
    "levenshtein_distance": "levenshtein($1, $2)", "xor": "(($1 AND NOT $2) OR (NOT $1 AND $2))", "space": "repeat(' ', $1)", "pad": "lpad($1, $2, $3)", "convert": _convert, "try_cast": "try_cast($1 AS $2)", "cast": "cast($1 AS $2)", "extract": "extract($1 FROM $2)", "case": _case, "and": "($1 AND $2)", "or": "($1 OR $2)",
    "justify_hours": _justify(False), "justify_days": _justify(True), "justify_interval": _justify(True), "json_table": "explode(from_json(get_json_object($1, $2), 'array<string>'))", "open_json": "explode(from_json($1, 'map<string,string>'))",
    "xml_table": "explode(xpath($1, $2))", "st_point": "named_struct('x', $1, 'y', $2)", "read_parquet": _file("parquet"), "read_csv": _file("csv"), "code_points_to_bytes": "unhex(array_join(transform($1, x -> lpad(hex(x), 2, '0')), ''))",
    "json_object": "to_json(named_struct($*))", "euclidean_distance": "sqrt(aggregate(zip_with($1, $2, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))",
}
#: Known names without anything to run.
ABSENT = set(
    """agg_func combined_agg_func combined_parameterized_agg parameterized_agg ai_agg ai_classify ai_summarize_agg anonymous generate_embedding
    ml_forecast ml_translate next_value_for predict features_at_time farm_fingerprint soundex_p123 try columns connect_by_root vector_search""".split()
)


#: Types by the names that casting functions carry.
_CASTS = {"float64": "double", "double": "double", "int64": "bigint", "bool": "boolean", "string": "string", "bignumeric": "decimal(38,9)", "numeric": "decimal(38,9)", "str_type": "string"}
#: By what a name ends in and the number of arguments: an interval, or an amount and its unit; u is the unit of two numbers.
_UNIT = {
    "add": {2: "($1 + $2)", 3: "timestampadd($3, $2, $1)"}, "sub": {2: "($1 - $2)", 3: "timestampadd($3, -($2), $1)"}, "diff": {2: "timestampdiff({u}, $2, $1)", 3: "timestampdiff($3, $2, $1)"},
    "trunc": {2: "date_trunc($2, $1)"},
}
_TO = {
    "date": "to_date($1)", "time": "to_timestamp($1)", "datetime": "to_timestamp($1)", "timestamp": "to_timestamp($1)", "unix": "unix_timestamp($1)", "date_str": "date_format($1, 'yyyy-MM-dd')",
    "time_str": "cast($1 as string)", "di": "cast(date_format($1, 'yyyyMMdd') as int)", "str": "cast($1 as string)",
}
_JSON = {
    "extract": "get_json_object($1, $2)", "extract_scalar": "get_json_object($1, $2)", "exists": "(get_json_object($1, $2) IS NOT NULL)", "extract_array": "from_json(get_json_object($1, $2), 'array<string>')",
    "value_array": "from_json(get_json_object($1, $2), 'array<string>')", "array": "to_json(array($*))", "array_agg": "to_json(collect_list($1))", "object": "to_json(map($*))", "object_agg": "to_json(map_from_entries(collect_list(struct($1, $2))))",
    "cast": "parse_json($1)", "type": "schema_of_variant(parse_json($1))", "contains": "array_contains(from_json($1, 'array<string>'), cast($2 as string))", "array_contains": "array_contains(from_json($1, 'array<string>'), cast($2 as string))",
    "contains_all_top_keys": "(size(array_except($2, json_object_keys($1))) = 0)", "contains_any_top_keys": "arrays_overlap($2, json_object_keys($1))",
}
_CODEC = {"base64": ("base64($1)", "unbase64($1)"), "hex": ("hex($1)", "unhex($1)")}


def by_rule(name: str) -> str | dict[int, str] | None:
    """Spark SQL for names that follow a pattern: casts, date parts, codecs, JSON, reciprocals, null-ignoring forms."""
    n = name.lower()
    if m := re.fullmatch(r"(?:lax_|json_|parse_|cast_to_|to_|try_to_)?(\w+)", n):
        if m[1] in _CASTS and n not in ("string", "double"):
            return f"try_cast($1 AS {_CASTS[m[1]]})" if n.startswith(("lax_", "try_")) else f"cast($1 AS {_CASTS[m[1]]})"
    if m := re.fullmatch(r"(?:date|datetime|timestamp|time|ts_or_ds)_(add|sub|diff|trunc)", n):
        if n in ("ts_or_ds_add", "ts_or_ds_diff"):  # days, unless a unit is given
            return {2: "timestampadd(DAY, $2, $1)" if n.endswith("add") else "timestampdiff(DAY, $2, $1)", 3: _UNIT[m[1]][3]}
        return {k: t.format(u="DAY" if n.startswith("date") else "SECOND") if "{u}" in t else t for k, t in _UNIT[m[1]].items()}
    if m := re.fullmatch(r"(?:ts_or_ds|ts_or_di|str|time_str|time|date|parse|from_iso8601)_?(?:to_)?(date_str|time_str|datetime|timestamp|date|time|unix|di|str)", n):
        return _TO[m[1]]
    if m := re.fullmatch(r"unix_to_(str|time_str)", n):
        return "from_unixtime($1)"
    if n == "di_to_date":
        return "to_date(cast($1 as string), 'yyyyMMdd')"
    if m := re.fullmatch(r"jsonb?_(\w+)", n):
        return _JSON.get(m[1])
    if m := re.fullmatch(r"(?:try_)?(?:to_|from_)?(base64|hex)_?(encode|decode)?(?:_(string|binary))?", n):
        code = _CODEC[m[1]][n.startswith("from_") or m[2] == "decode"]
        return f"cast({code} as string)" if m[3] == "string" and "decode" in n else code
    if n in ("coth", "csch", "sech"):
        return {"coth": "(cosh($1) / sinh($1))", "csch": "(1 / sinh($1))", "sech": "(1 / cosh($1))"}[n]
    if m := re.fullmatch(r"(\w+)_ignore_nulls", n):
        return f"{m[1]}($*)"
    if m := re.fullmatch(r"(md5|sha1|sha2)_?digest", n):
        return f"unhex({m[1]}($1{', 256' if m[1] == 'sha2' else ''}))"
    if m := re.fullmatch(r"(?:current_|utc_)(datetime|date|timestamp|timestamp_ltz|time)", n):
        return {"date": "current_date()", "time": "date_format(current_timestamp(), 'HH:mm:ss')"}.get(m[1], "current_timestamp()")
    if m := re.fullmatch(r"array_(filter|slice|overlaps)", n):
        return {"filter": "filter($1, $2)", "slice": "slice($1, $2, $3)", "overlaps": "arrays_overlap($1, $2)"}[m[1]]
    if m := re.fullmatch(r"bool(not|and|or)", n):
        return {"not": "(NOT $1)", "and": "($1 AND $2)", "or": "($1 OR $2)"}[m[1]]
    if m := re.fullmatch(r"md5number_(lower|upper)64", n):
        return f"conv(substring(md5($1), {17 if m[1] == 'lower' else 1}, 16), 16, 10)"
    if m := re.fullmatch(r"timestamp_(?:ltz|tz)_from_parts", n):
        return "make_timestamp($*)"
    if m := re.fullmatch(r"year_of_week(?:_iso)?", n):
        return "extract(YEAROFWEEK FROM $1)"
    return None


#: Names whose work no Spark function does, done by functions.custom.
CUSTOM = set("json_set json_remove json_strip_nulls json_array_append json_array_insert jsonb_delete_at_path json_keys_at_depth to_base32 from_base32 normalize compress decompress_binary decompress_string parse_ip st_distance to_code_points code_points_to_string minhash minhash_combine approximate_similarity jarowinkler_similarity".split())
#: Names that are operators over tables here.
OPERATORS = {"gap_fill": "operators.relational.gap_fill", "approx_top_sum": "operators.relational.top_sum"}


@lru_cache(maxsize=1)
def _builtin_of(session_id: int) -> frozenset[str]:
    spark = SparkSession.active()
    return frozenset(r[0].lower() for r in spark.sql("SHOW ALL FUNCTIONS").collect())


def builtin() -> frozenset[str]:
    return _builtin_of(id(SparkSession.active()))


def category(name: str) -> str:
    n = name.lower()
    return "aggregate" if n in AGGREGATES else "window" if n in WINDOWS else "scalar"


def template_of(name: str):
    """What stands for a name: Spark SQL over $1, $2 and so on or $* for all, one such for each number of arguments, or a function of them."""
    n = name.lower()
    return RENAMED.get(n) or (None if n in builtin() else by_rule(n))


def spark_sql(name: str, *args: str) -> str:
    """Spark SQL for a call; ValueError if nothing in Spark corresponds, or with too few or too many arguments."""
    n = name.lower()
    if n in ABSENT:
        raise ValueError(f"{name} has no counterpart in Spark")
    template = template_of(n)
    if callable(template):
        try:
            return template(*args)
        except TypeError:
            raise ValueError(f"{name} does not take {len(args)} arguments") from None
    if isinstance(template, dict):
        if len(args) not in template:
            raise ValueError(f"{name} does not take {len(args)} arguments")
        template = template[len(args)]
        if callable(template):
            return template(*args)
    if template:
        most = max((int(k) for k in re.findall(r"\$(\d)", template)), default=0)
        if "$*" not in template and len(args) != most:
            raise ValueError(f"{name} takes {most} arguments, not {len(args)}")
        return re.sub(r"\$(\d)", lambda m: args[int(m[1]) - 1], template.replace("$*", ", ".join(args)))
    if n in builtin():
        return f"{n}({', '.join(args)})"
    raise ValueError(f"{name} is not a known function")


def call(name: str, *args: str) -> Column:
    return F.expr(spark_sql(name, *args))


def coverage(spark: SparkSession, names: list[str]):
    """(name, category, spark) for names, spark null where nothing corresponds."""
    rows = []
    for n in names:
        how = None if n in ABSENT else template_of(n) or (n if n in builtin() else "functions.custom" if n in CUSTOM else OPERATORS.get(n))
        how = how if how is None or isinstance(how, str) else "; ".join(map(str, how.values())) if isinstance(how, dict) else f"functions.catalog.{how.__name__}"
        rows.append((n, category(n), how))
    return spark.createDataFrame(rows, "name string, category string, spark string")
