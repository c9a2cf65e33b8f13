"""Scalar functions by family, each checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, QUERIES, query, read
from tidemark.functions import custom
from tidemark.functions.catalog import CUSTOM, call, spark_sql
from tidemark.functions.examples import EXAMPLES

#: Rows of which an aggregate that keeps every value holds the values at once.
PART = 4096


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, substr(c_name, 1, 4) AS sub, replace(c_name, '#', '-') AS rep, trim('  ' || c_mktsegment || ' ') AS tr,
  lpad(c_custkey::VARCHAR, 8, '0') AS pad, reverse(c_mktsegment) AS rev, instr(c_name, '#') AS pos, split_part(c_name, '#', 2) AS part, c_name || '/' || c_mktsegment AS cat, repeat('ab', 2) AS twice,
  starts_with(c_mktsegment, 'M') AS m, contains(c_mktsegment, 'OU') AS ou, left(c_name, 3) AS l3, right(c_name, 3) AS r3, ascii(c_mktsegment) AS code, levenshtein(c_mktsegment, 'MACHINE') AS dist FROM customer""")
def fn_string(spark, sf):
    n, m = "c_name", "c_mktsegment"
    return read(spark, sf, "customer").select(
        "c_custkey", F.upper(n).alias("up"), F.lower(m).alias("low"), call("length", n).alias("len"), F.substring(n, 1, 4).alias("sub"), F.replace(n, F.lit("#"), F.lit("-")).alias("rep"),
        F.trim(F.concat(F.lit("  "), m, F.lit(" "))).alias("tr"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("pad"), F.reverse(m).alias("rev"), call("str_position", n, "'#'").alias("pos"),
        F.split_part(n, F.lit("#"), F.lit(2)).alias("part"), F.concat_ws("/", n, m).alias("cat"), F.repeat(F.lit("ab"), 2).alias("twice"), call("starts_with", m, "'M'").alias("m"), call("contains", m, "'OU'").alias("ou"),
        F.left(n, F.lit(3)).alias("l3"), F.right(n, F.lit(3)).alias("r3"), F.ascii(m).alias("code"), call("levenshtein_distance", m, "'MACHINE'").alias("dist"),
    )


@query("""SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice / 7) ::BIGINT AS c, floor(p_retailprice / 7)::BIGINT AS f, round(p_retailprice / 7, 2) AS r, sqrt(p_size) AS s, p_size % 7 AS m, power(p_size, 2) AS p2,
  sign(p_size - 25)::DOUBLE AS sg, round(ln(p_size), 9) AS ln, round(exp(p_size / 50.0), 9) AS e, greatest(p_size, 25) AS g, least(p_size, 25) AS l, p_size // 7 AS d, p_size & 6 AS ba, p_size | 9 AS bo, xor(p_size, 5) AS bx, p_size << 2 AS sl, bit_count(p_size)::INT AS bc,
  round(sin(p_size), 9) AS si, round(atan2(p_size, 3), 9) AS at, round(degrees(p_size), 6) AS dg FROM part""")
def fn_math(spark, sf):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return read(spark, sf, "part").select(
        "p_partkey", F.abs(-s).alias("a"), F.ceil(r / 7).alias("c"), F.floor(r / 7).alias("f"), F.round(r / 7, 2).alias("r"), F.sqrt(s).alias("s"), (s % 7).alias("m"), F.pow(s, F.lit(2)).alias("p2"),
        F.signum(s - 25).alias("sg"), F.round(F.ln(s), 9).alias("ln"), F.round(F.exp(s / 50.0), 9).alias("e"), F.greatest(s, F.lit(25)).alias("g"), F.least(s, F.lit(25)).alias("l"), call("int_div", "p_size", "7").cast("int").alias("d"),
        call("bitwise_and", "p_size", "6").alias("ba"), call("bitwise_or", "p_size", "9").alias("bo"), call("bitwise_xor", "p_size", "5").alias("bx"), call("bitwise_left_shift", "p_size", "2").alias("sl"), F.bit_count(s).alias("bc"),
        F.round(F.sin(s), 9).alias("si"), F.round(F.atan2(s, F.lit(3.0)), 9).alias("at"), F.round(F.degrees(s), 6).alias("dg"),
    )


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, dayofyear(o_orderdate)::INT AS dy, weekofyear(o_orderdate)::INT AS w, hour(o_orderdate)::INT AS h,
  date_trunc('month', o_orderdate)::TIMESTAMP AS tm, last_day(o_orderdate::DATE)::DATE::VARCHAR AS ld, (o_orderdate::DATE + 10)::VARCHAR AS plus, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS diff, epoch(o_orderdate)::BIGINT AS unix,
  strftime(o_orderdate, '%Y-%m-%d') AS txt, make_date(year(o_orderdate), 1, 1)::VARCHAR AS jan, (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE::VARCHAR AS two FROM orders""")
def fn_date(spark, sf):
    d = "o_orderdate"
    day = F.col(d).cast("date")
    return read(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), call("day_of_month", d).alias("d"), call("day_of_year", d).alias("dy"), call("week_of_year", d).alias("w"), F.hour(d).alias("h"),
        F.date_trunc("month", d).alias("tm"), call("last_day", d).cast("string").alias("ld"), F.date_add(day, 10).cast("string").alias("plus"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("diff"), F.unix_timestamp(d).alias("unix"),
        call("time_to_str", d, "'yyyy-MM-dd'").alias("txt"), call("date_from_parts", f"year({d})", "1", "1").cast("string").alias("jan"), F.add_months(day, 2).cast("string").alias("two"),
    )


@query("""SELECT event_id, coalesce(nullif(event_type, 'click'), 'c') AS co, CASE WHEN value > 50 THEN 'big' END AS ca, if(value > 10, 1, 0) AS i, ifnull(nullif(user_id, 3), -1) AS nv, try_cast('x' AS INT) AS tc, value IS NULL AS nn,
  event_type IN ('click', 'error') AS inl, value BETWEEN 5 AND 20 AS bt, user_id IS DISTINCT FROM 5 AS idf, value::INT::VARCHAR AS v FROM (SELECT event_id, event_type, user_id, floor(value) AS value FROM events)""")
def fn_conditional(spark, sf):
    e = read(spark, sf, "events").withColumn("value", F.floor("value").cast("double"))
    return e.select(
        "event_id", F.coalesce(F.nullif(F.col("event_type"), F.lit("click")), F.lit("c")).alias("co"), F.when(F.col("value") > 50, "big").alias("ca"), F.expr("if(value > 10, 1, 0)").alias("i"), F.expr("nvl(nullif(user_id, 3), -1)").alias("nv"),
        F.expr("try_cast('x' AS INT)").alias("tc"), F.col("value").isNull().alias("nn"), F.col("event_type").isin("click", "error").alias("inl"), F.col("value").between(5, 20).alias("bt"),
        (~F.col("user_id").eqNullSafe(5)).alias("idf"), F.col("value").cast("int").cast("string").alias("v"),
    )


@query("""SELECT event_id, (props::JSON ->> '$.k')::INT AS k, json_extract_string(props, '$.none') AS none, json_type(props, '$.k') IS NOT NULL AS has FROM events""")
def fn_json(spark, sf):
    got = call("json_extract_scalar", "props", "'$.k'")
    return read(spark, sf, "events").select("event_id", got.cast("int").alias("k"), call("json_extract_scalar", "props", "'$.none'").alias("none"), got.isNotNull().alias("has"))


@query("""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w, [p_size, p_size + 1, 3] AS n FROM part)
SELECT p_partkey, len(w) AS size, w[1] AS head, w[-1] AS tail, array_to_string(w, '-') AS joined, list_contains(w, 'ring') AS ring, array_to_string(list_sort(n), ',') AS sorted, list_sum(n)::DOUBLE AS total, array_to_string(list_transform(n, lambda x: x * 2), ',') AS twice,
  array_to_string(list_filter(n, lambda x: x > 10), ',') AS big, list_max(n) AS top, list_position(w, 'red')::BIGINT AS at, array_to_string(list_distinct(n).list_sort(), ',') AS uniq, array_to_string(list_concat(n, [0]), ',') AS more, array_to_string(list_slice(n, 2, 3), ',') AS cut, array_to_string(flatten([n, [1]]), ',') AS flat FROM a""")
def fn_array(spark, sf):
    a = read(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.array(F.col("p_size"), F.col("p_size") + 1, F.lit(3)).alias("n"))
    return a.select(
        "p_partkey", call("array_length", "w").alias("size"), call("array_first", "w").alias("head"), call("array_last", "w").alias("tail"), call("array_to_string", "w", "'-'").alias("joined"), F.array_contains("w", "ring").alias("ring"),
        F.array_join(F.sort_array("n"), ",").alias("sorted"), call("array_sum", "n").alias("total"), F.array_join(F.transform("n", lambda x: x * 2), ",").alias("twice"), F.array_join(F.filter("n", lambda x: x > 10), ",").alias("big"), F.array_max("n").alias("top"),
        F.nullif(F.array_position("w", "red"), F.lit(0)).alias("at"), F.array_join(F.sort_array(F.array_distinct("n")), ",").alias("uniq"), F.array_join(call("array_concat", "n", "array(0)"), ",").alias("more"), F.array_join(F.slice("n", 2, 2), ",").alias("cut"), F.array_join(F.flatten(F.array(F.col("n"), F.array(F.lit(1)))), ",").alias("flat"),
    )


@query("""SELECT c_custkey, regexp_matches(c_name, '0[1-3]$') AS m, regexp_replace(c_name, '[0-9]+', 'N') AS r, regexp_extract(c_name, '#0*([0-9]+)', 1) AS x, len(regexp_extract_all(c_name, '0')) AS n, c_mktsegment LIKE 'M%' AS lk, c_mktsegment ILIKE '%hold%' AS il,
  md5(c_name) AS md, sha256(c_name) AS sh, hex(c_mktsegment) AS hx, base64(c_mktsegment::BLOB) AS b64 FROM customer""")
def fn_regex_hash(spark, sf):
    n, m = "c_name", "c_mktsegment"
    return read(spark, sf, "customer").select(
        "c_custkey", F.col(n).rlike("0[1-3]$").alias("m"), F.regexp_replace(n, "[0-9]+", "N").alias("r"), F.regexp_extract(n, "#0*([0-9]+)", 1).alias("x"), F.regexp_count(F.col(n), F.lit("0")).alias("n"),
        F.col(m).like("M%").alias("lk"), F.col(m).ilike("%hold%").alias("il"), F.md5(n).alias("md"), F.sha2(n, 256).alias("sh"), F.hex(m).alias("hx"), F.base64(F.col(m).cast("binary")).alias("b64"),
    )


@query("""SELECT event_type, bit_and(user_id) AS ba, bit_or(user_id) AS bo, bit_xor(user_id) AS bx, bool_or(value > 99) AS any_big, arg_max(event_id, event_id) AS top, count(DISTINCT user_id) AS users, round(corr(value, user_id), 9) AS co, round(covar_pop(value, user_id), 6) AS cp,
  round(skewness(value), 6) AS sk, mode(event_type) AS mo FROM events GROUP BY event_type""")
def fn_aggregate(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(
        call("bitwise_and_agg", "user_id").alias("ba"), call("bitwise_or_agg", "user_id").alias("bo"), call("bitwise_xor_agg", "user_id").alias("bx"), call("logical_or", "value > 99").alias("any_big"), call("arg_max", "event_id", "event_id").alias("top"),
        F.countDistinct("user_id").alias("users"), F.round(F.corr("value", "user_id"), 9).alias("co"), F.round(F.covar_pop("value", "user_id"), 6).alias("cp"), F.round(F.skewness("value") * F.sqrt(F.count("value") * (F.count("value") - 1)) / (F.count("value") - 2), 6).alias("sk"), F.mode("event_type").alias("mo"),
    )


@query("""SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag""")
def fn_user_aggregate(spark, sf):
    means = custom.geometric_mean(read(spark, sf, "lineitem").where("l_quantity > 0"), ["l_returnflag"], "l_quantity", "g")
    return means.withColumn("g", F.round("g", 6))


@query("""SELECT p_partkey, (i - 1)::INT AS place, list_extract(string_split(p_name, ' '), i) AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def fn_user_table(spark, sf):
    spark.udtf.register("word_places", custom.word_places())
    read(spark, sf, "part").createOrReplaceTempView("tidemark_part")
    return spark.sql("SELECT p_partkey, w.place, w.word FROM tidemark_part, LATERAL word_places(p_name) w")


def _examples(family: str) -> None:
    rows = EXAMPLES[family]
    names = [f"{n}_{sum(m == n for m, *_ in rows[:i]) + 1}" for i, (n, *_) in enumerate(rows)]
    quote = lambda v: "NULL::VARCHAR" if v is None else "'" + v.replace("'", "''") + "'"
    sql = ", ".join(f"{quote(v)} AS {c}" for c, (_, _, v) in zip(names, rows, strict=True))

    def run(spark, sf):
        values = [F.expr(f"cast({spark_sql(n, *a)} AS string)").alias(c) if n not in CUSTOM else custom.call(n, *[F.expr(x) for x in a]).cast("string").alias(c) for c, (n, a, _) in zip(names, rows, strict=True)]
        return read(spark, sf, "region").select("r_regionkey", *values)

    QUERIES[f"fn_values_{family}"] = run
    ORACLES[f"fn_values_{family}"] = f"SELECT r_regionkey, {sql} FROM region"


for _family in EXAMPLES:
    _examples(_family)


@query("""SELECT l_returnflag, any_value(l_returnflag) AS any_, avg(l_quantity) AS avg_, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx, (count(*) FILTER (l_quantity > 10) % 2) = 1 AS xo,
  round(corr(l_quantity, l_tax), 9) AS co, count(*) AS n, count(*) FILTER (l_quantity > 10) AS ci, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, bool_and(l_quantity > 0) AS la, bool_or(l_quantity > 49) AS lo,
  max(l_quantity) AS mx, min(l_quantity) AS mn, median(l_quantity) AS md, quantile_cont(l_quantity, 0.25) AS qu, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, sum(l_linenumber)::BIGINT AS su, round(variance(l_quantity), 6) AS va,
  round(var_pop(l_quantity), 6) AS vp, sum(l_linenumber) FILTER (l_quantity > 10)::BIGINT AS si, arg_max(l_orderkey, l_orderkey) AS am, arg_min(l_orderkey, l_orderkey) AS an, first(l_returnflag) AS fi, last(l_returnflag) AS la_, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS un,
  array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS ua, count(*) AS ag, 2 * count(*) AS cc, count(*) AS gc, true AS ad, true AS hl, true AS aq, count(*) AS ja, round(regr_avgx(l_quantity, l_tax), 9) AS rx, round(regr_avgy(l_quantity, l_tax), 9) AS ry,
  count(DISTINCT l_linenumber) AS bc, true AS tk
FROM lineitem GROUP BY l_returnflag""")
def fn_aggregate_names(spark, sf):
    """Aggregates by their dialect names; approximate ones must come within a tenth.

    Those that keep every value of a group run over parts of PART rows, whose counts are added up: no task holds a group.
    """
    q, line = "l_quantity", "l_linenumber"
    near = lambda a, b: (F.abs(a / b - 1) < 0.1)
    rows = read(spark, sf, "lineitem").withColumn("big", F.col(q) > 10).withColumn("one", F.array(line)).withColumn("two", F.array(line, line))
    parts = rows.withColumn("part", F.floor(F.monotonically_increasing_id() / PART)).groupBy("l_returnflag", "part").agg(
        F.size(call("array_agg", line)).alias("ag"), F.size(call("array_concat_agg", "two")).alias("cc"), F.when(F.count(line) > 0, F.size(F.split(call("group_concat", line, "';'"), ";"))).alias("gc"),
        F.size(F.from_json(call("json_array_agg", line), "array<int>")).alias("ja"), call("array_union_agg", "one").alias("ua"),
    )
    kept = parts.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.sum("ag").alias("ag"), F.sum("cc").alias("cc"), F.coalesce(F.sum("gc"), F.lit(1)).alias("gc"), F.sum("ja").alias("ja"), F.array_join(F.sort_array(call("array_union_agg", "ua")), ",").alias("ua")
    )  # an empty text splits into one
    counted = rows.groupBy("l_returnflag").agg(
        call("any_value", "l_returnflag").alias("any_"), call("avg", q).alias("avg_"), call("bitwise_and_agg", line).alias("ba"), call("bitwise_or_agg", line).alias("bo"), call("bitwise_xor_agg", line).alias("bx"), call("boolxor_agg", "big").alias("xo"),
        F.round(call("corr", q, "l_tax"), 9).alias("co"), call("count", "1").alias("n"), call("count_if", "big").alias("ci"), F.round(call("covar_pop", q, "l_tax"), 6).alias("cp"), F.round(call("covar_samp", q, "l_tax"), 6).alias("cs"), call("logical_and", f"{q} > 0").alias("la"), call("logical_or", f"{q} > 49").alias("lo"),
        call("max", q).alias("mx"), call("min", q).alias("mn"), call("median", q).alias("md"), call("quantile", q, "0.25").alias("qu"), F.round(call("stddev", q), 6).alias("sd"), F.round(call("stddev_pop", q), 6).alias("sp"), F.round(call("stddev_samp", q), 6).alias("ss"), call("sum", line).alias("su"), F.round(call("variance", q), 6).alias("va"),
        F.round(call("variance_pop", q), 6).alias("vp"), call("sum_if", line, "big").alias("si"), call("arg_max", "l_orderkey", "l_orderkey").alias("am"), call("arg_min", "l_orderkey", "l_orderkey").alias("an"), call("first", "l_returnflag").alias("fi"), call("last", "l_returnflag").alias("la_"),
        F.array_join(F.sort_array(call("array_unique_agg", line)), ",").alias("un"),
        near(call("approx_distinct", line), F.countDistinct(line)).alias("ad"), near(call("hll", line), F.countDistinct(line)).alias("hl"), near(call("approx_quantile", q, "0.5"), F.median(q)).alias("aq"),
        F.round(call("regr_avgx", q, "l_tax"), 9).alias("rx"), F.round(call("regr_avgy", q, "l_tax"), 9).alias("ry"),
        F.bitmap_count(call("bitmap_construct_agg", f"bitmap_bit_position({line})")).alias("bc"), (F.size(call("approx_top_k", line, "3")) == 3).alias("tk"),
    )
    names = counted.columns
    at = names.index("un") + 1
    names = [*names[:at], "ua", "ag", "cc", "gc", *names[at : names.index("rx")], "ja", *names[names.index("rx") :]]
    return counted.join(kept, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select(*names)


@query("""SELECT r_regionkey, name, value FROM region, (VALUES ('explode', '1'), ('explode', '2'), ('explode_outer', NULL), ('posexplode', '7'), ('posexplode_outer', NULL), ('inline', '5'), ('unnest', '3'), ('exploding_generate_series', '1'), ('exploding_generate_series', '3'),
  ('json_table', '1'), ('json_table', '2'), ('xml_table', 'x'), ('xml_table', 'y'), ('open_json', 'v')) v(name, value)""")
def fn_generators(spark, sf):
    r = read(spark, sf, "region").select("r_regionkey")
    json_ = """'{"a": [1, 2]}'"""
    calls = [
        ("explode", ["array(1, 2)"], ["value"]), ("explode_outer", ["cast(NULL AS array<int>)"], ["value"]), ("posexplode", ["array(7)"], ["at", "value"]), ("posexplode_outer", ["cast(NULL AS array<int>)"], ["at", "value"]), ("inline", ["array(struct(5 AS x))"], ["value"]),
        ("unnest", ["array(3)"], ["value"]), ("exploding_generate_series", ["1", "4", "2"], ["value"]), ("json_table", [json_, "'$.a'"], ["value"]), ("xml_table", ["'<a><b>x</b><b>y</b></a>'", "'a/b/text()'"], ["value"]), ("open_json", ["""'{"k": "v"}'"""], ["key", "value"]),
    ]
    out = None
    for name, args, columns in calls:
        one = r.select("r_regionkey", F.lit(name).alias("name"), call(name, *args).alias(*columns)).select("r_regionkey", "name", F.col("value").cast("string"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT r_regionkey, true AS now, true AS current_date, true AS current_timestamp, true AS current_datetime, true AS current_timestamp_ltz, true AS utc_date, true AS utc_time, true AS utc_timestamp, true AS rand, true AS randn, true AS uuid, true AS current_user, true AS current_schema,
  true AS compress, true AS st_distance, true AS minhash FROM region""")
def fn_volatile(spark, sf):
    """Functions whose value changes from run to run or that only go with another: their form is checked."""
    today = "current_date()"
    return read(spark, sf, "region").select(
        "r_regionkey", (F.to_date(call("now")) == F.expr(today)).alias("now"), (call("current_date") == F.expr(today)).alias("current_date"), (F.to_date(call("current_timestamp")) == F.expr(today)).alias("current_timestamp"), (F.to_date(call("current_datetime")) == F.expr(today)).alias("current_datetime"),
        (F.to_date(call("current_timestamp_ltz")) == F.expr(today)).alias("current_timestamp_ltz"), (call("utc_date") == F.expr(today)).alias("utc_date"), call("utc_time").rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$").alias("utc_time"), (F.to_date(call("utc_timestamp")) == F.expr(today)).alias("utc_timestamp"),
        call("rand").between(0, 1).alias("rand"), call("randn").isNotNull().alias("randn"), (F.length(call("uuid")) == 36).alias("uuid"), call("current_user").isNotNull().alias("current_user"), (call("current_schema") == "default").alias("current_schema"),
        (custom.call("decompress_string", custom.call("compress", F.lit("abc").cast("binary"))) == "abc").alias("compress"), custom.call("st_distance", F.lit(48.85), F.lit(2.35), F.lit(51.5), F.lit(-0.12)).between(340_000, 347_000).alias("st_distance"),
        (F.size(custom.call("minhash", F.array(F.lit("x"), F.lit("y")))) == 64).alias("minhash"),
    )


@query("""SELECT r_regionkey, '{"' || r_name || '":' || r_regionkey || '}' AS o, '{"' || r_name || '":' || r_regionkey || '}' AS j, '{"' || r_name || '":' || r_regionkey || '}' AS b FROM region""")
def fn_object_aggregates(spark, sf):
    r = read(spark, sf, "region").groupBy("r_regionkey")
    return r.agg(call("object_agg", "r_name", "r_regionkey").alias("o"), call("json_object_agg", "r_name", "r_regionkey").alias("j"), call("jsonb_object_agg", "r_name", "r_regionkey").alias("b"))
