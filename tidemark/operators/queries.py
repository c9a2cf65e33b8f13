"""The relational surface: joins, aggregation, windows, set operations and table factors, run by Spark."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import query, read
from tidemark.operators.relational import as_of_join, exact_sum, gap_fill, median_by_counts, range_join, small, top_k, top_sum



def disc():
    return F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


SQL_DISC = "l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2))"


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price,
  sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS sum_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def agg_group_by(spark, sf):
    li = read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum("l_quantity", 2).alias("sum_qty"), exact_sum("l_extendedprice", 2).alias("sum_price"), F.sum(disc()).cast("double").alias("sum_disc"), F.count("*").alias("n")
    )


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def agg_cube(spark, sf):
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n")
    )


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def agg_rollup(spark, sf):
    return read(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def agg_grouping_sets(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(*) FILTER (WHERE c_acctbal > 0) AS positive,
  bool_and(c_acctbal > -1000) AS all_above, max(c_acctbal) FILTER (WHERE c_nationkey = 3) AS top3 FROM customer GROUP BY c_mktsegment""")
def agg_distinct_filter(spark, sf):
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.countDistinct("c_nationkey").alias("nations"), F.count_if(F.col("c_acctbal") > 0).alias("positive"),
        F.bool_and(F.col("c_acctbal") > -1000).alias("all_above"), F.max(F.when(F.col("c_nationkey") == 3, F.col("c_acctbal"))).alias("top3"),
    )


@query("""SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS low FROM customer GROUP BY c_nationkey HAVING count(*) > 10 AND min(c_acctbal) < 0""")
def agg_having(spark, sf):
    g = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"))
    return g.where("n > 10 AND low < 0")


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list(n_nationkey ORDER BY n_nationkey)[1] AS first_key, arg_max(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey""")
def agg_ordered(spark, sf):
    return read(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.element_at(F.sort_array(F.collect_list("n_nationkey")), 1).alias("first_key"), F.max_by("n_name", "n_nationkey").alias("last_name")
    )


@query("""SELECT c_mktsegment, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.9) AS p90, round(stddev_samp(c_acctbal), 6) AS sd, round(var_pop(c_acctbal), 4) AS vp FROM customer GROUP BY c_mktsegment""")
def agg_statistics(spark, sf):
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.median("c_acctbal").alias("med"), F.percentile("c_acctbal", 0.9).alias("p90"), F.round(F.stddev_samp("c_acctbal"), 6).alias("sd"), F.round(F.var_pop("c_acctbal"), 4).alias("vp")
    )


@query("""SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag""")
def agg_median_by_counts(spark, sf):
    return median_by_counts(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("""SELECT n_name, r_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def join_inner(spark, sf):
    n, r, s = (read(spark, sf, t) for t in ("nation", "region", "supplier"))
    near = n.join(small(r.where(F.col("r_name").isin("ASIA", "EUROPE"))), n.n_regionkey == r.r_regionkey)
    return s.join(small(near), s.s_nationkey == n.n_nationkey).select("n_name", "r_name", "s_suppkey")


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def join_left(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def join_right(spark, sf):
    s, n = read(spark, sf, "supplier").where("s_acctbal > 5000"), read(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("n_name", "s_suppkey")


@query("""SELECT a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1) b ON a.k = b.k""")
def join_full(spark, sf):
    a = read(spark, sf, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("ak")).agg(F.count("*").alias("an"))
    b = read(spark, sf, "supplier").where("s_nationkey % 3 = 0").groupBy(F.col("s_nationkey").alias("bk")).agg(F.count("*").alias("bn"))
    return a.join(b, a.ak == b.bk, "full")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return read(spark, sf, "nation").select("n_name").crossJoin(small(read(spark, sf, "region").select("r_name")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_left_semi(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def join_right_semi(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer").where("c_acctbal < 0")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_suppkey IS NOT NULL)")
def join_right_anti(spark, sf):
    s, li = read(spark, sf, "supplier"), read(spark, sf, "lineitem").where("l_quantity > 49")
    return s.join(li, s.s_suppkey == li.l_suppkey, "left_anti").select("s_suppkey")


@query("""SELECT n_nationkey, x.c_custkey, x.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x""")
def join_cross_apply(spark, sf):
    c = top_k(read(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 2)
    n = read(spark, sf, "nation")
    return n.join(c, n.n_nationkey == c.c_nationkey).select("n_nationkey", "c_custkey", "c_acctbal")


@query("""SELECT n_nationkey, x.s_suppkey FROM nation LEFT JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0 ORDER BY s_suppkey LIMIT 1) x ON true""")
def join_outer_apply(spark, sf):
    s = read(spark, sf, "supplier").where("s_acctbal < 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    n = read(spark, sf, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_nationkey", "s_suppkey")


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_as_of(spark, sf):
    e = read(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return as_of_join(clicks, bought, "user_id", "ts", "ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 > 0 THEN ts END AS ts, event_type FROM events)
  SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM e WHERE event_type = 'click') e
  LEFT JOIN LATERAL (SELECT max(event_id) AS event_id FROM e p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts = (SELECT max(q.ts) FROM e q WHERE q.event_type = 'purchase' AND q.user_id = e.user_id AND q.ts <= e.ts)) p ON true""")
def join_as_of_nulls(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.expr("if(event_id % 7 > 0, user_id, null)").alias("user_id"), F.expr("if(event_id % 11 > 0, ts, null)").alias("ts"), "event_type")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return as_of_join(clicks, bought, "user_id", "ts", "ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("""SELECT c_custkey, b.low FROM customer JOIN (SELECT range * 500.0::DOUBLE AS low, range * 500.0::DOUBLE + 700 AS high FROM range(0, 5)) b ON c_acctbal >= b.low AND c_acctbal < b.high""")
def join_range(spark, sf):
    bands = spark.range(5).select((F.col("id") * 500.0).alias("low"), (F.col("id") * 500.0 + 700).alias("high"))
    return range_join(read(spark, sf, "customer"), bands, "c_acctbal", "low", "high", 500.0).select("c_custkey", "low")


@query("""SELECT n_nationkey, c_custkey FROM nation JOIN (SELECT c_nationkey AS n_nationkey, c_custkey FROM customer WHERE c_acctbal > 9900) USING (n_nationkey)""")
def join_using(spark, sf):
    c = read(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return c.join(small(read(spark, sf, "nation").select("n_nationkey")), "n_nationkey").select("n_nationkey", "c_custkey")


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal AND a.s_suppkey < b.s_suppkey""")
def join_theta_self(spark, sf):
    s = read(spark, sf, "supplier")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))
    return a.join(b, on).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("""SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(4) OVER w AS nt
  FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def window_ranking(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return read(spark, sf, "customer").select(
        "c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"),
        F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.ntile(4).over(w).alias("nt"),
    )


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after2, first_value(o_orderkey) OVER w AS first,
  last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
  nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_offsets(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    k = "o_orderkey"
    return read(spark, sf, "orders").select(
        k, F.lag(k).over(w).alias("before"), F.lead(k, 2, -1).over(w).alias("after2"), F.first(k).over(w).alias("first"), F.last(k).over(whole).alias("last"), F.nth_value(k, 2).over(w).alias("second")
    )


@query("""SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS moving,
  count(*) OVER (PARTITION BY o_custkey ORDER BY extract(year FROM o_orderdate) RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS two_years FROM orders""")
def window_frames(spark, sf):
    rows = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    years = W.partitionBy("o_custkey").orderBy("year").rangeBetween(-1, 0)
    o = read(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return o.select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(rows).cast("double").alias("moving"), F.count("*").over(years).alias("two_years"))


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def window_qualify_top_k(spark, sf):
    return top_k(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark, sf):
    return read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_except(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(read(spark, sf, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(spark, sf, "supplier").select("s_nationkey"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def table_pivot(spark, sf):
    p = read(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("""SELECT s_suppkey, 'key' AS what, s_suppkey::DOUBLE AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier""")
def table_unpivot(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("key"), F.col("s_acctbal").alias("balance"))
    return s.unpivot(["s_suppkey"], ["key", "balance"], "what", "v")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def table_unnest(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(k, name)")
def table_values(spark, sf):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(k, name)")


@query("""WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t""")
def table_recursive_cte(spark, sf):
    return spark.sql("WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def sort_limit_offset(spark, sf):
    return read(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(10).select("p_partkey", "p_retailprice")


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring%' OR p_type IN ('PROMO')")
def filter_distinct(spark, sf):
    return read(spark, sf, "part").where("p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring%' OR p_type IN ('PROMO')").select("p_brand", "p_type").distinct()


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above FROM customer")
def project_case_scalar_subquery(spark, sf):
    c = read(spark, sf, "customer")
    mean = small(c.agg(F.avg("c_acctbal").alias("mean")))
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return c.crossJoin(mean).select("c_custkey", band.alias("band"), (F.col("c_acctbal") > F.col("mean")).alias("above"))


@query(f"""SELECT n_name, sum({SQL_DISC})::DOUBLE AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""")
def star_join(spark, sf):
    c, o, li, s, n, r = (read(spark, sf, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    near = n.join(small(r.where("r_name = 'ASIA'")), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name")
    sold = s.join(small(near), s.s_nationkey == near.n_nationkey).select("s_suppkey", "s_nationkey", "n_name")
    when = o.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
    bought = when.join(c, c.c_custkey == o.o_custkey).select("o_orderkey", "c_nationkey")
    lines = li.join(bought, li.l_orderkey == bought.o_orderkey).join(sold, (li.l_suppkey == sold.s_suppkey) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return lines.groupBy("n_name").agg(F.sum(disc()).cast("double").alias("revenue"))


@query("""WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_custkey < 40 GROUP BY ALL),
  e AS (SELECT o_custkey, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY o_custkey)
  SELECT o_custkey, day::VARCHAR AS day, last_value(n IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY day) AS n FROM e LEFT JOIN d USING (o_custkey, day)""")
def agg_gap_fill(spark, sf):
    d = read(spark, sf, "orders").where("o_custkey < 40").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return gap_fill(d, "o_custkey", "day", "1 DAY", ["n"], carry=True).withColumn("day", F.col("day").cast("string"))


@query("""SELECT l_suppkey, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS total FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 7""")
def agg_top_sum(spark, sf):
    return top_sum(read(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 7)


@query("""SELECT n_name, s_suppkey FROM nation NATURAL JOIN (SELECT s_nationkey AS n_nationkey, s_suppkey FROM supplier)""")
def join_natural(spark, sf):
    n, s = read(spark, sf, "nation"), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    shared = [c for c in n.columns if c in s.columns]
    return s.join(small(n), shared).select("n_name", "s_suppkey")


@query("""SELECT p_brand, p_size FROM part WHERE p_size < 30 INTERSECT ALL SELECT p_brand, p_size FROM part WHERE p_size > 10""")
def set_intersect_all(spark, sf):
    p = read(spark, sf, "part").select("p_brand", "p_size")
    return p.where("p_size < 30").intersectAll(p.where("p_size > 10"))


@query("""SELECT o_orderkey, first_value(c IGNORE NULLS) OVER w AS a, last_value(c IGNORE NULLS) OVER w AS b FROM (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS c FROM orders)
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def window_ignore_nulls(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    c = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", F.first(c, True).over(w).alias("a"), F.last(c, True).over(w).alias("b"))


@query("""SELECT l_returnflag, quantile_disc(l_quantity, 0.3) AS disc, quantile_cont(l_quantity, 0.3) AS cont FROM lineitem GROUP BY l_returnflag""")
def agg_percentiles(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY l_quantity)").alias("disc"), F.expr("percentile_cont(0.3) WITHIN GROUP (ORDER BY l_quantity)").alias("cont"))


@query("""SELECT event_id, e.value AS word FROM events, LATERAL (SELECT unnest(string_split(event_type, 'i')) AS value) e""")
def table_flatten(spark, sf):
    return read(spark, sf, "events").select("event_id", F.explode(F.split("event_type", "i")).alias("word"))


@query("""SELECT event_id, key, (props::JSON ->> ('$.' || key)) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def table_json_each(spark, sf):
    """OPENJSON and JSON_TABLE: a row for each member of an object."""
    return read(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
