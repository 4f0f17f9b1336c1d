"""Joins, set operations and windows (J1-J10, U1-U4, N1-N5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Registry

R = Registry()
q = R.query


@q("WITH offsets AS (SELECT CAST(max(r_regionkey) AS BIGINT) AS top FROM region) SELECT g + top AS id, r_name FROM offsets CROSS JOIN generate_series(1, 20) s(g) CROSS JOIN region")
def j1_cross_generate(t):
    top = t("region").agg(F.max("r_regionkey").cast("bigint").alias("top"))
    return t.spark.range(1, 21).crossJoin(top).crossJoin(t("region")).select((F.col("id") + F.col("top")).alias("id"), "r_name")


@q("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def j2_inner(t):
    rows = t("orders").where("o_orderstatus = 'P'").join(t("customer"), F.expr("o_custkey = c_custkey"))
    return rows.join(t("nation"), F.expr("c_nationkey = n_nationkey")).select("o_orderkey", "c_name", "n_name")


@q("SELECT s_suppkey, count(l_orderkey) AS lines FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def j3_join_then_aggregate(t):
    return t("supplier").join(t("lineitem"), F.expr("s_suppkey = l_suppkey")).groupBy("s_suppkey").agg(F.count("l_orderkey").alias("lines"))


@q("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def j4_shuffled_join(t):
    return t("orders").where("o_orderstatus = 'P'").join(t("lineitem").hint("merge"), F.expr("o_orderkey = l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@q("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def j5_left(t):
    return t("customer").join(t("orders"), F.expr("c_custkey = o_custkey AND o_orderstatus = 'P'"), "left").select("c_custkey", "o_orderkey")


@q("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders ON c_custkey = o_custkey")
def j5_right(t):
    return t("customer").where("c_acctbal > 5000").join(t("orders"), F.expr("c_custkey = o_custkey"), "right").select("c_custkey", "o_orderkey")


@q("SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k")
def j5_full(t):
    a = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("a")).distinct()
    b = t("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("b")).distinct()
    return a.join(b, F.expr("a = b"), "full")


@q("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j6_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey", "c_name")


@q("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_anti(t):
    return t("customer").join(t("orders"), F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey", "c_name")


@q("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j7_theta(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@q("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j8_broadcast(t):
    return t("nation").join(t("region"), F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name")


@q("SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts AND (p.ts, p.event_id) = (SELECT (x.ts, x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) WHERE e.event_type = 'error' GROUP BY e.event_id")
def j9_asof(t):
    """The last purchase of the user up to each error: one sort of both by (user, time) instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.expr("event_type = 'error'"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t("events").where("event_type IN ('purchase', 'error')").select("user_id", "ts", "event_type", "event_id")
    return rows.withColumn("last_purchase", F.last(F.expr("CASE WHEN event_type = 'purchase' THEN event_id END"), ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "last_purchase")


@q("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def u1_union_all(t):
    o = t("orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey").unionByName(o.where("o_totalprice > 300000").select("o_orderkey"))


@q("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def u2_union(t):
    return t("orders").select(F.col("o_custkey").alias("k")).unionByName(t("customer").select(F.col("c_custkey").alias("k"))).distinct()


@q("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def u3_intersect(t):
    return t("orders").select(F.col("o_custkey").alias("k")).intersect(t("customer").where("c_nationkey < 10").select("c_custkey"))


@q("SELECT o_custkey % 10 AS k FROM orders INTERSECT ALL SELECT c_custkey % 15 FROM customer")
def u3_intersect_all(t):
    return t("orders").selectExpr("o_custkey % 10 AS k").intersectAll(t("customer").selectExpr("c_custkey % 15"))


@q("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u4_except(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@q("SELECT o_custkey % 10 AS k FROM orders EXCEPT ALL SELECT c_custkey % 15 FROM customer")
def u4_except_all(t):
    return t("orders").selectExpr("o_custkey % 10 AS k").exceptAll(t("customer").selectExpr("c_custkey % 15"))


@q("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def n3a_rank(t):
    w, s = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(s).cast("bigint").alias("r"), F.dense_rank().over(s).cast("bigint").alias("d"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@q("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS later, first_value(event_id) OVER w AS first, last_value(event_id) OVER w AS here, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def n3b_lag(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("later"), F.first("event_id").over(w).alias("first"), F.last("event_id").over(w).alias("here"), F.nth_value("event_id", 2).over(w).alias("second"))


@q("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT) AS total, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def n3c_aggregate_window(t):
    w = Window.partitionBy("o_custkey")
    return t("orders").select("o_orderkey", F.sum("o_orderkey").over(w).alias("total"), F.count("*").over(w).alias("n"))


@q("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders")
def n3d_frames(t):
    rows = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    near = Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rangeBetween(-100, 0)
    return t("orders").select("o_orderkey", F.sum("o_orderkey").over(rows).alias("last3"), F.count("*").over(near).alias("near"))


@q("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def n5_qualify(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")
