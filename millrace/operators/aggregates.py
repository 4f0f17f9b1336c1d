"""Aggregation: key edges, grouped top-k, general forms, grouping sets (A1-A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import indexed
from .registry import Registry

R = Registry()
q = R.query

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def grouped_topk(df, by: list[str], value: str, least: int, limit: int, total: str = "total", count: str = "n"):
    """COUNT(*) and SUM(value) per group, HAVING COUNT(*) >= least, by sum descending, then key ascending.

    One partial and one final aggregate and a bounded top-k; ties at the cut go to the lesser key.
    """
    out = df.groupBy(*by).agg(F.count("*").alias(count), F.sum(value).alias(total)).where(F.col(count) >= least)
    return out.orderBy(F.col(total).desc_nulls_last(), *by).limit(limit)


@q("SELECT coalesce(min(o_orderkey), 0) AS least_key, coalesce(max(o_orderkey), 0) AS last_key FROM orders")
def a1_minmax_pk(t):
    return t("orders").agg(F.coalesce(F.min("o_orderkey"), F.lit(0)).alias("least_key"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("last_key"))


@q("SELECT g + (SELECT coalesce(max(o_orderkey), 0) FROM orders) AS order_id, g AS n FROM generate_series(1, 100) s(g)")
def a2_max_pk_as_insert_offset(t):
    top = t("orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("last"))
    return t.spark.range(1, 101).crossJoin(F.broadcast(top)).select((F.col("id") + F.col("last")).alias("order_id"), F.col("id").alias("n"))


@q(f"SELECT o_custkey, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey HAVING count(*) >= 3 ORDER BY total DESC, o_custkey LIMIT 50")
def a3_grouped_topk(t):
    rows = t("orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_custkey", F.expr(CENTS).alias("cents"))
    return grouped_topk(rows, ["o_custkey"], "cents", 3, 50)


@q("SELECT event_type, user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_type = 'click' GROUP BY event_type, user_id HAVING count(*) >= 2 ORDER BY total DESC, event_type, user_id LIMIT 20")
def a3_topk_two_keys(t):
    rows = t("events").where("event_type = 'click'").select("event_type", "user_id", F.expr("CAST(round(value * 100) AS BIGINT)").alias("cents"))
    return grouped_topk(rows, ["event_type", "user_id"], "cents", 2, 20)


@q("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2")
def a4_partial_aggregation(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)")).alias("cents"))


@q("SELECT o_orderstatus, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def a5_covering_index_aggregation(t):
    return indexed.orders(t).sql("SELECT o_orderstatus, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")


@q("SELECT k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT o_custkey % 5 AS k, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey END AS v FROM orders) x GROUP BY k")
def a6_sum_of_nulls_is_null(t):
    return t("orders").selectExpr("o_custkey % 5 AS k", "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey END AS v").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@q("SELECT o_custkey % 100 AS g, count(*) AS n, CAST(sum(o_orderkey % 3) AS BIGINT) AS total FROM orders GROUP BY 1 ORDER BY total DESC, g LIMIT 15")
def a8_topk_tie_break(t):
    return grouped_topk(t("orders").selectExpr("o_custkey % 100 AS g", "o_orderkey % 3 AS v"), ["g"], "v", 0, 15)


@q("SELECT count(*) AS n, count(value) AS with_value, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events")
def a10_counts(t):
    return t("events").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count(F.expr("CASE WHEN event_type = 'error' THEN 1 END")).alias("errors"))


@q("SELECT c_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents, min(c_acctbal) AS low, max(c_name) AS last_name FROM customer GROUP BY 1")
def a11_sum_min_max(t):
    return t("customer").groupBy("c_nationkey").agg(F.sum(F.expr("CAST(round(c_acctbal * 100) AS BIGINT)")).alias("cents"), F.min("c_acctbal").alias("low"), F.max("c_name").alias("last_name"))


@q("SELECT p_brand, round(avg(p_retailprice), 4) AS price, round(avg(p_size), 4) AS size FROM part GROUP BY 1")
def a12_avg(t):
    return t("part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.avg("p_size"), 4).alias("size"))


@q("SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY 1, 2 HAVING count(*) >= 2 AND min(event_id) < 900")
def a13_group_having(t):
    return t("events").where("value > 5").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least")).where("n >= 2 AND least < 900").drop("least")


@q("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def a15_count_distinct(t):
    return t("orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@q("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a15_rollup(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("bigint").alias("g"))


@q("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a15_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@q("SELECT event_type, user_id % 4 AS g, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())")
def a15_grouping_sets(t):
    t("events").selectExpr("event_type", "user_id % 4 AS g").createOrReplaceTempView("a15_events")
    return t.spark.sql("SELECT event_type, g, count(*) AS n FROM a15_events GROUP BY GROUPING SETS ((event_type), (g), ())")


@q("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, quantile_disc(o_orderkey, 0.5) AS middle FROM orders GROUP BY 1")
def a15_filter_and_percentile(t):
    return t("orders").groupBy("o_orderstatus").agg(F.expr("count(*) FILTER (WHERE o_totalprice > 100000)").alias("dear"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey) AS BIGINT)").alias("middle"))


@q()
def a15_approximate(t):
    return t("events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("middle"))
