"""Scans, filters, projections, ordering and limits (S1-S16, P1-P9, L1-L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dml
from ..sources.generators import generate_series, values
from ..statements import Bounds
from . import indexed
from .registry import Registry

R = Registry()
q = R.query


@q("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s1_table_scan(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@q("SELECT o_orderkey, o_custkey FROM orders LIMIT 0")
def s2_limit_zero(t):
    return t("orders").select("o_orderkey", "o_custkey").limit(0)


@q("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def s3_pk_range_scan(t):
    return t("orders").where("o_orderkey >= 100 AND o_orderkey < 400").select("o_orderkey", "o_totalprice")


@q("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 AND o_orderkey < 200")
def s3_contradictory_bounds(t):
    return t("orders").where("o_orderkey > 500 AND o_orderkey < 200").select("o_orderkey")


@q("SELECT o_orderkey % 4 AS part, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1")
def s4_key_ranges_per_bucket(t):
    return t("orders").groupBy((F.col("o_orderkey") % 4).alias("part")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


@q("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 399")
def s4_bounds_to_files(t):
    """Only the data files whose key range meets the bounds are read."""
    store, bounds = indexed.orders(t).store, Bounds(100, 399)
    snapshot = store.snapshot("orders")
    return store.read(snapshot, dml.touched(snapshot, bounds)[0]).where(dml.within("o_orderkey", bounds)).select("o_orderkey", "o_totalprice")


@q("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND user_id < 50")
def s5_row_scan_with_residual(t):
    return t("events").where("event_type = 'purchase' AND user_id < 50").select("event_id", "user_id", "event_type")


@q("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderdate AS created_at FROM orders WHERE o_orderkey BETWEEN 10 AND 60")
def s6_fixed_layout_scan(t):
    return t("orders").where("o_orderkey BETWEEN 10 AND 60").selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS status", "CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents", "o_orderdate AS created_at")


@q("SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o WHERE o.o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def s9_index_lookup_semijoin(t):
    """The index gives the keys, the table their rows."""
    store = indexed.orders(t).store
    orders = store.snapshot("orders")
    keys = store.read_index(orders, indexed.INDEXES[0]).where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select("o_orderkey")
    return store.read(orders).join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@q("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def s10_index_only_scan(t):
    return indexed.orders(t).sql("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'F'")


@q("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderstatus, o_orderdate, o_orderkey LIMIT 25")
def s11_ordered_index_scan(t):
    return indexed.orders(t).sql("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderstatus, o_orderdate, o_orderkey LIMIT 25")


@q("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'view') AND user_id IN (1, 2, 3, 5, 8, 13)")
def s12_multi_probe_in(t):
    return t("events").where(F.col("event_type").isin("click", "view") & F.col("user_id").isin(1, 2, 3, 5, 8, 13)).select("event_id", "event_type", "user_id")


@q("SELECT max(o_orderkey) AS last_key FROM orders")
def s13_reverse_edge(t):
    return t("orders").agg(F.max("o_orderkey").alias("last_key"))


@q("SELECT CAST(g AS BIGINT) AS i, CAST(g * 37 % 20000 + 100 AS BIGINT) AS amount_cents, CAST(1 + (g - 1) // 86400 AS BIGINT) AS event_day FROM generate_series(1, 2000) AS s(g)")
def s15_generate_series(t):
    return generate_series(t.spark, 1, 2000, "i").selectExpr("i", "i * 37 % 20000 + 100 AS amount_cents", "1 + (i - 1) div 86400 AS event_day")


@q("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(10 AS BIGINT)), (2, 'b', NULL), (3, NULL, 30)) AS v(id, name, n)")
def s16_values(t):
    return values(t.spark, "id BIGINT, name STRING, n BIGINT", [(1, "a", 10), (2, "b", None), (3, None, 30)])


@q("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01'")
def p1_column_projection(t):
    return t("lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01' AND l_shipdate < timestamp_ntz'1995-02-01'").select("l_orderkey", "l_quantity")


@q("SELECT event_id FROM events WHERE user_id = 7 AND value > 10 AND event_type IS NOT NULL AND props LIKE '%1%'")
def p2_exact_and_residual_filters(t):
    return t("events").where("user_id = 7 AND value > 10 AND event_type IS NOT NULL AND props LIKE '%1%'").select("event_id")


@q("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 50 AND o_custkey <= 90 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL")
def p3_predicate_summary(t):
    return t("orders").where("o_orderstatus = 'F' AND o_custkey > 50 AND o_custkey <= 90 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL").select("o_orderkey")


@q("SELECT o_orderkey FROM orders WHERE 20 <= o_orderkey AND 90 > o_orderkey")
def p4_literal_on_left(t):
    return t("orders").where("20 <= o_orderkey AND 90 > o_orderkey").select("o_orderkey")


@q("SELECT n_nationkey, n_name FROM nation WHERE CAST(n_nationkey AS BIGINT) < CAST(5 AS BIGINT)")
def p5_cast_stripped(t):
    return t("nation").where("CAST(n_nationkey AS BIGINT) < CAST(5 AS BIGINT)").select("n_nationkey", "n_name")


@q("SELECT o_orderkey FROM orders WHERE (o_orderkey BETWEEN 5 AND 20 OR o_orderpriority LIKE '5%') AND NOT (o_orderstatus = 'O') AND o_orderkey % 2 = 0")
def p6_or_not_like_between(t):
    return t("orders").where("(o_orderkey BETWEEN 5 AND 20 OR o_orderpriority LIKE '5%') AND NOT (o_orderstatus = 'O') AND o_orderkey % 2 = 0").select("o_orderkey")


@q("SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN 'paid' WHEN o_orderkey % 10 < 8 THEN 'shipped' ELSE 'pending' END AS state, 'c-' || CAST(o_custkey AS VARCHAR) AS label, o_orderkey * 2 + 1 - o_custkey AS n, o_orderkey // 7 AS whole, o_orderdate IS NOT NULL AS dated FROM orders")
def p7_computed_projection(t):
    return t("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 < 6 THEN 'paid' WHEN o_orderkey % 10 < 8 THEN 'shipped' ELSE 'pending' END AS state", "concat('c-', CAST(o_custkey AS STRING)) AS label", "o_orderkey * 2 + 1 - o_custkey AS n", "o_orderkey div 7 AS whole", "o_orderdate IS NOT NULL AS dated")


@q("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n, n - (SELECT min(n) FROM big) AS over_least FROM big WHERE n > (SELECT avg(n) FROM big)")
def p8_cte_and_scalar_subquery(t):
    t("orders").createOrReplaceTempView("p8_orders")
    return t.spark.sql("WITH big AS (SELECT o_custkey, count(*) AS n FROM p8_orders GROUP BY o_custkey) SELECT o_custkey, n, n - (SELECT min(n) FROM big) AS over_least FROM big WHERE n > (SELECT avg(n) FROM big)")


@q("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 10 AND o_orderstatus <> 'P'")
def p9_prepared_parameters(t):
    return t.spark.sql("SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey = :customer AND o_orderstatus <> :status", args={"customer": 10, "status": "P"}, orders=t("orders"))


@q("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def l1_order_by(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")


@q("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def l2_order_by_limit(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(10)


@q("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' LIMIT 7) x")
def l3_limit_after_filter(t):
    return t("orders").where("o_orderstatus = 'O'").select("o_orderkey").limit(7).agg(F.count("*").alias("n"))


@q("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
def l6_offset(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").offset(30).limit(10)
