"""Changes as maps from the read-only tables to the rows they would leave (W1-W20, D6-D12, C, T3, K2-K5)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import constraints, dml
from ..meta import Check, Column, Table
from ..session import latest, unmet
from ..statements import Bounds
from ..store import Store
from ..types import out_of_range
from . import indexed
from .registry import Registry

R = Registry()
q = R.query

FACTS = Table(
    "orders_fact",
    (Column("order_id", "int64", False), Column("customer_id", "int64", False), Column("status", "utf8", True, True, "new"), Column("total_cents", "int64", False, True, 0)),
    "order_id",
    (Check("total_check", "`total_cents` >= 0"), Check("status_check", "`status` <> ''")),
)
BASE = "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders"


def base(t):
    return t("orders").selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS status", "CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents")


@q(f"{BASE} UNION ALL SELECT * FROM (VALUES (CAST(9000001 AS BIGINT), CAST(1 AS BIGINT), 'new', CAST(0 AS BIGINT)), (9000002, 2, 'paid', 500)) v")
def w1_insert_values(t):
    new = t.spark.createDataFrame([(9000001, 1, None, None), (9000002, 2, "paid", 500)], "order_id BIGINT, customer_id BIGINT, status STRING, total_cents BIGINT")
    first = constraints.completed(new.where("status IS NULL").select("order_id", "customer_id"), FACTS)
    return base(t).unionByName(first).unionByName(constraints.completed(new.where("status IS NOT NULL"), FACTS))


@q(f"{BASE} UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'copy', 0 FROM orders WHERE o_orderstatus = 'P'")
def w2_insert_select(t):
    new = base(t).where("status = 'P'").selectExpr("order_id + 10000000 AS order_id", "customer_id", "'copy' AS status")
    return base(t).unionByName(constraints.completed(new, FACTS))


@q("SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders) AS order_id, o_custkey AS customer_id, 'new' AS status, CAST(0 AS BIGINT) AS total_cents FROM orders")
def w4_bulk_insert(t):
    top = t("orders").agg(F.max("o_orderkey").alias("top"))
    rows = t("orders").crossJoin(F.broadcast(top)).selectExpr("o_orderkey + top AS order_id", "o_custkey AS customer_id")
    return constraints.completed(rows, FACTS)


@q("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def w5_duplicate_keys(t):
    return constraints.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@q("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def w5_keys_in_base(t):
    return t("customer").select("c_custkey").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@q(f"WITH b AS ({BASE}), n AS (SELECT o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 20000000 ELSE 0 END AS order_id, o_custkey AS customer_id, 'up' AS status, CAST(1 AS BIGINT) AS total_cents FROM orders WHERE o_orderstatus = 'P') SELECT * FROM b WHERE order_id NOT IN (SELECT order_id FROM n) UNION ALL SELECT * FROM n")
def w6_upsert(t):
    new = t("orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 20000000 ELSE 0 END AS order_id", "o_custkey AS customer_id", "'up' AS status", "CAST(1 AS BIGINT) AS total_cents")
    return dml.upsert_rows(base(t), new, "order_id")


@q(f"SELECT order_id, customer_id, CASE WHEN order_id = 42 THEN 'shipped' ELSE status END AS status, total_cents FROM ({BASE}) b")
def w8_update_by_key(t):
    return dml.updated(base(t), FACTS, Bounds(42, 42), {"status": "shipped"})


@q(f"SELECT order_id, customer_id, CASE WHEN order_id BETWEEN 100 AND 299 THEN 'held' ELSE status END AS status, CASE WHEN order_id BETWEEN 100 AND 299 THEN 0 ELSE total_cents END AS total_cents FROM ({BASE}) b")
def w9_update_pk_range(t):
    return dml.updated(base(t), FACTS, Bounds(100, 299), {"status": "held", "total_cents": 0})


@q("SELECT count(*) AS matched, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS changed FROM orders WHERE o_orderkey BETWEEN 1 AND 500")
def w10_affected_counts(t):
    return base(t).where(dml.within("order_id", Bounds(1, 500))).agg(F.count("*").alias("matched"), F.count(F.expr("CASE WHEN status <> 'F' THEN 1 END")).alias("changed"))


@q(f"SELECT * FROM ({BASE}) b WHERE NOT (order_id >= 50 AND order_id <= 400)")
def w11_delete_pk_range(t):
    return base(t).where(~dml.within("order_id", Bounds(50, 400)))


@q("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'W' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey <= 60 UNION ALL SELECT -1, count(*), 'conflicts' FROM orders WHERE o_orderkey <= 60 AND o_orderkey % 5 = 0")
def w15_conditional_write(t):
    """A conditional write that saw the present rows applies; one that saw other values of every fifth key writes nothing."""
    store = Store(t.spark, indexed.folder(t.spark))
    table = replace(indexed.ORDERS, name="some")
    snapshot, _ = dml.insert(store, store.create(table), indexed.typed(t("orders").where("o_orderkey <= 60")))
    seen = store.read(snapshot)
    wanted = seen.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("W"))
    snapshot, _ = dml.apply_if(store, snapshot, wanted, seen.where("o_orderkey % 3 = 0"))
    stale = store.read(snapshot).withColumn("o_custkey", F.expr("if(o_orderkey % 5 = 0, o_custkey + 1, o_custkey)"))
    after, conflicts = dml.apply_if(store, snapshot, stale.withColumn("o_orderstatus", F.lit("X")), stale)
    out = store.read(after).select("o_orderkey", "o_custkey", "o_orderstatus")
    return out.unionByName(conflicts.agg(F.count("*").alias("o_custkey")).select(F.lit(-1).cast("long").alias("o_orderkey"), "o_custkey", F.lit("conflicts").alias("o_orderstatus")))


@q("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS bad, event_id % 300 BETWEEN -128 AND 127 AS fits_byte FROM events")
def w16_coercion(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("event_type").try_cast("bigint").alias("bad"), (~out_of_range(F.col("event_id") % 300, FACTS_BYTE)).alias("fits_byte"))


FACTS_BYTE = Column("b", "int8").kind


@q(f"SELECT * FROM ({BASE}) b WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '5%')")
def w19_tombstones(t):
    store = Store(t.spark, indexed.folder(t.spark))
    snapshot, _ = dml.insert(store, store.create(FACTS), base(t))
    return store.read(dml.tombstone(store, snapshot, t("orders").where("o_orderpriority LIKE '5%'").selectExpr("o_orderkey AS order_id")))


@q(f"SELECT order_id, customer_id, status, total_cents FROM ({BASE}) b")
def d6_redistributed(t):
    return base(t).repartition(32, "order_id")


@q("SELECT o_orderstatus, o_orderdate, o_totalprice, o_orderkey FROM orders")
def d10_index_backfill(t):
    return t("orders").select("o_orderstatus", "o_orderdate", "o_totalprice", "o_orderkey").repartitionByRange("o_orderstatus", "o_orderdate").sortWithinPartitions("o_orderstatus", "o_orderdate")


@q("SELECT k AS email, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 40 END AS k FROM customer) x WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1")
def d12_unique_violations(t):
    return constraints.duplicate_keys(t("customer").selectExpr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 40 END AS email"), ["email"])


@q("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END >= 0, true)")
def c_check_violations(t):
    return t("customer").withColumn("v", F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END")).where(~F.coalesce(F.expr("v >= 0"), F.lit(True))).select("c_custkey", "c_acctbal")


@q("SELECT c_custkey FROM customer WHERE CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END IS NULL")
def c_not_null_violations(t):
    return t("customer").where("CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END IS NULL").select("c_custkey")


@q("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '0000000000000000' AS big FROM customer WHERE CAST(CAST(c_custkey AS VARCHAR) || '0000000000000000' AS HUGEINT) > 18446744073709551615")
def c_unsigned_range(t):
    kind = Column("u", "uint64").kind
    big = F.concat(F.col("c_custkey").cast("string"), F.lit("0" * 16))
    return t("customer").select("c_custkey", big.alias("big")).where(out_of_range(F.col("big").cast("decimal(38,0)"), kind))


@q(f"WITH b AS ({BASE}) SELECT order_id, customer_id, CASE WHEN order_id BETWEEN 10 AND 20 THEN 'mine' ELSE status END AS status, total_cents FROM b WHERE order_id NOT BETWEEN 30 AND 40 UNION ALL SELECT 9000003, 3, 'added', 7")
def t3_read_your_writes(t):
    rows = dml.updated(base(t), FACTS, Bounds(10, 20), {"status": "mine"}).where(~dml.within("order_id", Bounds(30, 40)))
    return rows.unionByName(t.spark.createDataFrame([(9000003, 3, "added", 7)], rows.schema))


VERSIONS = "SELECT user_id AS k, ts, event_id AS seq, value, event_type = 'error' AS deleted FROM events"


def versions(t):
    return t("events").selectExpr("user_id AS k", "ts", "event_id AS seq", "value", "event_type = 'error' AS deleted")


@q(f"SELECT k, ts, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ({VERSIONS}) v WHERE seq <= 600) x WHERE rn = 1 AND NOT deleted")
def k2_mvcc_asof(t):
    return latest(versions(t), "k", ["seq"], {"seq": 600}).select("k", "ts", "seq", "value")


@q(f"SELECT k, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ({VERSIONS}) v) x WHERE rn = 1 AND NOT deleted AND k IN (3, 7, 11, 19)")
def k3_batch_get(t):
    keys = t.spark.createDataFrame([(3,), (7,), (11,), (19,)], "k BIGINT")
    return latest(versions(t).join(F.broadcast(keys), "k", "left_semi"), "k", ["seq"]).select("k", "seq", "value")


@q(f"SELECT k, arg_max(value, seq) AS value, max(seq) AS seq FROM ({VERSIONS}) v GROUP BY k")
def k4_latest_wins(t):
    return versions(t).groupBy("k").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


@q("SELECT 'present' AS expected, true AS applied, CAST(0 AS BIGINT) AS conflicts UNION ALL SELECT 'stale', count(DISTINCT user_id) = 0, count(DISTINCT user_id) FROM events WHERE user_id % 5 = 0 "
   f"UNION ALL SELECT 'none', count(*) = 0, count(*) FROM (SELECT k, arg_max(deleted, seq) AS gone FROM ({VERSIONS}) v GROUP BY k) h WHERE NOT gone")
def k5_conditional_apply(t):
    """Writes that expect each key's present version, one that every fifth key never had, or no live row; and of keys yet unknown."""
    rows = versions(t)
    unknown = t.spark.range(3).selectExpr("-1 - id AS k", "CAST(0 AS BIGINT) AS expected")
    present = rows.select("k").distinct().join(latest(rows, "k", ["seq"]).select("k", F.col("seq").alias("expected")), "k", "left").fillna(0, ["expected"]).unionByName(unknown)
    cases = {"present": present, "stale": present.withColumn("expected", F.expr("if(k >= 0 and k % 5 = 0, expected + 1, expected)")), "none": present.withColumn("expected", F.lit(0).cast("long"))}
    out = [unmet(rows, wanted, "k", "seq").agg(F.count("*").alias("conflicts")).select(F.lit(name).alias("expected"), (F.col("conflicts") == 0).alias("applied"), "conflicts") for name, wanted in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
