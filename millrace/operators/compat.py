"""Compatibility functions, introspection, plans and streams as queries (F1-F5, S17-S19, X1-X5, G1-G4, function families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import statements as st
from ..functions import pg
from ..plans import explain
from ..streaming import ingest
from . import indexed
from .registry import Registry

R = Registry()
q = R.query

#: The rule of age() spelt out for the oracle, since its own age() borrows days differently.
AGE_SQL = """
WITH p AS (SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 90000) SECOND AS a, TIMESTAMP '1996-03-31 13:14:15' AS b FROM orders),
o AS (SELECT o_orderkey, CASE WHEN a < b THEN -1 ELSE 1 END AS s, greatest(a, b) AS hi, least(a, b) AS lo FROM p),
m AS (SELECT *, (epoch_us(hi) - epoch_us(date_trunc('day', hi))) - (epoch_us(lo) - epoch_us(date_trunc('day', lo))) AS us FROM o),
d AS (SELECT *, day(hi) - day(lo) - CASE WHEN us < 0 THEN 1 ELSE 0 END AS dd FROM m)
SELECT o_orderkey, CAST(s * (12 * (year(hi) - year(lo)) + month(hi) - month(lo) - CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS BIGINT) AS months,
CAST(s * (dd + CASE WHEN dd < 0 THEN day(last_day(CAST(date_trunc('month', hi) - INTERVAL 1 DAY AS DATE))) ELSE 0 END) AS BIGINT) AS days,
CAST(s * (us + CASE WHEN us < 0 THEN 86400000000 ELSE 0 END) AS BIGINT) AS micros FROM d
"""


@q(AGE_SQL)
def f1_age(t):
    rows = t("orders").select("o_orderkey", F.expr("timestampadd(SECOND, CAST(o_orderkey % 90000 AS INT), o_orderdate)").alias("a"), F.expr("timestamp_ntz'1996-03-31 13:14:15'").alias("b"))
    return rows.select("o_orderkey", *[v.alias(k) for k, v in pg.age_parts("a", "b").items()])


@q("SELECT event_id, event_id - user_id AS age FROM events UNION ALL SELECT -1, 9223372036854775807")
def f2_age_xid(t):
    far = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), pg.age_xid(F.lit(9223372036854775807), F.lit(-5)).alias("age"))
    return t("events").select("event_id", pg.age_xid("event_id", "user_id").alias("age")).unionByName(far)


@q("SELECT CAST(17 AS BIGINT) AS txid")
def f3_txid_current(t):
    pg.register(t.spark, pg.Clock(), 17)
    return t.spark.sql(pg.rewrite("SELECT pg_catalog.txid_current() AS txid"))


@q("SELECT true AS started_before_now")
def f4_postmaster_start_time(t):
    pg.register(t.spark, pg.Clock(), 1)
    return t.spark.sql("SELECT pg_postmaster_start_time() <= current_timestamp() + INTERVAL 1 DAY AS started_before_now")


@q("SELECT false AS recovering")
def f5_is_in_recovery(t):
    pg.register(t.spark, pg.Clock(), 1)
    return t.spark.sql("SELECT pg_is_in_recovery() AS recovering")


@q("SELECT * FROM (VALUES ('virtualxid', '1/5', CAST(NULL AS BIGINT)), ('transactionid', NULL, 5)) v(locktype, virtualxid, transactionid)")
def s19_pg_locks(t):
    return pg.locks(t.spark, [5]).select("locktype", "virtualxid", "transactionid")


@q("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, substr(c_name, 1, 4) AS head, replace(c_mktsegment, 'A', '_') AS r, length(c_name) AS n, instr(c_name, '#') AS at, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, regexp_replace(c_name, '[0-9]+', 'N') AS pattern FROM customer")
def fn_string(t):
    return t("customer").selectExpr("c_custkey", "lower(c_name) AS low", "upper(c_mktsegment) AS up", "substr(c_name, 1, 4) AS head", "replace(c_mktsegment, 'A', '_') AS r", "CAST(length(c_name) AS BIGINT) AS n", "CAST(instr(c_name, '#') AS BIGINT) AS at", "lpad(CAST(c_custkey AS STRING), 8, '0') AS padded", "regexp_replace(c_name, '[0-9]+', 'N') AS pattern")


@q("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate) = o_orderdate AS first, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS since, o_orderdate + INTERVAL 36 HOUR AS later, CAST(last_day(o_orderdate) AS DATE) AS ends FROM orders")
def fn_time(t):
    return t("orders").selectExpr("o_orderkey", "CAST(year(o_orderdate) AS BIGINT) AS y", "CAST(month(o_orderdate) AS BIGINT) AS m", "date_trunc('MONTH', o_orderdate) = o_orderdate AS first", "CAST(datediff(o_orderdate, date'1992-01-01') AS BIGINT) AS since", "o_orderdate + make_dt_interval(0, 36, 0, 0) AS later", "last_day(o_orderdate) AS ends")


@q("SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, p_size % 7 AS m, greatest(p_size, 10) AS g, least(p_size, 10) AS l, round(sqrt(p_size), 6) AS s, round(ln(p_size + 1), 6) AS n FROM part")
def fn_math(t):
    return t("part").selectExpr("p_partkey", "abs(p_size - 25) AS a", "ceil(p_retailprice) AS c", "floor(p_retailprice) AS f", "p_size % 7 AS m", "greatest(p_size, 10) AS g", "least(p_size, 10) AS l", "round(sqrt(p_size), 6) AS s", "round(ln(p_size + 1), 6) AS n")


@q("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band FROM events")
def fn_conditional(t):
    return t("events").selectExpr("event_id", "coalesce(nullif(event_type, 'click'), 'none') AS kind", "CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band")


@q("SELECT p_partkey, CAST(len(w) AS BIGINT) AS n, w[1] AS first, list_contains(w, 'x') AS has FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part) x")
def fn_array(t):
    return t("part").withColumn("w", F.split("p_type", " ")).selectExpr("p_partkey", "CAST(size(w) AS BIGINT) AS n", "element_at(w, 1) AS first", "array_contains(w, 'x') AS has")


@q("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@q("SELECT n_nationkey, n_name AS v FROM nation")
def fn_map(t):
    one = t("nation").select("n_nationkey", F.create_map(F.lit("name"), "n_name").alias("m"))
    return one.select("n_nationkey", F.element_at("m", "name").alias("v"))


@q("SELECT p_partkey, array_to_string([upper(x) for x in w], '/') AS upper_words, CAST(len([x for x in w if length(x) > 5]) AS BIGINT) AS long_words FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part) x")
def fn_array_lambda(t):
    return t("part").withColumn("w", F.split("p_type", " ")).selectExpr("p_partkey", "array_join(transform(w, x -> upper(x)), '/') AS upper_words", "CAST(size(filter(w, x -> length(x) > 5)) AS BIGINT) AS long_words")


@q("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) x GROUP BY word")
def fn_explode(t):
    return t("part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@q("SELECT p_partkey, array_to_string(map_keys(m), ',') AS names, CAST(map_values(m)[2] AS BIGINT) AS second, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT p_partkey, map(['size', 'key'], [CAST(p_size AS BIGINT), CAST(p_partkey AS BIGINT)]) AS m FROM part) x")
def fn_map_parts(t):
    made = t("part").selectExpr("p_partkey", "map('size', CAST(p_size AS BIGINT), 'key', CAST(p_partkey AS BIGINT)) AS m")
    return made.selectExpr("p_partkey", "array_join(map_keys(m), ',') AS names", "element_at(map_values(m), 2) AS second", "CAST(cardinality(m) AS BIGINT) AS n")


@q("SELECT event_id, k, '{\"k\":' || k || '}' AS again FROM (SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events) x")
def fn_json_struct(t):
    parsed = t("events").select("event_id", F.coalesce(F.from_json("props", "k BIGINT")["k"], F.lit(-1)).alias("k"))
    return parsed.select("event_id", "k", F.to_json(F.struct("k")).alias("again"))


@q("SELECT * FROM (VALUES ('public', 'orders', 'by_customer'), ('public', 'orders', 'by_status')) v(schemaname, tablename, indexname)")
def s18_pg_catalog(t):
    return indexed.orders(t).sql("SELECT i.schemaname, i.tablename, i.indexname FROM pg_catalog.pg_indexes i JOIN pg_class c ON c.relname = i.indexname WHERE c.relkind = 'i'")


def _topk(t):
    return t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(5)


@q()
def x1_explain(t):
    return explain.explain(_topk(t), verbose=True)


@q()
def x2_explain_dist(t):
    return explain.explain(_topk(t), dist=True)


@q()
def x3_explain_json(t):
    return explain.explain(_topk(t), dist=True, as_json=True)


@q("SELECT 'covered' AS query, 'index_only' AS kind, 'by_status' AS index, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'narrow', 'index_only', 'by_customer', count(*) FROM orders WHERE o_custkey = 10 UNION ALL SELECT 'wide', 'table', NULL, count(*) FROM orders WHERE o_totalprice > 0")
def x5_access_path(t):
    """How a session reads an indexed table for three queries, and what each of them counts."""
    s = indexed.orders(t)
    rows = []
    for name, where in (("covered", "o_orderstatus = 'P'"), ("narrow", "o_custkey = 10"), ("wide", "o_totalprice > 0")):
        df, paths = s.planned(st.Query(f"SELECT count(*) AS n FROM orders WHERE {where}"))
        path = paths["orders"]
        rows.append((name, path.kind, path.index.name if path.index else None, df.first()["n"]))
    return t.spark.createDataFrame(rows, "query STRING, kind STRING, index STRING, n BIGINT")


@q("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def g2_tumbling_window(t):
    out = t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@q("SELECT b.start + INTERVAL (s * 30) MINUTE AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE AS start FROM events) b, (SELECT unnest([0, 1]) AS s) k GROUP BY 1")
def g2_sliding_window(t):
    out = t("events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


@q("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, date_trunc('millisecond', max(ts)) AS last FROM events GROUP BY user_id")
def g4_keyed_state(t):
    """What a stream over the events holds of each key at its end. A batch that comes again replaces its own rows."""
    folder = indexed.folder(t.spark)
    stream = t.spark.readStream.schema(t("events").schema).parquet(f"{t.sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))

    def write(rows, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = ingest.keyed(stream, "ts", ["user_id"], "value").writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    held = t.spark.read.parquet(f"{folder}/rows").groupBy("user_id")
    return held.agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"), F.timestamp_millis(F.max("last_ms")).cast("timestamp_ntz").alias("last"))


@q("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def g3_session_window(t):
    out = t("events").groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")
