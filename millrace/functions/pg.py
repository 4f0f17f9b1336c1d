"""Compatibility functions: age over timestamps and transaction ids, txid_current, start time, recovery; pg_locks."""

from __future__ import annotations

import datetime
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import PG_VIEWS, VIEWS

DAY = 86_400_000_000
UTC_MIDNIGHT = "CAST(CAST(convert_timezone('UTC', CAST(current_timestamp() AS TIMESTAMP_NTZ)) AS DATE) AS TIMESTAMP_NTZ)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_parts(later: Column | str, earlier: Column | str) -> dict[str, Column]:
    """months, days and micros between two timestamps without zone, as symbolic parts of one sign.

    Borrowed days are those of the month before the later date. A null gives nulls.
    """
    a, b = _col(later).cast("timestamp_ntz"), _col(earlier).cast("timestamp_ntz")
    swap = a < b
    hi, lo = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)

    def time(x: Column) -> Column:  # of the day, by the clock alone: no zone has a say
        return ((F.hour(x) * 3600 + F.minute(x) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long"))

    micros = time(hi) - time(lo)
    borrow_day = micros < 0
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - borrow_day.cast("int")
    borrow_month = days < 0
    before = F.dayofmonth(F.last_day(F.add_months(hi.cast("date"), -1)))
    months = 12 * (F.year(hi) - F.year(lo)) + F.month(hi) - F.month(lo) - borrow_month.cast("int")
    sign = F.when(swap, -1).otherwise(1)
    null = a.isNull() | b.isNull()
    parts = {"months": months, "days": days + F.when(borrow_month, before).otherwise(0), "micros": micros + F.when(borrow_day, DAY).otherwise(0)}
    return {k: F.when(~null, (sign * v).cast("long")) for k, v in parts.items()}


def age(later: Column | str, earlier: Column | str | None = None) -> Column:
    """age(a, b) as an interval; with one argument from midnight UTC of today."""
    if earlier is None:
        later, earlier = F.expr(UTC_MIDNIGHT), later
    p = age_parts(later, earlier)
    return F.make_interval(months=p["months"].cast("int"), days=p["days"].cast("int"), secs=(p["micros"] / 1_000_000).cast("decimal(18,6)"))


def age_xid(a: Column | str, b: Column | str) -> Column:
    """Difference of transaction ids, held at the ends of 64 bits."""
    wide = _col(a).cast("decimal(20,0)") - _col(b).cast("decimal(20,0)")
    return F.greatest(F.least(wide, F.lit(2**63 - 1).cast("decimal(20,0)")), F.lit(str(-(2**63))).cast("decimal(20,0)")).cast("long")


@dataclass
class Clock:
    """Transaction ids of a session and when it started."""

    started: datetime.datetime = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
    txid: int = 1
    _next: itertools.count = field(default_factory=lambda: itertools.count(2))

    def next(self) -> int:
        self.txid = next(self._next)
        return self.txid


def register(spark: SparkSession, clock: Clock, txid: int) -> None:
    """Makes the functions callable in SQL as temporary SQL functions; they inline into the plan."""
    start = clock.started.isoformat(sep=" ")
    for text in (
        f"txid_current() RETURNS BIGINT RETURN {int(txid)}L",
        f"pg_postmaster_start_time() RETURNS TIMESTAMP_NTZ RETURN TIMESTAMP_NTZ'{start}'",
        "pg_is_in_recovery() RETURNS BOOLEAN RETURN FALSE",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    xid = "CAST(greatest(least(CAST(a AS DECIMAL(20,0)) - CAST(b AS DECIMAL(20,0)), 9223372036854775807), -9223372036854775808) AS BIGINT)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION age_xid(a BIGINT, b BIGINT) RETURNS BIGINT RETURN {xid}")
    time = "(CAST(hour({0}) * 3600 + minute({0}) * 60 AS BIGINT) * 1000000 + CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT))"
    hi, lo = "(CASE WHEN a < b THEN b ELSE a END)", "(CASE WHEN a < b THEN a ELSE b END)"
    micros = f"({time.format(hi)} - {time.format(lo)})"
    days = f"(day({hi}) - day({lo}) - CAST({micros} < 0 AS INT))"
    sign = "(CASE WHEN a < b THEN -1 ELSE 1 END)"
    months = f"(12 * (year({hi}) - year({lo})) + month({hi}) - month({lo}) - CAST({days} < 0 AS INT))"
    body = f"make_interval(0, {sign} * {months}, 0, {sign} * ({days} + CASE WHEN {days} < 0 THEN day(last_day(add_months(CAST({hi} AS DATE), -1))) ELSE 0 END), 0, 0, CAST({sign} * ({micros} + CASE WHEN {micros} < 0 THEN {DAY} ELSE 0 END) / 1000000 AS DECIMAL(18, 6)))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION age_ts(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS INTERVAL RETURN {body}") if _intervals(spark) else None


def _intervals(spark: SparkSession) -> bool:
    """Whether this Spark lets an SQL function return a calendar interval."""
    try:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION _interval_probe() RETURNS INTERVAL RETURN make_interval(1)")
        return True
    except Exception:
        return False


def rewrite(sql: str) -> str:
    """Drops the pg_catalog prefix, names the catalogue's views as Spark has them, turns generate_series(a, b) into range(a, b + 1)."""
    out = re.sub(rf"\bpg_catalog\s*\.\s*(?=(?:age|txid_current|pg_postmaster_start_time|pg_is_in_recovery)\s*\(|(?:pg_locks|{'|'.join(PG_VIEWS)})\b)", "", sql, flags=re.I)
    for name, view in VIEWS.items():
        out = re.sub(rf"\b{name.replace('.', r'\s*\.\s*')}\b", view, out, flags=re.I)
    return re.sub(r"\bgenerate_series\s*\(([^(),]+),([^(),]+)\)", r"range(\1, (\2) + 1)", out, flags=re.I)


def has_age(sql: str) -> bool:
    return re.search(r"\bage\s*\(", sql, flags=re.I) is not None


def rewrite_age(sql: str, of_ids: bool, txid: int) -> str:
    """age(a[, b]) as the function over transaction ids, or the one over timestamps.

    With one argument from the current id, or from midnight UTC of today. Texts in quotes are left alone.
    """
    first = f"{int(txid)}L" if of_ids else UTC_MIDNIGHT
    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\bage\s*\(", sql, flags=re.I):
        if m.group().startswith("'") or m.start() < at:
            continue
        depth, commas, end = 1, 0, m.end()
        while end < len(sql) and depth:
            depth += (sql[end] == "(") - (sql[end] == ")")
            commas += sql[end] == "," and depth == 1
            end += 1
        arguments = rewrite_age(sql[m.end() : end - 1], of_ids, txid)
        out += [sql[at : m.start()], "age_xid(" if of_ids else "age_ts(", "" if commas else f"{first}, ", arguments, ")"]
        at = end
    return "".join(out) + sql[at:]


#: The columns of the lock view.
LOCK_COLUMNS = "locktype STRING, database BIGINT, relation BIGINT, page INT, tuple SMALLINT, virtualxid STRING, transactionid BIGINT, classid BIGINT, objid BIGINT, objsubid SMALLINT, virtualtransaction STRING, pid INT, mode STRING, granted BOOLEAN, fastpath BOOLEAN, waitstart TIMESTAMP"


def locks(spark: SparkSession, open_transactions: list[int]) -> DataFrame:
    """Two rows for each open transaction: its virtual id and its id."""
    rows = []
    for x in open_transactions:
        rows.append(("virtualxid", None, None, None, None, f"1/{x}", None, None, None, None, f"1/{x}", None, "ExclusiveLock", True, True, None))
        rows.append(("transactionid", None, None, None, None, None, x, None, None, None, f"1/{x}", None, "ExclusiveLock", True, False, None))
    return spark.createDataFrame(rows, LOCK_COLUMNS)
