"""Tables end to end: constraints, changes, transactions, indexes, plans; random changes against a dict."""

import random

import pytest
from pyspark.errors import ArithmeticException

from millrace import dml
from millrace.errors import EngineError
from millrace.functions import pg
from millrace.meta import Table
from millrace.session import Admission, Session, unmet
from millrace.sources import files
from millrace.store import Store

from .test_statements import DDL


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, Store(spark, f"file://{tmp_path}/db"))


def state(fn, *args):
    with pytest.raises(EngineError) as e:
        fn(*args)
    return e.value.sqlstate


def test_defaults_and_checks(session):
    s = session.sql
    s(DDL)
    assert state(s, DDL) == "42P07"
    assert s("INSERT INTO harvest (crate) VALUES (10)") == 1
    assert s("INSERT INTO harvest (crate, grade, kilos) VALUES (11, 'fine', 40)") == 1
    for values, expected in (("(crate, kilos) VALUES (12, 2)", "23514"), ("(crate, grade) VALUES (12, NULL)", "23502"), ("(crate) VALUES (10)", "23505"), ("(crate) VALUES (14), (14)", "23505"), ("(weight) VALUES (14)", "42703")):
        assert state(s, f"INSERT INTO harvest {values}") == expected, values
    for change, expected in (("UPDATE harvest SET kilos = 1 WHERE crate = 10", "23514"), ("UPDATE harvest SET kilos = 50", "0A000"), ("UPDATE harvest SET crate = 3 WHERE crate = 10", "0A000"), ("DELETE FROM harvest WHERE grade = 'fine'", "0A000"), ("DELETE FROM orchard WHERE tree = 1", "42P01")):
        assert state(s, change) == expected, change
    rows = s("SELECT crate, grade, kilos, picked IS NOT NULL AS p FROM harvest ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(10, "raw", 12, True), (11, "fine", 40, True)]


def test_unsigned_is_exact(session):
    """Values beyond what a double tells apart, at both ends of each unsigned type's range."""
    s = session.sql
    s("CREATE TABLE gauges (g BIGINT PRIMARY KEY, ticks BIGINT UNSIGNED NOT NULL DEFAULT 9223372036854775809)")
    top = 2**64 - 1
    s(f"INSERT INTO gauges (g, ticks) VALUES (5, {top}), (6, {top - 2}), (7, 0)")
    s("INSERT INTO gauges (g) VALUES (8)")
    assert [int(r[0]) for r in s("SELECT ticks FROM gauges ORDER BY g").collect()] == [top, top - 2, 0, 2**63 + 1]
    for value in (-1, top + 1):
        assert state(s, f"INSERT INTO gauges VALUES (9, {value})") == "22023"


def test_integer_range_and_missing_parameters(session):
    s = session.sql
    s("CREATE TABLE small (id BIGINT PRIMARY KEY, n SMALLINT)")
    assert state(s, "INSERT INTO small SELECT 1, 40000") == "22003"
    assert state(s, "SELECT $2 + 1", [1]) == "42601"
    assert s("SELECT count(*) FROM small").first()[0] == 0


def test_insert_select_series_and_parameters(session):
    s = session.sql
    s("CREATE TABLE tickets (ticket BIGINT PRIMARY KEY, gate BIGINT NOT NULL, cents BIGINT NOT NULL)")
    for _ in range(2):
        s("INSERT INTO tickets WITH last AS (SELECT coalesce(max(ticket), 1000) AS n FROM tickets) SELECT last.n + k.id, k.id % 6, 250 * (k.id % 11) FROM last CROSS JOIN generate_series(1, 90) AS k")
    assert s("SELECT max(ticket) FROM tickets").first()[0] == 1180
    assert s("SELECT count(*) FROM tickets WHERE gate = $1 AND ticket <= $2", [3, 1090]).first()[0] == 15
    assert state(s, "INSERT INTO tickets SELECT 1005, 1, 1") == "23505"


def test_unique_index(session):
    s = session.sql
    s("CREATE TABLE users (user_id BIGINT PRIMARY KEY, email TEXT, country TEXT)")
    s("INSERT INTO users VALUES (1, 'a@x', 'de'), (2, NULL, 'de'), (3, NULL, 'fr')")
    s("CREATE UNIQUE INDEX by_email ON users (email)")
    assert state(s, "CREATE INDEX by_email ON users (country)") == "42710"
    assert state(s, "INSERT INTO users VALUES (4, 'a@x', 'de')") == "23505"
    assert s("INSERT INTO users VALUES (4, NULL, 'de')") == 1
    assert state(s, "UPDATE users SET email = 'a@x' WHERE user_id = 2") == "23505"
    assert state(s, "CREATE UNIQUE INDEX by_country ON users (country)") == "23505"
    assert [i.name for i in session.store.snapshot("users").table.indexes] == ["by_email"]
    s("DROP INDEX by_email")
    assert state(s, "DROP INDEX by_email") == "42704"
    s("DROP INDEX IF EXISTS by_email")


def test_transactions(session, spark):
    s = session.sql
    s("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT)")
    s("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    other = Session(spark, session.store)
    s("BEGIN")
    assert s("UPDATE t SET v = 'mine' WHERE id = 1") == 1
    assert s("DELETE FROM t WHERE id = 2") == 1
    assert s("INSERT INTO t VALUES (9, 'new')") == 1
    assert [tuple(r) for r in s("SELECT * FROM t ORDER BY id").collect()] == [(1, "mine"), (3, "c"), (9, "new")]
    assert other.sql("SELECT count(*) FROM t").first()[0] == 3
    assert session.locks().count() == 2
    other.sql("UPDATE t SET v = 'theirs' WHERE id = 3")
    assert state(s, "COMMIT") == "40001"
    assert state(s, "SELECT 1") == "25P02"
    s("ROLLBACK")
    s("BEGIN")
    s("DELETE FROM t WHERE id = 3")
    s("COMMIT")
    assert [r[0] for r in other.sql("SELECT id FROM t ORDER BY id").collect()] == [1, 2]
    session.most_rows = 1
    assert state(s, "DELETE FROM t WHERE id > 0") == "54000"


def test_random_changes_match_a_dict(session):
    s, rng, model = session.sql, random.Random(5), {}
    s("CREATE TABLE r (id BIGINT PRIMARY KEY, v BIGINT) TBLPROPERTIES ('hash_buckets' = '3')")
    for _ in range(14):
        a, b = sorted((rng.randrange(20), rng.randrange(20)))
        kind = rng.choice(["insert", "insert", "update", "delete"])
        if kind == "insert":
            if a in model:
                assert state(s, f"INSERT INTO r VALUES ({a}, {b})") == "23505"
            else:
                s(f"INSERT INTO r VALUES ({a}, {b})")
                model[a] = b
        elif kind == "update":
            hit = [k for k in model if a <= k <= b]
            assert s(f"UPDATE r SET v = {a} WHERE id >= {a} AND id <= {b}") == len(hit)
            model |= dict.fromkeys(hit, a)
        else:
            hit = [k for k in model if a < k < b]
            assert s(f"DELETE FROM r WHERE id > {a} AND id < {b}") == len(hit)
            for k in hit:
                del model[k]
    s("ALTER TABLE r SET TBLPROPERTIES ('primary_key_distribution' = 'range')")
    assert {r.id: r.v for r in s("SELECT * FROM r").collect()} == model


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin", "Africa/Cairo"])
def test_age_by_type(session, spark, zone):
    s, before = session.sql, spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert s("SELECT pg_catalog.age(10, 3) AS d").first()[0] == 7
        text = "SELECT CAST(age(TIMESTAMP_NTZ'2024-03-31 01:00:00', TIMESTAMP_NTZ'2024-02-28 02:00:00') AS STRING) AS d, 'age(1)' AS t"
        assert tuple(s(text).first()) == ("1 months 2 days 23 hours", "age(1)")
        for day in ("2024-03-10", "2024-03-31", "2024-04-26"):  # clocks change in one of the zones
            rows = spark.sql(f"SELECT TIMESTAMP_NTZ'{day} 10:00:00' AS a, TIMESTAMP_NTZ'{day} 10:00:00' - INTERVAL 1 DAY AS b")
            assert rows.select(pg.age("a", "b").cast("string")).first()[0] == "1 days"
            assert s(f"SELECT CAST(age(TIMESTAMP_NTZ'{day} 10:00:00.5', TIMESTAMP_NTZ'{day} 00:30:00') AS STRING) AS d").first()[0] == "9 hours 30 minutes 0.5 seconds"
        assert s("SELECT age(NULL, TIMESTAMP_NTZ'2024-02-28') IS NULL AS n").first()[0]
        today = s("SELECT CAST(age(CAST(CAST(convert_timezone('UTC', current_timestamp()::timestamp_ntz) AS DATE) AS TIMESTAMP_NTZ)) AS STRING) AS d").first()[0]
        assert today == "0 seconds", "midnight of today by UTC is where age starts"
        assert s("SELECT txid_current() - age(0) AS z").first()[0] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_explain_and_admission(session):
    s = session.sql
    rows = s("EXPLAIN (DIST) SELECT id % 3 AS k, count(*) FROM range(100) GROUP BY 1 ORDER BY 2 DESC LIMIT 2").collect()
    assert {"partial aggregate", "final aggregate", "exchange"} <= {r.operator for r in rows}
    assert '"rows": 100' in s("EXPLAIN (ANALYZE, FORMAT JSON) SELECT * FROM range(100)").first()[0]
    s("CREATE TABLE paths (id BIGINT PRIMARY KEY, v TEXT)")
    s("INSERT INTO paths VALUES (1, 'a')")
    s("CREATE INDEX by_v ON paths (v)")
    assert '"kind": "index_only"' in s("EXPLAIN SELECT count(*) FROM paths WHERE v = 'a'").where("plan_type = 'access_path'").first()["plan"]


def test_time_limit_and_admission_cover_the_run(session):
    session.timeout_s = 2
    slow = "SELECT count(*) FROM range(100000000) a JOIN range(10000) b ON a.id % 7 < b.id"
    assert state(session.sql, f"EXPLAIN (ANALYZE) {slow}") == "57014"
    assert state(session.sql, slow) == "57014", "a SELECT runs under the limit"
    session.timeout_s = 60
    assert [r[0] for r in session.sql("SELECT id FROM range(50) ORDER BY id DESC").collect()] == list(range(49, -1, -1))
    session.admission["read"] = Admission(running=1, waiting=0)
    with session.admission["read"].admitted():
        assert state(session.sql, "SELECT 1") == "53300"
    assert session.sql("SELECT 1").first()[0] == 1


def test_scan_limit_counts_what_is_scanned(session):
    session.sql("CREATE TABLE wide (id BIGINT PRIMARY KEY, v TEXT)")
    session.sql("INSERT INTO wide SELECT id, 'x' FROM generate_series(1, 100)")
    session.most_scan_rows = 99
    assert state(session.sql, "SELECT count(*) FROM wide") == "54000"
    session.most_scan_rows = 100
    assert session.sql("SELECT count(*) FROM wide").first()[0] == 100


def test_reads_through_indexes(session):
    """A covered query reads the projections, a selective one only the files that hold its keys; changes keep both current."""
    s = session.sql
    s("CREATE TABLE sales (id BIGINT PRIMARY KEY, shop BIGINT, day BIGINT, note TEXT)")
    for k in range(4):
        s(f"INSERT INTO sales SELECT {1000 * k} + id, {k}, id % 5, repeat(uuid(), 20) FROM generate_series(1, 500)")
    s("CREATE INDEX by_shop ON sales (shop) INCLUDE (day)")

    def read(sql):
        return {p.split("/sales/")[1].split("/")[0] for p in s(sql).inputFiles()}

    covered, selective = "SELECT shop, sum(day) AS d FROM sales WHERE shop IN (1, 2) GROUP BY 1 ORDER BY 1", "SELECT count(note) FROM sales WHERE shop = 3"
    assert read(covered) == {"indexes"} and read(selective) == {"data"} and len(s(selective).inputFiles()) == 1
    assert [tuple(r) for r in s(covered).collect()] == [(1, 1000), (2, 1000)] and s(selective).first()[0] == 500
    assert read("SELECT * FROM sales WHERE day = 2") == {"data"}
    s("UPDATE sales SET shop = 1 WHERE id >= 3001 AND id <= 3100")
    s("DELETE FROM sales WHERE id >= 2001 AND id <= 2400")
    s("INSERT INTO sales VALUES (9000, 2, 7, 'n')")
    assert read(covered) == {"indexes"} and s(selective).first()[0] == 400
    assert [tuple(r) for r in s(covered).collect()] == [(1, 1200), (2, 207)]
    s("BEGIN")
    s("INSERT INTO sales VALUES (9001, 2, 1, 'n')")
    assert s(covered).collect()[1][1] == 208
    s("ROLLBACK")
    assert s(covered).collect()[1][1] == 207


def test_failed_backfill_leaves_no_index(session, monkeypatch):
    session.sql("CREATE TABLE b (id BIGINT PRIMARY KEY, v TEXT)")
    session.sql("INSERT INTO b VALUES (1, 'x')")

    def broken(*_):
        raise RuntimeError("a lost disk")

    monkeypatch.setattr(Store, "project", broken)
    with pytest.raises(RuntimeError):
        session.sql("CREATE INDEX i ON b (v)")
    assert session.store.snapshot("b").table.indexes == ()


def test_commits_rewrite_only_touched_files(session):
    s = session.sql
    s("CREATE TABLE c (id BIGINT PRIMARY KEY, v TEXT)")
    for k in range(3):
        s(f"INSERT INTO c SELECT {100 * k} + id, 'x' FROM generate_series(1, 50)")
    before = {f.path for f in session.store.snapshot("c").files}
    s("BEGIN")
    s("UPDATE c SET v = 'y' WHERE id = 120")
    s("INSERT INTO c VALUES (500, 'z')")
    s("COMMIT")
    after = {f.path for f in session.store.snapshot("c").files}
    assert len(before) == 3 and len(before & after) == 2 and len(after) == 4
    now = dml.tombstone(session.store, session.store.snapshot("c"), session.spark.sql("SELECT explode(array(10, 220, 999)) AS id"))
    kept = {f.path for f in now.files}
    assert len(kept & after) == 2 and now.rows == 149
    assert s("SELECT count(*) FROM c WHERE id IN (10, 220)").first()[0] == 0


def test_manifests(session, spark):
    """Half a manifest that somebody left locks nothing; of two writers one is refused; files are listed as changes."""
    s = session.sql
    s("CREATE TABLE m (id BIGINT PRIMARY KEY, v TEXT)")
    for k in range(24):
        if k == 3:
            path = session.store._manifest("m", session.store.snapshot("m").version + 1)
            session.store.fs.create(session.store._path(path), False).close()
        s(f"INSERT INTO m VALUES ({k}, 'x')")
    assert len(session.store.snapshot("m").files) == 24 and Store(spark, session.store.folder).snapshot("m").rows == 24
    last = session.store.snapshot("m")
    session.store.commit(last)
    assert state(session.store.commit, last) == "40001"


def test_old_metadata_is_read():
    data = {"name": "o", "columns": [{"name": "id", "type": "int64", "nullable": False}], "key": "id", "schema_version": 1}
    table = Table.from_json(data)
    assert (table.distribution, table.indexes, table.schema_version) == ("range", (), 2)


def test_conditional_write_applies_or_leaves_all(session, spark):
    s = session.sql
    s("CREATE TABLE k (id BIGINT PRIMARY KEY, v TEXT)")
    s("INSERT INTO k VALUES (1, 'a'), (2, NULL)")
    store = session.store
    rows = lambda *r: spark.createDataFrame(r, "id BIGINT, v STRING")
    after, conflicts = dml.apply_if(store, store.snapshot("k"), rows((1, "x"), (3, "new")), rows((1, "a")))
    assert conflicts.isEmpty() and sorted(map(tuple, store.read(after).collect())) == [(1, "x"), (2, None), (3, "new")]
    for seen in (rows((1, "a"), (2, None)), rows((2, None))):
        same, conflicts = dml.apply_if(store, after, rows((1, "y"), (2, "y")), seen)
        assert same is after and [r.id for r in conflicts.collect()] == [1]


def test_conditions_on_versions(spark):
    """A condition holds for the newest version, and 0 for a key without one or with a deleted one."""
    held = spark.createDataFrame([(1, 5, False), (1, 7, False), (2, 6, True)], "k BIGINT, seq BIGINT, deleted BOOLEAN")
    wanted = [(1, 7, True), (1, 5, False), (1, 0, False), (2, 0, True), (2, 6, True), (2, 4, False), (3, 0, True), (3, 1, False)]
    for k, expected, met in wanted:
        assert unmet(held, spark.createDataFrame([(k, expected)], "k BIGINT, expected BIGINT"), "k", "seq").isEmpty() == met, (k, expected)


def test_sum_beyond_its_range_is_an_error(session):
    with pytest.raises(ArithmeticException):
        session.sql("SELECT sum(n) FROM VALUES (9223372036854775807L), (1L) AS v(n)").collect()


def test_catalogue_qualify_and_files(session, spark, tmp_path):
    s = session.sql
    s("CREATE TABLE cat (id BIGINT PRIMARY KEY, v TEXT NOT NULL)")
    assert [r[0] for r in s("SELECT column_name FROM information_schema.columns WHERE table_name = 'cat' ORDER BY ordinal_position").collect()] == ["id", "v"]
    assert s("SELECT count(*) FROM information_schema . tables").first()[0] == 1
    s("CREATE INDEX cat_by_v ON cat (v)")
    columns = "SELECT a.attname, a.attnotnull FROM pg_catalog.pg_class c JOIN pg_attribute a ON a.attrelid = c.oid WHERE c.relname = 'cat' ORDER BY a.attnum"
    assert [tuple(r) for r in s(columns).collect()] == [("id", True), ("v", True)]
    assert s("SELECT hasindexes FROM pg_tables WHERE tablename = 'cat'").first()[0]
    s("BEGIN")
    assert s("SELECT count(*) FROM pg_catalog.pg_locks WHERE granted").first()[0] == 2
    s("ROLLBACK")
    assert s("SELECT count(*) FROM pg_locks").first()[0] == 0
    assert [r.id for r in s("SELECT id FROM range(9) QUALIFY row_number() OVER (PARTITION BY id % 3 ORDER BY id DESC) = 1 ORDER BY id").collect()] == [6, 7, 8]
    rows = spark.sql("SELECT id, concat('v', id) AS v FROM range(7)")
    for kind in files.FORMATS:
        files.write(rows, f"{tmp_path}/{kind}", kind)
        assert files.read(spark, f"{tmp_path}/{kind}", kind, "id BIGINT, v STRING").count() == 7
    with pytest.raises(ValueError):
        files.read(spark, f"{tmp_path}/csv", "csv")


def test_stream_windows_and_sessions(spark, tmp_path):
    """A late row is dropped once the watermark has passed it; windows and sessions close."""
    from millrace.streaming import ingest

    def run(make, name):
        folder = tmp_path / name
        folder.mkdir()
        stream = spark.readStream.schema("ts TIMESTAMP, k STRING, n BIGINT").option("maxFilesPerTrigger", 1).json(str(folder))
        for i, rows in enumerate((["10:00", "10:04", "10:31"], ["12:00"], ["10:02", "12:01"])):
            spark.createDataFrame([(f"2024-01-01 {t}:00", "a", 1) for t in rows], "ts STRING, k STRING, n BIGINT").coalesce(1).write.mode("append").json(str(folder))
            if i == 0:
                query = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-cp").start()
            query.processAllAvailable()
        query.stop()
        return sorted((str(r.start)[11:16], str(r.end)[11:16], r.n) for r in spark.table(name).collect())

    assert run(lambda x: ingest.windowed(x, "ts", ["k"], "10 minutes", late="5 minutes", value="n"), "w") == [("10:00", "10:10", 2), ("10:30", "10:40", 1)]
    assert run(lambda x: ingest.sessions(x, "ts", ["k"], "10 minutes", late="5 minutes"), "s") == [("10:00", "10:14", 2), ("10:31", "10:41", 1)]


def test_keyed_state_lives_until_the_key_is_idle(spark, tmp_path):
    from millrace.streaming import ingest

    folder = tmp_path / "keys"
    folder.mkdir()
    stream = spark.readStream.schema("ts TIMESTAMP, k STRING, v INT").json(str(folder))
    query = ingest.keyed(stream, "ts", ["k"], "v", late="5 minutes", idle_ms=1_800_000).writeStream.outputMode("update").format("memory").queryName("keys").option("checkpointLocation", f"{tmp_path}/cp").start()
    for rows in ([("10:00", "a", 1), ("10:05", "a", None), ("10:05", None, 4)], [("10:20", "a", 2)], [("12:00", "b", 7)], [("10:21", "a", 9), ("12:01", "a", 3)]):
        spark.createDataFrame([(f"2024-01-01 {t}:00", k, v) for t, k, v in rows], "ts STRING, k STRING, v INT").coalesce(1).write.mode("append").json(str(folder))
        query.processAllAvailable()
    query.stop()
    got = sorted((str(r.k), r.n, r.total, r.closed) for r in spark.table("keys").collect())
    assert got == [("None", 1, 4.0, False), ("None", 1, 4.0, True), ("a", 1, 3.0, False), ("a", 2, 1.0, False), ("a", 3, 3.0, False), ("a", 3, 3.0, True), ("b", 1, 7.0, False)]


def test_stream_ingest(session, spark, tmp_path):
    from millrace.streaming import ingest

    session.sql("CREATE TABLE e (id BIGINT PRIMARY KEY, v TEXT NOT NULL)")
    spark.range(50).selectExpr("id", "concat('v', id) AS v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id BIGINT, v STRING").parquet(f"{tmp_path}/in")
    ingest.ingest(stream, session.store, "e", f"{tmp_path}/cp").awaitTermination()
    assert session.sql("SELECT count(*) FROM e").first()[0] == 50
    with pytest.raises(Exception, match="23505"):  # a key that is there already stops the stream and leaves the row
        spark.sql("SELECT 1L AS id, 'other' AS v").write.parquet(f"{tmp_path}/again")
        again = spark.readStream.schema("id BIGINT, v STRING").parquet(f"{tmp_path}/again")
        ingest.ingest(again, session.store, "e", f"{tmp_path}/cp2").awaitTermination()
    assert session.sql("SELECT v FROM e WHERE id = 1").first()[0] == "v1"


def test_stream_batch_that_comes_again_is_known(session, spark, tmp_path):
    """The stream's record of a batch is lost after the rows were committed: the batch comes again and is skipped."""
    from pathlib import Path

    from millrace.streaming import ingest

    session.sql("CREATE TABLE twice (id BIGINT PRIMARY KEY, v TEXT)")
    spark.sql("SELECT id, 'a' AS v FROM range(20)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id BIGINT, v STRING").parquet(f"{tmp_path}/in")
    ingest.ingest(stream, session.store, "twice", f"{tmp_path}/cp").awaitTermination()
    version = session.store.snapshot("twice").version
    for f in Path(f"{tmp_path}/cp/commits").glob("*0*"):
        f.unlink()
    ingest.ingest(stream, session.store, "twice", f"{tmp_path}/cp").awaitTermination()
    assert session.store.snapshot("twice").version == version and session.store.snapshot("twice").rows == 20
