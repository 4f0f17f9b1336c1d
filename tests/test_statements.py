"""The statement reader: definitions, bounded changes, SQLSTATEs."""

import pytest

from millrace import statements as st
from millrace.errors import EngineError
from millrace.meta import NOW


def state(sql, params=None):
    with pytest.raises(EngineError) as e:
        st.parse(sql, params)
    return e.value.sqlstate


DDL = "CREATE TABLE harvest (crate BIGINT PRIMARY KEY, grade TEXT NOT NULL DEFAULT 'raw', kilos BIGINT NOT NULL DEFAULT 12, picked TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP, CHECK (kilos >= 3), CHECK (grade <> 'lost'))"


def test_create_table():
    t = st.parse(DDL).table
    assert t.key == "crate" and not t.column("crate").nullable
    assert t.column("picked").default is NOW and t.column("kilos").default == 12
    assert [(c.name, c.sql) for c in t.checks] == [("harvest_check", "`kilos` >= 3"), ("harvest_check1", "`grade` <> 'lost'")]


def test_integer_is_64_bits_and_lengths_are_free():
    t = st.parse("CREATE TABLE t (id INT NOT NULL, a VARCHAR(3), b INT32, c DOUBLE PRECISION, d BIGINT UNSIGNED, PRIMARY KEY (id))").table
    assert [c.type for c in t.columns] == ["int64", "utf8", "int32", "float64", "uint64"]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("CREATE TABLE t (a INT)", "0A000"),
        ("CREATE TABLE t (a INT, b INT, PRIMARY KEY (a, b))", "0A000"),
        ("CREATE TABLE t (a INT, PRIMARY KEY (a))", "23502"),
        ("CREATE TABLE t (a TEXT PRIMARY KEY)", "42804"),
        ("CREATE TABLE t (a INT PRIMARY KEY, a INT)", "42701"),
        ("CREATE TABLE t (a INT PRIMARY KEY, CHECK (z > 1))", "42703"),
        ("CREATE TABLE t (a INT PRIMARY KEY, CONSTRAINT k CHECK (a > 1), CONSTRAINT k CHECK (a > 2))", "42710"),
        ("CREATE TABLE t (a INT PRIMARY KEY, b DATE)", "0A000"),
        ("CREATE TABLE t (a INT PRIMARY KEY, b TIMESTAMP WITH TIME ZONE)", "0A000"),
        ("CREATE TABLE t (a INT PRIMARY KEY, b INT UNIQUE)", "0A000"),
        ("CREATE TABLE t AS SELECT 1", "0A000"),
        ("CREATE TEMP TABLE t (a INT PRIMARY KEY)", "0A000"),
        ("CREATE INDEX CONCURRENTLY i ON t (a)", "0A000"),
        ("CREATE INDEX i ON t (a DESC)", "0A000"),
        ("CREATE INDEX i ON t (a) WHERE a > 1", "0A000"),
        ("DROP TABLE t", "0A000"),
        ("TRUNCATE t", "0A000"),
        ("ALTER TABLE t ADD COLUMN b INT", "0A000"),
        ("INSERT INTO t VALUES (1) ON CONFLICT DO NOTHING", "0A000"),
        ("INSERT INTO t VALUES (1), (1, 2)", "42601"),
        ("UPDATE t SET a = 1 WHERE id = 1 OR id = 2", "0A000"),
        ("UPDATE t SET a = 1 WHERE id IN (1, 2)", "0A000"),
        ("UPDATE t SET a = 1, a = 2 WHERE id = 1", "42701"),
        ("DELETE FROM t USING u WHERE id = 1", "0A000"),
        ("BEGIN ISOLATION LEVEL SERIALIZABLE", "0A000"),
        ("EXPLAIN (FORMAT XML) SELECT 1", "0A000"),
        ("UPDATE t SET a = WHERE", "0A000"),
        ("INSERT INTO t VALUES (1", "42601"),
    ],
)
def test_refusals(sql, expected):
    assert state(sql) == expected


def test_check_grammar_is_three_valued_and_strips_casts():
    t = st.parse("CREATE TABLE t (a INT PRIMARY KEY, b TEXT, CHECK (NOT (a < 0 OR b IS NULL) AND CAST(a AS INT) <= 10::BIGINT))").table
    assert t.checks[0].sql == "(NOT ((`a` < 0) OR (`b` IS NULL))) AND `a` <= 10"


def test_bounds():
    d = st.parse("DELETE FROM t WHERE id >= 5 AND 20 > id")
    assert st.key_bounds(d.where, "id") == st.Bounds(5, 19)
    assert st.key_bounds(st.parse("DELETE FROM t WHERE id > 5 AND id < 3").where, "id").empty
    assert st.key_bounds(st.parse("DELETE FROM t WHERE (id = $1)", [7]).where, "id") == st.Bounds(7, 7)
    for where in ([], [("other", "=", 1)], [("id", "=", "x")]):
        with pytest.raises(EngineError) as e:
            st.key_bounds(where, "id")
        assert e.value.sqlstate == "0A000"


def test_explain_options():
    e = st.parse("EXPLAIN (ANALYZE, DIST TRUE, FORMAT JSON) SELECT 1")
    assert (e.query, e.analyze, e.dist, e.json) == ("SELECT 1", True, True, True)


def test_index():
    c = st.parse("CREATE UNIQUE INDEX IF NOT EXISTS i ON s.t USING HASH (a, b) INCLUDE (c) WITH (hash_buckets = 16)")
    assert (c.table, c.index.keys, c.index.include, c.index.unique, c.index.using, c.index.buckets) == ("t", ("a", "b"), ("c",), True, "hash", 16)


def test_qualify():
    assert st.without_qualify("SELECT 1") == "SELECT 1"
    out = st.without_qualify("WITH x AS (SELECT 1 AS a) SELECT a FROM x QUALIFY row_number() OVER (ORDER BY a) = 1 ORDER BY a LIMIT 3")
    assert out.split() == "WITH x AS (SELECT 1 AS a) SELECT * EXCEPT (_qualified) FROM (SELECT a , (row_number() OVER (ORDER BY a) = 1) AS _qualified FROM x ) WHERE _qualified ORDER BY a LIMIT 3".split()
    with pytest.raises(EngineError):
        st.without_qualify("SELECT DISTINCT a FROM x QUALIFY rank() OVER (ORDER BY a) = 1")
