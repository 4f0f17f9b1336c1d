"""Ranks over buckets, names, runs of keys, scratch tables."""

import pyarrow as pa

from millrace.llm.common import Scratch, WordHashes, fresh, ranked, runs, scratch_root, words_of


def test_ranks_are_gapless_over_buckets(spark):
    rows = Scratch(spark, "test").save(spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 11 END AS length", "id", "id % 5 AS x"), "rows")
    for few, order in ((True, "id"), (False, "id"), (True, "x")):  # many rows tie in x
        out = ranked(rows, "length", [order], per_bucket=7, few_keys=few).collect()
        by = {}
        for r in out:
            by.setdefault(r.length, []).append(r["rank"])
        assert len(out) == 500 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_word_tables_are_bounded_in_bytes():
    class Small(WordHashes):
        room = 5_000

    table, words = Small(), [b"%d" % i for i in range(500)] + [b"x" * 100_000]
    assert table.of(words).tolist() == [table.hash_of(w) for w in words] and 10 < len(table) < 40


def test_fresh_names():
    assert fresh(["a", "_ID", "__id"], "_id") == "___id" and fresh([], "x") == "x"


def test_words_are_cut_at_six_characters():
    assert words_of("a b\tc\nd\x0be\x0cf\rg\x85h\xa0i\x1cj") == [b"a", b"b", b"c", b"d", b"e", b"f", "g\x85h\xa0i\x1cj".encode()]
    assert words_of(None) == words_of(" \n") == []


def test_runs_go_over_batch_ends():
    table = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    got = [(k, t["v"].to_pylist()) for k, t in runs(iter(table.to_batches(max_chunksize=2)), ["k"])]
    assert got == [((1,), [0, 1]), ((2,), [2, 3, 4]), ((3,), [5])]


def test_scratch_is_in_the_shared_folder(spark, tmp_path):
    assert scratch_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or scratch_root(spark))
    scratch = Scratch(spark, "test")
    saved = scratch.save(spark.range(0), "empty")
    assert saved.count() == 0 and saved.columns == ["id"]
    scratch.drop("empty")
