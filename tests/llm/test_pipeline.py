"""The pipeline: its contract, planted cases, odd rows; every stage against its operator or brute force."""

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import line_rules, minhash, sentence_dedup


def prose(rng, sentences=14, lexicon=1500):
    return ". ".join(" ".join(f"k{''.join(chr(97 + int(c)) for c in str(x))}" for x in rng.integers(0, lexicon, 11)) for _ in range(sentences)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 clean documents; toxic ones; exact and near copies; a passage of over 50 words in several documents."""
    rng = np.random.default_rng(8)
    rows, toxic = [], []
    for i in range(300):
        text = prose(rng)
        if i % 6 == 0:
            words = text.split(" ")
            for k in rng.integers(0, len(words), 6):
                words[k] = "vilest"
            text = " ".join(words)
            toxic.append(i)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    passage = prose(rng, sentences=6)
    for i in (401, 402, 403):
        rows.append((i, f"{prose(rng)}\n{passage}\n{prose(rng)}", "en", "s1", 1))
    clean = prose(rng, 40)
    rows += [(500, clean, "en", "s0", 1), (501, clean, "en", "s2", 1), (502, clean.replace("a.", "b.", 2), "en", "s2", 1)]
    rows += [(600, None, None, None, None), (601, "", "en", None, 0), (None, prose(rng), "en", "s0", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return path, set(toxic), passage


def test_stages(spark, corpus):
    path, toxic, passage = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], path)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{path}/{k}")
        seen.append(spark.read.parquet(f"{path}/{k}"))
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in seen]
    assert len(toxic & set(ids[1])) <= 0.1 * len(toxic)
    clean = set(range(300)) - toxic
    assert len(clean - set(ids[1])) <= 0.03 * len(clean), "clean documents stay, but for what 200 examples mislead"
    assert set(ids[2]) == set(ids[1]) - {600, 601} and None in ids[2]
    base = {r.doc_id: r.text for r in seen[1].collect()}
    assert {r.doc_id for r in line_rules.judged(seen[1]).where("kept").collect()} == set(ids[2])
    groups = minhash.brute_force([(i, t) for i, t in base.items() if i in set(ids[2]) and i is not None], 5, 80)
    assert sorted(i for i in ids[3] if i is not None) == sorted(set(groups.values())) and 501 not in ids[3] and 502 not in ids[3]
    before = {r.doc_id: r.text for r in seen[3].where("doc_id is not null").collect()}
    expected = sentence_dedup.brute_force(list(before.items()))
    after = {r.doc_id: r.text for r in seen[4].where("doc_id is not null").collect()}
    assert after == expected
    assert passage in after[401] and passage not in after[402] and passage not in after[403]
    assert sorted({r.doc_id for r in seen[5].collect()}, key=str) == sorted(set(ids[4]), key=str)


def test_repeats_in_mid_sentence(spark, tmp_path):
    """A passage of 60 words, without marks or with, in the middle of sentences: the stage keeps its first occurrence only."""
    rng = np.random.default_rng(12)
    plain = [f"p{x}" for x in rng.integers(0, 3000, 60)]
    marked = [w + "." if k % 13 == 6 else w for k, w in enumerate(f"m{x}" for x in rng.integers(0, 3000, 60))]
    rows = []
    for i in range(40):
        passage = (plain, marked)[i % 2]
        head, tail = prose(rng, 3).rstrip(".").split(), prose(rng, 3).split()
        rows.append((i, " ".join([*head[: 15 + i % 17], *passage, *tail[i % 5 :]])))
    clean = {100 + i: prose(rng) for i in range(10)}
    docs = spark.createDataFrame(rows + list(clean.items()), "doc_id BIGINT, text STRING")
    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, str(tmp_path)).collect()}
    assert all(out[i] == t for i, t in [*rows[:2], *clean.items()])
    for i, _ in rows[2:]:
        words, passage = out[i].split(), (plain, marked)[i % 2]
        runs = {" ".join(words[k : k + 23]) for k in range(len(words))}
        assert not any(" ".join(passage[k : k + 23]) in runs for k in range(len(passage) - 22)), i


def test_run_equals_the_stages(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.run(spark, path)
    assert set(got.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and 0 < got.count() <= docs.count()


def test_empty_tables(spark, corpus, tmp_path):
    path, _, _ = corpus
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
