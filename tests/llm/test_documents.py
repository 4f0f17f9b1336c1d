"""The document operators on odd rows, on empty tables, and against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from millrace.llm import hilbert, line_rules, minhash, packing, sentence_dedup, sentencepiece, toxicity, warc, weak_labels

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_minhash(spark, odd_docs, no_docs):
    out = minhash.near_duplicates(odd_docs, shingle=3, percent=85).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1][0][1:] == (1, True) and all(x[1:] == (1, False) for x in by[2])
    assert by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[7] == [(0, 7, True)] and by[8] == [(1, 8, True)]
    assert all(x[1:] == (None, True) for x in by[None])
    assert by[6][0][1] == 6
    assert minhash.near_duplicates(no_docs).count() == 0


def test_minhash_against_all_pairs(spark):
    """Chains and mixed buckets: neighbours of a chain are linked though its ends are not."""
    rows, base = [], [f"t{i}" for i in range(400)]
    for k in range(40):
        base = base[:]
        for j in range(4):
            base[(k * 37 + j * 11) % 400] = f"n{k}_{j}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join(f"t{i}" if i % 9 or i % 5 != k % 5 else f"z{k}" for i in range(120))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for shingle, percent in ((3, 85), (5, 80)):
        expected = minhash.brute_force(rows, shingle, percent)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle, percent, block=16).collect()}
        assert got == expected


def test_minhash_blocks_pass_over_no_link():
    """A pair of similarity 0.8 whose signatures agree in 62 % of the bins only."""
    blocks = minhash.Blocks(1, 80)
    x = np.random.default_rng(17624).integers(0, 2**64, 125, dtype=np.uint64)
    sets = {"a": np.unique(x[:112]), "b": np.unique(np.concatenate((x[:100], x[112:]))), "c": np.unique(np.concatenate((x[:99], x[112:], x[:1] + np.uint64(1))))}
    assert (blocks.hasher.signature(sets["a"]) == blocks.hasher.signature(sets["b"])).mean() < 0.63
    blocks.hasher.shingles = sets.__getitem__
    for other, links in (("b", [(1, 2)]), ("c", [])):
        rows = pa.table({"doc_id": [1, 2], "side": [0, 0], "component": [1, 2], "low": [True, True], "text": ["a", other]})
        assert blocks.links(rows) == links


def test_sentences(spark, odd_docs, no_docs, small):
    out = sentence_dedup.substring_dedup(odd_docs)
    assert out.columns == [c for c in odd_docs.columns if c != "n_removed"] + ["n_removed"]
    rows = out.collect()
    texts = {(r.doc_id, i): r.text for i, r in enumerate(rows)}
    assert len(rows) == odd_docs.count() and all(t is None for (d, _), t in texts.items() if d == 5)
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0]
    assert {r.text for r in rows if r.doc_id == 2} == {"", "the same id, another text entirely"}
    assert sentence_dedup.substring_dedup(no_docs).count() == 0
    source = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    expected = sentence_dedup.brute_force(source)
    assert {r.doc_id: r.text for r in sentence_dedup.substring_dedup(small).collect()} == expected


def test_sentence_cuts_are_lossless_and_short():
    for text in ("A b. C d!\n\nE f? g", "x" * 500, " ".join(["word"] * 100), "\n\n a. . b", "no end"):
        parts = sentence_dedup.sentences(text)
        assert "".join(parts) == text and all(len(p.split()) <= 2 * sentence_dedup.LONGEST for p in parts)


def test_passages_spliced_in_mid_sentence(spark):
    """Whatever stands around a passage, with marks or without, wrapped or not: no 51 words that came before stay."""
    rng = np.random.default_rng(5)

    def prose(n, marks):
        words = [f"v{x}" for x in rng.integers(0, 5000, n)]
        return [w + "." if marks and rng.random() < 1 / marks else w for w in words]

    rows, passages = [], [prose(n, marks) for n in (51, 52, 60, 90, 200) for marks in (0, 9, 30)]
    for i in range(120):
        passage = passages[i % len(passages)]
        words = [*prose(int(rng.integers(0, 40)), 12), *passage, *prose(int(rng.integers(0, 40)), 0)]
        width = 5 if i % 7 == 3 else 1000
        rows.append((i, "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))))
    rows += [(200 + i, " ".join(prose(300, 10))) for i in range(20)]
    twice = prose(70, 0)
    rows.append((300, " ".join([*prose(5, 0), *twice, *prose(9, 0), *twice, "end"])))
    out = {r.doc_id: r.text for r in sentence_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert out == sentence_dedup.brute_force(rows)
    seen, repeated = set(), 0
    for i, text in rows:
        words, left = text.split(), " " + " ".join(out[i].split()) + " "
        windows = [" ".join(words[k : k + 51]) for k in range(len(words) - 50)]
        before = [w for w in windows if w in seen]
        assert not any(f" {w} " in left for w in before), i
        assert before or i == 300 or out[i] == text, "texts without a repeat stay as they are"
        seen.update(windows)
        repeated += bool(before)
    assert repeated == 120 - len(passages)
    assert " ".join(twice) in out[300] and out[300].count(twice[35]) == 1


def test_line_rules(spark, odd_docs, no_docs):
    out = line_rules.quality_rules(odd_docs).collect()
    assert len(out) == odd_docs.count() and line_rules.quality_rules(no_docs).count() == 0
    empty = next(r for r in out if r.doc_id == 5)
    assert (empty.n_words, empty.base_failed, empty.kept) == (0, True, False)
    assert next(r for r in out if r.doc_id == 1).kept
    spelt = str.maketrans("0123456789", "abcdefghij")  # digits are alike to the rules
    body = [" ".join(f"u{d}_{k}".translate(spelt) for k in range(80)) for d in range(60)]
    rows = [(d, f"Shared  LINE {d % 3}\n{body[d]}", "h") for d in range(60)] + [(100 + d, "shared line 7\n" * 30 + f"only q{d} w{d}", "h") for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    verdicts = line_rules.judged(docs)
    got = {r.doc_id: (r.removed_words, r.kept) for r in verdicts.collect()}
    assert all(got[d] == (3, True) for d in range(60)) and not any(got[100 + d][1] for d in range(40))
    cleaned = {r.doc_id: r.text for r in line_rules.cleaned(docs, verdicts).collect()}
    assert cleaned == {d: body[d] for d in range(60)}
    soft = {r.doc_id: r.removed_words for r in line_rules.judged(docs, first_stays=True).collect()}
    assert soft[0] == 0 and all(soft[d] == 3 for d in range(1, 60)), "the first holder keeps the line"
    # 30 copies of a document of lines that no other has: documents count, or texts with `copies_once`
    copies = docs.unionByName(spark.createDataFrame([(200 + d, body[0].replace(" ", "\n"), "h") for d in range(30)], docs.schema))
    assert not any(r.kept for r in line_rules.judged(copies).collect() if r.doc_id >= 200)
    assert all(r.kept for r in line_rules.judged(copies, copies_once=True).collect() if r.doc_id >= 200)
    assert line_rules.cleaned(odd_docs, line_rules.judged(odd_docs)).columns == odd_docs.columns


def test_line_rules_against_sql(spark, tmp_path):
    """On rows of which boilerplate lines are removed and depleted documents rejected, the query gives what its SQL gives."""
    import duckdb

    from millrace.llm import queries

    rng = np.random.default_rng(8)
    words = [f"x{c}" for c in "abcdefghijklmnop"]
    prose = lambda n: " ".join(rng.choice(words, n)) + f" end{'abcdefghij'[rng.integers(10)]}"
    shared = [prose(12) for _ in range(6)]
    rows = [(d, "\n".join([*rng.choice(shared, 1 + d % 6), *(prose(9) for _ in range(d % 9))]), f"h{d % 2}") for d in range(120)]
    rows += [(200 + d, rows[7][1], "h0") for d in range(9)] + [(300, None, None), (301, "", "h1")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_line_frequency_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.sql(queries.OP7_SQL).df()[got.columns].sort_values("doc_id").values.tolist()
    found = got.toPandas().sort_values("doc_id").values.tolist()
    assert found == expected
    assert sum(r[-2] > 0 for r in found) > 50 and sum(not r[-1] and not r[-3] for r in found) > 10


def test_packing(spark, odd_docs, no_docs, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    for docs in (odd_docs, small):
        packed = packing.pack(docs, WORD_BPE, ids=True)
        rows = packed.collect()
        texts = [tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.select("text").collect()]
        assert sorted(x for r in rows for x in r.ids) == sorted(x for t in texts for x in t)
        for r in rows:
            assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            end = 0
            for offset, length in sorted(p):
                assert offset == end
                end += length
            assert end <= 4096
        assert len(places) <= 1 + -(-sum(map(len, texts)) // 4000)
    assert sum(r.length for r in packing.sequences(packed).collect()) == sum(r.length for r in rows)
    assert packing.pack(no_docs, WORD_BPE).count() == 0
    assert sorted(r.length for r in packing.pack(odd_docs.where("doc_id in (4, 5)"), WORD_BPE).collect()) == [1, 1]


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(100):
        capacity = int(rng.choice([8, 16, 64]))
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, 9), rng.integers(0, 40, 9), strict=True)}
        slots, bins = packing.plan(counts, capacity)
        used, seen = {}, {n: [] for n in counts}
        for s in slots.itertuples():
            for i in range(s.n):
                seen[s.length].append(s.rank + i)
                used.setdefault(s.sequence + i // s.per_bin, []).append((s.offset + i % s.per_bin * s.length, s.length))
        assert all(sorted(v) == list(range(counts[n])) for n, v in seen.items())
        assert sorted(used) == list(range(bins)) and all(sum(n for _, n in u) <= capacity for u in used.values())
        total = sum(n * c for n, c in counts.items())
        large = sum(c for n, c in counts.items() if 2 * n > capacity)  # no two of these share a bin
        assert bins <= 11 / 9 * max(-(-total // capacity), large) + 1
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_sentencepiece(spark, odd_docs, no_docs, small):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd_docs.select("doc_id", "text", "rank"), small):
        source = sorted((r.text or "") for r in docs.select("text").collect())
        out = sentencepiece.encoded(docs, PIECES).collect()
        assert sorted(r.decoded for r in out) == sorted(t.replace("▁", " ") for t in source)
        assert sorted(map(tuple, (r.ids for r in out))) == sorted(tuple(sp.encode(t)) for t in source)
    assert sentencepiece.encoded(no_docs, PIECES).count() == 0


def test_sentencepiece_random_strings():
    import random

    import sentencepiece as spm

    sp, rng = spm.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    encoder = sentencepiece.Encoder(sentencepiece.load(PIECES))
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "中文", "\0", "ing", "x" * 90, "aaaa", "\t", "\U0001f600", "1", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(500)]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t) and encoder.decode(ids.tolist()) == sp.decode(ids.tolist())


def test_unigram_best_path():
    """The unigram relaxation finds the path of the greatest score among all segmentations."""
    import itertools

    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "bca"]
    scores = [-3.0, -2.5, -2.6, -2.7, -4.0, -4.1, -7.5, -4.9, -4.4, -5.0]
    names = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], *pieces]
    model = sentencepiece.Model(names, [2, *[6] * 256, *[1] * len(pieces)], [0.0] * 257 + scores, False, 0)
    encoder = sentencepiece.Encoder(model)
    for word in ("abc", "abcabca", "ccab", "bcabc"):
        text = "▁" + word
        best = max(sum(scores[pieces.index(text[i:j])] for i, j in itertools.pairwise([0, *cut, len(text)])) for n in range(len(text)) for cut in itertools.combinations(range(1, len(text)), n) if all(text[i:j] in pieces for i, j in itertools.pairwise([0, *cut, len(text)])))
        ids = encoder.encode([word])[0].tolist()
        assert "".join(names[i] for i in ids) == text and abs(sum(scores[i - 257] for i in ids) - best) < 1e-9


def test_hilbert(spark, odd_docs, no_docs, tmp_path):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert.curve_index(grid, bits)
        steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)
        assert sorted(index) == list(range(len(grid))) and (steps == 1).all()
    rows = hilbert.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id == 5] == [(1, None)]
    assert hilbert.shard_documents(no_docs).count() == 0
    with pytest.raises(ValueError):
        hilbert.sharded(odd_docs, [hilbert.by_size("n_chars")] * 6, 8, ["doc_id"])
    hilbert.write_shards(odd_docs, hilbert.shard_documents(odd_docs), f"{tmp_path}/odd")
    assert spark.read.parquet(f"{tmp_path}/odd").count() == odd_docs.count()
    plain = odd_docs.select("doc_id", "text", "lang", "source")
    hilbert.write_shards(plain, hilbert.shard_documents(plain), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == plain.count()


def test_hilbert_against_sorting(spark):
    """The query's cells, shards and slots against plain counting and sorting of all rows of a small table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.selectExpr("doc_id", "lang", "source", "coalesce(octet_length(text), 0) AS bytes").collect()

    def cells(names):
        ordered, total = sorted(names), len(names)
        start = {n: i for i, n in reversed(list(enumerate(ordered)))}
        out, cell = {}, 0
        for name in sorted(start):
            end = start[name] + ordered.count(name)
            share = -(-16 * start[name] // total)
            cell = share if share * total < 16 * end else cell
            out[name] = cell
        return out

    lang, source = cells([r.lang for r in rows]), cells([r.source for r in rows])
    place = {}
    for r in rows:
        size = min(15, max(0, int(np.floor(np.log2(r.bytes / 16))) + 1)) if r.bytes else 0
        place[r.doc_id] = int(hilbert.curve_index(np.array([[lang[r.lang], source[r.source], size]]), 4)[0])
    got = hilbert.shard_documents(docs).collect()
    assert {r.doc_id: r.curve for r in got} == place
    order = sorted(place.values())
    n = len(order)
    for r in got:
        at = r.shard * n // 8 + r.slot
        assert order[at] == r.curve, "a row's place is that of its cell in the sorted order"


def test_shards_prune(spark):
    """Of the 8 shards, filters on language, source or size have to read far fewer than if rows lay at random."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hilbert.shard_documents(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()

    def read(shard_of):
        boxes = {}
        for r in rows:
            boxes.setdefault(shard_of(r), []).append(r)
        share = []
        for key in (lambda r: r.lang, lambda r: r.source, lambda r: r.size.bit_length()):
            ranges = [(min(map(key, b)), max(map(key, b))) for b in boxes.values()]
            values = {key(r) for r in rows}
            share.append(np.mean([sum(lo <= v <= hi for lo, hi in ranges) / 8 for v in values]))
        return share

    mine, chance = read(lambda r: r.shard), read(lambda r: zlib.crc32(str(r.doc_id).encode()) % 8)
    print("read", mine, chance)
    assert all(a < 0.75 * b for a, b in zip(mine, chance, strict=True)), (mine, chance)


def test_toxicity(spark, odd_docs, no_docs):
    words = ["vile", "grim", "calm", "blue", "tree", "sand", "wolf", "rain"]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[1:], 40)) + (" vile vile" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(3, None), (None, 1), (4, 7)], "doc_id BIGINT, toxic INT")
    out = toxicity.toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    flipped = labels.selectExpr("doc_id", f"CASE WHEN {toxicity.held_out()} THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(toxicity.toxicity(docs, flipped).collect()) == sorted(out), "held-out labels teach nothing"
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.5}
    w = toxicity.Weights(np.array([1]), np.array([0.5]), 0.0, toxicity.BITS)
    assert toxicity.score(odd_docs, w).columns == [c for c in odd_docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]


def test_weak_labels(spark, odd_docs, no_docs, small):
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.9, 0.85, 0.7, 0.95])
    given = np.stack([np.where(rng.random(len(truth)) < 0.2, 1, np.where((rng.random(len(truth)) < a) == truth, 2, 0)) for a in right], axis=1)
    patterns, counts = np.unique(given, axis=0, return_counts=True)
    model = weak_labels.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.accuracies() - right).max() < 0.05
    assert weak_labels.quality(odd_docs).count() == odd_docs.count() and weak_labels.quality(no_docs).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = weak_labels.quality(docs).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.95 and np.mean([not r.kept for r in rows if r.quality == 0]) > 0.8


def test_warc(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, None, "same"), (1, None, "same"), (2, "u2", None), (4, "u\r\nx", ""), (5, "u5", "é" * 400_000), (None, "n", "same"), (6, "u6", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "'x' AS sha", "1 AS first")
    out = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    expected = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = {"same": 1, None: 2, "": 2}.get(html, i)
        revisit = i is not None and i != first
        expected.append((i, len(body), warc.digest(body), "revisit" if revisit else "response", first if revisit else None))
    assert out == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_attempts_keep_apart(spark, tmp_path):
    """A task runs twice; the second attempt writes its archive and is lost before it commits. Nothing of the first is."""
    folder = f"file://{tmp_path}/archives"
    batch = pa.RecordBatch.from_pylist([{"page_id": i, "url": "u", "body": b"%d" % i, "payload_bytes": 1, "sha": "00" * 20, "first": None, "revisit": True} for i in range(4)])
    won = warc.write_archive(iter([batch]), folder, "run", 3)
    lost = warc.write_archive(iter([batch]), folder, "run", 3)
    other = warc.write_archive(iter([batch]), folder, "another", 3)
    assert len({won[0], lost[0], other[0]}) == 3 and warc.write_archive(iter([]), folder, "run", 4) is None
    manifest = spark.createDataFrame([won], "file STRING, records BIGINT")
    warc.drop_lost(folder, "run", manifest)
    assert {p.name for p in (tmp_path / "archives").iterdir()} == {x[0].rpartition("/")[2] for x in (won, other)}
    assert sorted(r.page_id for r in warc.archived(manifest).collect()) == [0, 1, 2, 3]


def test_warc_reads_an_archive_to_a_task(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "concat('body ', id) AS html").repartition(12)
    from millrace.llm.common import Scratch

    scratch = Scratch(spark, "warc")
    manifest = warc.write(pages, scratch.path("archives"), scratch)
    assert manifest.count() == 12 and warc.archived(manifest).rdd.getNumPartitions() == 12


def test_warc_reader_refuses_damage():
    body = b"x" * 300_000
    whole = warc.archive_bytes([(1, "u", body, len(body), warc.digest(body), None, False), (2, "u", b"", 3, warc.digest(b"abc"), 1, True)])
    records = list(warc.read(whole))
    assert [r.headers["warc-type"] for r in records] == ["response", "revisit"] and records[0].payload == body
    import gzip
    import io

    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(whole.getvalue()[:-40])))
    with pytest.raises(warc.Damaged):
        list(warc.read(warc.archive_bytes([(1, "u", body, len(body), warc.digest(b"other"), None, False)])))
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n"))))
