"""The fitted operators against plain Python, and the recall of the hashes."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import cross_polytope, minhash, sentencepiece, toxicity, weak_labels


class PlainFtrl:
    """FTRL-proximal as published, a coordinate at a time, with dicts."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2, self.z, self.n = alpha, beta, l1, l2, {}, {}

    def weight(self, i):
        z = self.z.get(i, 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n.get(i, 0.0))) / self.alpha + self.l2)

    def score(self, coordinates):
        total = self.weight("bias") + sum(self.weight(i) for i in coordinates)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))

    def learn(self, coordinates, label):
        g = self.score(coordinates) - label
        for i in [*coordinates, "bias"]:
            n = self.n.get(i, 0.0)
            sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha
            self.z[i] = self.z.get(i, 0.0) + g - sigma * self.weight(i)
            self.n[i] = n + g * g


def test_toxicity_against_plain_ftrl(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 or text like '%the%' as int) AS toxic")
    rows = docs.join(labels, "doc_id").selectExpr("doc_id", "text", "toxic", "xxhash64(doc_id) AS o", f"{toxicity.held_out()} AS held").collect()
    features, plain = toxicity.Features(), PlainFtrl(2.0, 1.0, 4.0, 1.0)
    at = {r.doc_id: features.of(r.text).tolist() for r in rows}
    for _ in range(2):
        for r in sorted(rows, key=lambda r: (r.o, r.doc_id)):
            if not r.held and r.text is not None:
                plain.learn(at[r.doc_id], r.toxic)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) > 100
    assert max(abs(got[i] - plain.score(at[i])) for i in at) < 1e-9
    assert any(abs(s - plain.score([])) > 0.01 for s in got.values())


def test_toxicity_recall_at_two_sizes(spark):
    """Held-out toxic documents caught, clean ones left alone, with few labels and with ten times as many."""
    for sf, least in (("sf0.01", 0.45), ("sf0.1", 0.65)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
        assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= least
        assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.01


def test_packed_coordinates():
    for at in ([], [0], [5, 6, 70_000], list(range(0, 1 << 20, 9))):
        assert toxicity.unpacked(toxicity.packed(np.array(at, np.int64))).tolist() == at


def test_quality_against_plain_estimation(spark):
    """Expectation-maximisation over single texts instead of patterns, then plain FTRL on the posteriors."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and length(text) < 4000")
    rows = docs.selectExpr("doc_id", "text", "xxhash64(doc_id, xxhash64(text)) AS o").collect()
    features = weak_labels.Features()
    found = {r.doc_id: features.of(r.text) for r in rows}
    votes = {i: v for i, (_, v) in found.items()}
    k = len(weak_labels.LABELLERS)
    good = {}
    for i, v in votes.items():
        ups, downs = v.count(2), v.count(0)
        good[i] = 0.1 if downs >= 2 else 0.9 if ups > downs else 0.5
    for _ in range(200):
        prior = (sum(good.values()) + 1) / (len(good) + 2)
        says = [[[1.0] * 3 for _ in range(2)] for _ in range(k)]
        for i, v in votes.items():
            for j, vote in enumerate(v):
                says[j][1][vote] += good[i]
                says[j][0][vote] += 1 - good[i]
        new = {}
        for i, v in votes.items():
            logs = [math.log(1 - prior), math.log(prior)]
            for j, vote in enumerate(v):
                for y in (0, 1):
                    logs[y] += math.log(says[j][y][vote] / sum(says[j][y]))
            new[i] = 1 / (1 + math.exp(min(500, max(-500, logs[0] - logs[1]))))
        moved = max(abs(new[i] - good[i]) for i in good)
        good = new
        if moved < 1e-9:
            break
    got = {r.doc_id: r for r in weak_labels.quality(docs).collect()}
    assert max(abs(got[i].posterior - good[i]) for i in good) < 1e-6
    plain = PlainFtrl(0.5, 1.0, 2.0, 1.0)
    for _ in range(2):
        for r in sorted(rows, key=lambda r: r.o):
            plain.learn(found[r.doc_id][0].tolist(), got[r.doc_id].posterior)
    assert max(abs(got[i].score - plain.score(found[i][0].tolist())) for i in found) < 1e-6
    assert {r.kept for r in got.values()} == {True, False}


def test_pieces_are_the_same_with_and_without_memory():
    """A chunk's ids don't depend on what was indexed with it, before it, or whether it was looked up."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghilmnoprstué ") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + rng.choice(["", "\n", "x" * 80]) for _ in range(60)]
    model = sentencepiece.load(path)
    together = sentencepiece.Encoder(model)
    all_at_once = [x.tolist() for x in together.encode(texts)]
    again = [x.tolist() for x in together.encode(texts[::-1])][::-1]
    forgetful = sentencepiece.Encoder(model)
    alone = []
    for t in texts:
        forgetful.known.clear()
        alone.append(forgetful.encode([t])[0].tolist())
    assert all_at_once == again == alone


@pytest.mark.parametrize(("vectors", "dim"), [(10_000, 64), (500_000, 64), (50_000_000, 64), (1_000_000, 24), (1_000_000, 300)])
def test_recall_of_vector_hashes(vectors, dim):
    """Pairs at a cosine of just 0.95 that share a bucket, with the shape that a table of so many vectors gets."""
    rng = np.random.default_rng(vectors % 97 + dim)
    a, z = rng.normal(size=(2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    shape = cross_polytope.shape(vectors, dim)
    buckets = cross_polytope.CrossPolytope(dim, *shape)
    x, y = buckets.buckets(a), buckets.buckets(b)
    hit = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=2)
    assert hit.any(axis=1).mean() > 0.999
    assert (1 - hit.mean()) ** shape.tables < 3e-4, "the chance that all tables miss, if they are independent"
    cells = (2 * cross_polytope.width(dim)) ** (shape.hashes - 1) * 2 * shape.last
    assert cells >= vectors / cross_polytope.LOAD or shape.hashes == 4


def test_recall_of_signatures():
    """Sets of a similarity of just 0.8 or 0.85 share a band; sizes from some to thousands of shingles."""
    rng, hasher = np.random.default_rng(6), minhash.Hasher(5)
    for n in (60, 300, 3000):
        for share in (0.8, 0.85):
            missed = 0
            for _ in range(150):
                union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                own = round(len(union) * (1 - share) / 2)
                a, b = np.sort(union[own:]), np.sort(np.concatenate([union[:own], union[2 * own :]]))
                x, y = (hasher.signature(np.unique(s)).reshape(hasher.bands, hasher.rows) for s in (a, b))
                missed += not (x == y).all(axis=1).any()
            assert missed <= 1, (n, share)
