"""Half of all rows on one key: with broadcasts off, no task of a join or a search reads more than a small share of them."""

import numpy as np
import pytest

from millrace.llm import common, cross_polytope, minhash, sentence_dedup, warc
from millrace.llm.common import Scratch
from millrace.llm.components import connected

CONF = {
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def skewed(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_FILE", 100)  # so many files that tasks can be told apart
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(spark, run, least):
    """The largest share that one task has of the records that its stage reads from shuffles, over stages with `least` of them."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    one, none = gateway.new_array(jvm.double, 1), gateway.new_array(jvm.double, 0)
    one[0] = 1.0

    def stages():
        found = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleReadRecords() for s in (found.apply(i) for i in range(found.size())) if s.status().toString() == "COMPLETE"}

    before = stages()
    run()
    shares = {}
    for key, total in stages().items():
        if key not in before and total >= least:
            summary = store.taskSummary(*key, one)
            if summary.isDefined():
                shares[key] = summary.get().shuffleReadMetrics().readRecords().apply(0) / total
    assert shares, "no stage read so many rows"
    worst = max(shares, key=shares.get)
    return shares[worst]


def test_hub_of_a_component(skewed):
    """One node with half of all edges, and chains, so that rounds are needed."""
    n = 6000
    edges = skewed.range(n).selectExpr("if(id % 2 = 0, 0, 100000 + id - id % 8) AS u", "100000 + id AS v").unionByName(skewed.range(40).selectExpr("300000 + id AS u", "300001 + id AS v"))
    out = {}
    # the sums over nodes have a row for each node and task; joins are what is looked at
    share = largest_share(skewed, lambda: out.update((r.node, r.component) for r in connected(edges, Scratch(skewed, "hub")).collect()), 4000)
    assert share < 0.2 and out[100000] == 0 and out[300040] == 300000


def prose(rng, n):
    return " ".join(f"v{x}" for x in rng.integers(0, 20_000, n))


def test_passage_in_half_of_all_texts(skewed):
    rng = np.random.default_rng(2)
    passage = prose(rng, 80)
    rows = [(i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}" if i % 2 else prose(rng, 60)) for i in range(1500)]
    docs = skewed.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(16)
    out = {}
    share = largest_share(skewed, lambda: out.update((r.doc_id, r.text) for r in sentence_dedup.substring_dedup(docs).collect()), 4000)
    assert share < 0.2 and out == sentence_dedup.brute_force(rows)


def test_near_copies_in_half_of_all_texts(skewed):
    rng = np.random.default_rng(3)
    base = prose(rng, 200).split()
    rows = [(i, " ".join([*base[: i % 190], f"n{i}", *base[i % 190 + 1 :]]) if i % 2 else prose(rng, 80)) for i in range(1200)]
    docs = skewed.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(16)
    out = {}
    share = largest_share(skewed, lambda: out.update((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 3, 85, block=64).collect()), 3000)
    assert share < 0.25 and out == minhash.brute_force(rows, 3, 85)


def test_mixed_bucket_is_sent_about_once():
    """Of a large group with some strangers, rows sent to blocks grow with the group, not with its square."""

    def sent(group, strangers, block):
        few, main = -(-strangers // block), -(-group // block)
        return strangers * (few + main) + group * few

    assert sent(20_000, 8, 512) / sent(2_000, 8, 512) < 10.5


def test_near_copies_of_half_of_all_vectors(skewed):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.08 if i % 2 else rng.normal(size=32)).tolist()) for i in range(1500)]
    table = skewed.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(16)
    expected, out = cross_polytope.brute_force(rows), {}
    share = largest_share(skewed, lambda: out.update((r.vec_id, r.n_links) for r in cross_polytope.near_vectors(table, block=64).collect()), 3000)
    assert share < 0.25
    assert sum(abs(expected[i][0] - n) for i, n in out.items()) <= 0.001 * sum(n for n, _ in expected.values())


def test_one_payload_of_half_of_all_pages(skewed):
    pages = skewed.range(8000).selectExpr("id AS page_id", "'u' AS url", "if(id % 2 = 0, 'the same', concat('p', id)) AS html").repartition(16)
    out = []
    share = largest_share(skewed, lambda: out.extend(warc.round_trip(pages).collect()), 3000)
    assert share < 0.2 and sum(r.record_type == "revisit" and r.refers_to == 0 for r in out) == 3999
