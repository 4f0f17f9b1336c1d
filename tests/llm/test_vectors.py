"""Embedding near-duplicates against all pairs, and odd vectors."""

import numpy as np

from millrace.llm import cross_polytope


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 24))
    rows = []
    for i in range(500):
        c = centre[0] if i % 3 == 0 else centre[i % 30]
        rows.append((i, (c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.3])).tolist()))
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    expected = cross_polytope.brute_force(rows)
    out = cross_polytope.near_vectors(table, block=64).collect()
    missed = sum(expected[r.vec_id][0] - r.n_links for r in out)
    assert all(r.n_links <= expected[r.vec_id][0] for r in out), "no link below the threshold"
    assert missed <= 0.001 * sum(n for n, _ in expected.values())
    assert sum((r.component_id != expected[r.vec_id][1]) for r in out) <= 2


def test_odd_vectors(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [1.0, 0.0]), (None, a), (10, a), (11, [-1.0, 0.0, 0.0]), (12, [1e-300, 0.0, 0.0]), (13, [0.5] * 9), (14, [0.7] * 9)]
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").selectExpr("*", "1 AS label", "2 AS links", "3 AS component")
    out = cross_polytope.near_vectors(table).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[10] == (3, 1, False) and got[12] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 11):
        assert got[i] == (0, i, True)
    assert got[13] == got[14][:1] + (13, True) and got[14] == (1, 13, False), "widths don't mix"
    assert got[None] == (0, None, True)
    assert cross_polytope.near_vectors(table.limit(0)).count() == 0
