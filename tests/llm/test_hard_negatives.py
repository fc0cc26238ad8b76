"""Hard negatives against brute force: repeated ids, ties, odd components, many shards and blocks."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm.hard_negatives import Planes, mine_hard_negatives  # noqa: E402

ROWS = "vec_id long, embedding array<float>, label int, v string, shard int, bands int"


def plain(rows, positives=5, negatives=10):
    """The same by sorting all scores."""
    valid = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, lab, *_ in rows if i is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for anchor in sorted({i for i, _, _ in valid if i % 10 == 0}):
        label, v = min((lab, v) for i, lab, v in valid if i == anchor)
        said = sorted((-product(v, w), i, lab) for i, lab, w in valid if i != anchor)
        for s, p, _ in [x for x in said if x[2] == label][:positives]:
            hard = [(-n, i) for n, i, lab in said if lab != label and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out.update((anchor, p, k + 1, i, -s, n) for k, (n, i) in enumerate(hard))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(i, rng.normal(0, 0.4, 12).astype(np.float32).tolist(), int(rng.integers(3)), "x", 0, 0) for i in range(240)]
    out += [(1000, None, 1, "x", 0, 0), (1010, [float("nan")] * 12, 1, "x", 0, 0), (1020, [None] + [0.1] * 11, 1, "x", 0, 0), (1030, [0.5] * 12, None, "x", 0, 0), (None, [0.5] * 12, 1, "x", 0, 0)]
    out += [(1040, [0.5] * 7, 1, "x", 0, 0), (1050, [], 2, "x", 0, 0), (-20, [0.25] * 12, 0, "x", 0, 0)]
    out += [(i + 2000, [0.5, -0.5] * 6, i % 3, "x", 0, 0) for i in range(30)]  # ties
    out += [out[10]] * 20 + [(20, [0.9] * 12, 2, "x", 0, 0)] * 2 + [out[41]] * 3  # an anchor's own rows, another vector of an anchor, a candidate
    return out


def test_hard_negatives(spark, rows):
    data = spark.createDataFrame(rows, ROWS).repartition(3)
    want = plain(rows)
    for sizes in ({}, {"shard_rows": 60, "block_rows": 7}):
        assert collections.Counter(map(tuple, mine_hard_negatives(data, F.expr("pmod(vec_id, 10) = 0"), **sizes).collect())) == want
    assert len(want) > 500 and max(c for c in want.values()) > 1  # repeated candidates are told each
    few = plain(rows, 2, 3)
    assert collections.Counter(map(tuple, mine_hard_negatives(data, F.expr("pmod(vec_id, 10) = 0"), positives=2, negatives=3).collect())) == few


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert mine_hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [0.5], 1, "x", 0, 0), (10, [0.0], 2, "x", 0, 0), (20, [0.0], 2, "x", 0, 0)], ROWS)
    assert [tuple(r) for r in mine_hard_negatives(alone, F.col("vec_id") % 10 == 0).orderBy("anchor_id").collect()] == [(10, 20, 1, 0, 0, 0), (20, 10, 1, 0, 0, 0)]


def test_planes_drop_pairs():
    """Clusters: most pairs are dropped before the last plane, and none that counts."""
    rng = np.random.default_rng(4)
    centre = rng.integers(-200, 200, (200, 32))
    vectors = centre[np.arange(4000) % 200] + rng.integers(-20, 20, (4000, 32))
    ids, labels = np.arange(4000), np.arange(4000) % 200 % 5
    shard = Planes(ids, labels, vectors)
    top = shard.positives(ids[:50], labels[:50], vectors[:50], 5)
    assert shard.products < 0.6 * shard.pairs * shard.bits
    scores = vectors[:50] @ vectors.T
    for q in range(50):
        mine = sorted((-int(scores[q, i]), i) for i in range(4000) if labels[i] == labels[q] and i != q)[:5]
        assert list(zip((-top.scores[q]).tolist(), top.ids[q].tolist())) == mine


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 29])
def test_planes_are_exact_at_every_size(scale):
    rng = np.random.default_rng(scale)
    vectors = rng.integers(-scale, scale + 1, (300, 9))
    ids, labels = np.arange(300), np.zeros(300, dtype=np.int64)
    top = Planes(ids, labels, vectors).positives(ids[:20], labels[:20], vectors[:20], 4)
    for q in range(20):
        said = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], vectors[i])), i) for i in range(300) if i != q)[:4]
        assert list(zip((-top.scores[q]).tolist(), top.ids[q].tolist())) == said
