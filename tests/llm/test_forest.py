"""Nearest vectors: recall against brute force, and unusable vectors."""

import numpy as np
import pyarrow as pa

from tarnstone.llm import forest


def _frame(spark, rows):
    return spark.createDataFrame(rows, "coll int, id long, vec array<float>, code string")


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((250, 384))
    x = np.repeat(centres, 4, axis=0) + rng.standard_normal((1000, 384)) * rng.uniform(0.2, 0.6, (1000, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {(min(i, j), max(i, j)) for i in range(1000) for j in top[i] if s[i, j] >= 0.8}
    rows = [(0, i, (v * (i % 7 + 1)).tolist(), "c") for i, v in enumerate(x)]
    got = {(r.lo, r.hi) for r in forest.nearest(_frame(spark, rows)).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.98


def test_unusable_and_collections(spark):
    one = [1.0] + [0.0] * 383
    rows = [(0, 1, one, "c"), (0, 2, one, "c"), (1, 1, one, "c"), (0, 3, [0.0] * 384, "c"), (0, 4, one[:-1], "c"), (0, 5, None, "c"), (0, 6, [float("nan")] + one[1:], "c"), (0, 7, [float("inf")] + one[1:], "c"), (0, 8, [None, *one[1:]], "c"), (0, 9, [1e-30 * v for v in one], "c")]
    got = {(r.coll, r.lo, r.hi) for r in forest.nearest(_frame(spark, rows)).collect()}
    assert got == {(0, 1, 2), (0, 1, 9), (0, 2, 9)}
    assert forest.nearest(_frame(spark, rows[:1])).count() == 0
    assert forest.nearest(_frame(spark, [])).count() == 0


def test_many_copies(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(384).tolist()
    rows = [(0, k, v, "c") for k in range(300)] + [(0, 1000 + k, rng.standard_normal(384).tolist(), "c") for k in range(200)]
    got = forest.nearest(_frame(spark, rows)).collect()
    seen = {i for r in got for i in (r.lo, r.hi)}
    assert seen == set(range(300)) and all(r.cosine > 0.999 for r in got)


def test_windows_go_on_over_the_edges_of_ranges(spark):
    """Small partitions, and rows in an order without sense: the pairs are those of one sorted array all the same."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(384) + 0.3 * rng.standard_normal((1000, 384)), rng.standard_normal((2000, 384))])
    df = _frame(spark, [(0, int(i), x[i].tolist(), "c") for i in rng.permutation(3000)]).repartition(8)
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("8k", "12"), strict=True):
            spark.conf.set(n, v)
        got = {(r.lo, r.hi) for r in forest.nearest(df, k=3000, trees=2, reach=4).collect()}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    bits = unit @ forest._planes(384, 2, forest.SEED) > 0
    sketch = np.packbits(bits[:, 64:], axis=1).view(np.int64)
    want = set()
    for t in (0, 1):
        key = bits[:, 32 * t : 32 * t + 32] @ (1 << np.arange(31, -1, -1))
        order = np.lexsort((sketch[:, 0], key))
        for d in range(1, 5):
            a, b = order[:-d], order[d:]
            near = np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)).sum(axis=1) <= forest.most_bits(0.8)
            near &= (unit[a] * unit[b]).sum(axis=1) >= 0.8
            want |= {(min(i, j), max(i, j)) for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True)}
    assert len(want) > 4000 and len(got ^ want) <= 3


def _dense(spark, size, cosine, k=5):
    """Recall over ``size`` vectors, a third of them around one centre, a tenth of those copied."""
    rng = np.random.default_rng(4)
    n, unit = size // 3, lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre, noise = unit(rng.standard_normal(384)), rng.standard_normal((n, 384))
    noise = unit(noise - np.outer(noise @ centre, centre))
    x = np.concatenate([cosine * centre + (1 - cosine**2) ** 0.5 * noise, unit(rng.standard_normal((size - n, 384)))]).astype(np.float32)
    x[: n // 10] = x[n // 10 : n // 10 * 2]
    x = x[rng.permutation(size)]
    want = set()
    for lo in range(0, size, 1000):
        s = (x[lo : lo + 1000] @ x.T).round(6)
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -1
        for i, top in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k], lo):
            want |= {(min(i, j), max(i, j)) for j in top.tolist() if s[i - lo, j] >= 0.8}
    vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 384).cast(pa.list_(pa.float32()))
    df = spark.createDataFrame(pa.table({"coll": pa.array(np.zeros(size), pa.int32()), "id": np.arange(size), "vec": vec}))
    got = {(r.lo, r.hi) for r in forest.nearest(df.repartition(8)).collect()}
    return len(got & want) / len(want), len(got & want) / len(got)


def test_dense_group(spark):
    """Neighbours differ by less than codes tell in part, so a few of the fifth places are others."""
    for cosine in (0.95, 0.98):
        recall, precision = _dense(spark, 9000, cosine)
        assert recall >= 0.9 and precision >= 0.9, (cosine, recall, precision)


def test_many_copies_have_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    v, w = rng.standard_normal(384), rng.standard_normal(384)
    rows = [(0, i, (v if i % 3 else v + 0.2 * w).tolist(), "c") for i in range(400)] + [(0, 1000, (v + 0.1 * w).tolist(), "c")]
    got = {(r.lo, r.hi) for r in forest.nearest(_frame(spark, rows)).collect()}
    groups = [[i for i in range(400) if i % 3], [i for i in range(400) if not i % 3]]
    want = {(min(a, b), max(a, b)) for g in groups for a in g for b in [x for x in g[:6] if x != a][:5]}
    near = {p for p in got if 1000 in p}
    assert got - near == want and len(near) == 5 and len({p[0] % 3 == 0 for p in near}) == 1
