"""Most similar vectors for every vector (problem 7): a hash-prefix forest.

Every tree gives each vector a long hash string, the signs of 32 random projections. The strings of a tree are one
sorted array, spread over the tasks by tree and leading bits. In it the neighbours of a vector are the longest-prefix
matches; going further from it ascends to shorter and shorter common prefixes, in all trees alike, until ``reach``
neighbours on either side are met. The depth of the match therefore follows the density of the data, whatever its size.

A 256-bit sketch (signs of further projections, the same for all trees) travels with each string. A pair whose sketches
differ in more bits than a pair at the wanted cosine would, plus two standard deviations, is dropped on the spot; what
is left meets the vectors themselves, as 8-bit codes with a scale of their own (error of a cosine about 0.0006).

The random projections come from a seed; only they are shipped to the tasks. The sorted strings are streamed with a
window, never collected. A task has a range of the sorted array, cut where a bounded sample of it says, also inside a
frequent string; each range also gets the rows before it, so that the windows go on over its edge.

Vectors of equal code are one class: only the smallest id takes part, the others come in at the end. A row whose window
is nearly full of like sketches stands in a group denser than the window is wide, where the string doesn't tell who is
nearest. Such crowded rows are compared with one another exactly, in a triangular grid of blocks with a running top.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.storage import cut

TREES, BITS, SKETCH, REACH = 20, 32, 256, 192
DIM, FLOOR, K, SEED = 384, 0.8, 5, 20
#: Neighbours to one side with a like sketch from which a row is crowded.
CROWD = 144
PAIR, CROWDED, COPY = 0, 1, 2
#: Vectors whose strings decide where the sorted array is cut.
SAMPLE = 8192
_WORDS = [f"s{k}" for k in range(SKETCH // 64)]


def usable(batch: pa.RecordBatch, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """coll, id and unit vectors of the usable rows: ``dim`` finite numbers, not all zero."""
    vec = batch.column("vec")
    length = np.diff(vec.offsets.to_numpy())
    ok = length == dim
    if vec.null_count:
        ok &= vec.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    values = vec.values.cast(pa.float32()).to_numpy(zero_copy_only=False)  # a null number becomes NaN
    starts = vec.offsets.to_numpy()[:-1][at]
    if len(at) == len(length):
        x = values[starts[0] : starts[0] + len(at) * dim].reshape(-1, dim) if len(at) else np.empty((0, dim), np.float32)
    else:
        x = values[starts[:, None] + np.arange(dim)]
    with np.errstate(all="ignore"):
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x, at = x[good].astype(np.float64), at[good]
        x /= np.abs(x).max(axis=1, keepdims=True) if len(x) else 1
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else x.astype(np.float32)
    return batch.column("coll").to_numpy()[at], batch.column("id").to_numpy()[at], x


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS + SKETCH)).astype(np.float32)


def _code(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 8-bit numbers."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _place(cuts: np.ndarray, tk: np.ndarray, s0: np.ndarray) -> np.ndarray:
    """How many of the sorted ``cuts`` (tk, s0) are at or before each row."""
    lo, hi = np.searchsorted(cuts[:, 0], tk, "left"), np.searchsorted(cuts[:, 0], tk, "right")
    tie = np.flatnonzero(lo < hi)
    for at in np.unique(lo[tie]):
        rows = tie[lo[tie] == at]
        hi[rows] = at + np.searchsorted(cuts[at : hi[rows[0]], 1], s0[rows], "right")
    return hi


def strings(vectors: DataFrame, trees: int = TREES, dim: int = DIM, seed: int = SEED, edges: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(part, own, tk, id, code, s0..): a row per vector and tree; tk holds collection, tree and hash string, code a
    hash of the 8-bit code.

    With ``edges`` (see ``ranges``) part is the range of the row; a row shortly before the next range comes there as well,
    as one that isn't the range's own.
    """
    starts, cuts = edges or (np.empty((0, 2), np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, trees, seed)
        mix = np.random.default_rng(seed + 1).integers(-(1 << 63), 1 << 63, dim, dtype=np.int64) | 1
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                coll, ids, x = usable(batch.slice(lo, 2048), dim)
                if not len(ids):
                    continue
                bits = (x @ planes) > 0
                key = bits[:, : trees * BITS].reshape(-1, trees, BITS) @ weights
                tree = coll.astype(np.int64)[:, None] * trees + np.arange(trees)
                sk = np.packbits(bits[:, trees * BITS :], axis=1).view(np.int64)
                cols = [((tree << BITS) | key).ravel(), np.repeat(ids, trees), np.repeat(_code(x).astype(np.int64) @ mix, trees)] + [np.repeat(sk[:, k], trees) for k in range(len(_WORDS))]
                part = _place(cuts, cols[0], cols[3])
                again = np.flatnonzero(_place(starts, cols[0], cols[3]) > part)
                cols = [np.concatenate([c, c[again]]) for c in (part, *cols)]
                cols[0][len(part) :] += 1
                own = np.arange(len(cols[0])) < len(part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(own), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["part", "own", "tk", "id", "code", *_WORDS])

    return vectors.mapInArrow(run, "part int, own boolean, tk long, id long, code long, " + ", ".join(f"{w} long" for w in _WORDS))


def ranges(vectors: DataFrame, trees: int = TREES, reach: int = REACH, dim: int = DIM, seed: int = SEED, parts: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, cuts): where each range but the first has its first row to be carried in and its first own one.

    They are strings of about ``sample`` vectors. Between a start and its cut are ``reach`` different ones of them, so at
    least as many rows are carried in.
    """
    spark = vectors.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, sample / max(1, vectors.select("coll").count()))
    some = vectors.where(F.pmod(F.xxhash64("coll", "id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    got = strings(some, trees, dim, seed).select("tk", "s0").toArrow()
    at, rows = np.unique(np.stack([got["tk"].to_numpy(), got["s0"].to_numpy()], axis=1), axis=0, return_counts=True)
    first = [0]
    for at_row in np.searchsorted(np.cumsum(rows), np.arange(1, parts) * rows.sum() / parts):
        if at_row - first[-1] > reach:
            first.append(int(at_row))
    first = np.array(first[1:], np.int64)
    return at[first - reach], at[first]


def most_bits(floor: float) -> int:
    """Differing sketch bits up to which a pair is looked at."""
    p = math.acos(floor) / math.pi
    return math.ceil(SKETCH * p + 2.1 * math.sqrt(SKETCH * p * (1 - p)))


def candidates(rows: DataFrame, trees: int = TREES, floor: float = FLOOR, reach: int = REACH, parts: int = 1, crowd: int = CROWD) -> DataFrame:
    """(coll, lo, hi, kind), distinct, of the smallest ids of equal vectors.

    PAIR: two of the same collection that stand close in a tree and whose sketches are alike; left out where both are
    crowded. CROWDED: lo is. COPY: hi is equal to lo.
    """
    limit = most_bits(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, full = None, np.empty(0, bool)
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            old = 0 if tail is None else len(tail[0])
            cols = new if tail is None else [np.concatenate([a, b]) for a, b in zip(tail, new, strict=True)]
            first = np.ones(len(cols[0]), bool)
            first[1:] = ~np.logical_and.reduce([c[1:] == c[:-1] for c in (cols[1], *cols[3:])])
            first[:old] = True
            head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            copy = np.flatnonzero(~first & cols[0] & ((cols[1] >> BITS) % trees == 0))
            found = [np.stack([(cols[1][copy] >> BITS) // trees, cols[2][head[copy]], cols[2][copy], np.full(len(copy), COPY)])]
            cols = [c[first] for c in cols]
            own, tree, ids = cols[0], cols[1] >> BITS, cols[2]
            sk = [c.view(np.uint64) for c in cols[4:]]  # bitwise_count takes the absolute value of signed numbers
            hits, like = [], np.zeros(len(ids), np.int64)
            for d in range(1, min(reach, len(ids) - 1) + 1):
                a = max(0, old - d)
                diff = np.bitwise_count(sk[0][a + d :] ^ sk[0][a : len(ids) - d]).astype(np.int16)
                for s in sk[1:]:
                    diff += np.bitwise_count(s[a + d :] ^ s[a : len(ids) - d])
                hit = np.flatnonzero(diff <= limit) + a
                hit = hit[(tree[hit] == tree[hit + d]) & (ids[hit] != ids[hit + d]) & own[hit + d]]
                like[hit + d] += 1
                hits.append((hit, hit + d))
            full = np.concatenate([full, like[old:] >= crowd])
            at = np.flatnonzero(full[old:]) + old
            found.append(np.stack([tree[at] // trees, ids[at], ids[at], np.full(len(at), CROWDED)]))
            for a, b in hits:
                keep = ~(full[a] & full[b])
                a, b = a[keep], b[keep]
                found.append(np.stack([tree[a] // trees, np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), np.full(len(a), PAIR)]))
            tail, full = [c[-reach:] for c in cols], full[-reach:]
            rows = np.unique(np.concatenate(found, axis=1), axis=1)
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["coll", "lo", "hi", "kind"])

    near = rows.repartitionById(parts, "part").drop("part").sortWithinPartitions("tk", "s0", "code", "id")
    return near.mapInArrow(run, "coll long, lo long, hi long, kind long").distinct()


def codes(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(coll, id, code BINARY, scale DOUBLE): the vectors of unit length as 8-bit numbers; cosine = dot * scale * scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coll, ids, x = usable(batch, dim)
            if not len(ids):
                continue
            q = _code(x)
            scale = 1 / np.linalg.norm(q.astype(np.float64), axis=1)
            offsets = pa.py_buffer(np.arange(0, (len(ids) + 1) * dim, dim, dtype=np.int32))
            code = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(coll, pa.int64()), pa.array(ids, pa.int64()), code, pa.array(scale)], names=["coll", "id", "code", "scale"])

    return vectors.mapInArrow(run, "coll long, id long, code binary, scale double")


def scored(pairs: DataFrame, coded: DataFrame, dim: int = DIM) -> DataFrame:
    """(coll, lo, hi, cosine) of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int8).reshape(-1, dim) for c in ("x", "y")]
            dot = np.einsum("ij,ij->i", *[v.astype(np.float32) for v in q]).astype(np.float64)
            cosine = dot * batch.column("sx").to_numpy() * batch.column("sy").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("coll", "lo", "hi")], pa.array(cosine)], names=["coll", "lo", "hi", "cosine"])

    x = coded.select("coll", F.col("id").alias("lo"), F.col("code").alias("x"), F.col("scale").alias("sx"))
    y = coded.select("coll", F.col("id").alias("hi"), F.col("code").alias("y"), F.col("scale").alias("sy"))
    return pairs.join(x, ["coll", "lo"]).join(y, ["coll", "hi"]).select("coll", "lo", "hi", "x", "sx", "y", "sy").mapInArrow(
        run, "coll long, lo long, hi long, cosine double"
    )


def crowded_best(coded: DataFrame, crowded: DataFrame, k: int = K, floor: float = FLOOR, dim: int = DIM, side: int | None = None) -> DataFrame:
    """(coll, id, other, cosine): the ``k`` most similar of ``crowded`` (coll, id) in each pair of blocks, by brute force."""
    rows = crowded.count()
    side = side or min(32768, max(1024, rows // 6))
    blocks, tile = -(-rows // side), 1024

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, ids, scale = [table.column(c).to_numpy() for c in ("block", "id", "scale")]
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(-1, dim)
        sides = [np.flatnonzero(block == key[n].as_py()) for n in (1, 2)]
        best = [(np.full((len(ids), k), -np.inf, np.float32), np.zeros((len(ids), k), np.int64))]

        def meet(at: np.ndarray, others: np.ndarray, cosine: np.ndarray) -> None:
            value, other = best[0]
            least = max(0, len(others) - k)
            top = np.argpartition(cosine, least, axis=1)[:, least:] if least else np.tile(np.arange(len(others)), (len(at), 1))
            v = np.concatenate([value[at], np.take_along_axis(cosine, top, 1)], axis=1)
            o = np.concatenate([other[at], others[top]], axis=1)
            keep = np.argpartition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k :]
            value[at], other[at] = np.take_along_axis(v, keep, 1), np.take_along_axis(o, keep, 1)

        for lo in range(0, len(sides[0]), tile):
            a = sides[0][lo : lo + tile]
            x, sx = code[a].astype(np.float32), scale[a].astype(np.float32)
            for start in range(lo if key[1] == key[2] else 0, len(sides[1]), tile):
                b = sides[1][start : start + tile]
                cosine = (x @ code[b].astype(np.float32).T) * sx[:, None] * scale[b].astype(np.float32)
                if key[1] == key[2] and lo == start:
                    np.fill_diagonal(cosine, -np.inf)
                    meet(a, b, cosine)
                else:
                    meet(a, b, cosine)
                    meet(b, a, np.ascontiguousarray(cosine.T))
        value, other = best[0]
        at, place = np.nonzero(value >= floor - 1e-6)
        other = other[at, place]
        dot = np.array([0.0] * len(at))
        for lo in range(0, len(at), 65536):
            w = slice(lo, lo + 65536)
            dot[w] = np.einsum("ij,ij->i", code[at[w]].astype(np.float32), code[other[w]].astype(np.float32))
        return pa.table({"coll": pa.array(np.full(len(at), key[0].as_py()), pa.int64()), "id": ids[at], "other": ids[other], "cosine": dot * (scale[at] * scale[other])})

    spread = coded.join(crowded, ["coll", "id"], "left_semi").withColumn("block", F.pmod(F.xxhash64("coll", "id"), F.lit(max(1, blocks))))
    spread = spread.withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    cell = [F.col("coll"), F.least("block", "meets").alias("x"), F.greatest("block", "meets").alias("y")]
    return spread.groupBy(*cell).applyInArrow(run, "coll long, id long, other long, cosine double").where(F.col("cosine") >= floor)


def _top(both: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("coll", "id").orderBy(F.col("cosine").desc(), "other")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _with_copies(top: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """``top`` (coll, id, other, cosine) of the smallest ids of equal vectors, for all of them; copies is (coll, rep, id)."""
    place = F.row_number().over(Window.partitionBy("coll", "rep").orderBy("id"))
    few = copies.withColumn("place", place).where(F.col("place") <= k).select("coll", "rep", F.col("id").alias("copy"))
    reps = copies.select("coll", "rep", F.col("rep").alias("id")).distinct()
    cols = ["coll", "id", "other", "cosine"]
    top = top.unionByName(top.join(few.withColumnRenamed("rep", "other"), ["coll", "other"]).select("coll", "id", F.col("copy").alias("other"), "cosine"))
    top = top.unionByName(top.withColumnRenamed("id", "rep").join(copies, ["coll", "rep"]).select(*cols))
    heads = few.unionByName(reps.withColumnRenamed("id", "copy")).withColumnRenamed("copy", "other")
    own = copies.unionByName(reps).join(heads, ["coll", "rep"]).where("id <> other").select("coll", "id", "other", F.lit(1.0).alias("cosine"))
    return _top(top.unionByName(own), k)


def nearest(vectors: DataFrame, k: int = K, floor: float = FLOOR, trees: int = TREES, reach: int = REACH, dim: int = DIM, crowd: int = CROWD) -> DataFrame:
    """(coll, lo, hi, cosine): pairs of at least ``floor`` of which one is among the ``k`` most similar of the other.

    ``vectors`` has coll INT, id BIGINT, vec ARRAY<FLOAT>, (coll, id) unique. Vectors that are null, of another width,
    not finite or all zero are left out. Of equal cosines the smaller id comes first.
    """
    slim = vectors.where(F.col("id").isNotNull() & (F.size("vec") == dim)).select(
        F.col("coll").cast("long").alias("coll"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")
    )
    edges = ranges(slim, trees, reach, dim)
    rows = strings(slim, trees, dim, edges=edges)
    found = cut(candidates(rows, trees, floor, reach, len(edges[1]) + 1, crowd), "forest")
    coded = codes(slim, dim)
    pairs = scored(found.where(F.col("kind") == PAIR).drop("kind"), coded, dim).where(F.col("cosine") >= floor)
    both = pairs.select("coll", F.explode(F.array(F.struct(F.col("lo").alias("id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("id"), F.col("lo").alias("other")))).alias("p"), "cosine").select("coll", "p.id", "p.other", "cosine")
    crowded = found.where(F.col("kind") == CROWDED).select("coll", F.col("lo").alias("id"))
    if not crowded.isEmpty():
        both = both.unionByName(crowded_best(coded, crowded, k, floor, dim)).groupBy("coll", "id", "other").agg(F.max("cosine").alias("cosine"))
    copies = found.where(F.col("kind") == COPY).select("coll", F.col("lo").alias("rep"), F.col("hi").alias("id"))
    top = _with_copies(_top(both, k), copies, k)
    return top.groupBy("coll", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).agg(F.max("cosine").alias("cosine"))


def memory_vectors(memory: DataFrame, staging: DataFrame) -> DataFrame:
    """The collections 0 (memory.embedding), 1 and 2 (reembed_staging.vec by tbl)."""
    return memory.select(F.lit(0).alias("coll"), "id", F.col("embedding").alias("vec")).unionByName(
        staging.where("tbl IN (0, 1)").select((F.col("tbl") + 1).cast("int").alias("coll"), "id", "vec")
    )


def named(pairs: DataFrame) -> DataFrame:
    coll = F.when(F.col("coll") == 0, "memory").otherwise(F.concat(F.lit("staging:"), (F.col("coll") - 1).cast("string")))
    return pairs.select(coll.alias("coll"), F.col("lo").alias("lo_id"), F.col("hi").alias("hi_id")).distinct()
