"""Near-duplicate records with small edits (problem 5): a Hamming join on word sets with pigeonring pruning.

Two sets of a and b words share at least the part t of all their words exactly if they differ in at most
``budget = (a + b)(1 - t)/(1 + t)`` words, a Hamming distance. Rows of the same word set are one class first, so copies
never meet each other. Then:

1. Segments. The words are ordered from rare to frequent, and cut by frequency into tiers (k = 1, 2, 3) and by hash into
   ``GROUPS`` segments a tier, twice as many for every doubling of the set over ``LEVEL`` words, so that segments stay
   short and the combinations below grow with the words, not with their cube. A set is also cut as the smallest set it
   can be similar to would be, so a pair always meets at the level of its smaller set. A set's prefix is the shortest run of its rarest words for which the segments can absorb
   more losses than the set may have: a segment of c words still holds k common ones after c - k losses. By the
   pigeonhole principle two similar sets share k words in some segment of both prefixes, so the k-wise combinations of
   a segment's words are its signatures. k grows with frequency, which keeps every signature about equally rare.
2. Ring. Each set has a 128-bit parity sketch whose bits are a ring of eight segments; in any arc of the ring two sketches
   differ in at most as many bits as the sets differ in words of that arc. If all differences are within the budget, then
   from some segment on every chain of 1, 2, .. 8 consecutive segments stays within its proportional part of the budget.
   Pairs without such a chain are dropped where they meet, before anything is exchanged.
3. Check. The pairs that are left fetch their words, and the Hamming distance is counted in full.

Sets whose words are too few or too frequent for step 1 (their segments can't absorb enough) are compared exactly too:
their prefix words meet every set that has one of them and a size that can be similar; a word that very many sets have
is spread over several tasks.

Word frequencies are counted in hash buckets, twice as many as there are words, between 2^16 and 2^22: only their
logarithm in a byte is broadcast (4 MB at most). Beyond that a bucket holds the sum of some words, which makes them count
as more frequent than they are: more work for a pair, never a lost one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.storage import cut

NUM, DEN = 7, 10
CAP, GROUPS, LEVEL = 128, 4, 96
#: Least and most hash buckets of word frequencies, as powers of two, and steps a doubling of a frequency.
BUCKETS, STEPS = (16, 22), 8
#: Rows of one signature that a task compares; rows read before a comparison starts.
HOT_ROWS, BATCH_ROWS = 100_000, 1 << 19
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MASK = (1 << 64) - 1


def words(*columns: str) -> Column:
    """The distinct lower-cased runs of letters and digits of the columns joined by a space."""
    text = F.lower(F.concat(*[x for c in columns for x in (F.coalesce(F.col(c), F.lit("")), F.lit(" "))]))
    return F.array_distinct(F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), ""))


def word_sets(memory: DataFrame) -> DataFrame:
    """(id, s1, s2, w) of the rows with a word and a value that isn't blank: w are the words' hashes, s1 and s2 (96 bits
    together) tell whether two rows have the same words."""
    rows = memory.where(F.col("id").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]")).select(
        F.col("id").cast("long").alias("id"), F.array_sort(F.transform(words("key", "value"), lambda w: F.xxhash64(w))).alias("w")
    )
    return rows.where(F.size("w") > 0).select("id", F.xxhash64("w").alias("s1"), F.hash("w").alias("s2"), "w")


def _frequency_code(count: np.ndarray) -> np.ndarray:
    """Frequencies as a byte that keeps their order up to a step of a STEPS-th of a doubling."""
    return np.minimum(255, np.floor(np.log2(count + 1.0) * STEPS)).astype(np.uint8)


def _tiers(code: np.ndarray, n_sets: int) -> np.ndarray:
    c = np.exp2(code.astype(np.float64) / STEPS) - 1
    return np.where(c <= CAP, 1, np.where(c * c <= CAP * n_sets, 2, 3))


def _code(w: np.ndarray, df: np.ndarray) -> np.ndarray:
    return df[w & (len(df) - 1)]


def _need(n: int | np.ndarray, num: int, den: int):
    """Losses a set of n words may have, and one more."""
    return n - -(-num * n // den) + 1


def _level(n: int) -> int:
    return max(0, -(-n // LEVEL) - 1).bit_length()


def signatures(w: np.ndarray, df: np.ndarray, n_sets: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Signatures of one set (step 1), as signed 64-bit numbers."""
    code = _code(w, df)
    order = np.lexsort((w, code))
    w = w[order]
    tier = _tiers(code[order], n_sets).tolist()
    words, hashed = w.tolist(), ((w >> 40) & 0xFFFFFF).tolist()
    need, out = _need(len(w), num, den), []
    for level in range(_level(-(-num * len(w) // den)), _level(len(w)) + 1):
        units, last = 0, (GROUPS << level) - 1
        segments: dict[int, list[int]] = {}
        for x, k, g in zip(words, tier, hashed, strict=True):
            if units >= need:
                break
            seg = segments.setdefault(k if k == 1 else (level << 32) + ((g & last) << 4) + k, [])
            seg.append(x)
            units += len(seg) >= k
        for key, seg in segments.items():
            k = key & 15
            if len(seg) < k:
                continue
            for c in combinations(seg, k):
                s = key
                for x, m in zip(c, _MIX, strict=False):
                    s = ((s ^ x) * m) & _MASK
                    s ^= s >> 29
                out.append(s - (1 << 64) if s >> 63 else s)
    return out


def _too_few(w: np.ndarray, n: np.ndarray, df: np.ndarray, n_sets: int, num: int, den: int) -> np.ndarray:
    """Which of the sets (words w one after the other, sizes n) can't absorb their losses at one of their levels."""
    row, k = np.repeat(np.arange(len(n)), n), _tiers(_code(w, df), n_sets)
    few, need = np.zeros(len(n), bool), _need(n, num, den)
    own = np.array([_level(int(x)) for x in n], np.int64)
    least = np.array([_level(-(-num * int(x) // den)) for x in n], np.int64)
    for level in range(int(least.min(initial=0)), int(own.max(initial=0)) + 1):
        at = (least <= level) & (level <= own)
        mine = at[row]
        groups = GROUPS << level
        seg = np.where(k == 1, 0, groups * (k - 1) + ((w >> 40) & (groups - 1)))[mine]
        uniq, count = np.unique(row[mine] * (3 * groups) + seg, return_counts=True)
        tier = np.maximum(1, uniq % (3 * groups) // groups + 1)
        absorbed = np.bincount(uniq // (3 * groups), weights=np.maximum(0, count - tier + 1), minlength=len(n))
        few |= at & (absorbed < need)
    return few


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sizes = pdf["n"].to_numpy()
    return np.concatenate(pdf["w"].to_numpy()) if len(pdf) else np.empty(0, np.int64), sizes


def sketch(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Two 64-bit numbers a row: bit (hash mod 128) is the parity of the words that have it."""
    bit = ((flat >> 24) & 127).astype(np.int64)
    parity = (np.bincount(row * 128 + bit, minlength=rows * 128) & 1).astype(np.uint8).reshape(rows, 128)
    return np.packbits(parity, axis=1, bitorder="little").view(np.int64).reshape(rows, 2)


def with_sketch(sets: DataFrame) -> DataFrame:
    """(cid, n, a, b, w): the classes with their sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                flat, n = _flat(pdf)
                sk = sketch(flat, np.repeat(np.arange(len(pdf)), n), len(pdf))
                yield pdf.assign(a=sk[:, 0], b=sk[:, 1])[["cid", "n", "a", "b", "w"]]

    return sets.mapInPandas(run, "cid long, n int, a long, b long, w array<long>")


def ring(x: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Step 2 for the differing bits x (pairs by two words): has some segment all its chains within the budget?"""
    part = np.bitwise_count(np.ascontiguousarray(x).view(np.uint16)).astype(np.int32)  # eight segments of 16 bits
    around = np.concatenate([part, part[:, :7]], axis=1)
    ok, chain = np.ones(part.shape, bool), np.zeros(part.shape, np.int32)
    for size in range(1, 9):
        chain = chain + around[:, size - 1 : size + 7]
        ok &= chain * 8 <= size * budget[:, None]
    return ok.any(axis=1)


def met(cols: list[np.ndarray], num: int, den: int) -> list[np.ndarray]:
    """Pairs (lo, hi) of the rows (key.., cid, n, a, b, side), sorted by key, that share a key and pass step 2.

    The rows of a key are compared at growing distance; rows whose key has ended drop out, so the work is the number of
    pairs. Sides keep the pairs of a split key apart: 0 meets all, else only the other side.
    """
    key, cell, cid, n, a, b, side = cols
    ab = np.stack([a, b], axis=1).view(np.uint64)
    last, d, out = len(key) - 1, 1, []
    i = np.flatnonzero((key[1:] == key[:-1]) & (cell[1:] == cell[:-1]))
    while len(i):
        x = ab[i] ^ ab[i + d]
        budget = (n[i].astype(np.int64) + n[i + d]) * (den - num) // (den + num)
        near = np.flatnonzero(np.bitwise_count(x).sum(axis=1, dtype=np.int32) <= budget)
        if len(near):
            near = near[ring(x[near], budget[near])]
            p, q = i[near], i[near] + d
            keep = (cid[p] != cid[q]) & ((side[p] == 0) | (side[p] != side[q]))
            p, q = cid[p[keep]], cid[q[keep]]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
        d += 1
        i = i[i + d <= last]
        i = i[(key[i + d] == key[i]) & (cell[i + d] == cell[i])]
    return list(np.unique(np.concatenate(out, axis=1), axis=1)) if out else []


def meeting(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(lo, hi), distinct: the pairs of rows (sig, cell, cid, n, a, b, side) that share sig and cell and pass step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            if not final:  # the rows of the last key may go on in the next batch
                tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
                stop = tail[-1] + 1 if len(tail) else 0
                held.append([c[stop:] for c in cols])
                cols = [c[:stop] for c in cols]
            if len(cols[0]) > 1 and (pairs := met(cols, num, den)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["lo", "hi"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= BATCH_ROWS and (held[0][0][0] != held[-1][0][-1] or held[0][1][0] != held[-1][1][-1]):
                yield from flush(False)
        if held:
            yield from flush(True)

    sorted_ = rows.repartition("sig", "cell").sortWithinPartitions("sig", "cell")
    return sorted_.mapInArrow(run, "lo long, hi long").distinct()


def cells(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds (cell, side) to signature rows: a signature of more than ``hot_rows`` rows is spread over a triangular grid.

    Its rows are hashed into as many blocks as it needs, and a row goes to the cells of its block with every block, so
    each pair of rows still meets exactly once and no task holds the whole. Signatures are counted in hash buckets, whose
    number follows the rows; buckets without such a signature cost one count and no replica.
    """
    buckets = max(1, rows.count() // 1000)
    slot = F.pmod(F.xxhash64("sig"), F.lit(buckets))
    hot = cut(rows.groupBy(slot.alias("slot")).count().where(F.col("count") > hot_rows), "hot")
    plain = rows.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0).cast("long")})
    if hot.isEmpty():
        return plain
    at = rows.withColumn("slot", slot)
    blocks = F.ceil(F.col("count") / hot_rows).cast("long")
    mine = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks"))
    spread = (
        at.join(hot, "slot").withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("cell", 1 + F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
        .withColumn("side", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("long"))
    )
    cols = [*rows.columns, "cell", "side"]
    cold = at.join(hot.select("slot"), "slot", "left_anti").withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0).cast("long")})
    return cold.select(cols).unionByName(spread.select(cols))


def all_pairs(rows: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """(x, y), x < y: the pairs of rows (sig, cid) of one sig. A large group is spread over a grid of tasks."""
    spread = cells(rows, hot_rows)
    on = F.expr("a.sig = b.sig AND a.cell = b.cell AND a.cid < b.cid AND (a.side = 0 OR a.side <> b.side)")
    return spread.alias("a").join(spread.alias("b"), on).select(F.col("a.cid").alias("x"), F.col("b.cid").alias("y"))


def _short_pairs(few: DataFrame, slim: DataFrame, num: int, den: int, hot_rows: int) -> DataFrame:
    """(lo, hi) of the sets in ``few`` and all sets that have one of their words ``sig`` and a size they can be similar to.

    Rows meet by word and size. A word and size that more than ``hot_rows`` sets have is spread over as many tasks as it
    needs; the few rows go to each of them. The number of such words is bounded by the rows over ``hot_rows``.
    """
    sizes = F.sequence(F.ceil(F.col("n") * num / den).cast("int"), F.floor(F.col("n") * den / num).cast("int"))
    left = few.withColumn("size", F.explode(sizes))
    every = slim.select(F.explode("w").alias("sig"), "cid", "n", "a", "b").join(left.select("sig", F.col("size").alias("n")).distinct(), ["sig", "n"], "left_semi")
    every = cut(every, "every")
    hot = cut(every.groupBy("sig", "n").count().where(F.col("count") > hot_rows).select("sig", "n", F.ceil(F.col("count") / hot_rows).cast("int").alias("parts")), "hot")
    part = F.lit(0)
    if not hot.isEmpty():
        every = every.join(hot, ["sig", "n"], "left").withColumn("part", F.pmod(F.hash("cid", F.lit(11)), F.coalesce("parts", F.lit(1))))
        left = left.join(hot.withColumnRenamed("n", "size"), ["sig", "size"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    else:
        every, left = every.withColumn("part", part), left.withColumn("part", part)
    on = F.expr(f"l.sig = r.sig AND l.size = r.n AND l.part = r.part AND l.cid <> r.cid AND bit_count(l.a ^ r.a) + bit_count(l.b ^ r.b) <= (l.n + r.n) * {den - num} div {den + num}")
    return left.alias("l").join(every.alias("r"), on).select(F.least("l.cid", "r.cid").alias("lo"), F.greatest("l.cid", "r.cid").alias("hi"))


def similar_classes(sets: DataFrame, num: int = NUM, den: int = DEN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(lo BIGINT, hi BIGINT): pairs of classes, from a table (cid, n, w) that has each word set once."""
    spark = sets.sparkSession
    base = cut(with_sketch(sets), "sets")
    words_ = base.select(F.explode("w").alias("x"))
    size = base.agg(F.count("*")).first()[0], words_.agg(F.approx_count_distinct("x")).first()[0]
    n_sets, bits = max(1, size[0]), min(BUCKETS[1], max(BUCKETS[0], (2 * size[1]).bit_length()))
    counted = words_.groupBy((F.col("x").bitwiseAND((1 << bits) - 1)).cast("int").alias("k")).count().toArrow()
    freq = np.zeros(1 << bits, np.int64)
    freq[counted["k"].to_numpy()] = counted["count"].to_numpy()
    df = spark.sparkContext.broadcast(_frequency_code(freq))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = df.value
        for pdf in batches:
            sigs = [signatures(w, d, n_sets, num, den) for w in pdf["w"]]
            sizes = [len(s) for s in sigs]
            out = pdf[["cid", "n", "a", "b"]].loc[pdf.index.repeat(sizes)]
            yield out.assign(sig=np.concatenate([np.array(s, np.int64) for s in sigs]) if sigs else [])[["sig", "cid", "n", "a", "b"]]

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = df.value
        for pdf in batches:
            if not len(pdf):
                continue
            flat, n = _flat(pdf)
            for r in pdf[_too_few(flat, n, d, n_sets, num, den)].itertuples(index=False):
                order = np.lexsort((r.w, _code(r.w, d)))[: _need(r.n, num, den)]
                yield pd.DataFrame({"cid": r.cid, "n": r.n, "a": r.a, "b": r.b, "sig": r.w[order]})[["sig", "cid", "n", "a", "b"]]

    form = "sig long, cid long, n int, a long, b long"
    slim = base.select("cid", "n", "a", "b", "w")
    sig = cut(slim.mapInPandas(sign, form), "signatures")
    found = meeting(cells(sig, hot_rows).select("sig", "cell", "cid", "n", "a", "b", "side"), num, den)
    few = cut(slim.mapInPandas(short, form), "short")
    if not few.isEmpty():
        found = found.unionByName(_short_pairs(few, slim, num, den, hot_rows))
    pairs = cut(found.distinct(), "pairs")
    # the full check: the words of the classes that are in a pair
    left = base.select(F.col("cid").alias("lo"), F.col("w").alias("lw"))
    right = base.select(F.col("cid").alias("hi"), F.col("w").alias("rw"))
    common = F.size(F.array_intersect("lw", "rw"))
    whole = F.size("lw") + F.size("rw") - common
    return pairs.join(left, "lo").join(right, "hi").where(common * den >= whole * num).select("lo", "hi")


def classes_of(memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cid) and the classes (cid, n, w); a class is named by its smallest id. Texts are read once."""
    rows, same = cut(word_sets(memory), "words"), ["s1", "s2"]
    sets = rows.groupBy(*same).agg(F.min("id").alias("cid"), F.first("w").alias("w")).select("cid", F.size("w").alias("n"), "w")
    members = rows.select("id", *same).join(rows.groupBy(*same).agg(F.min("id").alias("cid")), same).select("id", "cid")
    return members, sets


def near_pairs(memory: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(lo_id, hi_id): every pair of rows whose common words are at least num/den of all their words.

    Rows with a null or blank value, a null id or no word at all are left out; a null key counts as empty; rows of the
    same words are pairs too; ids are taken as unique. Members of classes are expanded only in the last step.
    """
    members, sets = classes_of(memory)
    members = cut(members, "members")
    links = similar_classes(sets, num, den)
    lo = members.select(F.col("cid").alias("lo"), F.col("id").alias("x"))
    hi = members.select(F.col("cid").alias("hi"), F.col("id").alias("y"))
    across = links.join(lo, "lo").join(hi, "hi").select("x", "y")
    many = members.groupBy("cid").count().where("count > 1").select("cid")
    within = all_pairs(members.join(many, "cid", "left_semi").select(F.col("cid").alias("sig"), F.col("id").alias("cid")))
    return across.unionByName(within).select(F.least("x", "y").alias("lo_id"), F.greatest("x", "y").alias("hi_id"))


def near_groups(memory: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, class_id, group_id): the class of equal word sets and the group of near-duplicates of every row in one.

    Rows that are alone in both are left out. Groups are the connected components of the similar classes.
    """
    from tarnstone.llm.components import connected_components

    members, sets = classes_of(memory)
    members = cut(members, "members")
    groups = connected_components(similar_classes(sets, num, den), "lo", "hi").withColumnRenamed("vertex", "cid")
    sizes = members.groupBy("cid").count()
    out = members.join(groups, "cid", "left").join(sizes, "cid").where("count > 1 OR component IS NOT NULL")
    return out.select("id", F.col("cid").alias("class_id"), F.coalesce("component", "cid").alias("group_id"))
