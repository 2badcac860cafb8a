"""SimHash near-duplicate detection by a trie self-join.

Fingerprints are 64-bit majority votes over hashed word shingles. Two fingerprints link
when at most `budget` bits differ, and documents whose fingerprints are linked, directly or
by a chain, form a component.

Plan. Only distinct fingerprints are joined, so exact copies cost nothing. Bits are cut
into budget + 2 blocks: within the budget two blocks at least are equal, so each
fingerprint goes to one group per pair of blocks, keyed by those bits (a pigeonhole deal:
rows grow with the input, groups stay near one row). In a group the fingerprints,
sorted, are a binary trie whose nodes are index ranges. A frontier of node pairs walks down
one bit at a time, adds up differing bits, drops a pair beyond the budget, and drops
one whose leaves are in one class already. A group gives a spanning star, never all its
pairs. Groups over `group_cap` fingerprints, which one task should not hold, are found by counts
before anything is sent to a task, and linked by
shared midpoints instead: two values within the budget, and only such, have a common value
at half the budget, rounded down, from one and rounded up from the other; that takes only explode
and min. Components come from rounds of random-order edge contraction between tables in the shared folder.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SHINGLE, BUDGET, GROUP_CAP = 4, 4, 1 << 16
SEED = 42
#: Hashes whose bits are counted at a time, rows of a trie batch, node pairs of a step.
VOTES, TRIE_ROWS, FRONTIER = 1 << 16, 1 << 17, 1 << 17
#: Hash buckets at least by which groups are counted.
COUNTED = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 for one without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    digests = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:])]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(digests), VOTES):
        block = np.frombuffer(b"".join(digests[i : i + VOTES]), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) per row of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [struct.unpack("<q", struct.pack("<Q", fingerprint(t, shingle)))[0] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Masks of 64 bits, one for each pair of the blocks that the bits are cut into."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(spans, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _classes(n: int, links: list[tuple[np.ndarray, np.ndarray]], comp: np.ndarray) -> np.ndarray:
    """comp after the links: the least index of each class."""
    for a, b in links:
        while True:
            ra, rb = comp[a], comp[b]
            if not (open_ := ra != rb).any():
                break
            np.minimum.at(comp, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
            while not np.array_equal(up := comp[comp], comp):
                comp = up
    return comp


def trie_classes(values: np.ndarray, groups: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For sorted distinct values of each group (groups ascending): the index of the least
    member of each one's class within its group, classes by links of `budget` bits or less."""
    n = len(values)
    comp = np.arange(n)
    if not n:
        return comp
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        # leaves under both nodes in one class already: nothing to find
        edge = np.r_[0, np.cumsum(np.r_[False, comp[1:] != comp[:-1]])]
        done = (edge[ahi] == edge[alo + 1]) & (edge[bhi] == edge[blo + 1]) & (comp[alo] == comp[blo])
        done &= (alo != blo) | (ahi - alo < 2) | (edge[ahi] == edge[alo + 1])
        alo, ahi, blo, bhi, err = (x[~done] for x in (alo, ahi, blo, bhi, err))
        while len(alo) and depth < 64:
            if len(alo) > FRONTIER:
                half = len(alo) // 2
                stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
                alo, ahi, blo, bhi, err = (x[:half] for x in (alo, ahi, blo, bhi, err))
            if depth not in ones:
                ones[depth] = np.r_[0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
            up = ones[depth]
            amid, bmid = ahi - (up[ahi] - up[alo]), bhi - (up[bhi] - up[blo])
            same = alo == blo
            parts = []
            for a0, a1, b0, b1, cost, keep in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~same)):
                ok = (a0 < a1) & (b0 < b1)
                if cost:
                    ok &= err < budget
                else:
                    ok &= ~same | (a1 - a0 > 1)
                if keep is not None:
                    ok &= keep
                parts.append((a0[ok], a1[ok], b0[ok], b1[ok], (err + cost)[ok].astype(np.int8)))
            alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts))
            depth += 1
        if len(alo):
            comp = _classes(n, [(alo, blo)], comp)
    return comp


def _linked_in_groups(budget: int):
    """Streams rows (combo, key, fp), sorted, and yields star edges of each group."""

    def flush(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.r_[True, (c[1:] != c[:-1]) | (key[1:] != key[:-1])]) - 1
        ok = np.bincount(group)[group] > 1
        # trie order is that of the unsigned values
        value, g = fp[ok].astype(np.uint64), group[ok]
        order = np.lexsort((value, g))
        value, g = value[order], g[order]
        root = trie_classes(value, g, budget)
        child = np.flatnonzero(root != np.arange(len(root)))
        signed = value.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows < TRIE_ROWS:
                continue
            c, key, fp = (np.concatenate(x) for x in zip(*kept))
            last = np.flatnonzero((c != c[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from flush(c[:cut], key[:cut], fp[:cut])
            kept, rows = [[c[cut:], key[cut:], fp[cut:]]], len(fp) - cut
        if rows:
            yield from flush(*(np.concatenate(x) for x in zip(*kept)))

    return run


def _hot(dealt: DataFrame, rows: int, cap: int) -> DataFrame | None:
    """(c, key) of groups over the cap, of dealt (c, key, fp) with about that many rows; None if there are none.

    Groups are counted by hash bucket first, which combines before the shuffle; only rows
    of buckets over the cap are counted by group."""
    spot = F.pmod(F.xxhash64("c", "key"), F.lit(COUNTED + 4 * rows // cap))
    full = written(dealt.groupBy(spot.alias("spot")).agg(F.count("*").alias("n")).where(F.col("n") > cap).select("spot"), "full")
    if full.isEmpty():
        return None
    some = dealt.withColumn("spot", spot).join(full, "spot", "left_semi")
    hot = written(some.groupBy("c", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("c", "key"), "hot")
    return None if hot.isEmpty() else hot


def links(fps: DataFrame, budget: int = BUDGET, group_cap: int = GROUP_CAP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, written): their components are
    those of all pairs within the budget."""
    masks = block_masks(budget + 2)
    combos = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(combos).alias("g")).select(F.col("g.c").alias("c"), F.col("g.key").alias("key"), "fp")
    hot = _hot(dealt, len(masks) * fps.count(), group_cap)
    cold = dealt if hot is None else dealt.join(hot, ["c", "key"], "left_anti")
    edges = written(cold.repartition("c", "key").sortWithinPartitions("c", "key", "fp").mapInArrow(_linked_in_groups(budget), "a long, b long"), "links")
    if hot is None:
        return edges.distinct()
    # from one side half the budget, from the other the rest of it
    flips = []
    for m in masks:
        free = [i for i in range(64) if not m >> i & 1]
        flips.append([(_signed(sum(1 << i for i in x)), n <= budget // 2) for n in range((budget + 1) // 2 + 1) for x in combinations(free, n)])
    spec = fps.sparkSession.createDataFrame(list(enumerate(flips)), "c int, flips array<struct<f:long,near:boolean>>")
    middles = dealt.join(hot, ["c", "key"]).join(F.broadcast(spec), "c").select("c", "fp", F.explode("flips").alias("x")).select("c", F.col("fp").bitwiseXOR(F.col("x.f")).alias("mid"), "fp", "x.near")
    least = middles.where("near").groupBy("c", "mid").agg(F.min("fp").alias("b"))
    more = middles.join(least, ["c", "mid"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return edges.union(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), one root a component.

    Each round every node joins the neighbour, or itself, that comes first in an order
    drawn anew by hash, which removes a constant share of the nodes whatever the shape;
    node and edge tables stay in the shared folder.
    """
    labels, k = None, 0
    edges = written(edges.where("a <> b"), "edges")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c).alias("to"))
        near = both.groupBy("node").agg(F.min(rank("other")).alias("x"))
        step = written(near.select("node", F.least(F.col("x"), rank("node"))["to"].alias("to")), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            ahead = step.select(F.col("node").alias("root"), "to")
            labels = written(labels.join(ahead, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        a, b = (step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        edges = written(edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        k += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, group_cap: int = GROUP_CAP) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of docs.

    component_id is the least doc_id of the component, nulls aside; it is null only where
    all ids of a component are. Repeated rows give repeated rows. A null or blank text has
    fingerprint 0 and links like any other. An empty table gives none. Other columns of
    docs are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    labels = components(links(fps, budget, group_cap)).select(F.col("node").alias("fp"), "root")
    classes = written(fps.join(labels, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs, all columns, with one row of each component: that with the component's id.

    Of rows that share that id within the component one stays.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **params), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of found (doc_id, text_hash, root, component_id)."""
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = written(best.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.count("*").alias("n")).select("x.*", "n"), "kept")
    key = [docs[id_col].cast("long").eqNullSafe(F.col("k.doc_id")), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("k.text_hash")]
    kept = docs.join(chosen.where("n = 1").alias("k"), key, "left_semi")
    repeated = chosen.where("n > 1").alias("k")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, key, "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, text_col]))
