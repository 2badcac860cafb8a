"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text is cut into lines (paragraphs), a line into sentences, and over-long sentences into
runs of words that end where a word's hash says so, so that an insertion moves no cut but
its own. Consecutive lines make a section, which ends at a blank line, before a
heading, or at a line whose hash says so. Every node's hash covers the hashes below; nothing
of a text is left out, so equal roots mean equal texts. Comparing two trees takes equal
branches whole and goes down only where they differ, which locates edits.

Plan. Trees are made where the texts are. The neighbour in id order takes one shuffle of
texts: ids alone are ranked into `buckets` ranges first, rows are dealt by range and sorted
in it, and the first document of each range is sent to the range before as well, so
that no task needs a whole table and no window runs over all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest sentence that is one leaf; one in so many words and lines ends a run or section.
LEAF, RUN_WORDS, SECTION_LINES = 300, 8, 6


@dataclass
class Tree:
    """Nodes by level: hash, length in code points, number of children. Lengths count
    separators, so those of a level add up to the text's and the separators past it."""

    root: str
    sections: list[tuple[bytes, int, int]]
    paragraphs: list[tuple[bytes, int, int]]
    leaves: list[tuple[bytes, int]]

    def likeness(self, other: Tree) -> float:
        """Share of both texts, by length, in branches that both have; 1 if and only if equal."""
        if self.root == other.root:
            return 1.0
        total = sum(x[1] for x in self.leaves) + sum(x[1] for x in other.leaves)
        same = _shared(self, other)
        return min(2 * same / total, 1 - 1e-6) if total else 0.0

    def edit(self, other: Tree) -> tuple[int, int] | None:
        """Bounds, in code points of this text, of what differs from the other; None if equal."""
        if self.root == other.root:
            return None
        a, b = self.leaves, other.leaves
        n = min(len(a), len(b))
        lead = _level_lead(self, other)
        while lead < n and a[lead][0] == b[lead][0]:
            lead += 1
        tail = 0
        while tail < n - lead and a[-1 - tail][0] == b[-1 - tail][0]:
            tail += 1
        size = sum(x[1] for x in a)
        start, stop = sum(x[1] for x in a[:lead]), size - sum(x[1] for x in a[len(a) - tail :])
        return min(start, size - 1), max(min(stop, size - 1), min(start, size - 1))


def _level_lead(a: Tree, b: Tree) -> int:
    """Leaves under the equal leading sections and, below the first that differ, paragraphs."""
    lines = leaves = 0
    for x, y in zip(a.sections, b.sections):
        if x[0] != y[0]:
            break
        lines += x[2]
    for i, (x, y) in enumerate(zip(a.paragraphs, b.paragraphs)):
        if i >= lines and x[0] != y[0]:
            break
        leaves += x[2]
    return leaves


def _shared(a: Tree, b: Tree) -> int:
    same = 0
    level_a, level_b = [(x[0], x[1]) for x in a.sections], [(x[0], x[1]) for x in b.sections]
    below = ((a.sections, a.paragraphs, b.sections, b.paragraphs), (a.paragraphs, a.leaves, b.paragraphs, b.leaves), None)
    open_a, open_b = range(len(level_a)), range(len(level_b))
    for step in below:
        both = Counter(level_a[i] for i in open_a) & Counter(level_b[i] for i in open_b)
        same += sum(k[1] * n for k, n in both.items())
        if step is None:
            break
        open_a = _descend(step[0], open_a, level_a, both.copy())
        open_b = _descend(step[2], open_b, level_b, both)
        level_a, level_b = [(x[0], x[1]) for x in step[1]], [(x[0], x[1]) for x in step[3]]
    return same


def _descend(nodes: list[tuple[bytes, int, int]], open_: range | list[int], keys: list, taken: Counter) -> list[int]:
    """Children of the open nodes that have no equal on the other side."""
    starts, at = [], 0
    for x in nodes:
        starts.append(at)
        at += x[2]
    out: list[int] = []
    for i in open_:
        if taken.get(keys[i], 0) > 0:
            taken[keys[i]] -= 1
        else:
            out.extend(range(starts[i], starts[i] + nodes[i][2]))
    return out


def _hash(level: bytes, data: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=level).digest()


def _runs(sentence: str) -> Iterator[str]:
    """A long sentence's runs of words; joined by spaces they are the sentence."""
    run: list[str] = []
    for word in sentence.split(" "):
        run.append(word)
        if xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % RUN_WORDS == 0:
            yield " ".join(run)
            run = []
    if run:
        yield " ".join(run)


def tree(text: str | None) -> Tree:
    leaves: list[tuple[bytes, int]] = []
    paragraphs: list[tuple[bytes, int, int]] = []
    sections: list[tuple[bytes, int, int]] = []
    open_: list[bytes] = []
    size = 0

    def close() -> None:
        nonlocal open_, size
        if open_:
            sections.append((_hash(b"section", b"".join(open_)), size, len(open_)))
        open_, size = [], 0

    for line in (text or "").split("\n"):
        if not line.strip() or line.startswith("#"):
            close()
        parts, length = [], 0
        for sentence in line.split(". "):
            runs = [sentence] if len(sentence) <= LEAF else list(_runs(sentence))
            for i, run in enumerate(runs):
                last = i == len(runs) - 1
                h = _hash(b"sentence" if last else b"run", run.encode("utf-8", "surrogatepass"))
                leaves.append((h, len(run) + (2 if last else 1)))
                parts.append(h)
        leaves[-1] = (leaves[-1][0], leaves[-1][1] - 1)  # a line ends with one character
        length = sum(x[1] for x in leaves[-len(parts) :])
        h = _hash(b"line", b"".join(parts))
        paragraphs.append((h, length, len(parts)))
        open_.append(h)
        size += length
        if h[0] % SECTION_LINES == 0:
            close()
    close()
    return Tree(_hash(b"text", b"".join(x[0] for x in sections)).hex(), sections, paragraphs, leaves)


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, sections, paragraphs) per row: the root and the two levels below
    it, in hex. A null text counts as empty; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tree(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.root for t in made], pa.string()), *[pa.array([[x[0].hex() for x in getattr(t, k)] for t in made], pa.list_(pa.string())) for k in ("sections", "paragraphs")]], ["doc_id", "fingerprint", "sections", "paragraphs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string, sections array<string>, paragraphs array<string>")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> tuple[DataFrame, int]:
    """Rows (late, doc_id, text), dealt by id range and sorted; late rows (1) come after the others
    of their partition and hold, first, what follows its last document."""
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("o"))
    marks = ids.agg(F.percentile_approx("o", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("b")).first().b
    bounds = sorted(set(marks or []))
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("o"))) if bounds else F.lit(0)
    heads = sorted((r.p, r.o) for r in ids.select("o", place.alias("p")).groupBy("p").agg(F.min("o").alias("o")).collect())
    before = [(o, heads[i - 1][0]) for i, (_, o) in enumerate(heads)]  # the first goes to the last range
    side = F.broadcast(spark.createDataFrame(before, "o long, also int"))
    rows = docs.select(order.alias("o"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("p", place)
    here = F.struct(F.col("p"), F.lit(0).alias("late"))
    there = F.struct(F.col("also").alias("p"), F.lit(1).alias("late"))
    dealt = rows.join(side, "o", "left").select("doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to"))
    dealt = dealt.select("to.p", "to.late", "doc_id", "text").repartitionById(len(bounds) + 1, F.col("p"))
    return dealt.sortWithinPartitions("late", F.col("doc_id").asc_nulls_first(), "text").select("late", "doc_id", "text"), n


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_sections, n_paragraphs, edit_start, edit_stop.

    The edited text has the last floor(n_chars / 2) code points replaced by as many, or all,
    of the next document's first; next is in order of id (nulls first), then text, and the
    first follows the last. edit_start and edit_stop bound, in code points, where the trees
    differ (null if they do not). Null texts count as empty; repeated rows follow each
    other. An empty table gives none.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_sections", "n_paragraphs", "edit_start", "edit_stop"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def row(doc_id: int | None, text: str, own: Tree, following: str, ahead: Tree) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = tree(edited)
        where = own.edit(other) or (None, None)
        return doc_id, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.root, other.root, own.likeness(other), own.likeness(ahead), len(own.sections), len(own.paragraphs), *where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        over = False
        for batch in batches:
            out = []
            for k in range(batch.num_rows):  # a text at a time, not all of a batch
                if over:
                    break
                late, doc_id, text = (batch.column(i)[k].as_py() for i in range(3))
                made = tree(text)
                if last:
                    out.append(row(*last, text, made))
                last, over = (doc_id, text, made), bool(late)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names)

    rows, _ = with_next(docs, id_col, text_col, buckets)
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_paragraphs long, edit_start long, edit_stop long")
