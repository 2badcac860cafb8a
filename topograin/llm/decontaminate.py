"""Benchmark decontamination by spaced seeds.

A mask picks some token positions of a short span and ignores the rest; a text and a test
item that agree at those, whatever stands between, share a seed. The masks of weight five find
every overlap of 12 or more tokens with at most a fifth substituted, wherever the
substitutions fall, and with one of weight four, for items under 12 tokens, also those of whole
items of 8 to 11 tokens. Around each seed hit the whole diagonal is compared and the
longest stretch with a similarity of 0.8 or more is measured: it must span `min_overlap`
tokens, or the whole item where that is shorter. Items under `min_item` tokens must occur as they
are: their mask is the whole item.

Plan. The join's small side is the test set. Its seeds are cut into blocks whose size is
checked against `block_chars`, one block is broadcast at a time, and training texts
stream past it: no shuffle of texts, and a test set of any size takes more blocks, not
more memory. Seeds are compared as 64-bit sums behind a bitmap, vectorised over a batch of
texts; the comparison of tokens decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions that each mask compares; that for items under min_overlap tokens.
MASKS, SHORT_MASK = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5)), (0, 1, 2, 3)
MIN_OVERLAP, MIN_ITEM, SIMILARITY = 12, 8, 0.8
BLOCK_CHARS = 4_000_000
#: Tokens that are compared at a time; zeros between texts.
BATCH_TOKENS, GAP = 1 << 20, 8
BITMAP = 22
#: Seed pairs that are listed at a time.
PAIRS = 1 << 20
#: Added to diagonals, which begin before a line by an item's length at most.
REACH = 1 << 39
_PUNCTUATION = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(64)], np.uint64)
#: Scripts that are written without spaces: each character is a token.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words, ASCII punctuation aside; single characters of scripts without spaces."""
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.lower().encode().translate(_PUNCTUATION).split()


def longest_similar(match: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bounds of the longest stretch of match whose mean is at least similarity."""
    score = np.r_[0.0, np.cumsum(match - similarity)] + 1e-9 * np.arange(len(match) + 1)
    low = np.minimum.accumulate(score)
    first = np.searchsorted(-low, -score, side="left")
    length = np.arange(len(score)) - first
    end = int(length.argmax())
    return int(first[end]), end


class Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_item: int = MIN_ITEM, min_overlap: int = MIN_OVERLAP):
        self.vocabulary: dict[bytes, int] = {}
        same: dict[tuple, int | None] = {}
        for item_id, text in items:
            if t := tuple(tokens(text)):
                same[t] = item_id if same.get(t) is None else min(same[t], item_id if item_id is not None else same[t])
        self.ids = list(same.values())
        self.texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], np.int32) for t in same]
        self.exact = min(min_item, len(_MULTIPLIERS))  # shorter ones must occur as they are
        self.tables = []
        sizes = np.array([len(t) for t in self.texts], np.int64)
        whole = [(tuple(range(n)), np.flatnonzero(sizes == n)) for n in range(1, self.exact)]
        for mask, own_items in [*((m, np.flatnonzero(sizes >= self.exact)) for m in MASKS), (SHORT_MASK, np.flatnonzero((sizes >= self.exact) & (sizes < min_overlap))), *whole]:
            if not len(own_items):
                continue
            keys, owner, where = [], [], []
            for i in own_items.tolist():
                h = self.seeds(self.texts[i], mask)
                keys.append(h)
                owner.append(np.full(len(h), i, np.int32))
                where.append(np.arange(len(h), dtype=np.int32))
            key, own, pos = (np.concatenate(x) for x in (keys, owner, where))
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << BITMAP, bool)
            bitmap[(key >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
            self.tables.append((mask, bitmap, key[order], own[order], pos[order]))

    @staticmethod
    def seeds(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        n = max(0, len(ids) - mask[-1])
        wide = ids.astype(np.uint64)
        h = np.zeros(n, np.uint64)
        for at, m in zip(mask, _MULTIPLIERS):
            h = (h ^ (wide[at : at + n] * m)) * np.uint64(0x9FB21C651E98DF25)
        return h

    def overlaps(self, texts: list[str | None], min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY) -> list[tuple]:
        """(text's place, item id, start in text, start in item, tokens, equal tokens) of the
        longest overlap of each text and item."""
        found: list[tuple] = []
        get, batch, size = self.vocabulary.get, [], 0
        for i, text in enumerate(texts):
            words = tokens(text)
            batch.append((i, np.fromiter(map(get, words, repeat(0)), np.int32, len(words))))
            size += len(words) + GAP
            if size >= BATCH_TOKENS:
                found += self._batch(batch, min_overlap, similarity)
                batch, size = [], 0
        return found + self._batch(batch, min_overlap, similarity)

    def _batch(self, batch: list[tuple[int, np.ndarray]], min_overlap: int, similarity: float) -> list[tuple]:
        if not batch or not self.texts:
            return []
        gap = np.zeros(GAP, np.int32)
        line = np.concatenate([x for _, ids in batch for x in (ids, gap)])
        ends = np.cumsum([len(ids) + GAP for _, ids in batch])
        pairs: list[np.ndarray] = []
        for mask, bitmap, key, own, pos in self.tables:
            n = len(line) - mask[-1]
            known = line > 0
            ok = known[:n].copy()
            for at in mask[1:]:
                ok &= known[at : at + n]
            at = np.flatnonzero(ok)
            h = np.zeros(len(at), np.uint64)
            for off, m in zip(mask, _MULTIPLIERS):
                h = (h ^ (line[at + off].astype(np.uint64) * m)) * np.uint64(0x9FB21C651E98DF25)
            near = bitmap[(h >> np.uint64(64 - BITMAP)).astype(np.int64)]
            at, h = at[near], h[near]
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            count = hi - lo
            # a seed that repeats in a text and an item gives each diagonal many times: some pairs at a time, each once
            cuts = np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(count)]):
                c, lo_ = count[begin:end], lo[begin:end]
                if c.sum():
                    slot = np.repeat(lo_, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    pairs.append(np.unique((own[slot].astype(np.int64) << 40) + (np.repeat(at[begin:end], c) - pos[slot] + REACH)))
                    if sum(map(len, pairs)) > 8 * PAIRS:
                        pairs = [np.unique(np.concatenate(pairs))]
        if not pairs:
            return []
        best: dict[tuple[int, int], tuple] = {}
        for pair in np.unique(np.concatenate(pairs)).tolist():
            item, diagonal = pair >> 40, (pair & ((1 << 40) - 1)) - REACH
            text = self.texts[item]
            # a diagonal may begin before its text or the line: hits then lie at a later offset
            for k in self._touched(diagonal, len(text), ends):
                begin, end = (int(ends[k - 1]) if k else 0), int(ends[k]) - GAP
                a, b = max(begin, diagonal), min(end, diagonal + len(text))
                old = best.get((k, item))
                if b - a < min(min_overlap, len(text)) * similarity or old and old[5] == len(text):  # all of the item is found
                    continue
                match = line[a:b] == text[a - diagonal : b - diagonal]
                s, e = longest_similar(match, similarity) if len(text) >= self.exact else (0, len(match) * bool(match.all()))
                if e - s >= min(min_overlap, len(text)):
                    row = (batch[k][0], self.ids[item], a - begin + s, a - diagonal + s, e - s, int(match[s:e].sum()), len(text))
                    if old is None or row[4:6] > old[4:6]:
                        best[k, item] = row
        return list(best.values())

    @staticmethod
    def _touched(diagonal: int, length: int, ends: np.ndarray) -> range:
        first = int(np.searchsorted(ends, max(0, diagonal), "right"))
        last = int(np.searchsorted(ends, diagonal + length - 1, "right"))
        return range(first, min(last, len(ends) - 1) + 1)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int, min_item: int = MIN_ITEM, min_overlap: int = MIN_OVERLAP) -> Iterator[Index]:
    """Indexes of the test set, block by block, equal items once under their least id; each block's
    size is bounded by block_chars in expectation, or by its one item where that is longer."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").groupBy("t").agg(F.min("i").alias("i"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    for k in range(n):
        yield Index([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()], min_item, min_overlap)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY, min_item: int = MIN_ITEM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_equal, item_tokens): the longest
    overlap of each document and test item that overlap enough; starts are in tokens.

    Equal items count once, under the least id. Items under min_item tokens are found where they
    occur exactly; items without tokens never. Null or empty texts, and an empty test set, overlap with nothing. Repeated
    documents give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long, item_tokens long"
    out = None
    for index in blocks(benchmark, item_col, text_col, block_chars, min_item, min_overlap):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in schema.split(", ")]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = held.value.overlaps(batch.column(1).to_pylist(), min_overlap, similarity)
                cols = list(zip(*((ids[k], *rest) for k, *rest in found))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", min_overlap: int = MIN_OVERLAP, similarity: float = SIMILARITY, min_item: int = MIN_ITEM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, all columns, without those that `contaminated` would report."""
    for index in blocks(benchmark, item_col, text_col, block_chars, min_item, min_overlap):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in held.value.overlaps(batch.column(text_col).to_pylist(), min_overlap, similarity)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
