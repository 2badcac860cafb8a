"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded: shares of
byte classes, word statistics and hashed words, then a tanh layer. Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))) over the passages of a document, weighs them; the
weighted passage representation is scored by a logistic unit. Only document labels train
it: all parameters follow the gradient of the document loss, in numpy (Adam).

Plan. Training takes a bounded sample of labelled rows, `train_docs` documents in hash
order with at most `train_chars` characters in sum; encoding runs on the executors and the
driver gets the encoded passages. Scoring streams every document, all passages, past the
weights (some kB in the closure): no shuffle of texts. Encoding is vectorised over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

PASSAGE, HASHED, HIDDEN, ATTENTION = 64, 64, 24, 12
TRAIN_DOCS, TRAIN_CHARS, STEPS, THRESHOLD = 2000, 16_000_000, 250, 0.3
#: Bytes that are encoded at a time; longer texts are cut at a space, passages start anew there.
PIECE = 1 << 20
_SPACES = b" \t\n\v\f\r"
_CLASS = np.full(256, 7, np.int64)  # other ASCII
_CLASS[128:] = 6
for _i, _chars in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"-()", b"!?", _SPACES)):
    _CLASS[list(_chars)] = _i
_CLASSES, _WORD_STATS = 8, 9
FEATURES = _CLASSES + _WORD_STATS + HASHED + 1
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


def _powers(n: int, radix: np.uint64, held: dict = {}) -> np.ndarray:  # noqa: B006 - a cache
    have = held.get(int(radix))
    if have is None or len(have) < n:
        step = np.full(max(n, PIECE + 4096), radix, np.uint64)
        step[0] = 1
        have = held[int(radix)] = np.multiply.accumulate(step)
    return have[:n]


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER = (_LOWER + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of the pieces, and the piece of each; one empty passage for a
    piece without words."""
    line = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    kind = _CLASS[line]
    space = kind == 5
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    limits = np.cumsum([len(p) + 1 for p in pieces])
    owner = np.searchsorted(limits, starts, "right")
    words = np.bincount(owner, minlength=len(pieces))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    first = np.flatnonzero(place % PASSAGE == 0)
    n = len(first)
    if n:
        passage = np.cumsum(place % PASSAGE == 0) - 1
        begin = starts[first]
        spans = np.diff(np.r_[begin, len(line)])
        by_byte = np.repeat(np.arange(n), spans)
        counts = np.bincount(by_byte * _CLASSES + kind[begin[0] :], minlength=n * _CLASSES).reshape(n, _CLASSES)
        hashed = np.r_[np.uint64(0), np.cumsum(_LOWER[line] * _powers(len(line), _RADIX))]
        h = (hashed[ends] - hashed[starts]) * _powers(len(line), _INVERSE)[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        per = np.bincount(passage, minlength=n).astype(np.float64)
        mean = lambda x: np.bincount(passage, weights=x, minlength=n) / per
        length = (ends - starts).astype(np.float64)
        a, b = kind[starts], kind[ends - 1]
        order = np.lexsort((h, passage))
        run = np.flatnonzero(np.r_[True, (np.diff(passage[order]) != 0) | (np.diff(h[order]) != 0)])
        size = np.diff(np.r_[run, len(order)])
        most = np.zeros(n)
        np.maximum.at(most, passage[order][run], size)
        average = mean(length)
        stats = np.stack([
            average, np.sqrt(np.maximum(0, mean(length**2) - average**2)), np.bincount(passage[order][run], minlength=n) / per, (most - 1) / per,
            mean(a == 1), mean(b == 3), mean(b >= 7), mean((length == 1) & (a >= 7)), np.minimum(1, per / PASSAGE),
        ], axis=1)
        bag = np.bincount(passage * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / per[:, None]
        full = np.concatenate([counts / counts.sum(axis=1, keepdims=True), stats, bag, np.zeros((n, 1))], axis=1).astype(np.float32)
        of = owner[first]
    else:
        full, of = np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    if len(empty := np.flatnonzero(words == 0)):
        blank = np.zeros((len(empty), FEATURES), np.float32)
        blank[:, -1] = 1
        full, of = np.concatenate([full, blank]), np.r_[of, empty]
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    return full, of


def _pieces(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n"))
        cut = cut + 1 if cut > at else at + PIECE
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def bags(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, text of each passage), some whole texts at a time."""
    pieces: list[bytes] = []
    of: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for p in _pieces(text or b""):
            pieces.append(p)
            of.append(i)
            size += len(p)
        if size >= PIECE or i == len(texts) - 1:
            found, k, lo = [], [], 0
            while lo < len(pieces):  # a long text's pieces one by one
                hi, held = lo + 1, len(pieces[lo])
                while hi < len(pieces) and held + len(pieces[hi]) <= 2 * PIECE:
                    held += len(pieces[hi])
                    hi += 1
                x, own = encode(pieces[lo:hi])
                found.append(x)
                k.append(np.asarray(of[lo:hi])[own])
                lo = hi
            yield np.concatenate(found), np.concatenate(k)
            pieces, of, size = [], [], 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x standardised; starts: the first passage of each bag."""
        p, n = self.p, np.diff(np.r_[starts, len(x)])
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(h * a[:, None], starts)
        return h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return self.forward((x - self.mean) / self.scale, starts)[-1]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return np.concatenate([self.score(x, own) for x, own in bags(texts)]) if texts else np.zeros(0)


def gradient(model: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the bags' labels y, and its gradient by parameter; x standardised."""
    p, n = model.p, np.diff(np.r_[starts, len(x)])
    h, t, g, a, z, s = model.forward(x, starts)
    ds = ((s - y) / len(y)).astype(x.dtype)
    far = np.repeat(ds[:, None] * p["c"], n, axis=0)
    dh = far * a[:, None]
    da = (far * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh += dt @ p["V"].T + dg @ p["U"].T
    dq = dh * (1 - h * h)
    loss = -float(np.mean(y * np.log(s + 1e-30) + (1 - y) * np.log(1 - s + 1e-30)))
    return loss, {"W": x.T @ dq, "b": dq.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


def train(x: np.ndarray, own: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """x, own: passages and their bags, in order; y: a 0/1 label for each bag."""
    rng = np.random.default_rng(seed)
    weight = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"W": weight(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": weight(HIDDEN, ATTENTION), "U": weight(HIDDEN, ATTENTION), "w": 0.1 * weight(ATTENTION), "c": weight(HIDDEN), "d": np.zeros(1, np.float32)}
    model = Model(x.mean(axis=0), x.std(axis=0) + 0.05, p)
    x = (x - model.mean) / model.scale
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, grad = gradient(model, x, starts, y)
        for k, w in p.items():
            d = grad[k] + (1e-4 * w if w.ndim == 2 else 0)
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.001 * (d * d - v[k])
            w -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(w.dtype)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, steps: int = STEPS) -> Model | None:
    """A model from labelled rows; labels: (id, label 0/1), null ids and labels aside.

    The sample is the first train_docs labelled ids by hash; of their texts, in that order, each
    that still fits into train_chars is taken and longer ones are passed over. Where none
    fits the shortest is taken. None only where no labelled document is there.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    kept = written(rows, "labelled").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # sizes alone are ordered: no task and not the driver holds the texts of the sample
    first = kept.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"), F.length("text").alias("size"), "file", "row").orderBy("h", "doc_id", "t", "file", "row").limit(train_docs).collect()
    if not first:
        return None
    fits, left = [], train_chars
    for r in first:
        if r["size"] <= left:
            fits.append(r)
            left -= r["size"]
    chosen = [(n, r.file, r.row) for n, r in enumerate(fits or [min(first, key=lambda r: r["size"])], 1)]
    place = F.broadcast(docs.sparkSession.createDataFrame(chosen, "n int, file string, row long"))
    rows = kept.join(place, ["file", "row"]).select("n", "label", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, own in bags(batch.column(2).to_pylist()):
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([r.tobytes() for r in x], pa.binary())], ["n", "label", "x"])

    got = rows.mapInArrow(run, "n int, label int, x binary").toArrow()
    n, y = got["n"].to_numpy(), got["label"].to_numpy()
    order = np.argsort(n, kind="stable")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(n), -1)[order]
    n, y = n[order], y[order]
    return train(x, n, y[np.flatnonzero(np.r_[True, n[1:] != n[:-1]])].astype(np.float32), steps)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row. Null and empty texts are bags of one empty passage. Without a
    model every score is 0.5. Repeated rows stay; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist()) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with a score of at least threshold; all of them without a model."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores([None if t is None else t.encode() for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
