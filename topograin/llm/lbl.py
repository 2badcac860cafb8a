"""Language-model scoring with a log-bilinear model.

The model predicts a token from the `context` tokens before it: each context token's vector,
weighed by a vector of its distance, adds up to a prediction, which meets the vectors of the
targets, plus a bias over their frequency. The output has two levels, classes of about equal
mass and the words of a class, each a softmax of about the square root of the
vocabulary, so that batched matrix products normalise every probability. The vocabulary is
the square root of the number of training tokens, up to `vocabulary` most frequent ones, and
grows with the corpus. All other tokens fall into `BUCKETS` classes by their last bytes, as
contexts and as targets; in its bucket a token has its discounted share of the counts
(absolute discounting; what is discounted goes to unseen tokens), so that known tokens and
one unseen type a bucket sum to one.

Training is noise-contrastive estimation in numpy: at either level a target is told from
noise that is drawn from the unigram distribution. Tasks train on their own texts, from one
start, and the average of their weights, by tokens, is the model; a first pass over a part of the
texts makes the start of the second, over all, in which every token of every text is a target once.

Plan. Passes over the texts, each a stream of batches. (1) Token counts, combined
per task in Python, then by a hash aggregate; tokens are 64-bit XXH64 values. (2) Training;
weights are averaged in a tree, so that the driver gets few. (3) Scoring: counts of the
most frequent `resident` tokens (a bound on rows, found from the histogram of counts) are
broadcast with the weights, which `vocabulary` bounds; the rest of each document, its rare tokens,
goes through a join by hash, and only sums return to the document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

VOCABULARY, DIMENSION, CONTEXT, NOISE, RESIDENT = 1 << 17, 16, 4, 16, 1 << 18
#: Part of the texts in the first pass, step size, targets of a step at least and per class.
PART, RATE, BATCH, PER_CLASS = 16, 0.2, 1024, 32
#: Targets of a step at most where those two ask for fewer, and steps that a task then takes at least.
LARGE, STEPS = 1 << 14, 1000
SEED = 42
END = b"\n"  # no word has it
#: Classes of tokens outside the vocabulary, by so many last bytes.
BUCKETS, SUFFIX = 256, 3
#: Words that a task keeps at most before it hands its counts on, tokens looked up at a time, tokens scored at a time.
HELD, BATCH_TOKENS, SCORED = 1 << 19, 1 << 17, 1 << 13
#: Tokens that a training task has at least where there are more tasks than cores; weights that one task averages.
TASK_TOKENS, AVERAGED = 1 << 26, 4


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def token_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, SEED)
    return h - (1 << 64) if h >> 63 else h


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % BUCKETS


class Lookup(dict):
    """Token to a local number; new tokens wait in `fresh`."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and buckets of the new tokens."""
        out = np.array([token_hash(w) for w in self.fresh], np.int64), np.array([bucket(w) for w in self.fresh], np.int64)
        self.fresh = []
        return out


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, b, c): hash, bucket and count, from a binary column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h = pa.array(np.array([token_hash(w) for w in held], np.int64))
            return pa.RecordBatch.from_arrays([h, pa.array([bucket(w) for w in held], pa.int32()), pa.array(np.fromiter(held.values(), np.int64, len(held)))], ["h", "b", "c"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "h long, b int, c long").groupBy("h").agg(F.min("b").alias("b"), F.sum("c").alias("c"))


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each h in the sorted keys, -1 where it is not."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def classes_of(mass: np.ndarray) -> np.ndarray:
    """A class for each output, most frequent first: about sqrt(n) classes of equal mass, none too large."""
    size, out = max(1, math.isqrt(len(mass))), np.empty(len(mass), np.int64)
    now = held = 0
    total = 0.0
    for w in np.argsort(-mass, kind="stable").tolist():
        out[w] = now
        held, total = held + 1, total + mass[w]
        if total >= 1 / size or held >= 2 * size:
            now, held, total = now + 1, 0, 0.0
    return np.unique(out, return_inverse=True)[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _order(x: np.ndarray, n: int) -> np.ndarray:
    """A stable order of numbers below n."""
    return np.argsort(x.astype(np.uint16 if n <= 1 << 16 else np.int32), kind="stable")


def _scatter(ids: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of g by id."""
    order = _order(ids, n)
    begin, out = _runs(ids[order]), np.zeros((n, g.shape[1]), np.float32)
    out[ids[order[begin]]] = np.add.reduceat(g[order], begin, axis=0)
    return out


class Net:
    """The log-bilinear model over outputs 0 .. n - 1: the buckets, then the vocabulary.

    p: R, vectors of context tokens; C, weights by distance; A and a, vectors and biases of classes;
    Q and b, those of outputs in their class. Biases are over the log frequency. end is the output that
    stands before a text."""

    def __init__(self, mass: np.ndarray, end: int, dimension: int = DIMENSION, context: int = CONTEXT, seed: int = 7):
        self.mass, self.end, self.context = mass, end, context
        self.classes = classes_of(mass)
        k, rng = int(self.classes.max()) + 1, np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.1, s)
        p = {"R": draw(len(mass), dimension), "C": np.full((context, dimension), 1 / context), "A": draw(k, dimension), "a": np.zeros(k), "Q": draw(len(mass), dimension), "b": np.zeros(len(mass))}
        self.p = {name: w.astype(np.float32) for name, w in p.items()}
        self.order = np.argsort(self.classes, kind="stable")
        self.starts = np.r_[0, np.cumsum(np.bincount(self.classes, minlength=k))]
        self.rank = np.argsort(self.order)
        self.place = np.empty(len(mass), np.int64)
        self.place[self.order] = np.arange(len(mass)) - self.starts[self.classes[self.order]]
        of_class = np.bincount(self.classes, weights=mass, minlength=k)
        self.by_class, self.inner = of_class, mass / of_class[self.classes]
        self.upto = np.cumsum(self.inner[self.order])  # one for each class before, and its own up to there
        self.log_class, self.log_inner = np.log(of_class).astype(np.float32), np.log(self.inner).astype(np.float32)

    def members(self, k: int) -> np.ndarray:
        return self.order[self.starts[k] : self.starts[k + 1]]

    def weights(self) -> bytes:
        return b"".join(w.tobytes() for w in self.p.values())

    def load(self, weights: np.ndarray) -> Net:
        at = 0
        for name, w in self.p.items():
            self.p[name] = weights[at : at + w.size].astype(np.float32).reshape(w.shape)
            at += w.size
        return self

    def gradient(self, before: np.ndarray, target: np.ndarray, rng: np.random.Generator, noise: int = NOISE) -> dict[str, np.ndarray]:
        """Gradient of the noise-contrastive loss of targets, summed; before: (targets, context) outputs."""
        p = self.p
        x = p["R"][before]
        h = np.einsum("bnd,nd->bd", x, p["C"])
        grad, gh = self._outputs_gradient(h, target, rng, noise)
        grad["C"] = np.einsum("bnd,bd->nd", x, gh)
        grad["R"] = _scatter(before.ravel(), (gh[:, None, :] * p["C"]).reshape(-1, h.shape[1]), len(p["b"]))
        return grad

    def line_gradient(self, line: np.ndarray, at: np.ndarray, rng: np.random.Generator, noise: int = NOISE) -> dict[str, np.ndarray]:
        """The same for the outputs at ascending places of a line, whose contexts stand before them.

        Each output between is looked up, and has its gradient added up, once for all targets that it stands before."""
        p, n, first = self.p, self.context, int(at[0])
        own = line[first - n : int(at[-1])]
        x, spots, span = p["R"][own], at - first, int(at[-1]) - first + 1
        h = sum(x[n - 1 - back : n - 1 - back + span] * p["C"][back] for back in range(n))[spots]
        grad, gh = self._outputs_gradient(h, line[at], rng, noise)
        wide = np.zeros((span, h.shape[1]), h.dtype)
        wide[spots] = gh
        gx, grad["C"] = np.zeros_like(x), np.empty_like(p["C"])
        for back in range(n):
            some = slice(n - 1 - back, n - 1 - back + span)
            gx[some] += wide * p["C"][back]
            grad["C"][back] = (x[some] * wide).sum(axis=0)
        grad["R"] = _scatter(own, gx, len(p["b"]))
        return grad

    def _outputs_gradient(self, h: np.ndarray, target: np.ndarray, rng: np.random.Generator, noise: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient by A, a, Q and b, and that by each target's prediction h."""
        p, n, m = self.p, len(self.p["b"]), len(self.p["a"])
        order = _order(self.rank[target], n)  # by class, and by target in it
        target, h = target[order], h[order]
        k = self.classes[target]
        begin, of_target = _runs(k), _runs(target)
        found, end = k[begin], np.r_[begin[1:], len(k)]
        log_noise = np.float32(math.log(noise))  # margins are over the noise's own log-probability
        drawn = np.searchsorted(np.cumsum(self.by_class)[:-1], rng.random(noise))
        hit = _sigmoid((h * p["A"][k]).sum(axis=1) + p["a"][k] - log_noise) - 1
        miss = _sigmoid(h @ p["A"][drawn].T + p["a"][drawn] - log_noise)
        gh = hit[:, None] * p["A"][k] + miss @ p["A"][drawn]
        grad = {"A": np.zeros((m, h.shape[1]), np.float32), "a": np.bincount(k, weights=hit, minlength=m).astype(np.float32)}
        grad["A"][found] = np.add.reduceat(hit[:, None] * h, begin, axis=0)
        np.add.at(grad["A"], drawn, miss.T @ h)
        np.add.at(grad["a"], drawn, miss.sum(axis=0))
        own = p["Q"][target]
        hit = _sigmoid((h * own).sum(axis=1) + p["b"][target] - log_noise) - 1
        gh += hit[:, None] * own
        grad |= {"Q": np.zeros((n, h.shape[1]), np.float32), "b": np.bincount(target, weights=hit, minlength=n).astype(np.float32)}
        grad["Q"][target[of_target]] = np.add.reduceat(hit[:, None] * h, of_target, axis=0)
        # the targets of a class meet noise of their class
        drawn = np.searchsorted(self.upto, found[:, None] + rng.random((len(found), noise)))
        drawn = self.order[np.clip(drawn, self.starts[found, None], self.starts[found + 1, None] - 1)]
        vectors = p["Q"][drawn]
        miss = np.empty((len(k), noise), h.dtype)
        for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
            np.matmul(h[x:y], vectors[i].T, out=miss[x:y])
        miss = _sigmoid(miss + np.repeat(p["b"][drawn] - log_noise, end - begin, axis=0))
        by_noise = np.empty_like(vectors)
        for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
            gh[x:y] += miss[x:y] @ vectors[i]
            np.matmul(miss[x:y].T, h[x:y], out=by_noise[i])
        np.add.at(grad["Q"], drawn.ravel(), by_noise.reshape(-1, h.shape[1]))
        grad["b"] += np.bincount(drawn.ravel(), weights=np.add.reduceat(miss, begin, axis=0).ravel(), minlength=n).astype(np.float32)
        out = np.empty_like(gh)
        out[order] = gh
        return grad, out

    def log10(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P of the outputs at those places of a line, whose contexts stand before them."""
        p = self.p
        near = [p["R"] * c for c in p["C"]]
        by_class, by_output = p["a"] + self.log_class, p["b"] + self.log_inner
        target = line[at]
        k = self.classes[target]
        h, out = np.empty((len(at), p["R"].shape[1]), np.float32), np.empty(len(at))
        for i in range(0, len(at), SCORED):
            some = slice(i, i + SCORED)
            x = near[0][line[at[some] - 1]]
            for back in range(1, self.context):
                x += near[back][line[at[some] - 1 - back]]
            h[some] = x
            s = x @ p["A"].T
            s += by_class
            own = s[np.arange(len(x)), k[some]].astype(np.float64)
            out[some] = own - np.log(np.exp(s, out=s).sum(axis=1))
        order = np.argsort(k, kind="stable")
        bounds = np.searchsorted(k[order], np.arange(len(p["a"]) + 1))
        for q in np.flatnonzero(np.diff(bounds)).tolist():
            own = self.members(q)
            if len(own) == 1:
                continue
            vectors, bias = p["Q"][own].T, by_output[own]
            for i in range(bounds[q], bounds[q + 1], SCORED):
                rows = order[i : min(i + SCORED, bounds[q + 1])]
                s = h[rows] @ vectors
                s += bias
                mine = s[np.arange(len(rows)), self.place[target[rows]]].astype(np.float64)
                out[rows] += mine - np.log(np.exp(s, out=s).sum(axis=1))
        return out / math.log(10)


class Trainer:
    """Adaptive gradient steps over a stream of outputs; a step has targets enough for each class's noise, or `batch`."""

    def __init__(self, net: Net, seed: int, rate: float = RATE, batch: int = 0):
        self.net, self.rng, self.rate = net, np.random.default_rng([SEED, seed]), rate
        self.batch = max(BATCH, PER_CLASS * len(net.p["a"]), batch)
        self.squares = {k: np.full_like(w, 1e-8) for k, w in net.p.items()}

    def take(self, line: np.ndarray, at: np.ndarray) -> None:
        """Steps over the outputs at those ascending places, each a target."""
        for i in range(0, len(at), self.batch):
            some = at[i : i + self.batch]
            for k, g in self.net.line_gradient(line, some, self.rng).items():
                g /= max(len(some), self.batch / 4)
                self.squares[k] += g * g
                self.net.p[k] -= self.rate * g / np.sqrt(self.squares[k])


def lines(texts: list[np.ndarray], end: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """A line of the texts' outputs, `context` ends before each, and the places of the outputs."""
    pad = np.full(context, end, np.int64)
    sizes = np.array([len(x) for x in texts], np.int64)
    line = np.concatenate([x for t in texts for x in (pad, t)] or [pad])
    begin = np.cumsum(sizes + context) - sizes
    return line, np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Model:
    """keys: sorted hashes of resident tokens, with their counts and outputs (0 .. BUCKETS - 1 are
    buckets); others, kinds: tokens and distinct tokens of each bucket."""

    keys: np.ndarray
    counts: np.ndarray
    outputs: np.ndarray
    net: Net
    total: int
    distinct: int
    others: np.ndarray
    kinds: np.ndarray
    discount: float

    def find(self, h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the resident tokens (-1: none) and output of tokens with those hashes and buckets."""
        at = _find(self.keys, h)
        return at, np.where(at >= 0, self.outputs[at], b) if len(self.keys) else b

    def shares(self) -> np.ndarray:
        """log10 share of a bucket that its unseen tokens have."""
        return np.log10(np.where(self.others > 0, self.discount * self.kinds / np.maximum(self.others, 1), 1.0))


def _trained(texts: DataFrame, model: Model, seed: int, tasks: int) -> np.ndarray:
    """Weights after a pass over the texts, averaged over the tasks by their tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    batch_size = min(LARGE, model.total // tasks // STEPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lookup, of, seen = shared.value, Lookup(), np.zeros(0, np.int64), 0
        net = Net.__new__(Net)
        net.__dict__ |= model.net.__dict__ | {"p": {k: w.copy() for k, w in model.net.p.items()}}
        trainer = Trainer(net, seed * 1_000_003 + TaskContext.get().partitionId(), batch=batch_size)
        held: list[list[bytes]] = []

        def learn() -> None:
            nonlocal lookup, of
            words = [w for t in held for w in t]
            n = lookup.numbers(words)
            of = np.r_[of, model.find(*lookup.hashes())[1]]
            trainer.take(*lines(np.split(of[n], np.cumsum([len(t) for t in held])[:-1]), net.end, net.context))
            if len(lookup) > HELD:
                lookup, of = Lookup(), np.zeros(0, np.int64)

        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(tokens(text.as_py()))
                size += len(held[-1])
                if size >= BATCH_TOKENS // 2:
                    learn()
                    seen, held, size = seen + size, [], 0
        if held:
            learn()
            seen += size
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([net.weights()], pa.binary())], ["tokens", "weights"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(0)[i].as_py()
                total += n
                sums = sums + n * np.frombuffer(batch.column(1)[i].as_py(), np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])

    schema = "tokens double, weights binary"
    made = written(texts.select("text").coalesce(tasks).mapInArrow(run, schema), "weights")
    while (n := made.count()) > AVERAGED:
        made = written(made.repartition(-(-n // AVERAGED)).mapInArrow(mean, schema), "weights")
    rows = made.collect()
    if not rows:
        return np.frombuffer(model.net.weights(), np.float32)
    return sum(r.tokens * np.frombuffer(r.weights, np.float32).astype(np.float64) for r in rows) / sum(r.tokens for r in rows)


def fit(texts: DataFrame, vocabulary: int = VOCABULARY, dimension: int = DIMENSION, context: int = CONTEXT, resident: int = RESIDENT) -> tuple[Model, DataFrame]:
    """The model, and its table (h, b, c) of all token counts, from a binary column text.

    Weights depend on how the texts are dealt over tasks, counts do not."""
    counts = written(token_counts(texts), "tokens")
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    top = counts.orderBy(F.col("c").desc(), "h").limit(min(vocabulary, math.isqrt(stats.n))).toArrow()
    h, b, c = (top[k].to_numpy() for k in ("h", "b", "c"))
    level = _level(counts, resident)
    held = counts.where(F.col("c") >= level).toArrow()
    # the vocabulary is resident always
    keys, at = np.unique(np.r_[h, held["h"].to_numpy()], return_index=True)
    outputs = np.r_[BUCKETS + np.arange(len(h)), held["b"].to_numpy()][at]
    got = counts.groupBy("b").agg(F.sum("c").alias("c"), F.count("*").alias("k")).toArrow()
    others, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    others[got["b"].to_numpy()], kinds[got["b"].to_numpy()] = got["c"].to_numpy(), got["k"].to_numpy()
    others, kinds = others - np.bincount(b, weights=c, minlength=BUCKETS).astype(np.int64), kinds - np.bincount(b, minlength=BUCKETS)
    n1, n2 = stats.n1 or 0, stats.n2 or 0
    discount = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    mass = np.r_[others, c] + 0.5
    own = np.flatnonzero(h == token_hash(END))
    net = Net(mass / mass.sum(), BUCKETS + int(own[0]) if len(own) else bucket(END), dimension, context)
    model = Model(keys, np.r_[c, held["c"].to_numpy()][at], outputs, net, int(stats.n), int(stats.v), others, kinds, discount)
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-model.total // TASK_TOKENS))
    net.load(_trained(texts.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), model, 1, tasks))
    net.load(_trained(texts, model, 2, tasks))
    return model, counts


def _level(counts: DataFrame, rows: int) -> int:
    """The least count that at most `rows` tokens reach."""
    top = 1 << 20  # counts are told apart up to here
    found = counts.groupBy(F.least("c", F.lit(top)).alias("c")).agg(F.count("*").alias("n")).where(F.col("c") < top).collect()
    above = counts.where(F.col("c") >= top).count()
    level = top
    while above > rows:  # only where so many are that frequent
        level *= 2
        above = counts.where(F.col("c") >= level).count()
    for r in sorted(found, key=lambda r: -r.c) if level == top else []:
        if (above := above + r.n) > rows:
            break
        level = r.c
    return level


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_tokens, n_known, base_score, score) per row.

    A null text is an empty one, which has its end only. Repeated rows stay; other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "text_hash", "h", "b", "n", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        floor = np.log10(model.total + model.distinct + 1)
        net, others = model.net, np.maximum(model.others, 1)
        lookup = Lookup()
        h = b = own = np.zeros(0, np.int64)
        base = inner = np.zeros(0)
        rare = np.zeros(0, bool)

        def learn() -> None:
            nonlocal h, b, own, base, inner, rare
            new, last = lookup.hashes()
            at, out = model.find(new, last)
            c = np.where(at >= 0, model.counts[at], 0) if len(model.keys) else np.zeros(len(new))
            h, b, own, rare = np.r_[h, new], np.r_[b, last], np.r_[own, out], np.r_[rare, at < 0]
            base = np.r_[base, np.where(at >= 0, np.log10(c + 1.0), 0)]
            inner = np.r_[inner, np.where((at >= 0) & (out < BUCKETS), np.log10(np.maximum(c - model.discount, 1e-9) / others[np.minimum(out, BUCKETS - 1)]), 0)]

        def flush(some: list) -> Iterator[pa.RecordBatch]:
            nonlocal lookup, h, b, own, base, inner, rare
            sizes = [len(w) for _, _, w in some]
            of = np.repeat(np.arange(len(some)), sizes)
            n = lookup.numbers([x for _, _, w in some for x in w])
            learn()
            line, at = lines(np.split(own[n], np.cumsum(sizes)[:-1]), net.end, net.context)
            total = lambda x: np.bincount(of, weights=x, minlength=len(some))
            count = np.bincount(of, minlength=len(some))
            known = total(~rare[n])
            log_base = total(base[n]) - count * floor
            log_p = total(net.log10(line, at) + inner[n])
            ids, hashes = [d for d, _, _ in some], [t for _, t, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int32()), pa.array(count), pa.array(known.astype(np.int64)), pa.array(log_base), pa.array(log_p)], names)
            lone = rare[n]
            if lone.any():
                pair = of[lone] * len(h) + n[lone]
                pair, times = np.unique(pair, return_counts=True)
                of_pair = pair // len(h)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(of_pair)), pa.array(hashes, pa.int64()).take(pa.array(of_pair)), pa.array(h[pair % len(h)]), pa.array(b[pair % len(h)].astype(np.int32)), pa.array(times), *[pa.nulls(len(pair), t) for t in (pa.int64(), pa.float64(), pa.float64())]], names)
            if len(lookup) > HELD:
                lookup = Lookup()
                h = b = own = np.zeros(0, np.int64)
                base = inner = np.zeros(0)
                rare = np.zeros(0, bool)

        some, size = [], 0
        for batch in batches:
            for d, t, text in zip(*(batch.column(i) for i in range(3))):
                some.append((d.as_py(), t.as_py(), tokens(text.as_py())))
                size += len(some[-1][2])
                if size >= BATCH_TOKENS:
                    yield from flush(some)
                    some, size = [], 0
        if some:
            yield from flush(some)

    found = written(rows.mapInArrow(run, "doc_id long, text_hash long, h long, b int, n long, n_known long, base_score double, score double"), "scored")
    whole, rare = found.where("h is null").drop("h", "b"), found.where("h is not null")
    buckets = docs.sparkSession.createDataFrame([(i, float(max(1, n)), float(x)) for i, (n, x) in enumerate(zip(model.others, model.shares()))], "b int, others double, unseen double")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    share = F.when(c > 0, F.log10(F.greatest(c - F.lit(model.discount), F.lit(1e-9)) / F.col("others"))).otherwise(F.col("unseen"))
    joined = rare.join(counts.select("h", "c"), "h", "left").join(F.broadcast(buckets), "b")
    # repeated rows repeat their rare tokens: the sums are shared among them
    sums = joined.groupBy("doc_id", "text_hash").agg(F.sum(F.when(c > 0, n).otherwise(0)).alias("k"), F.sum(n * F.log10((c + 1).cast("double"))).alias("b"), F.sum(n * share).alias("s"))
    times = whole.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    sums = sums.join(times, sums["doc_id"].eqNullSafe(times["doc_id"]) & (sums["text_hash"] == times["text_hash"])).select(sums["doc_id"].alias("r_id"), sums["text_hash"].alias("r_hash"), *[(F.coalesce(F.col(x), F.lit(0)) / F.col("rows")).alias(x) for x in "kbs"])
    out = whole.join(sums, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0.0))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_tokens"), F.round(plus("n_known", "k")).cast("long").alias("n_known"), plus("base_score", "b").alias("base_score"), plus("score", "s").alias("score"))
