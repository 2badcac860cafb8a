"""Collective entity disambiguation: local attention, relations between mentions, belief propagation.

One group is a batch of at most `batch` mentions of a document, so a task's memory is bounded
whatever the document. Weights are a few arrays in the closure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = "#UNK#"


@dataclass
class Config:
    """Sizes and constants of the model."""

    dim: int = 300
    relations: int = 3
    hidden: int = 100
    top_words: int = 25
    candidates: int = 7
    loops: int = 10
    damping: float = 0.3
    batch: int = 100
    context_window: int = 100
    before_rank: int = 30
    min_prior: float = 1e-3
    pad_prior: float = 1e-8
    margin: float = 0.01
    learning_rate: float = 1e-4


@dataclass
class Weights:
    attention: np.ndarray
    local: np.ndarray
    relation: np.ndarray
    link: np.ndarray
    mention: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    config: Config = field(default_factory=Config)

    @classmethod
    def seeded(cls, config: Config, seed: int = 1) -> Weights:
        rng = np.random.default_rng(seed)
        d, k = config.dim, config.relations
        near = lambda *s: 1 + 0.1 * rng.normal(size=s)
        return cls(near(d), near(d), near(k, d), near(k, d), rng.normal(size=(2 * d, d)) / np.sqrt(2 * d), 0.1 * rng.normal(size=(2, config.hidden)), np.zeros(config.hidden), 0.1 * rng.normal(size=config.hidden), 0.0, config)


def _softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def log_softmax(x: np.ndarray) -> np.ndarray:
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def local_scores(entities: np.ndarray, mask: np.ndarray, words: np.ndarray, w: Weights) -> np.ndarray:
    """Scores of candidates (c, d) by the context words (n, d) that speak for any of them most."""
    if not len(words):
        return np.where(mask, 0.0, -1e10)
    support = (entities * w.attention) @ words.T
    support[~mask] = -1e10
    best = support.max(axis=0)
    top = np.argsort(-best, kind="stable")[: w.config.top_words]
    context = _softmax(best[top]) @ words[top]
    return np.where(mask, (entities * w.local) @ context, -1e10)


def relation_weights(contexts: np.ndarray, w: Weights) -> np.ndarray:
    """(k, n, n): how much mention i heeds mention j in relation k, over j adding up to 1."""
    m = np.tanh(contexts @ w.mention)
    n = len(m)
    raw = np.einsum("id,kd,jd->kij", m, w.relation, m) / np.sqrt(m.shape[1])
    raw[:, np.arange(n), np.arange(n)] = -1e10
    return _softmax(raw) * (1 - np.eye(n)) if n > 1 else np.zeros_like(raw)


def propagate(local: np.ndarray, entities: np.ndarray, mask: np.ndarray, heed: np.ndarray, w: Weights) -> np.ndarray:
    """Max-product belief propagation over all pairs: (n, c) beliefs as probabilities."""
    n, c = local.shape
    if n == 1:
        return _softmax(local)
    pair = np.einsum("kij,iad,kd,jbd->ijab", heed, entities, w.link, entities)
    pair = pair + pair.transpose(1, 0, 3, 2)
    messages = np.zeros((n, n, c))  # from j to i, over i's candidates
    other = ~np.eye(n, dtype=bool)
    for _ in range(w.config.loops):
        inbox = (messages * other[..., None]).sum(axis=1)
        out = (local + inbox)[None, :, :] - messages.transpose(1, 0, 2)  # [i, j]: j's belief without i's word
        fresh = (pair + out[:, :, None, :]).max(axis=3)
        fresh = np.where(mask[:, None, :], fresh, -1e10)
        fresh = np.log(np.maximum(w.config.damping * _softmax(fresh) + (1 - w.config.damping) * np.exp(messages), 1e-30))
        messages = fresh * other[..., None]
    total = local + (messages * other[..., None]).sum(axis=1)
    return _softmax(np.where(mask, total, -1e10))


def beliefs(entities: np.ndarray, mask: np.ndarray, words: list[np.ndarray], w: Weights) -> np.ndarray:
    """Beliefs (n, c) of a batch of mentions by context and each other."""
    d = entities.shape[2]
    local = np.stack([local_scores(e, m, x, w) for e, m, x in zip(entities, mask, words)])
    mean = np.stack([np.r_[x.mean(axis=0), x[-3:].mean(axis=0)] if len(x) else np.zeros(2 * d) for x in words])
    return propagate(local, entities, mask, relation_weights(mean, w), w)


def combined(x: np.ndarray, w: Weights) -> np.ndarray:
    """Scores from (..., 2) beliefs and log priors: the belief, corrected by the network."""
    return x[..., 0] + np.maximum(x @ w.w1 + w.b1, 0) @ w.w2 + w.b2


def features_of(belief: np.ndarray, prior: np.ndarray, w: Weights) -> np.ndarray:
    return np.stack([belief, np.log(np.maximum(prior, w.config.pad_prior))], axis=-1)


def score_batch(entities: np.ndarray, mask: np.ndarray, prior: np.ndarray, words: list[np.ndarray], w: Weights) -> np.ndarray:
    """Final scores (n, c) of a batch of mentions."""
    return np.where(mask, combined(features_of(beliefs(entities, mask, words, w), prior, w), w), -1e10)


def _by_batch(items: DataFrame, config: Config, columns: str, use: Callable) -> DataFrame:
    """(doc_id, mention_no, qid, columns, rank), columns being what use(entities, mask, prior, words)
    gives for the candidates (n, c, columns) of a batch of a document's consecutive mentions."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [(no, g.sort_values("rank").head(config.candidates)) for no, g in pdf.groupby("mention_no", sort=True)]
        n, c, d = len(groups), config.candidates, config.dim
        entities, mask, prior = np.zeros((n, c, d)), np.zeros((n, c), bool), np.full((n, c), config.pad_prior)
        words = []
        for i, (_, g) in enumerate(groups):
            for j, r in enumerate(g.itertuples()):
                entities[i, j] = 0 if r.emb is None else np.asarray(r.emb, float)
                mask[i, j], prior[i, j] = True, min(1.0, max(config.min_prior, r.prior))
            first = g.iloc[0].words
            words.append(np.array([np.asarray(x, float) for x in first]) if first is not None and len(first) else np.zeros((0, d)))
        out = use(entities, mask, prior, words)
        rows = [(key[0], no, r.qid, *map(float, out[i, j]), j + 1) for i, (no, g) in enumerate(groups) for j, r in enumerate(g.itertuples())]
        return pd.DataFrame(rows, columns=["doc_id", "mention_no", "qid", *(x.split()[0] for x in columns.split(", ")), "rank"])

    batch = F.floor(F.col("mention_no") / config.batch).alias("batch")
    return items.groupBy("doc_id", batch).applyInPandas(run, f"doc_id {dict(items.dtypes)['doc_id']}, mention_no long, qid string, {columns}, rank int")


def disambiguate(items: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, mention_no, qid, score, rank) from rows (doc_id, mention_no, rank, qid, prior, emb, words): a row a
    candidate, words the mention's context vectors (array of arrays; only the first candidate's count).

    Missing candidates are padding and are not returned. A document's mentions are scored together in
    batches of consecutive ones. A null vector is a zero vector.
    """
    return _by_batch(items, weights.config, "score double", lambda *x: score_batch(*x, weights)[..., None])


def features(items: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, mention_no, qid, belief, log_prior, rank): what the final network of disambiguate reads."""
    return _by_batch(items, weights.config, "belief double, log_prior double", lambda entities, mask, prior, words: features_of(beliefs(entities, mask, words, weights), prior, weights))


def align_labels(word_ids: list[int | None], labels: list[str], ids: dict[str, int]) -> list[int]:
    """Label ids of word pieces: -100 for special ones, 0 for a literal "0", else the word's."""
    return [-100 if w is None else 0 if labels[w] == "0" else ids[labels[w]] for w in word_ids]


def pad(rows: list[list], fill: object = 0, left: bool = False) -> tuple[list[list], list[list[int]]]:
    """Rows of one length, and masks of what is theirs."""
    n = max(map(len, rows), default=0)
    gap = [n - len(r) for r in rows]
    put = (lambda r, p: p + r) if left else (lambda r, p: r + p)
    return [put(list(r), [fill] * g) for r, g in zip(rows, gap)], [put([1] * len(r), [0] * g) for r, g in zip(rows, gap)]


def flatten(rows: list[list]) -> tuple[list, list[int]]:
    """All items, and where each row begins."""
    out, starts = [], []
    for r in rows:
        starts.append(len(out))
        out += r
    return out, starts


class Vocabulary:
    """Words and their ids; unknown ones have id 0."""

    BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}

    def __init__(self, words: Iterator[str] = (), lower: bool = False, zero_digits: bool = False):
        self.lower, self.zero_digits, self.ids = lower, zero_digits, {PAD: 0}
        for word in words:
            self.add(word)

    def normal(self, word: str) -> str:
        word = self.BRACKETS.get(word, word)
        word = "".join("0" if c.isdigit() else c for c in word) if self.zero_digits else word
        return word.lower() if self.lower else word

    def add(self, word: str) -> int:
        return self.ids.setdefault(self.normal(word), len(self.ids))

    def id(self, word: str) -> int:
        return self.ids.get(self.normal(word), 0)

    def __len__(self) -> int:
        return len(self.ids)


def confidence_model(scored: DataFrame, feature: str = "score", label: str = "correct"):  # noqa: ANN201 - a pyspark.ml model
    """Logistic regression of being right on the normalised winning score (L2, C = 1); None
    without both outcomes. The same normalised score is what it is applied to."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = scored.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).select(F.col(feature), F.col(label).cast("double").alias("label"))
    n, kinds = rows.agg(F.count("*"), F.countDistinct("label")).first()
    if kinds < 2:
        return None
    x = VectorAssembler(inputCols=[feature], outputCol="features").transform(rows)
    return LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=100, tol=1e-10).fit(x)


def confidence(scored: DataFrame, model, feature: str = "score") -> DataFrame:  # noqa: ANN001
    """scored with conf: the probability of being right; 0 without a model."""
    if model is None:
        return scored.withColumn("conf", F.lit(0.0))
    z = F.lit(float(model.coefficients[0])) * F.col(feature) + F.lit(float(model.intercept))
    return scored.withColumn("conf", 1 / (1 + F.exp(-z)))
