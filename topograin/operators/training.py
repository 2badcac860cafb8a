"""Training of the collective model's final network, its persistence, and its use as a linker.

Beliefs come from executors; what is learnt is how belief and prior make a score, on a bounded
sample of labelled mentions. Attention and relations are given with the weights.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, fields, replace

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import context_words, is_important
from ..sources.annotated import embeddings_of
from . import disambiguation as D
from .linking import prior_scores

#: Labelled mentions that training reads at most, epochs, epochs from one look at the dev set to the next, looks
#: without a gain that end it, and the F1 from which steps are a tenth.
TRAIN_MENTIONS, EPOCHS, LOOK, PATIENCE, SLOW_FROM = 50_000, 1000, 5, 10, 0.915


def labelled(items: DataFrame, gold: DataFrame, weights: D.Weights, mentions: int = TRAIN_MENTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x (n, c, 2), mask (n, c), place of the gold candidate (n) and dev marks (n) of labelled mentions.

    gold: (doc_id, mention_no, gold, split), split train or dev. Mentions whose gold entity is no candidate
    teach nothing and are left out; of more than `mentions` those that come first by hash are taken."""
    key = ["doc_id", "mention_no"]
    known = items.join(gold, key).where("qid = gold and split in ('train', 'dev')").select(*key, "gold", "split").distinct()
    some = known.orderBy(F.xxhash64(*key), *key).limit(mentions)
    docs = items.join(some.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = D.features(docs, weights).join(F.broadcast(some), key)
    got = rows.groupBy(*key, "split").agg(F.sort_array(F.collect_list(F.struct("rank", "belief", "log_prior", (F.col("qid") == F.col("gold")).alias("right")))).alias("c")).orderBy(*key).collect()
    got = [r for r in got if any(c.right for c in r.c)]
    x, mask = np.zeros((len(got), weights.config.candidates, 2)), np.zeros((len(got), weights.config.candidates), bool)
    for i, r in enumerate(got):
        for j, c in enumerate(r.c):
            x[i, j], mask[i, j] = (c.belief, c.log_prior), True
    return x, mask, np.array([next(j for j, c in enumerate(r.c) if c.right) for r in got], int), np.array([r.split == "dev" for r in got], bool)


def margin_loss(x: np.ndarray, mask: np.ndarray, gold: np.ndarray, w: D.Weights) -> tuple[float, dict[str, np.ndarray]]:
    """Mean multi-class margin loss, and its gradient by w1, b1, w2 and b2."""
    rows, hidden = np.arange(len(x)), np.maximum(x @ w.w1 + w.b1, 0)
    score = x[..., 0] + hidden @ w.w2 + w.b2
    over = w.config.margin - score[rows, gold][:, None] + score
    over[rows, gold] = 0
    over = np.where(mask, np.maximum(over, 0), 0)
    scale = 1 / (mask.sum(axis=1) * max(1, len(x)))
    g = (over > 0) * scale[:, None]
    g[rows, gold] = -g.sum(axis=1)
    back = g[..., None] * w.w2 * (hidden > 0)
    return float((over * scale[:, None]).sum()), {"w1": np.einsum("nci,nch->ih", x, back), "b1": back.sum(axis=(0, 1)), "w2": np.einsum("nc,nch->h", g, hidden), "b2": np.array(g.sum())}


def accuracy(x: np.ndarray, mask: np.ndarray, gold: np.ndarray, w: D.Weights) -> float:
    """Share of mentions whose best candidate is the gold one: micro F1, as each has one answer."""
    return float((np.where(mask, D.combined(x, w), -np.inf).argmax(axis=1) == gold).mean()) if len(x) else 0.0


def train(x: np.ndarray, mask: np.ndarray, gold: np.ndarray, dev: np.ndarray, weights: D.Weights, epochs: int = EPOCHS, rate: float | None = None) -> tuple[D.Weights, float]:
    """Weights that did best on the dev mentions, and their F1 there; Adam on the train mentions, with
    steps cut to a tenth from SLOW_FROM on. Without train or dev mentions the weights stay."""
    best, top, waited = weights, accuracy(x[dev], mask[dev], gold[dev], weights), 0
    if not dev.any() or dev.all():
        return best, top
    p = {k: np.array(getattr(weights, k), float) for k in ("w1", "b1", "w2", "b2")}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    rate = weights.config.learning_rate if rate is None else rate
    for epoch in range(1, epochs + 1):
        now = replace(weights, **p)
        _, grad = margin_loss(x[~dev], mask[~dev], gold[~dev], now)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
        if epoch % LOOK == 0:
            now = replace(weights, **p)
            f1 = accuracy(x[dev], mask[dev], gold[dev], now)
            waited = 0 if f1 > top else waited + 1
            if f1 > top:
                best, top = now, f1
            if f1 >= SLOW_FROM:
                rate = min(rate, weights.config.learning_rate / 10)
            if waited >= PATIENCE:
                break
    return best, top


def save_weights(spark: SparkSession, weights: D.Weights, path: str) -> None:
    """Weights as a small Parquet table (name, shape, data), where any executor can read them."""
    rows = [(f.name, list(np.shape(a)), np.asarray(a, "<f8").tobytes()) for f in fields(weights) if f.name != "config" for a in (getattr(weights, f.name),)]
    rows.append(("config", [], json.dumps(asdict(weights.config)).encode()))
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> D.Weights:
    rows = {r.name: r for r in spark.read.parquet(path).collect()}
    config = D.Config(**json.loads(bytes(rows.pop("config").data)))
    arrays = {k: np.frombuffer(bytes(r.data), "<f8").reshape(r["shape"]) for k, r in rows.items()}
    return D.Weights(**arrays | {"b2": float(arrays["b2"])}, config=config)


def load_or_train(spark: SparkSession, path: str, items: Callable[[], DataFrame], gold: Callable[[], DataFrame], weights: D.Weights, overwrite: bool = False, **params) -> D.Weights:
    """The weights under path, or, where there are none or overwrite is set, trained ones, saved there."""
    if not overwrite:
        try:
            return load_weights(spark, path)
        except AnalysisException:
            pass
    x, mask, place, dev = labelled(items(), gold(), weights)
    made, _ = train(x, mask, place, dev, weights, **params)
    save_weights(spark, made, path)
    return made


def model_items(found: DataFrame, candidates: DataFrame, store: DataFrame, config: D.Config) -> DataFrame:
    """Rows for disambiguate from mentions (doc_id, sent_idx, mention, pos, sentence, prev, next), candidates (mention,
    variation, score, qid, relv, n) and an embedding store (word, emb). mention_no numbers the mentions by sentence and position."""
    from pyspark.sql import Window

    numbered = found.withColumn("mention_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "pos")).cast("long") - 1)
    spoken = numbered.select("doc_id", "mention_no", F.posexplode(F.filter(context_words(F.concat_ws(" ", "prev", "sentence", "next")), lambda x: is_important(x))).alias("at", "word")).where(F.col("at") < config.context_window)
    vectors = embeddings_of(spoken, store, "word").where("emb is not null")
    words = vectors.groupBy("doc_id", "mention_no").agg(F.sort_array(F.collect_list(F.struct("at", "emb"))).alias("v")).select("doc_id", "mention_no", F.col("v.emb").alias("words"))
    # an entity under several names counts once
    rated = candidates.where("qid is not null").groupBy("mention", "qid").agg(F.max(F.coalesce("n", F.lit(0))).alias("n"), F.max("relv").alias("relv"), F.max(F.coalesce("score", F.lit(0.0))).alias("sel"))
    ranked = prior_scores(rated.withColumn("n", F.greatest("n", F.lit(1)))).where(F.col("rank") <= config.candidates)
    entities = embeddings_of(ranked.withColumn("word", F.col("qid")), store, "entity").drop("word")
    rows = numbered.select("doc_id", "sent_idx", "mention", "pos", "mention_no").join(entities, "mention")
    return rows.join(words, ["doc_id", "mention_no"], "left").select("doc_id", "sent_idx", "mention", "pos", "mention_no", "rank", "qid", "prior", "emb", "words")


def reldisamb(weights: D.Weights, store: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The linking method of that name: (doc_id, sent_idx, pos, mention, prediction, ed_score) from mentions
    and candidates. ed_score is the winner's share among the mention's candidates."""

    def link(found: DataFrame, candidates: DataFrame) -> DataFrame:
        items = model_items(found, candidates, store, weights.config)
        scored = D.disambiguate(items.select("doc_id", "mention_no", "rank", "qid", "prior", "emb", "words"), weights)
        power = F.exp("score")
        best = scored.groupBy("doc_id", "mention_no").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "qid")).alias("b"), F.sum(power).alias("total"))
        places = items.select("doc_id", "mention_no", "sent_idx", "pos", "mention").distinct()
        return places.join(best, ["doc_id", "mention_no"]).select("doc_id", "sent_idx", "pos", "mention", F.col("b.qid").alias("prediction"), (F.exp("b.score") / F.col("total")).alias("ed_score"))

    link.__name__ = "reldisamb"
    return link
