"""From candidates to one entity a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import haversine

FAR_KM, TOP = 1000.0, 7
DEFAULT_PLACE, DEFAULT_QID = "United Kingdom", "Q145"
PUBLISHED = "This article is published in "


def most_popular(candidates: DataFrame, key: str = "mention") -> DataFrame:
    """(key, prediction, ed_score): the entity of the most frequent (variation, entity) and its share
    of all; NIL and 0 for keys without entities. candidates: key, variation, qid, n.

    Ties go to the first variation, then entity.
    """
    has = F.col("qid").isNotNull() & (F.col("n") > 0)
    best = F.min(F.when(has, F.struct((-F.col("n")).alias("m"), "variation", "qid"))).alias("b")
    out = candidates.groupBy(key).agg(best, F.sum(F.when(has, F.col("n"))).alias("total"))
    return out.select(key, F.coalesce("b.qid", F.lit("NIL")).alias("prediction"), F.coalesce(F.try_divide(-F.col("b.m"), F.col("total")), F.lit(0.0)).alias("ed_score"))


def popularity(candidates: DataFrame, key: str = "mention") -> DataFrame:
    """(key, qid, score): the share of each entity; under several variations the last counts, in
    the sum all do."""
    total = candidates.groupBy(key).agg(F.sum("n").alias("total"))
    last = candidates.where("qid is not null").groupBy(key, "qid").agg(F.max_by("n", "variation").alias("n"))
    return last.join(total, key).select(key, "qid", F.try_divide("n", "total").alias("score"))


def by_distance(candidates: DataFrame, gazetteer: DataFrame, origins: DataFrame, key: str = "mention") -> DataFrame:
    """(key, prediction, ed_score, km): the nearest entity within 1000 km of the key's origin.

    candidates: key, variation, score, qid, relv; origins: key, origin_qid. The score is the mean
    of nearness and of the mean of string and entity score, to three digits. Entities or
    origins without valid coordinates are not eligible.
    """
    at = gazetteer.select("qid", "lat", "lon")
    home = origins.join(at.select(F.col("qid").alias("origin_qid"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "origin_qid", "left").select(key, "lat0", "lon0")
    placed = candidates.join(at, "qid", "left").join(home, key, "left")
    placed = placed.withColumn("km", haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    near = F.col("km") < FAR_KM
    best = placed.groupBy(key).agg(F.min(F.when(near, F.struct(F.round("km", 9).alias("k"), "qid", "variation", "score", "relv", "km"))).alias("b"))
    share = F.when(F.col("b.km") == 0, 1.0).otherwise(1 - F.col("b.km") / FAR_KM)
    score = F.round(((F.col("b.score") + F.col("b.relv")) / 2 + share) / 2, 3)
    return best.select(key, F.coalesce("b.qid", F.lit("NIL")).alias("prediction"), F.coalesce(score, F.lit(0.0)).alias("ed_score"), F.col("b.km").alias("km"))


def prior_scores(candidates: DataFrame, key: str = "mention") -> DataFrame:
    """(key, qid, prior, rank) from (key, qid, n, relv, sel): counts against the key's greatest,
    with the mean of relevance and string score (the relevance alone where sel is 0)."""
    most = candidates.groupBy(key).agg(F.max("n").alias("most"))
    similar = F.when(F.col("sel") != 0, (F.col("relv") + F.col("sel")) / 2).otherwise(F.col("relv"))
    scored = candidates.join(most, key).withColumn("prior", F.round(((F.col("n") / F.col("most") + similar) / 2) * 0.9, 3))
    order = Window.partitionBy(key).orderBy(F.col("prior").desc(), F.col("qid").desc())
    return scored.select(key, "qid", "prior", F.row_number().over(order).alias("rank"))


def with_default_place(df: DataFrame, place: str = "place", qid: str = "place_wqid", name: str = DEFAULT_PLACE, default: str = DEFAULT_QID) -> DataFrame:
    """If a place or its entity is empty, both are the default."""
    none = (F.coalesce(place, F.lit("")) == "") | (F.coalesce(qid, F.lit("")) == "")
    return df.withColumns({place: F.when(none, name).otherwise(F.col(place)), qid: F.when(none, default).otherwise(F.col(qid))})


def publication_mentions(articles: DataFrame) -> DataFrame:
    """A mention of its place of publication for each article (doc_id, place, place_wqid): it gives
    context and is dropped after scoring. end_pos counts the lead twice, which leaves
    nothing to its right."""
    sentence = F.concat(F.lit(PUBLISHED), F.col("place"), F.lit("."))
    return with_default_place(articles).select(
        "doc_id", F.col("place").alias("mention"), sentence.alias("sentence"), F.lit(len(PUBLISHED)).alias("pos"), (F.lit(len(PUBLISHED)) + F.length(sentence)).cast("int").alias("end_pos"),
        F.col("place_wqid").alias("qid"), F.lit(1.0).alias("prior"),
    )


def prerank(candidates: DataFrame, key: str = "mention", by_context: int = 3, keep: int = 7) -> DataFrame:
    """(key, qid, prior, context, rank): the best by_context by context, filled up by prior to keep, in
    the order of the prior."""
    context = Window.partitionBy(key).orderBy(F.col("context").desc(), "qid")
    first = candidates.withColumn("c", F.row_number().over(context)).withColumn("top", (F.col("c") <= by_context).cast("int"))
    fill = Window.partitionBy(key).orderBy(F.col("top").desc(), F.col("prior").desc(), "qid")
    kept = first.withColumn("f", F.row_number().over(fill)).where(F.col("f") <= keep)
    order = Window.partitionBy(key).orderBy(F.col("prior").desc(), "qid")
    return kept.select(key, "qid", "prior", "context", F.row_number().over(order).alias("rank"))


def normalise_cross(scores: Column) -> Column:
    """Scores by min and max to 0..1, then to sum 1; zeros where all are equal."""
    low, high = F.array_min(scores), F.array_max(scores)
    unit = F.transform(scores, lambda s: F.coalesce(F.try_divide(s - low, high - low), F.lit(0.0)))
    total = F.aggregate(unit, F.lit(0.0), lambda a, s: a + s)
    return F.transform(unit, lambda s: F.coalesce(F.try_divide(s, total), F.lit(0.0)))


def decide(candidates: DataFrame, key: str = "mention") -> DataFrame:
    """(key, prediction, score) from (key, rank, qid, score, valid): the greatest score; if that is
    of padding the first candidate if valid, else NIL with 0."""
    out = candidates.groupBy(key).agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "qid", "valid")).alias("b"), F.min(F.struct("rank", "qid", "score", "valid")).alias("f"))
    pick = lambda c, none: F.when(F.col("b.valid"), F.col(f"b.{c}")).when(F.col("f.valid"), F.col(f"f.{c}")).otherwise(F.lit(none))
    return out.select(key, pick("qid", "NIL").alias("prediction"), pick("score", 0.0).alias("score"))


def top_candidates(scores: DataFrame, key: str = "mention", keep: int = TOP) -> DataFrame:
    """The best `keep` of (key, qid, score), scores to three digits, ranked."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "qid")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select(key, "qid", F.round("score", 3).alias("score"), "rank")


def with_place(predicted: DataFrame, gazetteer: DataFrame, classes: DataFrame) -> DataFrame:
    """Predictions with coordinates and class, null where the entity has none."""
    return predicted.join(gazetteer.select(F.col("qid").alias("prediction"), "lat", "lon"), "prediction", "left").join(classes.select(F.col("qid").alias("prediction"), F.col("class_qid").alias("wkdt_class")), "prediction", "left")
