"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between knots. Its
integral is the source's cumulative demand; laid end to end in a hashed order, the
source's documents meet that demand, and a document's position is the time at which the
demand reaches it: the integral, inverted in closed form. Documents sorted by position are
the training order.

How much a source gives: its weight's share of `share` times all sizes, but at most
`max_repeat` times its own size, the excess going to the others by weight (water
filling, in closed form over the sorted caps). What a source gives is taken in whole
passes over its documents and one partial pass, the last document of which may be cut.

Plan, built-in functions only. Sizes are counted once and kept, without texts, in the
shared folder. Sums by source are combined before the shuffle. A running sum over a source
is split over hash buckets of about `bucket_rows` rows of the source: sums by bucket, a running sum of
those, and a window within (source, bucket), so that a source with a third of all rows is
dealt over as many tasks as its rows need. The table of sources is broadcast only if its
counted rows are within `broadcast_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

WEIGHTS, SHARE, MAX_REPEAT = (5.0, 2.0, 1.0), 1.5, 2.0
#: Knots (time, weight) for the sources of each weight: large ones lead, small ones follow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
BUCKET_ROWS, BROADCAST_ROWS = 2_000, 100_000
#: A column name that no table has.
OWN = "__topograin_plan"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_rows, source_size, rank, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn.
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    ranked = own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights)) + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weight = F.sum("source_size").over(every) * F.lit(share), F.sum("w").over(every)
    level = (total - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (weight - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return filled.select("source", "source_rows", "source_size", "rank", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def invert(y: Column, knots: Column) -> Column:
    """The time at which a schedule's integral, as a share of all of it, is y.

    knots: array of (t, w, area), area being the integral up to t.
    """
    last = F.element_at(knots, -1)
    z = y * last["area"]
    at = F.greatest(F.lit(1), F.least(F.size(F.filter(knots, lambda k: k["area"] <= z)), F.size(knots) - 1))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    slope, rest = (b["w"] - a["w"]) / (b["t"] - a["t"]), z - a["area"]
    root = F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + F.lit(2.0) * slope * rest))
    return F.least(b["t"], a["t"] + F.coalesce(F.try_divide(F.lit(2.0) * rest, a["w"] + root), F.lit(0.0)))


def _knots(points: tuple[tuple[float, float], ...]) -> Column:
    area, out = 0.0, []
    for i, (t, w) in enumerate(points):
        area += (t - points[i - 1][0]) * (w + points[i - 1][1]) / 2 if i else 0.0
        out.append(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"), F.lit(area).alias("area")))
    return F.array(*out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, schedules: tuple = SCHEDULES, bucket_rows: int = BUCKET_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken, position, repeat_position)
    per row, sorted by position.

    taken counts words, repeats included; position and repeat_position (0..1, null for what
    is not taken) are the middles of the first and second pass over the document. Sources
    take the schedules in turn, as the weights. The order within a source is by md5 of the
    id, then id, size and text hash, so reruns agree; of rows that agree in all of these it does not
    matter which comes first. Null or blank texts have size 0; a null source is a source;
    an empty table gives none. Other columns are not read.
    """
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    base = written(docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).alias("source"), words(text).alias("size"), F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("k")), "sizes")
    sources = written(targets(base, weights, share, max_repeat), "targets")
    side = F.broadcast(sources) if sources.count() <= broadcast_rows else sources
    bucket = F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.ceil(F.col("source_rows") / F.lit(bucket_rows))).cast("long")
    rows = base.join(side.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("rank", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("k", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("own", F.coalesce(own, F.lit(0))).join(offsets, ["rank", "bucket"])
    start, size = F.col("offset") + F.col("own"), F.col("size")
    want = F.floor(F.col("target") + F.lit(0.5))
    passes = F.coalesce(F.floor(F.try_divide(want.cast("double"), F.col("source_size").cast("double"))), F.lit(0))
    placed = placed.withColumn("start", start).withColumn("want", want).withColumn("passes", passes)
    part = F.greatest(F.lit(0), F.least(size, F.col("want") - F.col("passes") * F.col("source_size") - F.col("start")))
    placed = placed.withColumn("part", part).withColumn("taken", F.col("passes") * size + F.col("part"))
    turn = (F.col("rank") - 1) % len(schedules)
    knots = F.element_at(F.array(*[_knots(x) for x in schedules]), turn + 1)
    first = F.when(F.col("passes") >= 1, size).otherwise(F.col("part"))
    second = F.when(F.col("passes") >= 2, size).when(F.col("passes") >= 1, F.col("part")).otherwise(F.lit(0))
    at = lambda lead, length: F.when(length > 0, F.round(invert((lead + length / F.lit(2.0)) / F.col("want").cast("double"), knots), 9))
    out = placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), at(F.col("start"), first).alias("position"), at(F.col("source_size") + F.col("start"), second).alias("repeat_position"), "k")
    return out.orderBy(F.col("position").asc_nulls_last(), "k", "doc_id", "text_hash").drop("k")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The documents that the mix takes, all columns, with mix_taken, mix_position and
    mix_repeat_position, sorted by position. Columns of these names
    that docs has are replaced. Rows that repeat an id and text share all that is taken of them,
    the first a word more where it does not divide, and stay repeated but for those without a
    word; an empty table gives none."""
    docs = docs.drop("mix_taken", "mix_position", "mix_repeat_position")
    plan = mix(docs, id_col, text_col, source_col, **params).where("taken > 0")
    rows = plan.groupBy("doc_id", "text_hash", "source").agg(F.sum("taken").alias("taken"), F.min("position").alias("at"), F.min("repeat_position").alias("again"), F.count("*").alias("n"))
    rows = written(rows, "taken")
    p = rows.select(F.struct("*").alias(OWN))
    key = docs[id_col].cast("long").eqNullSafe(p[OWN]["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == p[OWN]["text_hash"]) & docs[source_col].eqNullSafe(p[OWN]["source"])
    own = F.col(OWN)
    share = F.floor(own["taken"] / own["n"])
    if not rows.where("n > 1").isEmpty():  # of equal rows the first have a word more
        nth = F.row_number().over(Window.partitionBy(own["doc_id"], own["text_hash"], own["source"]).orderBy(F.lit(1)))
        share = share + F.when(nth <= own["taken"] % own["n"], 1).otherwise(0)
    out = docs.join(p, key).select(*docs.columns, share.cast("long").alias("mix_taken"), own["at"].alias("mix_position"), own["again"].alias("mix_repeat_position"))
    return out.where("mix_taken > 0").orderBy("mix_position", id_col)
