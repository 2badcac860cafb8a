"""Gold alignment, overlap matches, write-back, and metrics. Range conditions always stand
beside an equality on the sentence, so they are hash joins with a residual condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mentions import SENTENCE


def align_gold(tokens: DataFrame, gold: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """keys, tok, word, gold_tag, gold_link: tags of tokens (keys, tok, word, start, end) by the
    annotations (keys, a_start, a_end, a_type, a_link, a_pos) that hold them; the last wins.
    A link that is null or * is NIL."""
    inside = (F.col("start") >= F.col("a_start")) & (F.col("end") <= F.col("a_end"))
    pairs = tokens.join(gold, keys, "left").withColumn("hit", F.coalesce(inside, F.lit(False)))
    link = F.when(F.col("a_link").isNull() | (F.col("a_link") == "*"), "NIL").otherwise(F.col("a_link"))
    prefix = F.when(F.col("start") == F.col("a_start"), "B-").otherwise("I-")
    best = F.max(F.when(F.col("hit"), F.struct("a_pos", F.concat(prefix, F.upper("a_type")).alias("tag"), F.concat(prefix, link).alias("link")))).alias("b")
    out = pairs.groupBy(*keys, "tok", "word").agg(best)
    return out.select(*keys, "tok", "word", F.coalesce("b.tag", F.lit("O")).alias("gold_tag"), F.coalesce("b.link", F.lit("O")).alias("gold_link"))


def match_overlaps(predicted: DataFrame, gold: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """Each predicted mention (keys, p_first, p_last) with the gold mention (keys, g_first, g_last, g_qid)
    that shares most tokens, the first of equals; NIL without any."""
    shared = F.greatest(F.lit(0), F.least("p_last", "g_last") - F.greatest("p_first", "g_first") + 1)
    pairs = predicted.join(gold, keys, "left").withColumn("shared", F.when(F.col("g_first").isNotNull(), shared).otherwise(0))
    best = F.max(F.when(F.col("shared") > 0, F.struct("shared", (-F.col("g_first")).alias("o"), "g_qid"))).alias("b")
    return pairs.groupBy(*keys, "p_first", "p_last").agg(best).select(*keys, "p_first", "p_last", F.coalesce("b.g_qid", F.lit("NIL")).alias("gold_qid"), F.coalesce("b.shared", F.lit(0)).alias("shared"))


def write_links(tokens: DataFrame, linked: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """keys, tok, link: each token's link from the mention (keys, first, last, qid) over it, with B- at its
    first token and I- after; O elsewhere."""
    over = tokens.join(linked, keys, "left").withColumn("hit", F.coalesce(F.col("tok").between(F.col("first"), F.col("last")), F.lit(False)))
    own = F.max(F.when(F.col("hit"), F.struct("first", F.concat(F.when(F.col("tok") == F.col("first"), "B-").otherwise("I-"), F.col("qid")).alias("link")))).alias("b")
    return over.groupBy(*keys, "tok").agg(own).select(*keys, "tok", F.coalesce("b.link", F.lit("O")).alias("link"))


def skyline(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """gold (mention, gold_qid, ...) with skyline: the gold entity where it is a candidate, else O."""
    found = candidates.where("qid is not null").select("mention", F.col("qid").alias("gold_qid")).distinct().withColumn("found", F.lit(True))
    return gold.join(found, ["mention", "gold_qid"], "left").withColumn("skyline", F.when(F.col("found"), F.col("gold_qid")).otherwise("O")).drop("found")


def micro_prf(pairs: DataFrame) -> DataFrame:
    """(tp, n_predicted, n_gold, n_nil, p, r, f1) of (gold, prediction); NIL is never right, and counts
    as gold."""
    known = F.col("prediction") != "NIL"
    tp = (F.col("gold") == F.col("prediction")) & known
    out = pairs.agg(F.count_if(tp).alias("tp"), F.count_if(known).alias("n_predicted"), F.count(F.lit(1)).alias("n_gold"), F.count_if(~known).alias("n_nil"))
    return with_prf(out, "tp", "n_predicted", "n_gold")


def with_prf(df: DataFrame, tp: str, predicted: str, gold: str) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    p, r = ratio(tp, predicted), ratio(tp, gold)
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return df.withColumns({"p": F.round(p, 3), "r": F.round(r, 3), "f1": F.round(f, 3)})


def span_prf(predicted: DataFrame, gold: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """(tag, regime, tp, n_predicted, n_gold, p, r, f1): spans (keys, first, last, tag) matched strictly
    (bounds and tag), exactly (bounds), partially (an overlap) or by ent_type (an overlap and the
    tag), for each tag and for ALL. A span is right once, however many it meets."""
    p = predicted.select(*keys, F.col("first").alias("pf"), F.col("last").alias("pl"), F.col("tag").alias("pt"))
    g = gold.select(*keys, F.col("first").alias("gf"), F.col("last").alias("gl"), F.col("tag").alias("gt"))
    same, bounds = F.col("pt") == F.col("gt"), (F.col("pf") == F.col("gf")) & (F.col("pl") == F.col("gl"))
    tests = {"strict": same & bounds, "exact": bounds, "partial": F.lit(True), "ent_type": same}
    met = p.join(g, keys).where("pf <= gl and gf <= pl")
    each = met.groupBy(*keys, "pf", "pl", "pt").agg(*[F.max(t.cast("int")).alias(k) for k, t in tests.items()])
    stack = "stack(4, 'strict', strict, 'exact', exact, 'partial', partial, 'ent_type', ent_type) as (regime, hit)"
    sums = lambda df, c: df.withColumn("tag", F.explode(F.array(F.col(c), F.lit("ALL")))).groupBy("tag")
    tp = each.select("pt", F.expr(stack)).withColumn("tag", F.explode(F.array("pt", F.lit("ALL")))).groupBy("tag", "regime").agg(F.sum("hit").alias("tp"))
    n_p, n_g = sums(p, "pt").agg(F.count("*").alias("n_predicted")), sums(g, "gt").agg(F.count("*").alias("n_gold"))
    rows = n_p.join(n_g, "tag", "full").withColumn("regime", F.explode(F.array(*[F.lit(k) for k in tests]))).join(tp, ["tag", "regime"], "left")
    out = rows.select("tag", "regime", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "n_predicted", "n_gold")])
    return with_prf(out, "tp", "n_predicted", "n_gold")


def retag_by_spans(tokens: DataFrame, found: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """keys, tok, tag, link: tokens (keys, tok, start, end) in an external linker's spans (keys, s_start, s_end,
    s_qid): B-LOC, or I-LOC right after a tagged token."""
    inside = (F.col("start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end"))
    hit = tokens.join(found, keys, "left").groupBy(*keys, "tok").agg(F.max(F.when(inside, F.struct("s_start", "s_qid"))).alias("b"))
    order = Window.partitionBy(*keys).orderBy("tok")
    goes_on = F.coalesce(F.lag(F.col("b").isNotNull()).over(order), F.lit(False))
    prefix = F.when(goes_on, "I-").otherwise("B-")
    tagged = F.col("b").isNotNull()
    return hit.select(*keys, "tok", F.when(tagged, F.concat(prefix, F.lit("LOC"))).otherwise("O").alias("tag"), F.when(tagged, F.concat(prefix, F.col("b.s_qid"))).otherwise("O").alias("link"))


def hipe_lines(tokens: DataFrame, test: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """(doc_id, sent_idx, lines): a sentence's scorer lines, for documents of the test set only. Of
    a link, B- and I- go; without one a tagged token has NIL."""
    link = F.when(F.col("link").rlike("^[BI]-"), F.substring(F.col("link"), 3, 1 << 30)).when(F.col("tag") != "O", "NIL").otherwise(F.col("link"))
    line = F.concat_ws("\t", "word", F.when(F.col("tag") == "", "O").otherwise(F.col("tag")), *[F.lit(x) for x in ("O", "O", "O", "O", "O")], link, F.lit("O"), F.lit("O"))
    kept = tokens.join(test.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = F.sort_array(F.collect_list(F.struct("tok", line.alias("line"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("lines"))
