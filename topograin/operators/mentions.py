"""From tagged tokens to mentions, and sentences from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = ["doc_id", "sent_idx"]


def explode_tokens(tagged: DataFrame, keys: list[str] = SENTENCE) -> DataFrame:
    """One row a token, with its place (tok) in the sentence."""
    return tagged.select(*keys, F.posexplode("tokens").alias("tok", "t")).select(*keys, "tok", "t.*")


def with_context(sentences: DataFrame) -> DataFrame:
    """Sentences with the one before and after in their document, empty at the edges."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    return sentences.withColumn("prev", F.lag("sentence", 1, "").over(order)).withColumn("next", F.lead("sentence", 1, "").over(order))


def spans(tokens: DataFrame, keys: list[str] = SENTENCE, continues: bool = False) -> DataFrame:
    """Maximal runs of tagged tokens: keys, span, type, start_offset, end_offset (token places,
    inclusive), start_char, end_char.

    A span starts at a B- tag, after O, or where the type changes; with `continues` an I- tag
    always goes on.
    """
    order = Window.partitionBy(*keys).orderBy("tok")
    kind = F.substring_index("entity", "-", -1)
    before = F.lag("entity").over(order)
    new = F.col("entity").startswith("B-") | F.coalesce(before == "O", F.lit(True))
    if not continues:
        new = new | (F.substring_index(before, "-", -1) != kind)
    marked = tokens.withColumn("new", ((F.col("entity") != "O") & new).cast("int"))
    numbered = marked.withColumn("span", F.sum("new").over(order)).where("entity <> 'O'")
    return numbered.groupBy(*keys, "span").agg(
        F.min_by(kind, "tok").alias("type"), F.min("tok").alias("start_offset"), F.max("tok").alias("end_offset"), F.min("start").alias("start_char"), F.max("end").alias("end_char"),
        F.round(F.avg("score"), 3).alias("ner_score"), F.sort_array(F.collect_list(F.struct("tok", "word", "start", "end", "entity"))).alias("parts"),
    )


def surface(parts: Column) -> Column:
    """Token words with as many blanks between as the offsets leave."""
    begin = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("at"))
    step = lambda acc, p: F.struct(F.concat(acc["text"], F.repeat(F.lit(" "), F.greatest(F.coalesce(p["start"] - acc["at"], F.lit(0)), F.lit(0))), p["word"]).alias("text"), p["end"].alias("at"))
    return F.aggregate(parts, begin, step, lambda acc: acc["text"])


def mentions(tokens: DataFrame, keys: list[str] = SENTENCE, gold: bool = False) -> DataFrame:
    """Mentions of tagged tokens. Predicted ones carry the mean score and no link; gold ones
    score 1 and link to what follows the first - of their first token's link."""
    out = spans(tokens, keys).withColumn("mention", surface(F.col("parts")))
    link = F.regexp_replace(F.element_at("parts", 1)["entity"], r"^[^-]*-", "") if gold else F.lit("O")
    score = F.lit(1.0) if gold else F.col("ner_score")
    return out.select(*keys, "mention", "start_offset", "end_offset", "start_char", "end_char", score.alias("ner_score"), F.col("type").alias("ner_label"), link.alias("entity_link"))


def reconstruct(tokens: DataFrame, doc: str = "doc_id", sent: str = "sent_idx") -> DataFrame:
    """Sentence texts from tokens (doc, sent, word, start, end), gaps up to the next token
    as blanks, overlapped tokens left out: doc, sent, start, text."""
    order = Window.partitionBy(doc).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    clear = tokens.withColumn("reach", reach).where("reach is null or start >= reach")
    gap = F.greatest(F.coalesce(F.lead("start").over(order) - F.col("end"), F.lit(0)), F.lit(0))
    padded = clear.withColumn("piece", F.concat("word", F.repeat(F.lit(" "), gap)))
    parts = F.sort_array(F.collect_list(F.struct("start", "piece")))
    return padded.groupBy(doc, sent).agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))
