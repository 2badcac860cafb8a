"""Readers of annotated text: WebAnno and HIPE lines, literals, embeddings, titles.

Files are read as lines with their number, (doc_id, line_no, line); the order of lines comes from that
number, never from partitions. A document is the unit of every window.
"""

from __future__ import annotations

import ast
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

WEBANNO_LINE = r"^\d+-\d+\t\d+-\d+\t.*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of text files; doc_id is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), "value")
    return files.select("doc_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def webanno_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, tok, start, end, word, entity, link, group): tokens of WebAnno TSV lines, three or
    five fields. A token whose annotation number is that of the one before goes on with its span."""
    f = F.split("line", "\t")
    own = lambda i: F.when(F.size(f) > i, F.try_element_at(f, F.lit(i + 1)))
    rows = lines.where(F.col("line").rlike(WEBANNO_LINE)).select(
        "doc_id", "line_no", F.split_part(f[0], F.lit("-"), F.lit(1)).cast("int").alias("sent_idx"), F.split_part(f[0], F.lit("-"), F.lit(2)).cast("int").alias("tok"),
        F.split_part(f[1], F.lit("-"), F.lit(1)).cast("int").alias("start"), F.split_part(f[1], F.lit("-"), F.lit(2)).cast("int").alias("end"), f[2].alias("word"), own(3).alias("l"), own(4).alias("k"),
    )
    name = lambda c: F.nullif(F.regexp_replace(c, r"\[\d+\]$", ""), F.lit("_"))
    group = F.try_element_at(F.regexp_extract_all("k", F.lit(r"\[(\d+)\]$"), F.lit(1)), F.lit(1)).cast("int")
    rows = rows.withColumns({"kind": name(F.col("k")), "link": name(F.col("l")), "group": group})
    order = Window.partitionBy("doc_id").orderBy("line_no")
    goes_on = F.col("group").isNotNull() & (F.lag("group").over(order) == F.col("group"))
    tag = F.when(F.col("kind").isNull(), "O").otherwise(F.concat(F.when(F.coalesce(goes_on, F.lit(False)), "I-").otherwise("B-"), F.col("kind")))
    return rows.select("doc_id", "sent_idx", "tok", "start", "end", "word", tag.alias("entity"), "link", "group")


def hipe_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, tok, start, end, word, entity, meto, link): tokens of HIPE lines of ten fields.

    A comment names the document; EndOfSentence and NoSpaceAfter in the last field close a
    sentence and join tokens; a sentence that would start with an I- tag belongs to the one
    before. Offsets are of the sentence.
    """
    file_order = Window.partitionBy("file").orderBy("line_no")
    named = lines.withColumnRenamed("doc_id", "file").withColumn("doc", F.last(F.when(F.col("line").startswith("# hipe2022:document_id"), F.trim(F.split_part("line", F.lit("="), F.lit(2)))), ignorenulls=True).over(file_order))
    f = F.split("line", "\t")
    rows = named.where((F.size(f) >= 10) & ~F.col("line").startswith("#") & ~F.col("line").startswith("TOKEN")).select(F.col("doc").alias("doc_id"), "line_no", f[0].alias("word"), f[1].alias("entity"), f[2].alias("meto"), f[7].alias("link"), f[9].alias("misc"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    cut = F.coalesce(F.lag("misc").over(order).contains("EndOfSentence"), F.lit(False)) & ~F.col("entity").startswith("I-")
    rows = rows.withColumn("sent_idx", F.sum(cut.cast("int")).over(order).cast("int") + 1)
    sentence = Window.partitionBy("doc_id", "sent_idx").orderBy("line_no")
    width = F.length("word") + F.when(F.col("misc").contains("NoSpaceAfter"), 0).otherwise(1)
    start = F.coalesce(F.sum(width).over(sentence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("start", start).withColumn("tok", F.row_number().over(sentence))
    return rows.select("doc_id", "sent_idx", "tok", "start", (F.col("start") + F.length("word")).alias("end"), "word", "entity", "meto", "link")


def ner_rows(tokens: DataFrame) -> DataFrame:
    """(id, ner_tags, tokens): training rows, one a sentence, coarse tags aside."""
    parts = F.sort_array(F.collect_list(F.struct("tok", "word", "entity")))
    return tokens.groupBy(F.concat_ws("_", "doc_id", "sent_idx").alias("id")).agg(parts.alias("p")).select("id", F.col("p.entity").alias("ner_tags"), F.col("p.word").alias("tokens"))


def clean_annotations(annotations: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Annotations (doc_id, sent_idx, start, mention, qid, ...) with what markup left in mentions removed, entities
    outside the gazetteer as NIL, and mention_pos counting from 0 in the document. Bare _ go."""
    text = F.split_part(F.replace(F.col("mention"), F.lit("\\"), F.lit("")), F.lit("—"), F.lit(1))
    known = gazetteer.select("qid").distinct().withColumn("known", F.lit(True))
    order = Window.partitionBy("doc_id").orderBy("sent_idx", "start")
    rows = annotations.where("mention <> '_'").withColumn("mention", text).join(known, "qid", "left")
    return rows.withColumn("qid", F.when(F.col("known"), F.col("qid")).otherwise("NIL")).drop("known").withColumn("mention_pos", F.row_number().over(order) - 1)


def locations(annotations: DataFrame) -> DataFrame:
    """Those whose type, or metonymic type, is a location (loc, in any case)."""
    is_loc = lambda c: F.lower(F.coalesce(c, F.lit(""))).isin("loc", "b-loc", "i-loc")
    return annotations.where(is_loc(F.col("entity_type")) | is_loc(F.col("meto_type")))


@F.udf(StringType())
def literal_json(text):  # noqa: ANN001, ANN201
    """A Python literal as JSON, null if it is none; for the ingest of legacy tables only."""
    import json

    try:
        return None if text is None else json.dumps(ast.literal_eval(text))
    except ValueError:
        return None


@F.udf(ArrayType(FloatType()))
def unpack_floats(blob):  # noqa: ANN001, ANN201
    """Packed 32-bit floats, as embedding stores keep them."""
    return None if blob is None else list(struct.unpack(f"<{len(blob) // 4}f", bytes(blob)))


def embedding_key(word: Column, kind: str) -> Column:
    """The store's key of an entity or word."""
    if kind == "entity":
        return F.when(word == "#ENTITY/UNK#", word).otherwise(F.concat(F.lit("ENTITY/"), word))
    return F.when(word.isin("#WORD/UNK#", "#SND/UNK#"), "#WORD/UNK#").otherwise(F.lower(word))


def embeddings_of(words: DataFrame, store: DataFrame, kind: str) -> DataFrame:
    """words (word, ...) with emb from store (word, emb), null where it has none."""
    keyed = words.withColumn("k", embedding_key(F.col("word"), kind))
    return keyed.join(store.select(F.col("word").alias("k"), "emb"), "k", "left").drop("k")


def titles_to_entities(pages: DataFrame, titles: DataFrame, lower: bool = False) -> DataFrame:
    """pages (title, ...) with qid from titles (wikipedia_title, lower_wikipedia_title, wikidata_id), the
    least of several; null where there is none."""
    name = "lower_wikipedia_title" if lower else "wikipedia_title"
    one = titles.groupBy(F.col(name).alias("title")).agg(F.min("wikidata_id").alias("qid"))
    return pages.join(one, "title", "left")
