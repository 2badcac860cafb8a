"""Annotated corpora as article tables, NER rows, split columns and training items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wiki_title
from ..operators import mentions as M
from ..operators.splits import hash_share
from .annotated import clean_annotations, hipe_tokens, locations, titles_to_entities, webanno_tokens

SHARE_DEV = 330


def _annotated(tokens: DataFrame, continues: bool, more: list[str]) -> DataFrame:
    """Spans of tokens with the first token's link and more columns."""
    spans = M.spans(tokens.withColumn("score", F.lit(1.0)), continues=continues).withColumn("mention", M.surface(F.col("parts")))
    first = tokens.select("doc_id", "sent_idx", F.col("tok").alias("start_offset"), "link", *more)
    return spans.select("doc_id", "sent_idx", "mention", F.col("start_char").alias("start"), "start_offset", F.col("type").alias("entity_type")).join(first, ["doc_id", "sent_idx", "start_offset"])


def _article(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_id, sentences, annotations) with ordered arrays; annotations may be none."""
    own = sentences.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("sent_idx").alias("sentence_pos"), F.col("text").alias("sentence_text")))).alias("sentences"))
    fields = ["mention_pos", "mention", "entity_type", "wkpd_url", "wkdt_qid", "mention_start", "mention_end", "sent_pos"]
    held = annotations.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("annotations"))
    return own.join(held, "doc_id", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(held.schema["annotations"].dataType)))


def lwm_articles(lines: DataFrame, metadata: DataFrame, titles: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Articles of WebAnno files (doc_id = file name) joined with their metadata (fname, place_publication,
    issue_date, ocr_quality_mean, ocr_quality_sd, publication_title, publication_code)."""
    tokens = webanno_tokens(lines)
    sentences = M.reconstruct(tokens)
    found = _annotated(tokens, False, []).where("link is not null")
    found = found.withColumns({"wkpd_url": F.replace("link", F.lit("\\"), F.lit("")), "title": wiki_title(F.substring_index(F.replace("link", F.lit("\\"), F.lit("")), "/wiki/", -1))})
    found = clean_annotations(titles_to_entities(found.withColumn("title", F.when(~F.col("link").isin("NIL", "*"), F.col("title"))), titles, lower=True), gazetteer)
    at = sentences.select("doc_id", "sent_idx", F.col("start").alias("sentence_start"))
    found = found.join(at, ["doc_id", "sent_idx"]).withColumns({"mention_start": F.col("start") - F.col("sentence_start"), "wkdt_qid": F.col("qid"), "sent_pos": F.col("sent_idx")})
    rows = _article(sentences, found.withColumn("mention_end", F.col("mention_start") + F.length("mention")))
    date = F.col("issue_date").cast("string")
    about = metadata.select(
        F.col("fname").alias("f"), F.col("place_publication").alias("place"), F.concat(F.substring(date, 1, 3), F.lit("0")).cast("int").alias("decade"), F.substring(date, 1, 4).cast("int").alias("year"),
        F.col("ocr_quality_mean").cast("double").alias("ocr_quality_mean"), F.col("ocr_quality_sd").cast("double").alias("ocr_quality_sd"), "publication_title", F.lpad(F.col("publication_code").cast("string"), 7, "0").alias("publication_code"),
    )
    name = F.regexp_replace("doc_id", r"\.tsv$", "")
    return rows.join(about, name == F.col("f")).select(F.split_part(name, F.lit("_"), F.lit(1)).alias("article_id"), "sentences", "annotations", "place", "decade", "year", "ocr_quality_mean", "ocr_quality_sd", "publication_title", "publication_code")


def hipe_articles(lines: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Articles of HIPE files: locations and metonymic locations with their entities."""
    tokens = hipe_tokens(lines)
    one = tokens.withColumn("key", F.struct("doc_id", "sent_idx"))
    sentences = M.reconstruct(one, "key", "sent_idx").select(F.col("key.doc_id").alias("doc_id"), "sent_idx", "text")
    found = locations(_annotated(tokens, True, ["meto"]).withColumnRenamed("meto", "meto_type")).withColumn("qid", F.col("link"))
    found = clean_annotations(found, gazetteer).withColumns({"wkpd_url": F.lit(None).cast("string"), "wkdt_qid": F.col("qid"), "mention_start": F.col("start"), "mention_end": F.col("start") + F.length("mention"), "sent_pos": F.col("sent_idx")})
    return _article(sentences, found).select(F.col("doc_id").alias("article_id"), "sentences", "annotations")


def with_publication_place(articles: DataFrame, publications: DataFrame) -> DataFrame:
    """articles with place_wqid from publications (code, wikidata_qid)."""
    return articles.join(publications.select(F.col("code").alias("publication_code"), F.col("wikidata_qid").alias("place_wqid")), "publication_code", "left")


def split_columns(articles: DataFrame, is_test: Column, key: str = "article_id") -> DataFrame:
    """originalsplit (test as given, dev a third of the rest), apply (no test) and withouttest (the
    original dev set tests, the given test set is left out)."""
    first, second = hash_share(F.col(key), 42) < SHARE_DEV, hash_share(F.col(key), 43) < SHARE_DEV
    return articles.withColumns({
        "originalsplit": F.when(is_test, "test").when(first, "dev").otherwise("train"),
        "apply": F.when(is_test, "dev").otherwise("train"),
        "withouttest": F.when(is_test, "left_out").when(first, "test").when(second, "dev").otherwise("train"),
    })


def training_items(articles: DataFrame) -> DataFrame:
    """A row an annotation, with its sentence and those at the positions before and after
    (empty where there is none): article_id, mention_pos, mention, ner_label, pos, end_pos, sentence, prev, next, gold."""
    sentences = articles.select("article_id", F.explode("sentences").alias("s")).select("article_id", F.col("s.sentence_pos").alias("sent_pos"), F.col("s.sentence_text").alias("sentence"))
    items = articles.select("article_id", F.explode("annotations").alias("a")).select("article_id", "a.*")
    for shift, name in ((0, "sentence"), (1, "prev"), (-1, "next")):
        items = items.join(sentences.select("article_id", (F.col("sent_pos") + shift).alias("sent_pos"), F.col("sentence").alias(name)), ["article_id", "sent_pos"], "left")
    return items.select("article_id", "sent_pos", "mention_pos", "mention", F.col("entity_type").alias("ner_label"), F.col("mention_start").alias("pos"), F.col("mention_end").alias("end_pos"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("sentence", "prev", "next")], F.col("wkdt_qid").alias("gold"))
