"""The queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lbl, merkle, mixing, quality, secret_scan, simhash, url_filter, warc
from .shared import WORD, remainder, table

#: A dated filter list: kind, rule, action, date.
FILTER_LIST = [
    ("host", "spam-farm.example.org", "block", "2024-02-01 00:00:00"),
    ("host", "cheap-pills.example.com", "block", "2024-01-15 00:00:00"),
    ("host", "cheap-pills.example.com", "remove", "2024-07-01 00:00:00"),
    ("host", "cheap-pills.example.com", "block", "2025-01-01 00:00:00"),
    ("host", "blog.ththan.example.net", "block", "2024-03-10 00:00:00"),
    ("host", "blog.ththan.example.net", "allow", "2024-09-10 00:00:00"),
    ("host", "example.net", "block", "2025-06-01 00:00:00"),
    ("host", "ththble.example.net", "allow", "2025-07-01 00:00:00"),
    ("host", "example.org", "block", "2024-05-01 00:00:00"),
    ("host", "example.org", "remove", "2024-06-01 00:00:00"),
    ("prefix", "ththble.example.net/de", "block", "2024-04-01 00:00:00"),
    ("prefix", "ththed.example.org/en", "block", "2024-01-01 00:00:00"),
    ("prefix", "ththed.example.org/en", "remove", "2024-12-31 00:00:00"),
    ("prefix", "thther.example.org/fr", "allow", "2024-05-02 00:00:00"),
]
MONTHS_OF_FETCHES = 730


def fetched_at(page_id: Column) -> Column:
    """Pages have no time: each is taken as fetched on a day, by its id, in 2024 or 2025."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(page_id * 37, F.lit(MONTHS_OF_FETCHES)) * 86_400)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched_at(F.col("page_id")).alias("fetched_at"))
    entries = spark.createDataFrame(FILTER_LIST, "kind string, rule string, action string, listed_at string")
    return url_filter.evaluate(captures, entries)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"),
        line(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("live").cast("long").alias("n_live"), (F.size("base") - F.size(F.filter("live", lambda s: s["kind"] != "opaque"))).cast("long").alias("n_copied"),
    )


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model | None:
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    return quality.fit(docs, labels)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, quality_model(spark, docs, sf_dir))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", fetched_at(F.col("page_id")).alias("at"))
    return warc.round_trip(pages, date=F.col("at"), payloads=False).drop("payload")


def op8_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    texts = docs.where(~held_out).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    model, counts = lbl.fit(texts)
    scores = lbl.score(docs, model, counts)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_decontaminate, op3_html_text, op4_secret_scan, op5_merkle, op6_quality, op7_warc, op8_lbl, op9_simhash, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{k}', '{r}', '{a}', TIMESTAMP '{d}')" for k, r, a, d in FILTER_LIST)
    return {
        "op1_url_filters": f"""
            WITH entries(kind, rule, action, listed_at) AS (VALUES {rules}),
            spans AS (SELECT kind, rule, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY kind, rule ORDER BY listed_at) AS valid_to FROM entries),
            captures AS (SELECT page_id, url, make_timestamp((1704067200 + ((page_id * 37) % 730) * 86400) * 1000000) AS fetched_at, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS bare FROM pages),
            parts AS (SELECT *, regexp_replace(lower(split_part(bare, '/', 1)), '^www\\.', '') AS host, regexp_replace(regexp_replace(bare, '^[^/]*', ''), '/+$', '') AS path FROM captures),
            hits AS (SELECT p.page_id, s.kind, s.rule, s.action, length(s.rule) + CASE WHEN s.kind = 'prefix' THEN 10000 ELSE 0 END AS specificity
                FROM parts p JOIN spans s ON s.action <> 'remove' AND s.valid_from <= p.fetched_at AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to)
                AND CASE WHEN s.kind = 'host' THEN p.host = s.rule OR ends_with(p.host, '.' || s.rule) ELSE p.host || p.path = s.rule OR starts_with(p.host || p.path, s.rule || '/') END),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY specificity DESC, action DESC) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM hits)
            SELECT p.page_id, p.url, p.fetched_at, coalesce(r.action, 'none') AS verdict, r.rule, coalesce(r.n, 0) AS n_active
            FROM parts p LEFT JOIN ranked r ON r.page_id = p.page_id AND r.k = 1""",
        "op10_mixing": f"""
            WITH sized AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS k, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
            own AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
            ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM own),
            weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
            levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE)) AS level FROM weighed
                WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            goals AS (SELECT source, source_size, rank, least(cap, max(level) OVER () * w) AS target FROM levels),
            placed AS (SELECT s.doc_id, s.size, g.source_size, g.rank, g.target, floor(g.target + 0.5)::BIGINT AS want,
                coalesce(sum(s.size) OVER (PARTITION BY g.rank ORDER BY s.k, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
                FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
            passed AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE want // source_size END AS passes FROM placed),
            parted AS (SELECT *, greatest(0, least(size, want - passes * source_size - start)) AS part FROM passed),
            timed AS (SELECT *, passes * size + part AS taken, CASE WHEN passes >= 1 THEN size ELSE part END AS first, CASE WHEN passes >= 2 THEN size WHEN passes >= 1 THEN part ELSE 0 END AS second,
                CASE (rank - 1) % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, CASE (rank - 1) % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope FROM parted),
            drawn AS (SELECT *, CASE WHEN first > 0 THEN (start + first / 2.0::DOUBLE) / want END AS y1, CASE WHEN second > 0 THEN (source_size + start + second / 2.0::DOUBLE) / want END AS y2 FROM timed)
            SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
                CASE WHEN y1 IS NOT NULL THEN round(least(1.0::DOUBLE, 2.0::DOUBLE * y1 / (a + sqrt(greatest(0.0::DOUBLE, a * a + 2.0::DOUBLE * slope * y1)))), 9) END AS position,
                CASE WHEN y2 IS NOT NULL THEN round(least(1.0::DOUBLE, 2.0::DOUBLE * y2 / (a + sqrt(greatest(0.0::DOUBLE, a * a + 2.0::DOUBLE * slope * y2)))), 9) END AS repeat_position
            FROM drawn""",
    }
