"""Knowledge bases: loaders of JSON and CSV resources, and builders from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import drop_noisy_names, normalise_by_entity

NAME = r"\p{Lu}\p{L}+"


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(mention, qid, n) from JSON {mention: {entity: count}}."""
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,bigint>>").alias("m"))
    return nested.select(F.explode("m").alias("mention", "q")).select("mention", F.explode("q").alias("qid", "n"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(qid, label, lat, lon) from CSV with a header."""
    return spark.read.csv(path, header=True, schema="qid string, label string, lat double, lon double")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(qid, class_qid) from JSON {entity: class}."""
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return nested.select(F.explode("m").alias("qid", "class_qid"))


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    """(code, publication_title, ...) from JSON {code: {...}}."""
    fields = "publication_title string, publication_place string, publication_ctxt string, publication_dates string, wikidata_qid string"
    nested = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{fields.replace(' string', ':string')}>>").alias("m"))
    return nested.select(F.explode("m").alias("code", "p")).select("code", "p.*")


def load_kb(counts: DataFrame) -> DataFrame:
    """(mention, qid, relv, n): relevance by entity, noisy names dropped."""
    kept = drop_noisy_names(normalise_by_entity(counts))
    return kept.join(counts, ["mention", "qid"])


def counts_of_parts(part: DataFrame) -> DataFrame:
    return part.groupBy(F.col("p_name").alias("mention"), F.col("p_brand").alias("qid")).agg(F.count("*").alias("n"))


def counts_of_sales(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Counts by line item: summed by part first, so that the join sees one row a part."""
    sold = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("c"))
    return sold.join(part, "p_partkey").groupBy(F.col("p_name").alias("mention"), F.col("p_brand").alias("qid")).agg(F.sum("c").alias("n"))


def counts_of_texts(documents: DataFrame) -> DataFrame:
    """Capitalised words as names, sources as entities."""
    names = documents.select(F.col("source").alias("qid"), F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("mention"))
    return names.groupBy("mention", "qid").agg(F.count("*").alias("n"))


def numbered_gazetteer(entities: DataFrame) -> DataFrame:
    """(qid, label, lat, lon) for distinct entities whose name ends in a number; it places them on a grid."""
    k = F.regexp_extract("qid", r"(\d+)$", 1).cast("int") % 25
    return entities.select("qid").distinct().select("qid", F.col("qid").alias("label"), (F.lit(-60.0) + k * 5).alias("lat"), (F.lit(-170.0) + k * 14).alias("lon"))


def commonest_class(rows: DataFrame, entity: str, kind: str) -> DataFrame:
    """(qid, class_qid): the commonest kind of each entity, the first by name of equals."""
    each = rows.groupBy(F.col(entity).alias("qid"), F.col(kind).alias("class_qid")).agg(F.count("*").alias("c"))
    return each.groupBy("qid").agg(F.min(F.struct((-F.col("c")).alias("m"), "class_qid")).alias("b")).select("qid", "b.class_qid")
