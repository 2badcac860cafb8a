"""Dataset splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(key: Column, seed: int = 42) -> Column:
    """A number in 0..999 that depends on the key and seed alone."""
    h = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 1000


def assign(df: DataFrame, key: str, train: int = 640, dev: int = 160, seed: int = 42) -> DataFrame:
    """df with split: train, dev or test by hash of the key; shares in thousandths."""
    h = hash_share(F.col(key), seed)
    return df.withColumn("split", F.when(h < train, "train").when(h < train + dev, "dev").otherwise("test"))


def by_membership(df: DataFrame, key: str, train: DataFrame, dev: DataFrame, test: DataFrame) -> DataFrame:
    """df with split by membership in the tables of keys, left_out for rows in none."""
    named = train.select(key, F.lit("train").alias("split")).unionByName(dev.select(key, F.lit("dev").alias("split"))).unionByName(test.select(key, F.lit("test").alias("split")))
    return df.join(named.dropDuplicates([key]), key, "left").fillna("left_out", ["split"])


def group_split(df: DataFrame, groups: list[str], held: tuple, dev: tuple) -> DataFrame:
    """df with split: the held group is test, another dev, the rest train."""
    same = lambda values: F.struct(*groups) == F.struct(*[F.lit(v).alias(g) for g, v in zip(groups, values)])
    return df.withColumn("split", F.when(same(held), "test").when(same(dev), "dev").otherwise("train"))


def leave_one_group_out(df: DataFrame, groups: list[str]) -> DataFrame:
    """Sizes of the splits that hold out one group each: groups, n_test, n_dev (the group that
    follows, the first after the last) and n_train. Only the table of groups is ordered."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n_test"))
    order = Window.orderBy(*groups)
    whole = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dev = F.coalesce(F.lead("n_test").over(order), F.first("n_test").over(whole))
    return sizes.withColumn("n_dev", dev).withColumn("n_train", F.sum("n_test").over(whole) - F.col("n_test") - F.col("n_dev"))
