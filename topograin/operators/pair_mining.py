"""String pairs for training fuzzy matchers: OCR variants of words, and an entity's names."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.similarity import ratio


@F.pandas_udf(IntegerType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


def mine_pairs(neighbours: DataFrame, words: DataFrame, threshold: int = 70, min_len: int = 5, max_len: int = 15) -> DataFrame:
    """(s1, s2, label) from neighbours (word, other) of English words (word).

    A neighbour that is no word and whose halves are both more than threshold alike is a
    positive pair; one that is a word, with halves less than 100 - threshold alike and of about the
    same length, a negative. Neighbours that contain each other are left out.
    """
    english = words.select(F.col("word").alias("other")).distinct().withColumn("english", F.lit(True))
    pairs = neighbours.where(F.length("word").between(min_len, max_len) & ~F.col("word").contains(F.col("other")) & ~F.col("other").contains(F.col("word")))
    pairs = pairs.join(english, "other", "left").withColumn("english", F.coalesce("english", F.lit(False)))
    half = lambda c, k: F.expr(f"substring({c}, 1, cast(length({c}) / 2 as int))" if k == 0 else f"substring({c}, cast(length({c}) / 2 as int) + 1)")
    rated = pairs.withColumns({f"r{k}": ratio_udf(half("word", k), half("other", k)) for k in (0, 1)})
    low, high = (F.col("r0") < 100 - threshold) & (F.col("r1") < 100 - threshold), (F.col("r0") > threshold) & (F.col("r1") > threshold)
    near = F.abs(F.length("word") - F.length("other")) <= 2
    negative, positive = F.col("english") & low & near, ~F.col("english") & high
    return rated.where(negative | positive).select(F.col("word").alias("s1"), F.col("other").alias("s2"), positive.alias("label"))


def name_pairs(kb: DataFrame, threshold: int = 85) -> DataFrame:
    """(s1, s2, label true): pairs of an entity's names more than threshold alike."""
    names = kb.select("qid", "mention").distinct()
    both = names.select("qid", F.col("mention").alias("s1")).join(names.select("qid", F.col("mention").alias("s2")), "qid").where("s1 < s2")
    return both.select("s1", "s2").distinct().where(ratio_udf("s1", "s2") > threshold).withColumn("label", F.lit(True))


def balance(pairs: DataFrame) -> DataFrame:
    """As many positive as negative pairs of each length of s1, in hash order."""
    size = F.length("s1")
    order = Window.partitionBy(size, "label").orderBy(F.md5(F.concat_ws(":", "s1", "s2").cast("binary")), "s1", "s2")
    count = pairs.groupBy(size.alias("k")).agg(F.least(F.count_if("label"), F.count_if(~F.col("label"))).alias("most"))
    ranked = pairs.withColumn("k", size).withColumn("r", F.row_number().over(order))
    return ranked.join(count, "k").where("r <= most").select("s1", "s2", "label")
