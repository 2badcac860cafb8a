"""Knowledge-base names and candidate selection.

Similar names are found without a cross join. Containment goes through a gram index: a
string that another contains shares every gram with it, so the rarest of its grams is enough
to meet. Nearest names by edit distance, which have no least score, are searched for each
query against all names, in blocks of bounded size that stream past the queries, with
exact bounds. Vector neighbours are searched likewise. Queries that match exactly
never get there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import containment, osa_distances

BLOCK_NAMES, BLOCK_VECTORS = 20_000, 4096
#: Names that are compared with a query in one step.
AT_ONCE = 128


def normalise_by_entity(counts: DataFrame) -> DataFrame:
    """(mention, qid, relv): a name's share of all mentions of the entity."""
    total = counts.groupBy("qid").agg(F.sum("n").alias("total"))
    return counts.join(total, "qid").select("mention", "qid", (F.col("n") / F.col("total")).alias("relv"))


def drop_noisy_names(kb: DataFrame) -> DataFrame:
    """kb without names that hold ", " or " (", save those of entities that have no other."""
    clean = ~(F.col("mention").contains(", ") | F.col("mention").contains(" ("))
    some = kb.groupBy("qid").agg(F.bool_or(clean).alias("some"))
    return kb.join(some, "qid").where(clean | ~F.col("some")).drop("some")


def name_list(counts: DataFrame) -> DataFrame:
    """(name, n_entities): names for fuzzy matching, trimmed, tabs as blanks, of two characters
    or more and not all lower-case; of spellings that differ in case that with most entities."""
    name = F.replace(F.trim("mention"), F.lit("\t"), F.lit(" "))
    own = counts.groupBy(name.alias("name")).agg(F.countDistinct("qid").alias("n_entities"))
    kept = own.where((F.length("name") >= 2) & ~((F.col("name") == F.lower("name")) & (F.col("name") != F.upper("name"))))
    best = kept.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct((-F.col("n_entities")).alias("m"), "name")).alias("b"))
    return best.select("b.name", (-F.col("b.m")).alias("n_entities"))


def perfect_match(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, variation, score) for distinct queries (mention); variation null without a match."""
    found = names.select(F.col("name").alias("variation")).distinct()
    return queries.select("mention").distinct().join(found, F.col("mention") == F.col("variation"), "left").select("mention", "variation", F.when(F.col("variation").isNotNull(), 1.0).alias("score"))


def _grams(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: s.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, variation, score) of all pairs one of which contains the other.

    Every string goes under all its grams of one to three characters; to be contained, it
    asks under one only, itself if that short, else the gram that fewest strings have.
    """
    sides = {k: df.select(F.col(c).alias("s")).where("s <> ''").distinct().withColumn("l", F.lower("s")) for k, df, c in (("q", queries, "mention"), ("n", names, "name"))}
    index = {k: df.select("s", F.explode(F.concat(*[_grams(F.col("l"), n) for n in (1, 2, 3)])).alias("g")) for k, df in sides.items()}
    rare = {k: df.where(F.length("g") == 3).groupBy("g").agg(F.count("*").alias("f")) for k, df in index.items()}
    out = None
    for small, large in (("q", "n"), ("n", "q")):
        short = sides[small].where(F.length("l") < 3).select("s", F.col("l").alias("g"))
        grams = sides[small].where(F.length("l") >= 3).select("s", F.explode(_grams(F.col("l"), 3)).alias("g"))
        # a gram that no string on the other side has rules the string out
        held = grams.join(rare[large], "g", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("b"))
        probe = short.unionByName(held.where("b.f > 0").select("s", F.col("b.g").alias("g")))
        pairs = probe.withColumnRenamed("s", "a").join(index[large].withColumnRenamed("s", "b"), "g").where(F.lower("b").contains(F.lower("a")))
        pairs = pairs.select(F.col("a").alias("mention"), F.col("b").alias("variation")) if small == "q" else pairs.select(F.col("b").alias("mention"), F.col("a").alias("variation"))
        out = pairs if out is None else out.union(pairs)
    return out.distinct().withColumn("score", containment(F.col("mention"), F.col("variation")))


def top_ties(scored: DataFrame) -> DataFrame:
    """Of (mention, variation, score) those rows with the mention's greatest score."""
    best = scored.groupBy("mention").agg(F.max("score").alias("best"))
    return scored.join(best, "mention").where("score = best").drop("best")


def nearest_names(queries: DataFrame, names: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(mention, variation, score): for each query all names with the greatest edit similarity,
    however low. Names stream past in blocks of about block_names, each broadcast."""
    known = names.select("name").where("name is not null").distinct()
    blocks = max(1, math.ceil(known.count() / block_names))
    asked = queries.select("mention").where("mention is not null").distinct()
    out = None
    for k in range(blocks):
        part = [r.name for r in known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]
        held = queries.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lower = [n.lower() for n in held.value]
            sizes = np.array([len(n) for n in lower])
            bags = _bags(lower)
            for batch in batches:
                rows: list[tuple] = []
                for q in batch.column(0).to_pylist() if len(lower) else []:
                    low = q.lower()
                    longest = np.maximum(np.maximum(sizes, len(low)), 1)
                    # edits are at least the characters of the longer that the shorter lacks
                    bound = (longest - np.minimum(bags, _bags([low])).sum(axis=1)) / longest
                    best, found = 2.0, []
                    order = np.argsort(bound, kind="stable")
                    for at in range(0, len(order), AT_ONCE):
                        near = order[at : at + AT_ONCE]
                        near = near[bound[near] <= best]
                        if not len(near):
                            break
                        d = osa_distances(low, [lower[i] for i in near]) / longest[near]
                        least = float(d.min())
                        found, best = (found if least == best else []) if least <= best else found, min(best, least)
                        found += [i for i, e in zip(near, d) if e == best]
                    rows += [(q, held.value[i], 1.0 - float(np.float32(best))) for i in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.string(), pa.string(), pa.float64()))], ["mention", "variation", "score"])

        part_out = asked.mapInArrow(run, "mention string, variation string, score double")
        out = part_out if out is None else out.union(part_out)
    return top_ties(out) if blocks > 1 else out


def _bags(strings: list[str]) -> np.ndarray:
    """Characters counted in 64 classes; classes that share a cell only loosen the bound."""
    out = np.zeros((len(strings), 64), np.int16)
    for i, s in enumerate(strings):
        np.add.at(out[i], [ord(c) % 64 for c in s], 1)
    return out


def fuzzy_match(queries: DataFrame, names: DataFrame, method: str) -> DataFrame:
    """(mention, variation, score) per query: exact matches, else for perfectmatch none, for
    partialmatch the best containment, for levenshtein the nearest names. Queries without a match
    have a null variation."""
    exact = perfect_match(queries, names)
    if method == "perfectmatch":
        return exact
    missed = exact.where("variation is null").select("mention")
    if method == "partialmatch":
        near = top_ties(contained_pairs(missed, names))
    elif method == "levenshtein":
        near = nearest_names(missed, names)
    else:
        raise ValueError(f"unknown ranking method {method!r}")
    hit = exact.where("variation is not null").unionByName(near.select("mention", "variation", "score"))
    return queries.select("mention").distinct().join(hit, "mention", "left")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK_VECTORS) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest of vectors (vec_id, embedding) to each of
    queries (the same columns), itself aside; cosine distance or l2.

    Queries are broadcast in blocks of bounded size; each task keeps its k best of a query,
    so what is shuffled does not grow with the vectors that a task reads.
    """
    ids = queries.select("vec_id", "embedding").where("embedding is not null")
    blocks = max(1, math.ceil(ids.count() / block))
    out = None
    for b in range(blocks):
        rows = ids.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        held = queries.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            best_d, best_i = np.full((len(qid), 0), 0.0), np.full((len(qid), 0), 0, np.int64)
            unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                i = batch.column(0).to_numpy(zero_copy_only=False)
                x = np.array(batch.column(1).to_pylist(), np.float64)
                if not len(i):
                    continue
                if metric == "cosine":
                    d = 1 - unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                else:
                    d = np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * q @ x.T))
                d = np.where(qid[:, None] == i[None, :], np.inf, d)
                all_d, all_i = np.concatenate([best_d, d], axis=1), np.concatenate([best_i, np.broadcast_to(i, d.shape)], axis=1)
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            ok = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], best_d.shape)[ok]), pa.array(best_i[ok]), pa.array(best_d[ok])], ["query_id", "vec_id", "distance"])

        part = vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "query_id long, vec_id long, distance double")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distance_score(distance: Column, threshold: float) -> Column:
    """Similarity of a distance within the threshold: 1 at 0, 0 at the threshold; null beyond."""
    return F.when(distance <= threshold, (F.lit(threshold) - distance) / F.lit(threshold))


def find_candidates(matches: DataFrame, kb: DataFrame) -> DataFrame:
    """(mention, variation, score, qid, relv) for matches (mention, variation, score) and kb
    (mention, qid, relv). Variations without entities go; a mention left without any stays with nulls."""
    entities = kb.select(F.col("mention").alias("variation"), "qid", "relv")
    found = matches.where("variation is not null").join(entities, "variation").select("mention", "variation", "score", "qid", "relv")
    return matches.select("mention").distinct().join(found, "mention", "left")


def only_new(queries: DataFrame, memo: DataFrame) -> DataFrame:
    """Distinct queries (mention) for which the memo (mention, qid) has no entity; those with an
    empty result are asked again."""
    return queries.select("mention").distinct().join(memo.where("qid is not null").select("mention").distinct(), "mention", "left_anti")
