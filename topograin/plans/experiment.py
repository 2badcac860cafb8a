"""Experiments: gold mentions against predictions, over scenarios and splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import coarse_tag
from ..operators import evaluation as E
from ..operators.linking import most_popular
from ..operators.mentions import SENTENCE, explode_tokens, mentions
from ..sources.sinks import write_scorer_file
from .pipeline import Pipeline


def scenarios(datasets: list[str], rankers: list[str], linkers: list[str], publication: tuple[bool, ...] = (True, False), microtoponyms: tuple[bool, ...] = (True, False)) -> Iterator[dict]:
    """The grid of experiments, each with the name of its results."""
    for dataset, ranker, linker, publ, micro in product(datasets, rankers, linkers, publication, microtoponyms):
        name = "_".join([dataset, ranker, linker, *(["wpubl"] if publ else []), *(["wmtops"] if micro else [])])
        yield {"dataset": dataset, "ranker": ranker, "linker": linker, "publication": publ, "microtoponyms": micro, "name": name}


def model_name(ranker: str, split: str, publication: bool = True, without_microtoponyms: bool = True, test: bool = False, num_candidates: int = 1, threshold: float = 50) -> str:
    """The name under which a disambiguation model of these choices is kept."""
    own = f"{ranker}+{num_candidates}+{threshold:g}" if ranker == "vectors" else ranker
    return f"{own}_{split}{'+wpubl' * publication}{'+wmtops' * without_microtoponyms}{'_test' * test}"


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Processed tables, each a Parquet folder under path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def load(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    """The tables that save wrote; none of them if one is not there."""
    try:
        return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
    except AnalysisException:
        return {}


@dataclass
class Experiment:
    """articles: (doc_id, text, split[, place, place_wqid]); gold: annotations (doc_id, sent_idx, a_pos, a_start, a_end,
    a_type, a_link) by sentence offsets."""

    pipeline: Pipeline
    articles: DataFrame
    gold: DataFrame
    test_split: str = "test"
    coarse: bool = True

    def tokens(self) -> DataFrame:
        """Tokens of the test articles with predicted and gold tags."""
        rows = self.pipeline.sentences(self.articles.where(F.col("split") == self.test_split))
        tagged = rows.withColumn("tokens", self.pipeline.tagger(F.col("sentence")))
        tokens = explode_tokens(tagged)
        aligned = E.align_gold(tokens, self.gold).select(*SENTENCE, "tok", "gold_tag", "gold_link")
        out = tokens.join(aligned, [*SENTENCE, "tok"])
        return out.withColumns({c: coarse_tag(F.col(c)) for c in ("entity", "gold_tag")}) if self.coarse else out

    def mention_table(self, tokens: DataFrame) -> DataFrame:
        """Predicted mentions with the gold entity that they overlap most, candidates' best, and the skyline."""
        found = mentions(tokens.select(*SENTENCE, "tok", "word", "entity", "score", "start", "end"))
        true = mentions(tokens.select(*SENTENCE, "tok", "word", F.col("gold_tag").alias("entity"), "score", "start", "end"))
        links = tokens.select(*SENTENCE, F.col("tok").alias("start_offset"), F.regexp_replace("gold_link", "^[BI]-", "").alias("g_qid"))
        gold = true.join(links, [*SENTENCE, "start_offset"]).select(*SENTENCE, F.col("start_offset").alias("g_first"), F.col("end_offset").alias("g_last"), "g_qid")
        p = found.select(*SENTENCE, "mention", F.col("start_offset").alias("p_first"), F.col("end_offset").alias("p_last"), F.col("ner_label").alias("tag"))
        matched = p.join(E.match_overlaps(p.select(*SENTENCE, "p_first", "p_last"), gold), [*SENTENCE, "p_first", "p_last"])
        candidates = self.pipeline.select_candidates(matched)
        linked = matched.join(most_popular(candidates), "mention", "left").withColumn("prediction", F.coalesce("prediction", F.lit("NIL")))
        return E.skyline(linked, candidates)

    def report(self, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Span metrics of recognition, and micro metrics of linking."""
        side = lambda c: mentions(tokens.select(*SENTENCE, "tok", "word", F.col(c).alias("entity"), "score", "start", "end")).select(*SENTENCE, F.col("start_offset").alias("first"), F.col("end_offset").alias("last"), F.col("ner_label").alias("tag"))
        pairs = self.mention_table(tokens).select(F.col("gold_qid").alias("gold"), "prediction")
        return E.span_prf(side("entity"), side("gold_tag")), E.micro_prf(pairs)

    def store(self, tokens: DataFrame, path: str) -> None:
        """Scorer files of predictions, gold and skyline."""
        test = self.articles.where(F.col("split") == self.test_split).select("doc_id")
        table = self.mention_table(tokens)
        frames = {"preds": ("entity", "prediction"), "skys": ("entity", "skyline")}
        for name, (tag, qid) in frames.items():
            links = E.write_links(tokens, table.select(*SENTENCE, F.col("p_first").alias("first"), F.col("p_last").alias("last"), F.col(qid).alias("qid")))
            rows = tokens.join(links, [*SENTENCE, "tok"]).select(*SENTENCE, "tok", "word", F.col(tag).alias("tag"), "link")
            write_scorer_file(E.hipe_lines(rows, test), f"{path}/{name}")
        true = tokens.select(*SENTENCE, "tok", "word", F.col("gold_tag").alias("tag"), F.col("gold_link").alias("link"))
        write_scorer_file(E.hipe_lines(true, test), f"{path}/trues")
