"""The resolution pipeline: texts to sentences, mentions, candidates, and entities with coordinates.

Three set-at-a-time stages, each usable alone: recognition is local to a row, candidate
selection runs once over the distinct mentions, and linking joins back. A sentence or a text is
the same plan over one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..operators import candidates as C
from ..operators import linking as L
from ..operators.disambiguation import Weights
from ..operators.mentions import explode_tokens, mentions, with_context
from ..operators.training import reldisamb
from ..sources.tables import spread, written

Tagger = Callable[[Column], Column]


def rule_tagger(sentence: Column) -> Column:
    """Tokens of a sentence, runs of capitalised words tagged as locations; it stands where a
    trained tagger can be plugged in, and is built-in functions only."""
    words = F.split(sentence, " ")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("cap"), F.array().cast(f"array<{K.TOKEN}>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        bare = F.regexp_replace(w, r"[^\p{L}\p{N}’'\-]+$", "")
        cap = bare.rlike(r"^\p{Lu}")
        tag = F.when(~cap, "O").when(acc["cap"], "I-LOC").otherwise("B-LOC")
        token = F.struct(bare.alias("word"), tag.alias("entity"), F.lit(1.0).alias("score"), acc["at"].alias("start"), (acc["at"] + F.length(bare)).alias("end"))
        goes_on = cap & (bare == w)  # punctuation after a word ends its run
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), goes_on.alias("cap"), F.when(bare == "", acc["out"]).otherwise(F.array_append(acc["out"], token)).alias("out"))

    return F.aggregate(words, begin, step, lambda acc: acc["out"])


@dataclass
class Ranker:
    """How mentions meet names: perfectmatch, partialmatch, levenshtein or vectors."""

    method: str = "perfectmatch"
    vectors: DataFrame | None = None
    metric: str = "l2"
    threshold: float = 50.0
    num_candidates: int = 1

    def rank(self, queries: DataFrame, kb: DataFrame) -> DataFrame:
        """(mention, variation, score) for queries (mention) and kb (mention, ...)."""
        names = kb.select(F.col("mention").alias("name"))
        if self.method == "vectors":
            return self._by_vectors(queries, names)
        return C.fuzzy_match(queries, names, self.method)

    def _by_vectors(self, queries: DataFrame, names: DataFrame) -> DataFrame:
        """Exact matches, else the nearest names by vectors (string, vec_id, embedding) within the threshold."""
        exact = C.perfect_match(queries, names)
        missed = exact.where("variation is null").select("mention")
        known = self.vectors
        asked = missed.join(known.withColumnRenamed("string", "mention"), "mention").select("vec_id", "embedding")
        pool = names.distinct().join(known.withColumnRenamed("string", "name"), "name")
        near = C.nearest_vectors(asked, pool.select("vec_id", "embedding"), self.num_candidates, self.metric)
        score = C.distance_score(F.col("distance"), self.threshold) if self.metric == "l2" else 1 - F.col("distance")
        ids = known.select(F.col("vec_id").alias("query_id"), F.col("string").alias("mention"))
        found = near.join(ids, "query_id").join(pool.select("vec_id", F.col("name").alias("variation")), "vec_id").select("mention", "variation", score.alias("score")).where("score is not null")
        hit = exact.where("variation is not null").unionByName(found)
        return queries.select("mention").distinct().join(hit, "mention", "left")


@dataclass
class Linker:
    """How candidates become one entity: mostpopular, bydistance, reldisamb (with the collective model's
    weights and its store of vectors), or a function of mentions and candidates to (doc_id, sent_idx,
    pos, mention, prediction, ed_score)."""

    method: str | Callable[[DataFrame], DataFrame] = "mostpopular"
    without_microtoponyms: bool = False
    default_place: str = L.DEFAULT_PLACE
    default_qid: str = L.DEFAULT_QID
    weights: Weights | None = None
    store: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.method == "reldisamb":
            if self.weights is None or self.store is None:
                raise ValueError("reldisamb needs weights and a store of vectors")
            self.method = reldisamb(self.weights, self.store)


@dataclass
class Pipeline:
    """kb: (mention, qid, n, relv); gazetteer: (qid, lat, lon); classes: (qid, class_qid)."""

    kb: DataFrame
    gazetteer: DataFrame
    classes: DataFrame
    ranker: Ranker = field(default_factory=Ranker)
    linker: Linker = field(default_factory=Linker)
    tagger: Tagger = rule_tagger
    drop_noise: bool = False

    def sentences(self, documents: DataFrame) -> DataFrame:
        """(doc_id, sent_idx, sentence, prev, next, place, place_wqid) from (doc_id, text[, place, place_wqid])."""
        rows = documents
        for c in ("place", "place_wqid"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(""))
        split = rows.select("doc_id", "place", "place_wqid", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))
        return with_context(split.where("sentence <> ''"))

    def recognise(self, sentences: DataFrame) -> DataFrame:
        """Mentions of sentences (doc_id, sent_idx, sentence, ...), with what their rows hold."""
        tagged = spread(sentences).withColumn("clean", T.normal_dashes(F.col("sentence"))).where("clean is not null")
        tagged = tagged.withColumn("tokens", K.repair(self.tagger(F.col("clean")), F.col("clean")))
        keep = [c for c in sentences.columns if c not in ("doc_id", "sent_idx")]
        # a sentence's mentions are found by its row alone: all that it holds goes along as one value
        tagged = tagged.withColumn("row", F.struct(*keep))
        found = mentions(explode_tokens(tagged, ["doc_id", "sent_idx", "row"]), ["doc_id", "sent_idx", "row"])
        if self.drop_noise:
            found = found.where(T.is_mention(F.col("mention")))
        return found.select("doc_id", "sent_idx", "mention", F.col("ner_label").alias("tag"), F.col("start_char").alias("pos"), F.col("end_char").alias("end_pos"), "start_offset", "end_offset", "ner_score", "row.*")

    def select_candidates(self, found: DataFrame) -> DataFrame:
        """(mention, variation, score, qid, relv, n) for the distinct mentions."""
        asked = found.where("tag = 'LOC'") if self.linker.without_microtoponyms else found
        matched = self.ranker.rank(asked.select("mention").distinct(), self.kb)
        counts = self.kb.select(F.col("mention").alias("variation"), "qid", "n")
        return C.find_candidates(matched, self.kb).join(counts, ["variation", "qid"], "left").select("mention", "variation", "score", "qid", "relv", "n")

    def link(self, found: DataFrame, candidates: DataFrame) -> DataFrame:
        """Mentions with prediction, ed_score, lat, lon and wkdt_class; NIL for those without candidates."""
        if callable(self.linker.method):
            predicted = self.linker.method(found, candidates)
            key = ["doc_id", "sent_idx", "pos", "mention"]
        elif self.linker.method == "mostpopular":
            predicted, key = L.most_popular(candidates), ["mention"]
        elif self.linker.method == "bydistance":
            key = ["mention", "origin_qid"]
            place = F.when(F.coalesce("place_wqid", F.lit("")) == "", self.linker.default_qid).otherwise(F.col("place_wqid"))
            found = found.withColumn("origin_qid", place)
            # each pair of mention and origin is decided once
            asked = found.select("mention", "origin_qid").distinct().withColumn("k", F.concat_ws("\x01", "mention", "origin_qid"))
            out = L.by_distance(asked.join(candidates, "mention").select("k", "variation", "score", "qid", "relv"), self.gazetteer, asked.select("k", "origin_qid"), "k")
            predicted = asked.join(out, "k").select("mention", "origin_qid", "prediction", "ed_score")
        else:
            raise ValueError(f"unknown linking method {self.linker.method!r}")
        linked = found.join(predicted, key, "left").withColumns({"prediction": F.coalesce("prediction", F.lit("NIL")), "ed_score": F.coalesce(F.round("ed_score", 3), F.lit(0.0))})
        return L.with_place(linked, self.gazetteer, self.classes)

    def run(self, documents: DataFrame) -> DataFrame:
        # mentions are few against texts and used twice: recognition runs once
        found = written(self.recognise(self.sentences(documents)), "mentions")
        return self.link(found, self.select_candidates(found))

    def run_text(self, text: str, place: str = "", place_wqid: str = "") -> DataFrame:
        return self.run(self._one(text, place, place_wqid))

    def run_sentence(self, sentence: str, sent_idx: int = 0, context: tuple[str, str] = ("", ""), place: str = "", place_wqid: str = "") -> DataFrame:
        rows = self.spark.createDataFrame([("", sent_idx, sentence, *context, place, place_wqid)], "doc_id string, sent_idx int, sentence string, prev string, next string, place string, place_wqid string")
        found = self.recognise(rows)
        return self.link(found, self.select_candidates(found))

    def run_text_recognition(self, text: str, place: str = "", place_wqid: str = "") -> DataFrame:
        """The mentions of a text, without those that are noise."""
        return self.recognise(self.sentences(self._one(text, place, place_wqid))).where(T.is_mention(F.col("mention")))

    run_candidate_selection = select_candidates
    run_disambiguation = link

    @property
    def spark(self) -> SparkSession:
        return self.kb.sparkSession

    def _one(self, text: str, place: str, place_wqid: str) -> DataFrame:
        return self.spark.createDataFrame([("", text, place, place_wqid)], "doc_id string, text string, place string, place_wqid string")

    def describe(self) -> str:
        method = self.linker.method if isinstance(self.linker.method, str) else getattr(self.linker.method, "__name__", "custom")
        return f"Pipeline(ranker={self.ranker.method}, linker={method}, microtoponyms={not self.linker.without_microtoponyms}, noise_filter={self.drop_noise})"


def output(linked: DataFrame) -> DataFrame:
    """The public columns of resolved mentions."""
    latlon = F.when(F.col("lat").isNotNull(), F.array("lat", "lon"))
    return linked.select("doc_id", "sent_idx", "mention", "pos", "end_pos", "tag", "prediction", "ner_score", "ed_score", "sentence", latlon.alias("latlon"), "wkdt_class")
