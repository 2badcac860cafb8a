"""Resolution of a stream of texts: a stateless plan against static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.candidates import only_new
from ..operators.linking import with_place
from ..plans.pipeline import Pipeline


def stream_names(texts: DataFrame, pipeline: Pipeline) -> DataFrame:
    """A stream (doc_id, text) to its exact names with entities: every capitalised name joins a static
    table of best entities, so that no state is kept and batches may be of any size."""
    from ..functions.text import sentences
    from ..operators.linking import most_popular
    from ..sources.kb import NAME

    best = most_popular(pipeline.kb.select("mention", F.col("mention").alias("variation"), "qid", "n"))
    static = with_place(best, pipeline.gazetteer, pipeline.classes)
    rows = texts.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent_idx", "sentence"))
    named = rows.select("doc_id", "sent_idx", F.explode(F.regexp_extract_all("sentence", F.lit(NAME), F.lit(0))).alias("mention"))
    return named.join(static, "mention", "left")


def resolve_stream(texts: DataFrame, pipeline: Pipeline, path: str, checkpoint: str) -> StreamingQuery:
    """The whole pipeline over each micro-batch, appended as Parquet under path; a batch that is run
    again after a failure overwrites its own folder, so each text is resolved once."""

    def batch(rows: DataFrame, number: int) -> None:
        pipeline.run(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ask_new_only(queries: DataFrame, memo: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Candidates of queries that the memo (mention, ..., qid) lacks; append them to it."""
    return pipeline.select_candidates(only_new(queries, memo).withColumn("tag", F.lit("LOC")))
