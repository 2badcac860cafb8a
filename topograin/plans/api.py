"""Request handlers over a pipeline: plain functions from request bodies to JSON-ready values.

They serve single requests; corpora go through Pipeline.run.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .pipeline import Pipeline, output

EXAMPLE = "The mail coach from Exeter reached Plymouth before noon on Tuesday."


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


@dataclass
class Api:
    pipeline: Pipeline

    def root(self) -> dict:
        return {"title": "topograin", "pipeline": self.pipeline.describe()}

    def health(self) -> dict:
        return {"status": "ok"}

    def test(self) -> list[dict]:
        return self.resolve_sentence({"text": EXAMPLE})

    def resolve_sentence(self, body: dict) -> list[dict]:
        return _rows(output(self.pipeline.run_sentence(body["text"], place=body.get("place") or "", place_wqid=body.get("place_wqid") or "")))

    def resolve_full_text(self, body: dict) -> list[dict]:
        return _rows(output(self.pipeline.run_text(body["text"], body.get("place") or "", body.get("place_wqid") or "")))

    def run_ner(self, body: dict) -> list[dict]:
        return _rows(self.pipeline.run_text_recognition(body["text"], body.get("place") or "", body.get("place_wqid") or ""))

    def run_candidate_selection(self, body: dict) -> dict[str, dict]:
        asked = self.pipeline.spark.createDataFrame([(t, "LOC") for t in body["toponyms"]], "mention string, tag string")
        out: dict[str, dict] = {t: {} for t in body["toponyms"]}
        for r in self.pipeline.select_candidates(asked).where("qid is not null").collect():
            out[r.mention].setdefault(r.variation, {"Score": r.score, "Candidates": {}})["Candidates"][r.qid] = r.relv
        return out

    def run_disambiguation(self, body: dict) -> list[dict]:
        """body: dataset, the rows of run_ner, and wk_cands, the result of run_candidate_selection."""
        spark, place, qid = self.pipeline.spark, body.get("place") or "", body.get("place_wqid") or ""
        keys = ("doc_id", "sent_idx", "mention", "tag", "pos", "end_pos", "ner_score", "sentence")
        found = spark.createDataFrame([(*(d.get(k) for k in keys), d.get("place") or place, d.get("place_wqid") or qid) for d in body["dataset"]], "doc_id string, sent_idx int, mention string, tag string, pos int, end_pos int, ner_score double, sentence string, place string, place_wqid string")
        rows = [(m, v, float(c["Score"]), q, float(r)) for m, vs in body["wk_cands"].items() for v, c in vs.items() for q, r in c["Candidates"].items()]
        given = spark.createDataFrame(rows, "mention string, variation string, score double, qid string, relv double")
        counts = self.pipeline.kb.selectExpr("mention as variation", "qid", "n")
        return _rows(output(self.pipeline.link(found, given.join(counts, ["variation", "qid"], "left"))))
