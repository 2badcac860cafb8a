"""The pipeline's stages, each against what its operator, or brute force, says of its input."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_near_copies import brute_force
from topograin.llm import decontaminate, quality, queries, secret_scan
from topograin.llm.shared import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = written(stage(spark, docs, sf), name)
        if name != "mixing_sources":
            assert docs.columns == inputs[0].columns
    good, one, clean, redacted, mixed = [*inputs[1:], docs]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    model = queries.quality_model(spark, inputs[0], sf)
    scores = quality.score(inputs[0], model)
    assert ids(good) == ids(scores.where(F.col("score") >= quality.THRESHOLD))
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = ids(good)
    assert sum(d in kept for d, q in labels.items() if q) >= 0.97 * sum(labels.values())
    # five words and 0.8 on their sets, which this stage has instead of the query's four words and four bits
    groups = set(brute_force([(r.doc_id, r.text) for r in good.collect()]).values())
    assert ids(one) == groups and one.count() == len(groups)
    bench = table(spark, sf, "benchmark")
    items = [" ".join(r.text.split()) for r in bench.collect()]
    assert not any(i in " ".join(r.text.split()) for r in clean.collect() for i in items)
    assert ids(one) - ids(clean) == ids(decontaminate.contaminated(one, bench))
    assert ids(redacted) == ids(clean)
    live = {r.doc_id for r in secret_scan.scan(clean).where(F.size("live") > 0).collect()}
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (clean, redacted))
    assert live == {d for d in after if before[d] != after[d]} and all(secret_scan.REDACTED in after[d] for d in live)
    assert ids(mixed) <= ids(redacted) and mixed.where("mix_taken <= 0").count() == 0
    assert ids(corpus_pipeline.run(spark, sf)) == ids(mixed)


NAMES = ["fp", "c", "size", "value", "live", "rank", "target", "position", "text_hash", "k", "taken", "mix_taken", "root", "score", "base", "label", "n", "h", "o", "p", "late"]


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, empty tables, and names that the stages use inside."""
    secret = 'token = "0123456789abcdef0123456789abcdef01234567" '
    texts = ["", None, " \n", "word " * 60_000, secret + "The story of the day was long and it was told by all of them. " * 5, "It was the best of times and the worst of times for one and all here.", "It was the best of times and the worst of times for one and all here.", "x"]
    rows = [(i, t, "en", "s" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *[1] * len(NAMES)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this kind is in any of the documents of the table"), (None, None)], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / "odd" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    for folder in ("odd", "none"):
        sf = str(tmp_path / folder)
        for name, stage in corpus_pipeline.STAGES:
            for given in (docs, docs.limit(0)):
                out = stage(spark, given, sf)
                found = out.collect()
                if name != "mixing_sources":
                    assert out.columns == docs.columns
                if given is not docs:
                    assert found == []
                    continue
                ids = sorted((r.doc_id is None, r.doc_id or 0) for r in found)
                if name == "simhash_near_dedup":
                    # blank texts are one group, the equal ones another
                    assert ids == [(False, i) for i in (0, 3, 4, 5, 7)]
                elif name in ("benchmark_decontamination", "secret_scans"):
                    assert len(found) == docs.count()
                if name == "secret_scans":
                    assert all(secret_scan.REDACTED in r.text and "0123456789abcdef" not in r.text and r.n_chars == len(r.text) for r in found if r.doc_id == 4)
                    assert sum(r.doc_id == 4 for r in found) == 3
                if name == "mixing_sources":
                    assert all(0 < r.mix_taken <= 2 * len(r.text.split()) and 0 <= r.mix_position <= 1 for r in found)
