"""Training of the final network, kept weights, the linking method and the server."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F
from topograin.operators import disambiguation as D
from topograin.operators import training as R
from topograin.plans.api import Api
from topograin.plans.pipeline import Linker, Pipeline, Ranker, output
from topograin.plans.server import answer, serve

CONFIG = D.Config(dim=8, hidden=6, candidates=3)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x, mask = rng.normal(size=(n, 3, 2)), np.ones((n, 3), bool)
    mask[::4, 2] = False
    # what is right is the greater prior, against the belief
    return x, mask, np.where(mask, x[..., 1] - 0.5 * x[..., 0], -np.inf).argmax(axis=1)


def test_margin_gradient_is_numeric():
    w = D.Weights.seeded(CONFIG)
    w.config.margin = 0.3
    x, mask, gold = sample(12, 1)
    _, grad = R.margin_loss(x, mask, gold, w)
    for name, at in (("w1", (0, 2)), ("w1", (1, 4)), ("b1", (3,)), ("w2", (1,)), ("w2", (5,))):
        a = getattr(w, name)
        was, sides = a[at], []
        for step in (1e-6, -1e-6):
            a[at] = was + step
            sides.append(R.margin_loss(x, mask, gold, w)[0])
        a[at] = was
        assert grad[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-3, abs=1e-7)


def test_training_learns_and_keeps_the_best():
    w = D.Weights.seeded(CONFIG)
    x, mask, gold = sample(400, 2)
    dev = np.arange(400) % 4 == 0
    before = R.accuracy(x[dev], mask[dev], gold[dev], w)
    made, f1 = R.train(x, mask, gold, dev, w, epochs=400, rate=0.02)
    assert f1 > before + 0.3 and f1 > 0.85 and R.accuracy(x[dev], mask[dev], gold[dev], made) == f1
    for none in (np.zeros(400, bool), np.ones(400, bool)):
        assert R.train(x, mask, gold, none, w)[0] is w


def tables(spark):
    kb = spark.createDataFrame([("London", "Q84", 90, 0.9), ("London", "Q92561", 10, 0.1), ("Paris", "Q90", 70, 0.7), ("Paris", "Q830149", 30, 0.3)], "mention string, qid string, n long, relv double")
    places = spark.createDataFrame([("Q84", 51.5, -0.1), ("Q92561", 42.9, -81.2), ("Q90", 48.8, 2.3), ("Q830149", 33.6, -95.5)], "qid string, lat double, lon double")
    kinds = spark.createDataFrame([("Q84", "Q515")], "qid string, class_qid string")
    rng = np.random.default_rng(3)
    names = ["ENTITY/Q84", "ENTITY/Q92561", "ENTITY/Q90", "mail", "road", "went"]
    store = spark.createDataFrame([(n, [float(v) for v in rng.normal(size=8)]) for n in names], "word string, emb array<float>")
    return kb, places, kinds, store


def test_reldisamb_links_every_mention(spark, tmp_path):
    kb, places, kinds, store = tables(spark)
    with pytest.raises(ValueError):
        Linker("reldisamb")
    weights = D.Weights.seeded(CONFIG)
    pipeline = Pipeline(kb, places, kinds, Ranker("perfectmatch"), Linker("reldisamb", weights=weights, store=store))
    docs = spark.createDataFrame([(1, "He went to London by the mail road. Then he came to Paris and to Nowhere."), (2, "They saw London."), (3, None)], "doc_id long, text string")
    rows = output(pipeline.run(docs)).where("mention in ('London', 'Paris', 'Nowhere')").collect()
    got = {(r.doc_id, r.mention): (r.prediction, r.ed_score) for r in rows}
    assert set(got) == {(1, "London"), (1, "Paris"), (1, "Nowhere"), (2, "London")} and got[1, "Nowhere"] == ("NIL", 0.0)
    assert got[1, "London"][0] in ("Q84", "Q92561") and 0.3 < got[1, "London"][1] <= 1
    assert "reldisamb" in pipeline.describe()


def test_weights_are_loaded_or_trained(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(d, m, k + 1, f"Q{k}", float(rng.random()), [float(v) for v in rng.normal(size=8)], [[float(v) for v in rng.normal(size=8)]]) for d in range(12) for m in range(2) for k in range(3)]
    items = spark.createDataFrame(rows, "doc_id long, mention_no long, rank int, qid string, prior double, emb array<double>, words array<array<double>>")
    best = items.groupBy("doc_id", "mention_no").agg(F.max_by("qid", "prior").alias("gold"))
    gold = best.withColumn("split", F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("train")).union(spark.createDataFrame([(0, 0, "Q9", "train")], "d long, m long, g string, s string"))
    weights, path, asked = D.Weights.seeded(CONFIG), str(tmp_path / "model"), []
    load = lambda **more: R.load_or_train(spark, path, lambda: asked.append(1) or items, lambda: gold, weights, epochs=50, rate=0.02, **more)
    made = load()
    again = load()
    assert len(asked) == 1 and made.config == again.config
    assert all(np.array_equal(getattr(made, k), getattr(again, k)) for k in ("attention", "relation", "mention", "w1", "b1", "w2", "b2"))
    load(overwrite=True)
    assert len(asked) == 2
    x, mask, place, dev = R.labelled(items, gold, weights)
    assert len(x) == 24 and dev.sum() == 8 and mask.all()
    assert R.accuracy(x[dev], mask[dev], place[dev], made) >= R.accuracy(x[dev], mask[dev], place[dev], weights)
    assert len(R.labelled(items, gold, weights, mentions=5)[0]) == 5
    assert len(R.labelled(items.limit(0), gold, weights)[0]) == 0


def test_server_routes(spark):
    kb, places, kinds, _ = tables(spark)
    api = Api(Pipeline(kb, places, kinds))
    assert answer(api, "/nothing", b"")[0] == 404 and answer(api, "/run_ner", b"[1]")[0] == 422 and answer(api, "/run_ner", b"{")[0] == 422
    server = serve(api, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(at + path, data=data), timeout=120) as r:
            return json.loads(r.read())

    try:
        assert ask("/health") == {"status": "ok"} and ask("/")["title"] == "topograin"
        assert [r["prediction"] for r in ask("/resolve_sentence", {"text": "He went to London."}) if r["mention"] == "London"] == ["Q84"]
        found = ask("/run_ner", {"text": "He went to London."})
        candidates = ask("/run_candidate_selection", {"toponyms": ["London"]})
        assert candidates["London"]["London"]["Candidates"] == {"Q84": 0.9, "Q92561": 0.1}
        linked = ask("/run_disambiguation", {"dataset": found, "wk_cands": candidates})
        assert [r["prediction"] for r in linked if r["mention"] == "London"] == ["Q84"]
        with pytest.raises(urllib.error.HTTPError, match="422"):
            ask("/resolve_full_text", {})
    finally:
        server.shutdown()
        server.server_close()
