"""Golden cases and invariants of single operators."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from topograin.functions import similarity as S
from topograin.functions import text as T
from topograin.functions import tokens as K
from topograin.operators import candidates as C
from topograin.operators import disambiguation as D
from topograin.operators import evaluation as E
from topograin.operators import linking as L
from topograin.operators import mentions as M
from topograin.operators import pair_mining, splits
from topograin.plans.api import Api
from topograin.plans.experiment import Experiment, scenarios
from topograin.plans.pipeline import Linker, Pipeline, Ranker, output
from topograin.sources import annotated as A
from topograin.sources import kb as KB
from topograin.sources import sinks, tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_edit_similarity():
    assert S.osa_similarity("Lvndon", "London") == 0.8333333283662796
    assert S.osa_similarity("uityity", "asdasd") == 0.0
    assert S.osa_similarity("apple", "orange") == 0.1666666865348816
    assert (S.osa_distance("ca", "abc"), S.osa_distance("ab", "ba"), S.osa_distance("", "é")) == (3, 1, 1)
    rng = random.Random(0)
    some = ["", "é"] + ["".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(60)]
    for a in some:
        assert S.osa_distances(a, some).tolist() == [S.osa_distance(a, b) for b in some]
    assert S.osa_distances("ab", ["", ""]).tolist() == [2, 2] and not len(S.osa_distances("ab", []))


def test_shared_folder_is_not_local_on_a_cluster():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    unset = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(unset)


def test_containment(spark):
    f = lambda a, b: one(spark, S.containment(F.col("a"), F.col("b")), a=a, b=b)
    assert f("New York", "New York City") == f("New York City", "New York") == 0.6153846153846154
    assert f("London", "New York") is None and f("apple", "Delicious apple") == 0.3333333333333333


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def asked(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "mention string")


def found(df):
    return {(r.mention, r.variation): r.score for r in df.collect()}


def test_matching(spark):
    f = lambda q, n, m: found(C.fuzzy_match(asked(spark, *q), names(spark, *n), m))
    assert f(["London", "Lvndon"], ["London"], "perfectmatch") == {("London", "London"): 1.0, ("Lvndon", None): None}
    assert f(["Lvndvn"], ["London"], "levenshtein") == {("Lvndvn", "London"): 0.6666666567325592}
    assert f(["asdasd"], ["New York City"], "levenshtein") == {("asdasd", "New York City"): 0.0}
    assert f(["Lvndvn"], ["New York City"], "partialmatch") == {("Lvndvn", None): None}
    assert set(f(["New York"], ["New York City", "New York Hill", "York"], "partialmatch")) == {("New York", "New York City"), ("New York", "New York Hill")}
    with pytest.raises(ValueError):
        f(["a"], ["b"], "guess")


def test_blocked_matching_is_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abA c") for _ in range(rng.randint(1, 7)))
    qs, ns = {word() for _ in range(60)}, {word() for _ in range(80)}
    low = str.lower
    want = {(q, n): len(q) / len(n) if low(q) in low(n) else len(n) / len(q) for q in qs for n in ns if low(q) in low(n) or low(n) in low(q)}
    assert found(C.contained_pairs(asked(spark, *qs), names(spark, *ns))) == pytest.approx(want)
    best = {q: max(S.osa_similarity(q, n) for n in ns) for q in qs}
    want = {(q, n): best[q] for q in qs for n in ns if S.osa_similarity(q, n) == best[q]}
    for block in (20_000, 17):
        assert found(C.nearest_names(asked(spark, *qs), names(spark, *ns), block)) == want


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(4)
    for metric, dist in (("l2", lambda a, b: np.linalg.norm(a - b)), ("cosine", lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))):
        for block in (4096, 5):
            got = C.nearest_vectors(df.where("vec_id % 10 = 0"), df, 4, metric, block).collect()
            for q in range(0, 60, 10):
                want = sorted((dist(x[q], x[i]), i) for i in range(60) if i != q)[:4]
                assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in want]


def test_linkers(spark):
    c = spark.createDataFrame([("m", "v", 0.397048, "Q84", 0.9, 76), ("m", "v", 0.397048, "Q1", 0.1, 4), ("none", None, None, None, None, None)], "mention string, variation string, score double, qid string, relv double, n long")
    got = {r.mention: (r.prediction, r.ed_score) for r in L.most_popular(c).collect()}
    assert got == {"m": ("Q84", 0.95), "none": ("NIL", 0.0)}
    shares = {r.qid: r.score for r in L.popularity(c).collect()}
    assert sum(shares.values()) == pytest.approx(1)
    gaz = spark.createDataFrame([("Q84", 51.5, -0.1), ("Q1", 40.0, -74.0), ("bad", 99.0, 0.0)], "qid string, lat double, lon double")
    at = lambda q: spark.createDataFrame([("m", q), ("none", q)], "mention string, origin_qid string")
    got = {r.mention: (r.prediction, r.ed_score) for r in L.by_distance(c, gaz, at("Q84")).collect()}
    assert got == {"m": ("Q84", 0.824), "none": ("NIL", 0.0)}
    for q in ("bad", "unknown"):
        assert {r.prediction for r in L.by_distance(c, gaz, at(q)).collect()} == {"NIL"}


def test_haversine(spark):
    d = one(spark, S.haversine(*[F.col(c) for c in "abcd"]), a=45.7597, b=4.8422, c=48.8567, d=2.3508)
    assert d == pytest.approx(392.2172595594006, rel=1e-9)


def test_priors_publication_and_output(spark):
    c = spark.createDataFrame([("m", "Q10", 4, 0.5, 0.8), ("m", "Q9", 2, 0.5, 0.0)], "mention string, qid string, n long, relv double, sel double")
    got = {r.qid: (r.prior, r["rank"]) for r in L.prior_scores(c).collect()}
    assert got == {"Q10": (pytest.approx((1 + 0.65) / 2 * 0.9, abs=1e-3), 1), "Q9": (pytest.approx((0.5 + 0.5) / 2 * 0.9, abs=1e-3), 2)}
    p = L.publication_mentions(spark.createDataFrame([("d", "Poole", ""), ("e", "Poole", "Q2")], "doc_id string, place string, place_wqid string")).collect()
    assert [(r.mention, r.qid, r.pos, r.end_pos - r.pos) for r in p] == [("United Kingdom", "Q145", 29, 29 + 15), ("Poole", "Q2", 29, 29 + 6)]
    scores = one(spark, L.normalise_cross(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))), a="x")
    assert scores == pytest.approx([0, 2 / 3, 1 / 3]) and one(spark, L.normalise_cross(F.array(F.lit(1.0), F.lit(1.0))), a="x") == [0, 0]


def test_wiki_links(spark):
    f = lambda u, g=T.wiki_link: one(spark, g(F.col("u")), u=u)
    assert f("Havannah%2C_Cheshire") == f("Havannah%2C%20Cheshire")
    assert f("New_York") == "new%20york"
    assert f("Python_(programming_language)#Overview") == "python%20%28programming%20language%29"
    assert f("New York City", T.wiki_title) == "new_york_city" and f("a+b~c/d*") == "a%2Bb~c/d%2A" and f("100%") == "100%25"


def test_text_functions(spark):
    s = "Mr. Smith of St. Albans came. He left! \"Did he?\" Yes (he did.) No. 5 is it"
    assert one(spark, T.sentences(F.col("s")), s=s) == ["Mr. Smith of St. Albans came.", "He left!", "\"Did he?\"", "Yes (he did.)", "No. 5 is it"]
    assert [one(spark, T.normal_dashes(F.col("s")), s=x) for x in ("", " ", "—a—b")] == [None, None, "—a,b"]
    assert [one(spark, T.is_mention(F.col("s")), s=x) for x in ("a", "ab1", "12", "Ab")] == [False, False, True, True]
    assert [one(spark, T.is_important(F.col("s")), s=x) for x in ("the", "with", "1850", "1850d", "1_000", "1e5", "Town", "With")] == [False, False, False, True, False, False, True, False]
    assert one(spark, T.context_words(F.col("s")), s="It's a well-known, (old) town.") == ["It's", "a", "well-known", "old", "town"]


def tok(*rows):
    return [(w, e, s, a, b) for w, e, s, a, b in rows]


def fold(spark, f, rows):
    df = spark.createDataFrame([(tok(*rows),)], f"t array<{K.TOKEN}>")
    return [tuple(x) for x in df.select(f(F.col("t")).alias("t")).first().t]


def test_token_repairs(spark):
    rows = [("Lon", "B-LOC", 0.8, 0, 3), ("##don", "O", 0.6, 3, 6), ("##x", "O", 0.5, 6, 7), ("is", "O", 1.0, 8, 10)]
    assert fold(spark, K.join_pieces, rows) == [("Londonx", "B-LOC", pytest.approx(0.6), 0, 7), ("is", "O", 1.0, 8, 10)]
    rows = [("Stratford", "B-LOC", 1.0, 0, 9), ("-", "B-LOC", 1.0, 9, 10), ("on", "B-LOC", 1.0, 10, 12), ("x", "O", 1.0, 13, 14), ("-", "B-LOC", 1.0, 14, 15)]
    assert [x[1] for x in fold(spark, K.fix_connectors, rows)] == ["B-LOC", "I-LOC", "I-LOC", "O", "B-LOC"]
    rows = [("Isle", "B-LOC", 1.0, 0, 4), ("of", "I-LOC", 1.0, 5, 7), ("Man", "B-STREET", 1.0, 8, 11)]
    assert [x[1] for x in fold(spark, K.fix_nested, rows)] == ["B-LOC", "I-LOC", "I-LOC"]
    rows = [("a", "I-LOC", 1.0, 0, 1), ("b", "I-LOC", 1.0, 2, 3), ("c", "O", 1.0, 4, 5), ("d", "I-X", 1.0, 6, 7), ("e", "I-LOC", 1.0, 8, 9)]
    assert [x[1] for x in fold(spark, K.fix_starts, rows)] == ["B-LOC", "I-LOC", "O", "B-X", "B-LOC"]


def test_every_inside_tag_follows_its_span(spark):
    rng = random.Random(2)
    rows = [(i, [(f"w{j}", rng.choice(["O", "B-LOC", "I-LOC", "I-STREET", "B-STREET"]), 1.0, 3 * j, 3 * j + 2) for j in range(rng.randint(1, 9))]) for i in range(50)]
    df = spark.createDataFrame(rows, f"doc_id int, t array<{K.TOKEN}>").select("doc_id", K.fix_starts(F.col("t")).alias("t"))
    for r in df.collect():
        for p, t in zip([None, *r.t], r.t):
            assert not t.entity.startswith("I-") or p.entity != "O" and p.entity[2:] == t.entity[2:]


def test_spans_and_surfaces(spark):
    rows = [("New", "B-LOC", 0.8, 8, 11), ("York", "I-LOC", 0.6, 13, 17), ("road", "I-STREET", 1.0, 18, 22), ("x", "O", 1.0, 23, 24), ("Rye", "I-LOC", 1.0, 25, 28)]
    df = spark.createDataFrame([("d", 0, rows)], f"doc_id string, sent_idx int, tokens array<{K.TOKEN}>")
    got = M.mentions(M.explode_tokens(df)).orderBy("start_char").collect()
    assert [(r.mention, r.start_offset, r.end_offset, r.start_char, r.end_char, r.ner_score, r.ner_label) for r in got] == [("New  York", 0, 1, 8, 17, 0.7, "LOC"), ("road", 2, 2, 18, 22, 1.0, "STREET"), ("Rye", 4, 4, 25, 28, 1.0, "LOC")]
    assert all(len(r.mention) == r.end_char - r.start_char for r in got)
    assert M.spans(M.explode_tokens(df), continues=True).count() == 2


def test_kb_loading(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"London": {"Q84": 3, "Q9": 1}, "London, UK": {"Q84": 1}, "Rye (town)": {"Q7": 2}}')
    (tmp_path / "g.csv").write_text("wikidata_id,english_label,latitude,longitude\nQ84,London,51.5,-0.1\n")
    (tmp_path / "k.txt").write_text('{"Q84": "Q515"}')
    counts = KB.read_counts(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in KB.load_kb(counts).select("mention", "qid", "relv", "n").collect()} == {("London", "Q84", 0.75, 3), ("London", "Q9", 1.0, 1), ("Rye (town)", "Q7", 1.0, 2)}
    assert KB.read_gazetteer(spark, str(tmp_path / "g.csv")).first().lat == 51.5 and KB.read_classes(spark, str(tmp_path / "k.txt")).first().class_qid == "Q515"


def test_annotated_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#FORMAT=WebAnno TSV 3.2\n\n#Text=Near Rye Hill\n1-1\t0-4\tNear\t_\t_\n1-2\t5-8\tRye\thttps://x/wiki/Rye[1]\tLOC[1]\n1-3\t9-13\tHill\thttps://x/wiki/Rye[1]\tLOC[1]\n2-1\t14-17\tRye\t*\tBUILDING\n2-2\t18-19\t.\n")
    got = A.webanno_tokens(A.read_lines(spark, str(tmp_path / "a.tsv"))).orderBy("start").collect()
    assert [(r.sent_idx, r.word, r.entity) for r in got] == [(1, "Near", "O"), (1, "Rye", "B-LOC"), (1, "Hill", "I-LOC"), (2, "Rye", "B-BUILDING"), (2, ".", "O")]
    line = lambda w, t, misc: "\t".join([w, t, "O", "O", "O", "O", "O", "Q1", "_", misc])
    text = ["# hipe2022:document_id = d1", line("At", "O", "_"), line("Rye", "B-loc", "NoSpaceAfter"), line(".", "O", "EndOfSentence"), line("Hill", "I-loc", "_"), line("x", "O", "EndOfSentence"), line("Y", "O", "_"), "# hipe2022:document_id = d2", line("Z", "O", "_")]
    (tmp_path / "h.tsv").write_text("\n".join(text))
    got = A.hipe_tokens(A.read_lines(spark, str(tmp_path / "h.tsv"))).orderBy("doc_id", "sent_idx", "tok").collect()
    assert [(r.doc_id, r.sent_idx, r.word, r.start, r.end) for r in got] == [("d1", 1, "At", 0, 2), ("d1", 1, "Rye", 3, 6), ("d1", 1, ".", 6, 7), ("d1", 1, "Hill", 8, 12), ("d1", 1, "x", 13, 14), ("d1", 2, "Y", 0, 1), ("d2", 1, "Z", 0, 1)]
    df = spark.createDataFrame([("{'a': None}",), ("x y",), (None,)], "s string")
    with pytest.raises(Exception):  # noqa: B017 - broken syntax is an error, as for the literal parser
        df.select(A.literal_json("s")).collect()
    assert [r.x for r in df.where("s is null or s like '{%'").select(A.literal_json("s").alias("x")).collect()] == ['{"a": null}', None]


def test_embeddings(spark):
    store = spark.createDataFrame([("ENTITY/Q1", [1.0]), ("rye", [2.0]), ("#WORD/UNK#", [0.0])], "word string, emb array<float>")
    words = spark.createDataFrame([("Rye",), ("Q1",), ("#SND/UNK#",)], "word string")
    assert {r.word: r.emb for r in A.embeddings_of(words, store, "word").collect()} == {"Rye": [2.0], "Q1": None, "#SND/UNK#": [0.0]}
    assert {r.word: r.emb for r in A.embeddings_of(words, store, "entity").collect()}["Q1"] == [1.0]


def test_disambiguation_follows_prior_and_is_a_distribution():
    rng = np.random.default_rng(0)
    config = D.Config(dim=8, hidden=4, loops=3)
    w = D.Weights.seeded(config)
    entities = rng.normal(size=(3, 7, 8))
    mask = np.ones((3, 7), bool)
    mask[1, 4:] = False
    beliefs = D.propagate(np.where(mask, 0.0, -1e10), entities, mask, D.relation_weights(rng.normal(size=(3, 16)), w), w)
    assert np.allclose(beliefs.sum(axis=1), 1) and (beliefs[1, 4:] < 1e-9).all()
    assert np.allclose(D.relation_weights(rng.normal(size=(3, 16)), w).sum(axis=2), 1)
    scores = D.score_batch(entities, mask, np.where(mask, 0.2, 1e-8), [rng.normal(size=(5, 8)), np.zeros((0, 8)), rng.normal(size=(40, 8))], w)
    assert scores.shape == (3, 7) and (scores[1, 4:] == -1e10).all() and np.exp(D.log_softmax(np.array([1.0, 2.0]))).sum() == pytest.approx(1)


def test_small_helpers():
    assert D.pad([[1, 2, 3], [4, 5], [6, 7, 8, 9]]) == ([[1, 2, 3, 0], [4, 5, 0, 0], [6, 7, 8, 9]], [[1, 1, 1, 0], [1, 1, 0, 0], [1, 1, 1, 1]])
    assert D.pad([[1], [2, 3]], left=True)[0] == [[0, 1], [2, 3]] and D.flatten([[1, 2, 3], [4, 5], [6]]) == ([1, 2, 3, 4, 5, 6], [0, 3, 5])
    v = D.Vocabulary(["A", "-LRB-", "19"], lower=True, zero_digits=True)
    assert (v.id("a"), v.id("("), v.id("20"), v.id("z"), len(v)) == (1, 2, 3, 0, 4)
    assert D.align_labels([None, 0, 0, 1], ["B-LOC", "0"], {"B-LOC": 3}) == [-100, 3, 3, 0]
    assert len({s["name"] for s in scenarios(["lwm"], ["perfectmatch", "levenshtein"], ["mostpopular"])}) == 8


def test_metrics(spark):
    pairs = spark.createDataFrame([("Q1", "Q1"), ("Q2", "Q1"), ("NIL", "NIL"), ("Q3", "NIL")], "gold string, prediction string")
    r = E.micro_prf(pairs).first()
    assert (r.tp, r.n_predicted, r.n_gold, r.n_nil, r.p, r.r, r.f1) == (1, 2, 4, 2, 0.5, 0.25, 0.333)
    assert E.micro_prf(pairs.limit(0)).first().f1 == 0
    mk = lambda *rows: spark.createDataFrame([("d", 0, *x) for x in rows], "doc_id string, sent_idx int, first int, last int, tag string")
    got = {(r.tag, r.regime): r.tp for r in E.span_prf(mk((0, 1, "LOC"), (3, 3, "LOC"), (5, 6, "STREET")), mk((0, 1, "LOC"), (3, 4, "LOC"), (5, 6, "LOC"))).collect()}
    assert [got["ALL", k] for k in ("strict", "exact", "partial", "ent_type")] == [1, 2, 3, 2] and got["STREET", "strict"] == 0


def test_confidence(spark):
    rows = spark.createDataFrame([(x / 10, int(x > 5)) for x in range(11)], "score double, correct int")
    model = D.confidence_model(rows)
    got = {r.score: r.conf for r in D.confidence(rows, model).collect()}
    assert got[1.0] > 0.5 > got[0.0] and D.confidence_model(rows.where("correct = 1")) is None
    assert {r.conf for r in D.confidence(rows, None).collect()} == {0.0}


def test_pairs(spark):
    words = spark.createDataFrame([("london",), ("bridges",), ("stones",)], "word string")
    near = spark.createDataFrame([("london", "lcndon"), ("london", "londons"), ("bridges", "stones"), ("london", "qqqqqq")], "word string, other string")
    got = {(r.s1, r.s2): r.label for r in pair_mining.mine_pairs(near, words, threshold=60).collect()}
    assert got[("london", "lcndon")] is True and ("london", "londons") not in got
    kb = spark.createDataFrame([("Q1", "Saint Albans"), ("Q1", "Saint Alban"), ("Q1", "Verulam")], "qid string, mention string")
    assert [tuple(r) for r in pair_mining.name_pairs(kb).collect()] == [("Saint Alban", "Saint Albans", True)]


def test_splits(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    got = {r.split: r["count"] for r in splits.assign(df, "k").groupBy("split").count().collect()}
    assert abs(got["train"] - 1280) < 100 and abs(got["dev"] - 320) < 80
    few = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    got = {r.k: r.split for r in splits.by_membership(few(1, 2, 3, 4), "k", few(1), few(2), few(3)).collect()}
    assert got == {1: "train", 2: "dev", 3: "test", 4: "left_out"}
    g = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "place string, decade int")
    assert {r.place: r.split for r in splits.group_split(g, ["place", "decade"], ("a", 1), ("b", 1)).collect()} == {"a": "test", "b": "dev", "c": "train"}


@pytest.fixture()
def pipeline(spark):
    counts = spark.createDataFrame([("London", "Q84", 75), ("London", "Q92561", 5), ("Manchester", "Q18125", 9), ("Rye", "Q7", 1)], KB_COUNTS := "mention string, qid string, n long")
    assert KB_COUNTS
    gaz = spark.createDataFrame([("Q84", 51.5, -0.1), ("Q92561", 42.98, -81.2), ("Q18125", 53.5, -2.2)], "qid string, lat double, lon double")
    classes = spark.createDataFrame([("Q84", "Q515")], "qid string, class_qid string")
    return Pipeline(KB.load_kb(counts), gaz, classes)


def test_pipeline(spark, pipeline):
    text = "Harvey, from London; came to Manchester. He saw Rye."
    rows = {r.mention: r for r in output(pipeline.run_text(text)).collect()}
    assert rows["London"].prediction == "Q84" and rows["London"].ed_score == 0.938 and rows["London"].latlon == [51.5, -0.1] and rows["London"].wkdt_class == "Q515"
    assert rows["Rye"].prediction == "Q7" and rows["Rye"].latlon is None and rows["Rye"].sent_idx == 1
    assert rows["Harvey"].prediction == "NIL" and rows["Harvey"].ed_score == 0.0
    assert all(r.sentence[r.pos : r.end_pos] == r.mention for r in rows.values())
    near = Pipeline(pipeline.kb, pipeline.gazetteer, pipeline.classes, Ranker("levenshtein"), Linker("bydistance"))
    rows = {r.mention: r for r in output(near.run_sentence("Harvey, of Lvndon", place="London", place_wqid="Q92561")).collect()}
    assert rows["Lvndon"].prediction == "Q92561"
    assert pipeline.run_sentence("").count() == 0 and pipeline.run_text_recognition("A b.").count() == 0
    with pytest.raises(ValueError):
        Pipeline(pipeline.kb, pipeline.gazetteer, pipeline.classes, linker=Linker("guess")).run_text(text)


def test_vector_ranker(spark, pipeline):
    vectors = spark.createDataFrame([("Lndon", 1, [0.0, 1.0]), ("London", 2, [0.0, 1.1]), ("Manchester", 3, [9.0, 9.0])], "string string, vec_id long, embedding array<double>")
    got = found(Ranker("vectors", vectors, threshold=1.0).rank(asked(spark, "London", "Lndon", "Other"), pipeline.kb))
    assert got == {("London", "London"): 1.0, ("Lndon", "London"): pytest.approx(0.9), ("Other", None): None}


def test_api_steps_agree_with_the_whole(pipeline):
    api = Api(pipeline)
    body = {"text": "He went to London and Manchester."}
    ner = api.run_ner(body)
    cands = api.run_candidate_selection({"toponyms": [m["mention"] for m in ner]})
    steps = api.run_disambiguation({"dataset": ner, "wk_cands": cands})
    whole = [r for r in api.resolve_sentence(body) if r["mention"] != "He"]
    pick = lambda rows: sorted((r["mention"], r["prediction"], r["ed_score"]) for r in rows if r["mention"] != "He")
    assert pick(steps) == pick(whole) and api.health() == {"status": "ok"} and "perfectmatch" in api.root()["pipeline"]
    assert cands["London"]["London"]["Score"] == 1.0 and len(api.test()) > 0 and len(api.resolve_full_text(body)) == 3


def test_experiment(spark, pipeline, tmp_path):
    articles = spark.createDataFrame([("a", "He went to London and Manchester.", "test"), ("b", "Rye.", "train")], "doc_id string, text string, split string")
    gold = spark.createDataFrame([("a", 0, 0, 11, 17, "loc", "Q84"), ("a", 0, 1, 22, 32, "loc", "*")], "doc_id string, sent_idx int, a_pos int, a_start int, a_end int, a_type string, a_link string")
    e = Experiment(pipeline, articles, gold)
    tokens = e.tokens()
    table = {r.mention: r for r in e.mention_table(tokens).collect()}
    assert (table["London"].gold_qid, table["London"].prediction, table["London"].skyline) == ("Q84", "Q84", "Q84") and table["Manchester"].gold_qid == "NIL"
    ner, nel = e.report(tokens)
    assert {(r.regime, r.tp, r.n_predicted, r.n_gold) for r in ner.where("tag = 'ALL'").collect()} == {(k, 2, 3, 2) for k in ("strict", "exact", "partial", "ent_type")}
    assert nel.first().tp == 1
    e.store(tokens, str(tmp_path))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "trues").glob("part-*")))
    assert "London\tB-LOC\tO\tO\tO\tO\tO\tQ84\tO\tO" in text and "Manchester\tB-LOC\tO\tO\tO\tO\tO\tNIL" in text and "# sentence_id = a_0" in text and "Rye" not in text
    assert sinks.latex([{"a": 1, "b": "x_y"}], ["a", "b"]).count(r"\\") == 2


def test_stream(spark, pipeline, tmp_path):
    from topograin.streaming.stream import resolve_stream, stream_names

    spark.createDataFrame([("a", "He went to London."), ("b", "Rye is near.")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    resolve_stream(source(), pipeline, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Q84", "Q7", "NIL"}
    q = stream_names(source(), pipeline).writeStream.format("memory").queryName("names").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.mention, r.prediction) for r in spark.table("names").collect()} >= {("London", "Q84"), ("Rye", "Q7")}
    assert math.isclose(sum(1 for _ in spark.table("names").collect()), 3)
