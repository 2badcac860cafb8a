"""Article tables from annotated files."""

from pyspark.sql import functions as F
from topograin.functions.similarity import gram_vector
from topograin.operators.candidates import nearest_vectors
from topograin.plans.experiment import load, model_name, save
from topograin.sources import annotated as A
from topograin.sources import datasets as D


def test_lwm_articles(spark, tmp_path):
    (tmp_path / "10_a.tsv").write_text("1-1\t0-4\tNear\t_\t_\n1-2\t5-8\tRye\thttps://en.wikipedia.org/wiki/Rye,\\_England[1]\tLOC[1]\n1-3\t8-9\t.\t_\t_\n2-1\t10-15\tDover\thttps://en.wikipedia.org/wiki/Nowhere[2]\tLOC[2]\n2-2\t16-20\tRoad\thttps://en.wikipedia.org/wiki/Nowhere[2]\tLOC[2]\n")
    meta = spark.createDataFrame([("10_a", "Poole", "1855-01-02", 0.9, 0.1, "Herald", "47")], "fname string, place_publication string, issue_date string, ocr_quality_mean double, ocr_quality_sd double, publication_title string, publication_code string")
    titles = spark.createDataFrame([("Rye,_England", "rye,_england", "Q7"), ("Nowhere", "nowhere", "Q8")], "wikipedia_title string, lower_wikipedia_title string, wikidata_id string")
    gaz = spark.createDataFrame([("Q7",)], "qid string")
    articles = D.lwm_articles(A.read_lines(spark, str(tmp_path / "10_a.tsv")), meta, titles, gaz)
    r = articles.first()
    assert (r.article_id, r.place, r.decade, r.year, r.publication_code) == ("10", "Poole", 1850, 1855, "0000047")
    assert [(s.sentence_pos, s.sentence_text) for s in r.sentences] == [(1, "Near Rye. "), (2, "Dover Road")]
    assert [(a.mention_pos, a.mention, a.wkdt_qid, a.mention_start, a.mention_end, a.sent_pos) for a in r.annotations] == [(0, "Rye", "Q7", 5, 8, 1), (1, "Dover Road", "NIL", 0, 10, 2)]
    items = {x.mention: x for x in D.training_items(articles).collect()}
    assert (items["Rye"].prev, items["Rye"].next, items["Dover Road"].prev) == ("", "Dover Road", "Near Rye. ")
    pubs = spark.createDataFrame([("0000047", "Q9")], "code string, wikidata_qid string")
    assert D.with_publication_place(articles, pubs).first().place_wqid == "Q9"
    rows = A.ner_rows(A.webanno_tokens(A.read_lines(spark, str(tmp_path / "10_a.tsv"))))
    assert {r.id: r.ner_tags for r in rows.collect()}["10_a.tsv_2"] == ["B-LOC", "I-LOC"]


def test_hipe_articles(spark, tmp_path):
    line = lambda w, t, m, q, misc: "\t".join([w, t, m, "O", "O", "O", "O", q, "_", misc])
    (tmp_path / "h.tsv").write_text("\n".join(["# hipe2022:document_id = d1", line("At", "O", "O", "_", "_"), line("Rye", "B-loc", "O", "Q7", "NoSpaceAfter"), line(",", "O", "O", "_", "_"), line("Times", "B-prod", "O", "Q5", "_"), line("House", "B-org", "B-loc", "Q6", "EndOfSentence"), line("So", "O", "O", "_", "_")]))
    r = D.hipe_articles(A.read_lines(spark, str(tmp_path / "h.tsv")), spark.createDataFrame([("Q7",)], "qid string")).first()
    assert [s.sentence_text for s in r.sentences] == ["At Rye, Times House", "So"]
    assert [(a.mention, a.wkdt_qid, a.mention_start) for a in r.annotations] == [("Rye", "Q7", 3), ("House", "NIL", 14)]


def test_split_columns_are_disjoint(spark):
    df = spark.range(900).withColumnRenamed("id", "article_id")
    rows = D.split_columns(df, F.col("article_id") % 4 == 0).collect()
    assert {r.originalsplit for r in rows if r.article_id % 4 == 0} == {"test"} and {r.withouttest for r in rows if r.article_id % 4 == 0} == {"left_out"}
    assert all((r.withouttest == "test") == (r.originalsplit == "dev") for r in rows)
    assert 0.25 < sum(r.originalsplit == "dev" for r in rows) / 675 < 0.42


def test_cache_and_names(spark, tmp_path):
    save({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path))
    assert load(spark, ["a", "b"], str(tmp_path))["a"].count() == 3 and load(spark, ["a", "c"], str(tmp_path)) == {}
    assert model_name("vectors", "originalsplit") == "vectors+1+50_originalsplit+wpubl+wmtops" and model_name("perfectmatch", "x", False, False, True) == "perfectmatch_x_test"


def test_gram_vectors_match_spellings(spark):
    df = spark.createDataFrame([(1, "London"), (2, "Lvndon"), (3, "Manchester"), (4, "L")], "vec_id long, s string").select("vec_id", "s", gram_vector(F.col("s")).alias("embedding"))
    near = nearest_vectors(df.where("vec_id = 2"), df, 1).first()
    assert near.vec_id == 1
