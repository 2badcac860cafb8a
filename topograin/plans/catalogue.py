"""The catalogue of queries over the test tables, each with the SQL that says the same.

Tables stand in for resources: parts and sales for a knowledge base (name, brand), capitalised
words and sources of documents for another, conversations for tagged sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import tokens as K
from ..operators import candidates as C
from ..operators import disambiguation as D
from ..operators import evaluation as E
from ..operators import linking as L
from ..operators import mentions as M
from ..operators import pair_mining, splits
from ..sources import annotated as A
from ..sources import kb
from ..sources.tables import table
from .pipeline import Pipeline, output

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# knowledge bases

PART_COUNTS = "SELECT p_name AS mention, p_brand AS qid, count(*) AS n FROM part GROUP BY ALL"
SALES_COUNTS = "SELECT p_name AS mention, p_brand AS qid, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
TEXT_COUNTS = r"SELECT mention, qid, count(*) AS n FROM (SELECT source AS qid, unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) AS mention FROM documents) GROUP BY ALL"
NORM = "SELECT mention, qid, n / sum(n) OVER (PARTITION BY qid) AS relv, n FROM counts"
GRID = "SELECT qid, -60.0::DOUBLE + 5 * k AS lat, -170.0::DOUBLE + 14 * k AS lon FROM (SELECT DISTINCT qid, regexp_extract(qid, '(\\d+)$', 1)::INT % 25 AS k FROM counts)"
RADIUS = S.EARTH_KM


def sales(spark: SparkSession, d: str) -> DataFrame:
    return kb.counts_of_sales(table(spark, d, "lineitem"), table(spark, d, "part"))


@query(PART_COUNTS)
def kb_counts_part(spark, d):
    return kb.counts_of_parts(table(spark, d, "part"))


@query(f"WITH counts AS ({SALES_COUNTS}) SELECT mention, qid, round(relv, 9) AS relv FROM ({NORM})")
def kb_normalise_by_entity(spark, d):
    return C.normalise_by_entity(sales(spark, d)).withColumn("relv", F.round("relv", 9))


@query("""WITH names AS (SELECT DISTINCT p_name || CASE p_size % 3 WHEN 0 THEN ', ' || p_type WHEN 1 THEN ' (' || p_type || ')' ELSE '' END AS mention, p_brand || '-' || p_size AS qid FROM part),
    marked AS (SELECT *, NOT (contains(mention, ', ') OR contains(mention, ' (')) AS clean FROM names),
    known AS (SELECT *, bool_or(clean) OVER (PARTITION BY qid) AS has_clean FROM marked)
    SELECT mention, qid FROM known WHERE clean OR NOT has_clean""")
def kb_noise_filter(spark, d):
    tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(", "), "p_type")).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise("")
    names = table(spark, d, "part").select(F.concat("p_name", tail).alias("mention"), F.concat_ws("-", "p_brand", "p_size").alias("qid")).distinct()
    return C.drop_noisy_names(names)


@query("""WITH names AS (SELECT replace(trim(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE upper(p_name[1]) || p_name[2:] END), chr(9), ' ') AS name, p_brand AS qid FROM part),
    own AS (SELECT name, count(DISTINCT qid) AS n_entities FROM names GROUP BY name HAVING length(name) >= 2 AND NOT (name = lower(name) AND name <> upper(name)))
    SELECT name, n_entities FROM own QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY n_entities DESC, name) = 1""")
def kb_name_dedupe_ci(spark, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 20)))
    return C.name_list(table(spark, d, "part").select(name.alias("mention"), F.col("p_brand").alias("qid")))


# names

WORD_QUERIES = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS mention FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_name || ' ' || p_size FROM part"


def word_queries(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.select(F.explode(F.split("p_name", " ")).alias("mention")).union(part.select("p_type")).union(part.select(F.concat_ws(" ", "p_name", "p_size")))
    return rows.distinct()


def part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


def spoken_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(kb.NAME), F.lit(0))).alias("mention"))


SPOKEN = r"SELECT DISTINCT unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) AS mention FROM conversations"


@query(f"WITH counts AS ({TEXT_COUNTS}), asked AS ({SPOKEN}), names AS (SELECT DISTINCT mention AS variation FROM counts) SELECT mention, variation, CASE WHEN variation IS NOT NULL THEN 1.0::DOUBLE END AS score FROM asked LEFT JOIN names ON mention = variation")
def perfect_match(spark, d):
    names = kb.counts_of_texts(table(spark, d, "documents")).select(F.col("mention").alias("name"))
    return C.perfect_match(spoken_names(spark, d), names)


CONTAINED = f"""asked AS ({WORD_QUERIES}), names AS (SELECT DISTINCT p_name AS variation FROM part),
    pairs AS (SELECT mention, variation, CASE WHEN contains(lower(variation), lower(mention)) THEN length(mention) / length(variation) WHEN contains(lower(mention), lower(variation)) THEN length(variation) / length(mention) END AS score FROM asked, names)"""


@query(f"WITH {CONTAINED} SELECT mention, variation, round(score, 9) AS score FROM pairs WHERE score IS NOT NULL")
def containment_score(spark, d):
    return C.contained_pairs(word_queries(spark, d), part_names(spark, d)).withColumn("score", F.round("score", 9))


@query(f"""WITH {CONTAINED}, exact AS (SELECT mention, variation, 1.0::DOUBLE AS score FROM asked JOIN names ON mention = variation),
    best AS (SELECT * FROM pairs WHERE score IS NOT NULL AND mention NOT IN (SELECT mention FROM exact) QUALIFY rank() OVER (PARTITION BY mention ORDER BY score DESC) = 1),
    hit AS (SELECT * FROM exact UNION ALL SELECT * FROM best)
    SELECT mention, variation, round(score, 9) AS score FROM asked LEFT JOIN hit USING (mention)""")
def partial_match_top1(spark, d):
    return C.fuzzy_match(word_queries(spark, d), part_names(spark, d), "partialmatch").withColumn("score", F.round("score", 9))


OSA = "1 - (damerau_levenshtein(lower(mention), lower(variation)) / greatest(length(mention), length(variation)))::FLOAT::DOUBLE"


def cells(pairs: str, cell: str) -> str:
    """SQL: the table of a recurrence over two strings (a, b) of each row of pairs, filled a cell a step by
    rows of b's characters: i and j number the cell, w is a row's width, d the cells before."""
    return f"""grid AS (SELECT a, b, 0 AS k, []::INT[] AS d FROM {pairs} UNION ALL
        SELECT a, b, k + 1, list_append(d, {cell}) FROM (SELECT *, k // w AS i, k % w AS j FROM (SELECT *, length(b) + 1 AS w FROM grid)) WHERE k < (length(a) + 1) * w),
    filled AS (SELECT a, b, d[-1] AS cell FROM grid WHERE k = (length(a) + 1) * (length(b) + 1))"""


OSA_CELL = """CASE WHEN i = 0 THEN j WHEN j = 0 THEN i ELSE least(d[k - w + 1] + 1, d[k] + 1, d[k - w] + (a[i] <> b[j])::INT,
    CASE WHEN i > 1 AND j > 1 AND a[i] = b[j - 1] AND a[i - 1] = b[j] THEN d[k - 2 * w - 1] + 1 ELSE 1000000 END) END::INT"""
LCS_CELL = "CASE WHEN i = 0 OR j = 0 THEN 0 WHEN a[i] = b[j] THEN d[k - w] + 1 ELSE greatest(d[k - w + 1], d[k]) END::INT"


@query(f"""WITH RECURSIVE pairs AS (SELECT DISTINCT p_type AS mention, p_name AS variation, lower(p_type) AS a, lower(p_name) AS b FROM part), own AS (SELECT DISTINCT a, b FROM pairs), {cells("own", OSA_CELL)}
    SELECT mention, variation, round(1 - (cell / greatest(length(a), length(b), 1))::FLOAT::DOUBLE, 6) AS score FROM pairs JOIN filled USING (a, b)""")
def damlev_similarity(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_type").alias("mention"), F.col("p_name").alias("variation")).distinct()
    return pairs.withColumn("score", F.round(S.osa_similarity_udf("mention", "variation"), 6))


@query(f"""WITH asked AS ({WORD_QUERIES}), names AS (SELECT DISTINCT p_name AS variation FROM part), scored AS (SELECT mention, variation, CASE WHEN mention = variation THEN 1.0::DOUBLE ELSE {OSA} END AS score FROM asked, names)
    SELECT mention, variation, round(score, 6) AS score FROM scored QUALIFY rank() OVER (PARTITION BY mention ORDER BY round(score, 9) DESC) = 1""")
def levenshtein_top1(spark, d):
    return C.fuzzy_match(word_queries(spark, d), part_names(spark, d), "levenshtein").withColumn("score", F.round("score", 6))


VECTORS = """q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
    pairs AS (SELECT query_id, vec_id, {distance} AS distance FROM q JOIN embeddings ON vec_id <> query_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)"""
A64, B64 = "a::DOUBLE[]", "embedding::DOUBLE[]"


def vector_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every hundredth id, and all vectors."""
    vectors = table(spark, d, "embeddings")
    return vectors.where(F.col("vec_id") % 100 == 0), vectors


@query("WITH " + VECTORS.format(distance=f"1 - list_cosine_similarity({A64}, {B64})") + " SELECT query_id, vec_id, rank::INT AS rank, round(1 - distance, 6) AS score FROM ranked WHERE rank <= 10")
def vector_knn_cosine(spark, d):
    return C.nearest_vectors(*vector_queries(spark, d), 10, "cosine").select("query_id", "vec_id", "rank", F.round(1 - F.col("distance"), 6).alias("score"))


@query("WITH " + VECTORS.format(distance=f"list_distance({A64}, {B64})") + " SELECT query_id, vec_id, rank::INT AS rank, round((20 - distance) / 20, 6) AS score FROM ranked WHERE rank <= 10 AND distance <= 20")
def vector_knn_l2_score(spark, d):
    near = C.nearest_vectors(*vector_queries(spark, d), 10, "l2").withColumn("score", C.distance_score(F.col("distance"), 20.0))
    return near.where("score is not null").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


CANDIDATES = f"""counts AS ({SALES_COUNTS}), kb AS ({NORM}), {CONTAINED}, exact AS (SELECT mention, variation, 1.0::DOUBLE AS score FROM asked JOIN names ON mention = variation),
    best AS (SELECT * FROM pairs WHERE score IS NOT NULL AND mention NOT IN (SELECT mention FROM exact) QUALIFY rank() OVER (PARTITION BY mention ORDER BY score DESC) = 1),
    hit AS (SELECT * FROM exact UNION ALL SELECT * FROM best),
    candidates AS (SELECT a.mention, c.variation, c.score, c.qid, c.relv, c.n FROM asked a LEFT JOIN (SELECT h.mention, h.variation, h.score, kb.qid, kb.relv, kb.n FROM hit h JOIN kb ON kb.mention = h.variation) c ON c.mention = a.mention)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    counts = sales(spark, d)
    matched = C.fuzzy_match(word_queries(spark, d), part_names(spark, d), "partialmatch")
    found = C.find_candidates(matched, C.normalise_by_entity(counts))
    return found.join(counts.withColumnRenamed("mention", "variation"), ["variation", "qid"], "left")


@query(f"WITH {CANDIDATES} SELECT mention, variation, round(score, 9) AS score, qid, round(relv, 9) AS relv FROM candidates")
def find_candidates(spark, d):
    return candidates(spark, d).select("mention", "variation", F.round("score", 9).alias("score"), "qid", F.round("relv", 9).alias("relv"))


@query(f"WITH counts AS ({TEXT_COUNTS}), asked AS ({SPOKEN}) SELECT mention FROM asked WHERE mention NOT IN (SELECT mention FROM counts WHERE mention IS NOT NULL)")
def candidate_memo_anti(spark, d):
    return C.only_new(spoken_names(spark, d), kb.counts_of_texts(table(spark, d, "documents")))


# linking


@query(f"""WITH {CANDIDATES}, chosen AS (SELECT *, sum(n) OVER (PARTITION BY mention) AS total, row_number() OVER (PARTITION BY mention ORDER BY n DESC NULLS LAST, variation, qid) AS k FROM candidates)
    SELECT mention, coalesce(qid, 'NIL') AS prediction, round(coalesce(n / total, 0), 9)::DOUBLE AS ed_score FROM chosen WHERE k = 1""")
def most_popular(spark, d):
    return L.most_popular(candidates(spark, d)).withColumn("ed_score", F.round("ed_score", 9))


KM = f"{2 * RADIUS!r} * asin(sqrt(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon0)) / 2), 2)))"


@query(f"""WITH {CANDIDATES}, gaz AS ({GRID}), home AS (SELECT mention, lat AS lat0, lon AS lon0 FROM asked LEFT JOIN gaz ON qid = 'Brand#' || (length(mention) % 25 + 1)),
    placed AS (SELECT c.*, {KM} AS km FROM candidates c LEFT JOIN gaz g USING (qid) LEFT JOIN home h USING (mention)),
    nearest AS (SELECT * FROM placed WHERE km < 1000 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY round(km, 9), qid, variation) = 1)
    SELECT a.mention, coalesce(qid, 'NIL') AS prediction, coalesce(round(((score + relv) / 2 + CASE WHEN km = 0 THEN 1 ELSE 1 - km / 1000 END) / 2, 3), 0) AS ed_score, round(km, 6) AS km FROM asked a LEFT JOIN nearest b USING (mention)""")
def by_distance(spark, d):
    found = candidates(spark, d)
    origins = word_queries(spark, d).select("mention", F.concat(F.lit("Brand#"), F.length("mention") % 25 + 1).alias("origin_qid"))
    return L.by_distance(found, kb.numbered_gazetteer(sales(spark, d)), origins).withColumn("km", F.round("km", 6))


PRIORS = f"""counts AS ({SALES_COUNTS}), kb AS ({NORM}), rated AS (SELECT *, CASE WHEN length(mention) % 2 = 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS sel, max(n) OVER (PARTITION BY mention) AS most FROM kb),
    scored AS (SELECT mention, qid, n, round(((n / most + CASE WHEN sel <> 0 THEN (relv + sel) / 2 ELSE relv END) / 2) * 0.9::DOUBLE, 3) AS prior FROM rated),
    priors AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY prior DESC, qid DESC)::INT AS rank FROM scored)"""


def priors(spark: SparkSession, d: str) -> DataFrame:
    counts = sales(spark, d)
    rated = C.normalise_by_entity(counts).join(counts, ["mention", "qid"]).withColumn("sel", F.when(F.length("mention") % 2 == 0, 0.9).otherwise(0.0))
    return L.prior_scores(rated)


@query(f"WITH {PRIORS} SELECT mention, qid, prior, rank FROM priors")
def prior_scores(spark, d):
    return priors(spark, d)


@query(f"""WITH places AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS place, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Q' || (doc_id % 25) END AS qid FROM documents),
    filled AS (SELECT doc_id, CASE WHEN place = '' OR qid IS NULL THEN '{L.DEFAULT_PLACE}' ELSE place END AS mention, CASE WHEN place = '' OR qid IS NULL THEN '{L.DEFAULT_QID}' ELSE qid END AS qid FROM places)
    SELECT doc_id, mention, '{L.PUBLISHED}' || mention || '.' AS sentence, {len(L.PUBLISHED)} AS pos, {2 * len(L.PUBLISHED) + 1} + length(mention) AS end_pos, qid, 1.0::DOUBLE AS prior FROM filled""")
def publication_mention(spark, d):
    docs = table(spark, d, "documents")
    place, qid = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Q"), F.col("doc_id") % 25))
    return L.publication_mentions(docs.select("doc_id", place.alias("place"), qid.alias("place_wqid")))


CONTEXT = "(n * 7919 % 1000) / 1000.0::DOUBLE"


@query(f"""WITH {PRIORS}, c AS (SELECT mention, qid, prior, {CONTEXT} AS context FROM priors), t AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY context DESC, qid) <= 3 AS top FROM c),
    f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY mention ORDER BY top DESC, prior DESC, qid) <= 7)
    SELECT mention, qid, prior, context, row_number() OVER (PARTITION BY mention ORDER BY prior DESC, qid)::INT AS rank FROM f""")
def prerank_topk_mix(spark, d):
    context = (F.col("n") * 7919 % 1000) / 1000.0
    rows = priors(spark, d).drop("rank").join(sales(spark, d), ["mention", "qid"]).withColumn("context", context).drop("n")
    return L.prerank(rows)


@query(f"""WITH {PRIORS}, top AS (SELECT mention, rank, prior, min(prior) OVER w AS low, max(prior) OVER w AS high FROM priors WHERE rank <= 7 WINDOW w AS (PARTITION BY mention)),
    unit AS (SELECT mention, rank, CASE WHEN high > low THEN (prior - low) / (high - low) ELSE 0 END AS u FROM top)
    SELECT mention, rank, round(CASE WHEN sum(u) OVER (PARTITION BY mention) > 0 THEN u / sum(u) OVER (PARTITION BY mention) ELSE 0 END, 6) AS score FROM unit""")
def cross_cand_normalise(spark, d):
    lists = priors(spark, d).where("rank <= 7").groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("rank", "prior"))).alias("p"))
    scores = lists.select("mention", F.posexplode(L.normalise_cross(F.col("p.prior"))).alias("i", "score"))
    return scores.select("mention", (F.col("i") + 1).alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {PRIORS}, c AS (SELECT mention, rank, qid, {CONTEXT} AS score, n % 3 <> 0 AS valid FROM priors WHERE rank <= 7),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, rank) = 1), f AS (SELECT * FROM c WHERE rank = 1)
    SELECT b.mention, CASE WHEN b.valid THEN b.qid WHEN f.valid THEN f.qid ELSE 'NIL' END AS prediction, CASE WHEN b.valid THEN b.score WHEN f.valid THEN f.score ELSE 0 END AS score FROM b JOIN f USING (mention)""")
def nil_rule(spark, d):
    rows = priors(spark, d).where("rank <= 7").join(sales(spark, d), ["mention", "qid"])
    return L.decide(rows.select("mention", "rank", "qid", ((F.col("n") * 7919 % 1000) / 1000.0).alias("score"), (F.col("n") % 3 != 0).alias("valid")))


@query(f"""WITH {CANDIDATES}, total AS (SELECT mention, sum(n) AS total FROM candidates GROUP BY mention), last AS (SELECT mention, qid, arg_max(n, variation) AS n FROM candidates WHERE qid IS NOT NULL GROUP BY mention, qid),
    shares AS (SELECT mention, qid, n / total AS score FROM last JOIN total USING (mention)), ranked AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, qid)::INT AS rank FROM shares)
    SELECT mention, qid, round(score, 3)::DOUBLE AS score, rank FROM ranked WHERE rank <= 7""")
def top7_output(spark, d):
    return L.top_candidates(L.popularity(candidates(spark, d)))


GUARDED, SENTENCE_END = T.GUARDED, T.SENTENCE_END.replace("'", "''")
CUT = rf"string_split(replace(regexp_replace(regexp_replace(text, '{GUARDED}', '\1\2' || chr(2) || '\3', 'g'), '{SENTENCE_END}', '\1' || chr(1) || '\2', 'g'), chr(2), '.'), chr(1))"
SENTENCES = f"SELECT doc_id, source, lang, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT doc_id, source, lang, {CUT} AS s FROM documents)"
CLASSES = "SELECT source AS qid, lang AS class_qid FROM documents GROUP BY source, lang QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1"


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


@query(rf"""WITH counts AS ({TEXT_COUNTS}), sent AS ({SENTENCES}), found AS (SELECT doc_id, sent_idx, unnest(regexp_extract_all(sentence, '\p{{Lu}}\p{{L}}+')) AS mention FROM sent),
    kb AS (SELECT *, sum(n) OVER (PARTITION BY mention) AS total, row_number() OVER (PARTITION BY mention ORDER BY n DESC, qid) AS k FROM counts), gaz AS ({GRID}),
    classes AS ({CLASSES})
    SELECT f.doc_id, f.sent_idx::INT AS sent_idx, f.mention, count(*) AS n, coalesce(kb.qid, 'NIL') AS prediction, round(coalesce(kb.n / kb.total, 0), 3)::DOUBLE AS ed_score, lat, lon, class_qid AS wkdt_class
    FROM found f LEFT JOIN kb ON kb.mention = f.mention AND kb.k = 1 LEFT JOIN gaz ON gaz.qid = kb.qid LEFT JOIN classes ON classes.qid = kb.qid GROUP BY ALL""")
def resolve_with_coords(spark, d):
    docs = table(spark, d, "documents")
    counts = kb.counts_of_texts(docs)
    found = sentences(spark, d).select("doc_id", "sent_idx", F.explode(F.regexp_extract_all("sentence", F.lit(kb.NAME), F.lit(0))).alias("mention"))
    found = found.groupBy("doc_id", "sent_idx", "mention").agg(F.count("*").alias("n"))
    matched = C.perfect_match(found.select("mention"), counts.select(F.col("mention").alias("name")))
    known = matched.join(counts.withColumnRenamed("mention", "variation"), "variation", "left")
    best = L.most_popular(known).withColumn("ed_score", F.round("ed_score", 3))
    return L.with_place(found.join(best, "mention"), kb.numbered_gazetteer(counts), kb.commonest_class(docs, "source", "lang"))


# texts


@query(f"SELECT doc_id, sent_idx::INT AS sent_idx, sentence FROM ({SENTENCES})")
def sentence_split(spark, d):
    return sentences(spark, d)


@query("SELECT conv_id AS doc_id, turn AS sent_idx, text AS sentence, coalesce(lag(text) OVER w, '') AS prev, coalesce(lead(text) OVER w, '') AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sentence_context(spark, d):
    return M.with_context(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_idx"), F.col("text").alias("sentence")))


@query("SELECT conv_id, turn, s[1] || replace(s[2:], '—', ',') AS clean FROM (SELECT conv_id, turn, '—' || replace(text, ', ', ' — ') AS s FROM conversations) WHERE length(s) > 1")
def dash_normalise(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("—"), F.replace("text", F.lit(", "), F.lit(" — "))).alias("s"))
    return rows.select("conv_id", "turn", T.normal_dashes(F.col("s")).alias("clean")).where("clean is not null")


TYPES = "CASE length(word) % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'STREET' ELSE 'LOC' END"
TOKENS = rf"""lines AS (SELECT conv_id AS doc_id, turn AS sent_idx, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS ws FROM conversations),
    words AS (SELECT doc_id, sent_idx, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1)::INT AS tok FROM lines),
    placed AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, regexp_matches(word, '^\p{{Lu}}') AS cap FROM words),
    runs AS (SELECT *, start + length(word)::INT AS "end", lag(cap, 1, false) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok) AS before FROM placed),
    tokens AS (SELECT doc_id, sent_idx, tok, word, start, "end", cap, before, CASE WHEN NOT cap THEN 'O' WHEN before THEN 'I-' || {TYPES} ELSE 'B-' || {TYPES} END AS entity, ((tok * 37 + length(word) * 11) % 100) / 100.0::DOUBLE AS score FROM runs)"""


def flat_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations with offsets; runs of capitalised ones are tagged, types by length.

    The window is dealt by sentence, as are all operators on its result: they need no other shuffle.
    """
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    words = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_idx"), F.posexplode(F.split(line, " ")).alias("tok", "word"))
    order = Window.partitionBy("doc_id", "sent_idx").orderBy("tok")
    start = F.coalesce(F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    cap = F.col("word").rlike(r"^\p{Lu}")
    rows = words.withColumns({"start": start, "cap": cap, "before": F.lag(cap, 1, False).over(order)})
    kind = F.element_at(F.array(F.lit("BUILDING"), F.lit("STREET"), F.lit("LOC")), F.length("word") % 3 + 1)
    tag = F.when(~F.col("cap"), "O").otherwise(F.concat(F.when(F.col("before"), "I-").otherwise("B-"), kind))
    score = (F.col("tok") * 37 + F.length("word") * 11) % 100 / 100.0
    return rows.select("doc_id", "sent_idx", "tok", "word", tag.alias("entity"), score.alias("score"), "start", (F.col("start") + F.length("word")).alias("end"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """The same, one row a sentence."""
    parts = F.sort_array(F.collect_list(F.struct("tok", "word", "entity", "score", "start", "end")))
    bare = F.transform(parts, lambda t: F.struct(*[t[c].alias(c) for c in ("word", "entity", "score", "start", "end")]))
    return flat_tokens(spark, d).groupBy("doc_id", "sent_idx").agg(bare.alias("tokens"))


SPANS = f"""{TOKENS}, marked AS (SELECT *, CASE WHEN cap AND (NOT before OR split_part(lag(entity) OVER w, '-', 2) <> split_part(entity, '-', 2)) THEN 1 ELSE 0 END AS new FROM tokens WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY tok)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok) AS span FROM marked),
    spans AS (SELECT doc_id, sent_idx, span, arg_min(split_part(entity, '-', 2), tok) AS type, min(tok) AS start_offset, max(tok) AS end_offset, min(start) AS start_char, max("end") AS end_char, round(avg(score), 3) AS ner_score, string_agg(word, ' ' ORDER BY tok) AS mention FROM numbered WHERE entity <> 'O' GROUP BY doc_id, sent_idx, span)"""


@query(f"WITH {SPANS} SELECT doc_id, sent_idx, span::INT AS span, type, start_offset, end_offset, start_char, end_char FROM spans")
def bio_spans(spark, d):
    return M.spans(flat_tokens(spark, d)).select("doc_id", "sent_idx", F.col("span").cast("int").alias("span"), "type", "start_offset", "end_offset", "start_char", "end_char")


MENTIONS = "SELECT doc_id, sent_idx, mention, start_offset, end_offset, start_char, end_char, ner_score, type AS ner_label, 'O' AS entity_link FROM spans"


@query(f"WITH {SPANS} {MENTIONS}")
def mention_aggregate(spark, d):
    return M.mentions(flat_tokens(spark, d))


@query(rf"WITH {TOKENS} SELECT DISTINCT word AS mention FROM tokens WHERE length(word) <> 1 AND NOT (word = lower(word) AND regexp_matches(word, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]'))")
def mention_noise_filter(spark, d):
    words = flat_tokens(spark, d).select(F.col("word").alias("mention"))
    return words.where(T.is_mention(F.col("mention"))).distinct()


@query(f"WITH {SPANS} SELECT DISTINCT mention FROM spans WHERE type = 'LOC'")
def microtoponym_filter(spark, d):
    return M.mentions(flat_tokens(spark, d)).where("ner_label = 'LOC'").select("mention").distinct()


@query(f"WITH {TOKENS} SELECT doc_id, sent_idx, tok, CASE WHEN starts_with(entity, 'B-') THEN 'B-LOC' WHEN starts_with(entity, 'I-') THEN 'I-LOC' ELSE entity END AS entity FROM tokens")
def fine_to_coarse(spark, d):
    return flat_tokens(spark, d).select("doc_id", "sent_idx", "tok", T.coarse_tag(F.col("entity")).alias("entity"))


@query(f"""WITH {TOKENS}, shifted AS (SELECT doc_id, sent_idx, tok, word, start + sent_idx * 1000000 AS start, "end" + sent_idx * 1000000 + (tok % 2) AS "end" FROM tokens WHERE word <> ''),
    last AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY tok DESC) AS k FROM shifted)
    SELECT doc_id, sent_idx, min(start) AS start, string_agg(word || CASE WHEN k > 1 THEN repeat(' ', 1 - tok % 2) ELSE '' END, '' ORDER BY tok) AS text FROM last GROUP BY doc_id, sent_idx""")
def sentence_reconstruct(spark, d):
    shift = F.col("sent_idx") * 1_000_000
    rows = flat_tokens(spark, d).where("word <> ''").withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift + F.col("tok") % 2})
    # offsets count on from sentence to sentence only within one: each is a document of its own
    rows = rows.withColumn("key", F.struct("doc_id", "sent_idx"))
    return M.reconstruct(rows, "key", "sent_idx").select(F.col("key.doc_id").alias("doc_id"), "sent_idx", "start", "text")


WIKI = "replace(replace(url_encode(split_part(replace(url_decode(lower(url)), '_', ' '), '#', 1)), '%2F', '/'), '*', '%2A')"


@query(f"SELECT page_id, {WIKI} AS link, replace(url_decode({WIKI}), ' ', '_') AS title FROM (SELECT page_id, replace(url, 'example', 'Some_Place%2C') AS url FROM pages)")
def wiki_link_normalise(spark, d):
    rows = table(spark, d, "pages").withColumn("url", F.replace("url", F.lit("example"), F.lit("Some_Place%2C")))
    return rows.select("page_id", T.wiki_link(F.col("url")).alias("link"), T.wiki_title(F.col("url")).alias("title"))


@query(r"""WITH titles AS (SELECT lower(split_part(url, '/', 3)) AS title, min('Q' || page_id) AS qid FROM pages GROUP BY ALL) SELECT p.page_id, lower(split_part(p.url, '/', 3)) AS title, t.qid FROM pages p LEFT JOIN titles t ON t.title = lower(split_part(p.url, '/', 3)) AND p.page_id % 7 <> 0""")
def url_title_lookup(spark, d):
    pages = table(spark, d, "pages")
    host = F.lower(F.split_part("url", F.lit("/"), F.lit(3)))
    titles = pages.select(host.alias("wikipedia_title"), host.alias("lower_wikipedia_title"), F.concat(F.lit("Q"), "page_id").alias("wikidata_id"))
    known = pages.select("page_id", F.when(F.col("page_id") % 7 != 0, host).alias("title"), host.alias("host"))
    return A.titles_to_entities(known, titles, lower=True).select("page_id", F.col("host").alias("title"), "qid")


@query(f"""WITH {SPANS}, a AS (SELECT doc_id, sent_idx, start_char, mention, 'Brand#' || (length(mention) % 40) AS qid FROM spans), g AS (SELECT DISTINCT p_brand AS qid FROM part)
    SELECT doc_id, sent_idx, start_char AS start, mention, coalesce(g.qid, 'NIL') AS qid, (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, start_char) - 1)::INT AS mention_pos FROM a LEFT JOIN g USING (qid)""")
def annotation_nil_map(spark, d):
    found = M.mentions(flat_tokens(spark, d)).select("doc_id", "sent_idx", F.col("start_char").alias("start"), "mention", F.concat(F.lit("Brand#"), F.length("mention") % 40).alias("qid"))
    return A.clean_annotations(found, table(spark, d, "part").select(F.col("p_brand").alias("qid"))).select("doc_id", "sent_idx", "start", "mention", "qid", "mention_pos")


SQL_PUNCTUATION = T.PUNCTUATION.replace("'", "''")
CONTEXT_WORDS = rf"SELECT conv_id, turn, unnest(list_filter(string_split(trim(regexp_replace(translate(text, '{SQL_PUNCTUATION}', ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS word FROM conversations"


@query(f"SELECT conv_id, turn, word, count(*) AS n FROM ({CONTEXT_WORDS}) GROUP BY ALL")
def context_tokens(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.context_words(F.col("text"))).alias("word"))
    return words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, word, count(*) AS n FROM ({CONTEXT_WORDS}) WHERE length(word) > 3 AND lower(word) NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) AND try_cast(word AS DOUBLE) IS NULL GROUP BY ALL")
def important_words(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.context_words(F.col("text"))).alias("word"))
    return words.where(T.is_important(F.col("word"))).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


# evaluation

GOLD = f"""{SPANS}, islands AS (SELECT *, tok - row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY tok) AS island FROM tokens WHERE cap),
    gold AS (SELECT doc_id, sent_idx, min(tok) AS g_first, max(tok) AS g_last, min(start) AS a_start, max("end") AS a_end, arg_min({TYPES}, tok) AS a_type, CASE WHEN arg_min(length(word), tok) % 5 = 0 THEN '*' ELSE 'Q' || arg_min(length(word), tok) END AS a_link FROM islands GROUP BY doc_id, sent_idx, island)"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Whole runs of capitalised words, whatever their types, as annotations."""
    rows = M.spans(flat_tokens(spark, d).withColumn("entity", F.when(F.col("entity") != "O", F.concat(F.substring("entity", 1, 2), F.lit("X"))).otherwise("O")))
    first = F.element_at("parts", 1)
    size = F.length(first["word"])
    return rows.select("doc_id", "sent_idx", F.col("start_offset").alias("g_first"), F.col("end_offset").alias("g_last"), F.col("start_char").alias("a_start"), F.col("end_char").alias("a_end"), F.substring(first["entity"], 3, 20).alias("t"), size.alias("size"), F.element_at(F.array(F.lit("BUILDING"), F.lit("STREET"), F.lit("LOC")), size % 3 + 1).alias("a_type"), F.when(size % 5 == 0, "*").otherwise(F.concat(F.lit("Q"), size)).alias("a_link"), F.col("start_offset").alias("a_pos")).drop("t", "size")


@query(f"""WITH {GOLD} SELECT t.doc_id, t.sent_idx, t.tok, t.word, CASE WHEN g.a_start IS NULL THEN 'O' ELSE CASE WHEN t.start = g.a_start THEN 'B-' ELSE 'I-' END || g.a_type END AS gold_tag,
    CASE WHEN g.a_start IS NULL THEN 'O' ELSE CASE WHEN t.start = g.a_start THEN 'B-' ELSE 'I-' END || CASE WHEN g.a_link = '*' THEN 'NIL' ELSE g.a_link END END AS gold_link
    FROM tokens t LEFT JOIN gold g ON g.doc_id = t.doc_id AND g.sent_idx = t.sent_idx AND t.start >= g.a_start AND t."end" <= g.a_end""")
def gold_align_range_join(spark, d):
    return E.align_gold(flat_tokens(spark, d), gold(spark, d).select("doc_id", "sent_idx", "a_start", "a_end", "a_type", "a_link", "a_pos"))


@query(f"""WITH {GOLD}, pairs AS (SELECT s.doc_id, s.sent_idx, s.start_offset AS p_first, s.end_offset AS p_last, g.a_link, g.g_first, least(s.end_offset, g.g_last) - greatest(s.start_offset, g.g_first) + 1 AS shared FROM spans s JOIN gold g USING (doc_id, sent_idx) WHERE g.g_first > 0),
    best AS (SELECT * FROM pairs WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, p_first, p_last ORDER BY shared DESC, g_first) = 1)
    SELECT s.doc_id, s.sent_idx, s.start_offset AS p_first, s.end_offset AS p_last, coalesce(a_link, 'NIL') AS gold_qid, coalesce(shared, 0)::INT AS shared FROM spans s LEFT JOIN best b ON b.doc_id = s.doc_id AND b.sent_idx = s.sent_idx AND b.p_first = s.start_offset AND b.p_last = s.end_offset""")
def overlap_gold_match(spark, d):
    p = M.mentions(flat_tokens(spark, d)).select("doc_id", "sent_idx", F.col("start_offset").alias("p_first"), F.col("end_offset").alias("p_last"))
    g = gold(spark, d).select("doc_id", "sent_idx", "g_first", "g_last", F.col("a_link").alias("g_qid"))
    return E.match_overlaps(p, g.where("g_first > 0"))


@query(f"""WITH {SPANS} SELECT t.doc_id, t.sent_idx, t.tok, CASE WHEN s.span IS NULL THEN 'O' WHEN t.tok = s.start_offset THEN 'B-Q' || length(s.mention) ELSE 'I-Q' || length(s.mention) END AS link
    FROM tokens t LEFT JOIN spans s ON s.doc_id = t.doc_id AND s.sent_idx = t.sent_idx AND t.tok BETWEEN s.start_offset AND s.end_offset""")
def link_writeback(spark, d):
    linked = M.mentions(flat_tokens(spark, d)).select("doc_id", "sent_idx", F.col("start_offset").alias("first"), F.col("end_offset").alias("last"), F.concat(F.lit("Q"), F.length("mention")).alias("qid"))
    return E.write_links(flat_tokens(spark, d), linked)


@query(f"WITH {CANDIDATES}, g AS (SELECT mention, 'Brand#' || (length(mention) % 30 + 1) AS gold_qid FROM asked) SELECT g.mention, g.gold_qid, CASE WHEN EXISTS (SELECT 1 FROM candidates c WHERE c.mention = g.mention AND c.qid = g.gold_qid) THEN g.gold_qid ELSE 'O' END AS skyline FROM g")
def skyline(spark, d):
    asked = word_queries(spark, d).withColumn("gold_qid", F.concat(F.lit("Brand#"), F.length("mention") % 30 + 1))
    return E.skyline(asked, candidates(spark, d))


PAIRS = "SELECT 'Q' || quality AS gold, CASE WHEN toxic = 1 THEN 'NIL' ELSE 'Q' || (doc_id % 2) END AS prediction FROM labels"


@query(f"""WITH s AS (SELECT count(*) FILTER (gold = prediction) AS tp, count(*) FILTER (prediction <> 'NIL') AS n_predicted, count(*) AS n_gold, count(*) FILTER (prediction = 'NIL') AS n_nil FROM ({PAIRS}))
    SELECT tp, n_predicted, n_gold, n_nil, round(tp / n_predicted, 3) AS p, round(tp / n_gold, 3) AS r, round(2 * (tp / n_predicted) * (tp / n_gold) / ((tp / n_predicted) + (tp / n_gold)), 3) AS f1 FROM s""")
def micro_prf(spark, d):
    pairs = table(spark, d, "labels").select(F.concat(F.lit("Q"), "quality").alias("gold"), F.when(F.col("toxic") == 1, "NIL").otherwise(F.concat(F.lit("Q"), F.col("doc_id") % 2)).alias("prediction"))
    return E.micro_prf(pairs)


@query(f"""WITH {GOLD}, met AS (SELECT s.doc_id, s.sent_idx, s.start_offset, s.type, max((s.type = g.a_type AND s.start_offset = g.g_first AND s.end_offset = g.g_last)::INT) AS strict, max((s.start_offset = g.g_first AND s.end_offset = g.g_last)::INT) AS exact, 1 AS partial, max((s.type = g.a_type)::INT) AS ent_type
        FROM spans s JOIN gold g ON g.doc_id = s.doc_id AND g.sent_idx = s.sent_idx AND s.start_offset <= g.g_last AND g.g_first <= s.end_offset GROUP BY ALL),
    long AS (UNPIVOT (SELECT type, strict, exact, partial, ent_type FROM met) ON strict, exact, partial, ent_type INTO NAME regime VALUE hit),
    tp AS (SELECT unnest([type, 'ALL']) AS tag, regime, hit FROM long), tps AS (SELECT tag, regime, sum(hit)::BIGINT AS tp FROM tp GROUP BY ALL),
    np AS (SELECT tag, count(*) AS n_predicted FROM (SELECT unnest([type, 'ALL']) AS tag FROM spans) GROUP BY tag), ng AS (SELECT tag, count(*) AS n_gold FROM (SELECT unnest([a_type, 'ALL']) AS tag FROM gold) GROUP BY tag),
    s AS (SELECT tag, regime, coalesce(tp, 0) AS tp, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_gold, 0) AS n_gold FROM (np FULL JOIN ng USING (tag)) CROSS JOIN (SELECT unnest(['strict', 'exact', 'partial', 'ent_type']) AS regime) LEFT JOIN tps USING (tag, regime)),
    pr AS (SELECT *, CASE WHEN n_predicted = 0 THEN 0 ELSE tp / n_predicted END AS p0, CASE WHEN n_gold = 0 THEN 0 ELSE tp / n_gold END AS r0 FROM s)
    SELECT tag, regime, tp, n_predicted, n_gold, round(p0, 3) AS p, round(r0, 3) AS r, CASE WHEN p0 + r0 = 0 THEN 0 ELSE round(2 * p0 * r0 / (p0 + r0), 3) END AS f1 FROM pr""")
def span_prf_strict_partial(spark, d):
    p = M.mentions(flat_tokens(spark, d)).select("doc_id", "sent_idx", F.col("start_offset").alias("first"), F.col("end_offset").alias("last"), F.col("ner_label").alias("tag"))
    g = gold(spark, d).select("doc_id", "sent_idx", F.col("g_first").alias("first"), F.col("g_last").alias("last"), F.col("a_type").alias("tag"))
    return E.span_prf(p, g)


@query(f"""WITH {GOLD}, hit AS (SELECT t.doc_id, t.sent_idx, t.tok, g.a_link FROM tokens t LEFT JOIN gold g ON g.doc_id = t.doc_id AND g.sent_idx = t.sent_idx AND t.start >= g.a_start AND t."end" <= g.a_end AND g.a_link <> '*'),
    r AS (SELECT *, lag(a_link) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok) IS NOT NULL AS goes_on FROM hit)
    SELECT doc_id, sent_idx, tok, CASE WHEN a_link IS NULL THEN 'O' WHEN goes_on THEN 'I-LOC' ELSE 'B-LOC' END AS tag, CASE WHEN a_link IS NULL THEN 'O' WHEN goes_on THEN 'I-' || a_link ELSE 'B-' || a_link END AS link FROM r""")
def rel_retokenise(spark, d):
    found = gold(spark, d).where("a_link <> '*'").select("doc_id", "sent_idx", F.col("a_start").alias("s_start"), F.col("a_end").alias("s_end"), F.col("a_link").alias("s_qid"))
    return E.retag_by_spans(flat_tokens(spark, d), found)


@query(f"""WITH {SPANS}, linked AS (SELECT t.*, CASE WHEN s.span IS NULL OR length(s.mention) % 3 = 0 THEN 'O' WHEN t.tok = s.start_offset THEN 'B-Q' || length(s.mention) ELSE 'I-Q' || length(s.mention) END AS link FROM tokens t LEFT JOIN spans s ON s.doc_id = t.doc_id AND s.sent_idx = t.sent_idx AND t.tok BETWEEN s.start_offset AND s.end_offset),
    line AS (SELECT doc_id, sent_idx, tok, concat_ws(chr(9), word, entity, 'O', 'O', 'O', 'O', 'O', CASE WHEN link <> 'O' THEN link[3:] WHEN entity <> 'O' THEN 'NIL' ELSE link END, 'O', 'O') AS l FROM linked)
    SELECT doc_id, sent_idx, string_agg(l, chr(10) ORDER BY tok) AS lines FROM line GROUP BY ALL""")
def hipe_lines(spark, d):
    linked = M.mentions(flat_tokens(spark, d)).where(F.length("mention") % 3 != 0).select("doc_id", "sent_idx", F.col("start_offset").alias("first"), F.col("end_offset").alias("last"), F.concat(F.lit("Q"), F.length("mention")).alias("qid"))
    rows = flat_tokens(spark, d)
    links = E.write_links(rows, linked)
    full = rows.join(links, ["doc_id", "sent_idx", "tok"]).select("doc_id", "sent_idx", "tok", "word", F.col("entity").alias("tag"), "link")
    test = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return E.hipe_lines(full, test)


SPLIT = "SELECT doc_id, source, CASE WHEN h < 640 THEN 'train' WHEN h < 800 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, source, ('0x' || md5('42:' || doc_id)[1:8])::BIGINT % 1000 AS h FROM documents)"


@query(f"SELECT doc_id, split FROM ({SPLIT})")
def split_assignment(spark, d):
    return splits.assign(table(spark, d, "documents"), "doc_id").select("doc_id", "split")


@query(f"SELECT source, split, count(*) AS n FROM ({SPLIT}) GROUP BY ALL")
def split_counts(spark, d):
    return splits.assign(table(spark, d, "documents"), "doc_id").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT source, lang, count(*) AS n_test FROM documents GROUP BY ALL), o AS (SELECT *, coalesce(lead(n_test) OVER (ORDER BY source, lang), first(n_test) OVER (ORDER BY source, lang)) AS n_dev, sum(n_test) OVER () AS total FROM g)
    SELECT source, lang, n_test, n_dev, (total - n_test - n_dev)::BIGINT AS n_train FROM o""")
def leave_one_group_out(spark, d):
    return splits.leave_one_group_out(table(spark, d, "documents"), ["source", "lang"])


# token repairs, parsers and models: tested against goldens


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with every seventh word cut in two pieces, and odd tags."""
    cut = lambda t: F.array(F.struct(F.substring(t["word"], 1, 3).alias("word"), t["entity"].alias("entity"), t["score"].alias("score"), t["start"].alias("start"), (t["start"] + 3).alias("end")), F.struct(F.concat(F.lit("##"), F.substring(t["word"], 4, 1 << 20)).alias("word"), t["entity"].alias("entity"), t["score"].alias("score"), (t["start"] + 3).alias("start"), t["end"].alias("end")))
    return tokens(spark, d).withColumn("tokens", F.flatten(F.transform("tokens", lambda t: F.when(F.length(t["word"]) % 7 == 5, cut(t)).otherwise(F.array(t)))))


def _exploded(rows: DataFrame) -> DataFrame:
    return M.explode_tokens(rows).withColumn("score", F.round("score", 6))


PLAIN = f'WITH {TOKENS} SELECT doc_id, sent_idx, tok, word, entity, round(score, 6) AS score, start, "end" FROM tokens'


@query(PLAIN)
def wordpiece_join_fold(spark, d):
    return _exploded(_pieces(spark, d).withColumn("tokens", K.join_pieces(F.col("tokens"))))


@query(f"""WITH {TOKENS} SELECT doc_id, sent_idx, tok, word, CASE WHEN cap AND before AND split_part(lag(entity) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok), '-', 2) <> split_part(entity, '-', 2) THEN 'B-' || split_part(entity, '-', 2) ELSE entity END AS entity, round(score, 6) AS score, start, "end" FROM tokens""")
def start_fix_fold(spark, d):
    return _exploded(tokens(spark, d).withColumn("tokens", K.fix_starts(F.col("tokens"))))


def walk(tagged: str, goes_on: str) -> str:
    """SQL: tokens one by one; t takes the type of p, the one before as repaired, where it goes on with its span."""
    return f"""WITH RECURSIVE {TOKENS}, tagged AS MATERIALIZED ({tagged}),
    walk AS (SELECT * FROM tagged WHERE tok = 0 UNION ALL
        SELECT t.doc_id, t.sent_idx, t.tok, t.word, CASE WHEN p.entity <> 'O' AND t.entity <> 'O' AND ({goes_on}) THEN 'I-' || split_part(p.entity, '-', 2) ELSE t.entity END, t.score, t.start, t."end"
        FROM walk p JOIN tagged t ON t.doc_id = p.doc_id AND t.sent_idx = p.sent_idx AND t.tok = p.tok + 1)
    SELECT doc_id, sent_idx, tok, word, entity, round(score, 6) AS score, start, "end" FROM walk"""


SQL_CONNECTORS = ", ".join("'" + c.replace("'", "''") + "'" for c in K.CONNECTORS)
IS_LINK = f"({{0}}.word IN ({SQL_CONNECTORS}) OR regexp_matches({{0}}.word, '^[0-9]$'))"


@query(walk("""SELECT doc_id, sent_idx, tok, CASE tok % 4 WHEN 1 THEN '-' WHEN 3 THEN word ELSE CASE WHEN length(word) % 5 = 4 THEN '7' ELSE word END END AS word,
        CASE WHEN tok % 4 = 1 THEN 'I-LOC' WHEN entity = 'O' AND length(word) % 2 = 0 THEN 'B-STREET' ELSE entity END AS entity, score, start - CASE WHEN tok % 3 = 2 THEN 1 ELSE 0 END AS start, "end" FROM tokens""",
    f"""({IS_LINK.format('p')} OR {IS_LINK.format('t')}) AND (split_part(p.entity, '-', 2) = split_part(t.entity, '-', 2) OR (t.word[1] = lower(t.word[1]) AND t.word[1] <> upper(t.word[1])) OR regexp_matches(t.word, '^[0-9]+$') OR p."end" = t.start)"""))
def hyphen_fix_fold(spark, d):
    """Every fourth word is made a tagged hyphen and some a digit; words of even length are tagged; some tokens touch."""
    word = lambda t, i: F.when(i % 4 == 1, "-").when((i % 2 == 0) & (F.length(t["word"]) % 5 == 4), "7").otherwise(t["word"])
    tag = lambda t, i: F.when(i % 4 == 1, "I-LOC").when((t["entity"] == "O") & (F.length(t["word"]) % 2 == 0), "B-STREET").otherwise(t["entity"])
    tagged = F.transform("tokens", lambda t, i: F.struct(word(t, i).alias("word"), tag(t, i).alias("entity"), t["score"].alias("score"), (t["start"] - (i % 3 == 2).cast("int")).alias("start"), t["end"].alias("end")))
    return _exploded(tokens(spark, d).withColumn("tokens", K.fix_connectors(tagged)))


@query(walk("""SELECT doc_id, sent_idx, tok, CASE WHEN tok % 4 = 1 THEN 'of' ELSE word END AS word, CASE WHEN tok % 4 = 1 THEN 'I-LOC' WHEN entity = 'O' AND length(word) % 2 = 0 THEN 'B-STREET' ELSE entity END AS entity, score, start, "end" FROM tokens""", "lower(p.word) = 'of'"))
def nested_fix_fold(spark, d):
    """Every fourth word is made a tagged "of"; words of even length are tagged."""
    tag = lambda t, i: F.when(i % 4 == 1, "I-LOC").when((t["entity"] == "O") & (F.length(t["word"]) % 2 == 0), "B-STREET").otherwise(t["entity"])
    tagged = F.transform("tokens", lambda t, i: F.struct(F.when(i % 4 == 1, "of").otherwise(t["word"]).alias("word"), tag(t, i).alias("entity"), t["score"].alias("score"), t["start"].alias("start"), t["end"].alias("end")))
    return _exploded(tokens(spark, d).withColumn("tokens", K.fix_nested(tagged)))


@query(f"WITH {TOKENS}, n AS (SELECT *, sum(CASE WHEN starts_with(entity, 'B-') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_idx, tok) AS g FROM tokens WHERE word <> '')"
       """ SELECT doc_id, sent_idx, tok, start, "end", word, CASE WHEN cap THEN CASE WHEN before THEN 'I-LOC' ELSE 'B-LOC' END ELSE 'O' END AS entity, CASE WHEN cap THEN 'Q' || g END AS link FROM n""")
def webanno_parse(spark, d):
    rows = flat_tokens(spark, d).where("word <> ''")
    number = F.sum(F.col("entity").startswith("B-").cast("int")).over(Window.partitionBy("doc_id").orderBy("sent_idx", "tok"))
    rows = rows.withColumn("g", F.concat(F.lit("["), number, F.lit("]")))
    mark = lambda c: F.when(F.col("entity") != "O", F.concat(c, "g")).otherwise("_")
    qid = F.concat(F.lit("Q"), F.regexp_extract("g", r"\d+", 0))
    line = F.concat_ws("\t", F.concat_ws("-", "sent_idx", "tok"), F.concat_ws("-", "start", "end"), "word", mark(qid), mark(F.lit("LOC")))
    lines = rows.select("doc_id", (F.col("sent_idx") * 1_000_000 + F.col("tok")).alias("line_no"), line.alias("line"))
    out = A.webanno_tokens(lines)
    return out.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "tok", "start", "end", "word", "entity", "link")


@query(f"""WITH {TOKENS} SELECT 'd' || doc_id AS doc_id, (sent_idx + 1)::INT AS sent_idx, tok + 1 AS tok, start, "end", word, CASE WHEN cap THEN CASE WHEN before THEN 'I-loc' ELSE 'B-loc' END ELSE 'O' END AS entity, 'O' AS meto, 'Q' || length(word) AS link FROM tokens""")
def hipe_parse(spark, d):
    rows = flat_tokens(spark, d)
    last = F.lead("tok").over(Window.partitionBy("doc_id", "sent_idx").orderBy("tok")).isNull()
    tag = F.when(F.col("entity") != "O", F.concat(F.substring("entity", 1, 2), F.lit("loc"))).otherwise("O")
    line = F.concat_ws("\t", "word", tag, *[F.lit(x) for x in "OOOOO"], F.concat(F.lit("Q"), F.length("word")), F.lit("_"), F.when(last, "EndOfSentence").otherwise("_"))
    number = F.col("sent_idx") * 1_000_000 + F.col("tok") + 1
    lines = rows.select(F.col("doc_id").cast("string").alias("doc_id"), number.alias("line_no"), line.alias("line"))
    heads = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("# hipe2022:document_id = d"), F.col("doc_id").cast("string")).alias("line")).distinct()
    return A.hipe_tokens(lines.unionByName(heads))


@query()
def lbp_global_score(spark, d):
    """Collective scores of parts as mentions, brands as candidates, embeddings as vectors."""
    found = priors(spark, d).where("rank <= 7")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    number = F.regexp_extract("qid", r"(\d+)$", 1).cast("long")
    names = found.select("mention").distinct().select("mention", F.split_part("mention", F.lit(" "), F.lit(1)).alias("doc_id"), F.pmod(F.xxhash64("mention"), F.lit(1000)).alias("mention_no"), F.pmod(F.xxhash64("mention"), F.lit(100)).alias("w"))
    words = names.join(vectors, F.col("vec_id").between(F.col("w"), F.col("w") + 4)).groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).select("mention", F.col("v.embedding").alias("words"))
    items = found.join(names, "mention").join(words, "mention").join(vectors.select(F.col("vec_id").alias("k"), F.col("embedding").alias("emb")), number == F.col("k"), "left")
    out = D.disambiguate(items.select("doc_id", "mention_no", "rank", "qid", "prior", "emb", "words"), D.Weights.seeded(D.Config(dim=64, hidden=16)))
    return out.withColumn("score", F.round("score", 6))


RATIO = "round_even(200 * cell / (length(a) + length(b)), 0)"


@query(f"""WITH RECURSIVE asked AS ({WORD_QUERIES}), words AS (SELECT DISTINCT lower(mention) AS word FROM asked WHERE NOT contains(mention, ' ')),
    near AS (SELECT word, unnest([translate(word, 'eo', 'cu'), reverse(word), word || 's']) AS other FROM words UNION ALL SELECT * FROM (SELECT word, lead(word) OVER (PARTITION BY length(word) ORDER BY word) AS other FROM words) WHERE other IS NOT NULL),
    halves AS (SELECT *, length(word) // 2 AS h, length(other) // 2 AS g, other IN (SELECT word FROM words) AS english FROM near WHERE length(word) BETWEEN 3 AND 15 AND NOT contains(word, other) AND NOT contains(other, word)),
    names AS (SELECT DISTINCT x.p_name AS s1, y.p_name AS s2 FROM part x JOIN part y USING (p_brand) WHERE x.p_name < y.p_name),
    own AS (SELECT word[:h] AS a, other[:g] AS b FROM halves UNION SELECT word[h + 1:], other[g + 1:] FROM halves UNION SELECT * FROM names), {cells("own", LCS_CELL)},
    ratios AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 100 ELSE {RATIO} END AS r FROM filled),
    rated AS (SELECT word AS s1, other AS s2, NOT english AS label, x.r AS r0, y.r AS r1 FROM halves JOIN ratios x ON x.a = word[:h] AND x.b = other[:g] JOIN ratios y ON y.a = word[h + 1:] AND y.b = other[g + 1:]),
    mined AS (SELECT s1, s2, label, row_number() OVER (PARTITION BY length(s1), label ORDER BY md5(s1 || ':' || s2), s1, s2) AS k, count(*) FILTER (label) OVER w AS yes, count(*) FILTER (NOT label) OVER w AS no FROM rated
        WHERE (label AND r0 > 70 AND r1 > 70) OR (NOT label AND r0 < 30 AND r1 < 30 AND abs(length(s1) - length(s2)) <= 2) WINDOW w AS (PARTITION BY length(s1)))
    SELECT s1, s2, label FROM mined WHERE k <= least(yes, no) UNION ALL SELECT s1, s2, true FROM names JOIN ratios ON a = s1 AND b = s2 WHERE r > 85""")
def pair_mining_pairs(spark, d):
    words = word_queries(spark, d).select(F.lower("mention").alias("word")).where(~F.col("word").contains(" ")).distinct()
    spoilt = words.select("word", F.explode(F.array(F.translate("word", "eo", "cu"), F.reverse("word"), F.concat("word", F.lit("s")))).alias("other"))
    other = words.select("word", F.lead("word").over(_by_name()).alias("other")).where("other is not null")
    mined = pair_mining.mine_pairs(spoilt.union(other), words, min_len=3)
    return pair_mining.balance(mined).unionByName(pair_mining.name_pairs(kb.counts_of_parts(table(spark, d, "part"))))


def _by_name():
    return Window.partitionBy(F.length("word")).orderBy("word")


@query()
def confidence_lr(spark, d):
    """Confidence that a document without toxic text is good, by its normalised length."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    scored = docs.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), (F.col("quality") == 1).cast("int").alias("correct"))
    return D.confidence(scored, D.confidence_model(scored)).select("doc_id", F.round("conf", 4).alias("conf"))


@query(rf"""WITH counts AS ({TEXT_COUNTS}), kb AS ({NORM}), gaz AS ({GRID}), classes AS ({CLASSES}),
    sent AS (SELECT doc_id, home, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INT AS sent_idx FROM (SELECT conv_id || '-' || turn AS doc_id, 'src' || (conv_id % 20) AS home, {CUT} AS s FROM conversations)),
    cut AS (SELECT *, string_split(sentence[1] || replace(sentence[2:], '—', ','), ' ') AS ws FROM sent WHERE length(sentence) > 1),
    words AS (SELECT doc_id, home, sent_idx, sentence, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
    bare AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, sent_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, regexp_replace(w, '[^\p{{L}}\p{{N}}’''\-]+$', '') AS word FROM words),
    runs AS (SELECT *, regexp_matches(word, '^\p{{Lu}}') AS cap, lag(regexp_matches(word, '^\p{{Lu}}') AND word = w, 1, false) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS goes_on FROM bare),
    nested AS (SELECT *, lag(cap AND lower(word) = 'of', 1, false) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS after_of FROM runs WHERE word <> ''),
    numbered AS (SELECT *, sum((cap AND NOT goes_on AND NOT after_of)::INT) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS span FROM nested),
    gaps AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id, sent_idx, span ORDER BY i) - start - length(word), 0) AS gap FROM numbered WHERE cap),
    spans AS (SELECT doc_id, home, sent_idx, sentence, string_agg(word || repeat(' ', gap), '' ORDER BY i) AS mention, min(start) AS pos, max(start + length(word))::INT AS end_pos FROM gaps GROUP BY doc_id, home, sent_idx, sentence, span),
    found AS (SELECT * FROM spans WHERE length(mention) <> 1 AND NOT (mention = lower(mention) AND regexp_matches(mention, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]'))),
    placed AS (SELECT f.mention, f.home, kb.qid, relv, {KM} AS km FROM (SELECT DISTINCT mention, home FROM found) f JOIN kb ON kb.mention = f.mention JOIN gaz ON gaz.qid = kb.qid JOIN (SELECT qid AS home, lat AS lat0, lon AS lon0 FROM gaz) h ON h.home = f.home),
    nearest AS (SELECT * FROM placed WHERE km < 1000 QUALIFY row_number() OVER (PARTITION BY mention, home ORDER BY round(km, 9), qid) = 1)
    SELECT f.doc_id, f.sent_idx, f.mention, f.pos, f.end_pos, 'LOC' AS tag, coalesce(n.qid, 'NIL') AS prediction, 1.0::DOUBLE AS ner_score, coalesce(round(((1 + relv) / 2 + CASE WHEN km = 0 THEN 1 ELSE 1 - km / 1000 END) / 2, 3), 0) AS ed_score, f.sentence, class_qid AS wkdt_class
    FROM found f LEFT JOIN nearest n ON n.mention = f.mention AND n.home = f.home LEFT JOIN classes c ON c.qid = n.qid""")
def pipeline_by_distance(spark, d):
    """The whole pipeline over documents: partial matches, linked by distance from their source."""
    docs = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text", F.lit("somewhere").alias("place"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("place_wqid"))
    texts = table(spark, d, "documents")
    counts = kb.counts_of_texts(texts)
    base = C.normalise_by_entity(counts).join(counts, ["mention", "qid"])
    p = Pipeline(base, kb.numbered_gazetteer(counts), kb.commonest_class(texts, "source", "lang"), drop_noise=True)
    p.linker.method = "bydistance"
    return output(p.run(docs)).drop("latlon")
