"""Secret scanning with corpus-wide ownership frequency.

Patterns find candidates in every text. The hash of each candidate's value is counted over
the whole corpus by distinct repositories and owners: a value in the hands of several
owners, or in many repositories, is a widely copied example; one that a single owner
has is live-looking. Candidates of the three base kinds are always reported. What ownership
says is live adds spans: one of kind live over each such value, without its key and
quotes, and one of kind opaque over each merely opaque string that one owner has; a value that is
widely copied adds none.

Plan, built-in functions only. Positions come without a UDF: the pieces that a text falls
into between the matches, and the matches, have lengths that add up. Texts are read once;
what is found, ids and hashes, goes to a table in the shared folder. Counts are distinct
triples first, combined before the shuffle, so that a value found in a third of all documents is
a few rows per task. Only shared values are joined back, and adaptive execution splits the
hot ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Kinds in order: pattern, group that is the value, least length of the value.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = [*BASE, "opaque", "live"]
MAX_OWNERS, MAX_REPOSITORIES, DISTINCT_CHARS = 1, 3, 6
#: Matches of a text that one fold runs over.
FOLD = 128
REDACTED = "[REDACTED]"
#: Rows and spans of live-looking secrets up to which they are broadcast.
BROADCAST_SPANS = 100_000
#: A column name that no table has.
OWN = "__topograin_live"
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string,varied:boolean,begin:int>>"


def _spans(text: Column, matches: Column, values: Column, pattern: str, kind: str, least: int) -> Column:
    """Spans, in code points, of those matches whose value has at least `least` characters.

    Pieces, matches and values are arguments of higher-order functions, which are evaluated once;
    inside a function they would be evaluated again for each match. A fold copies what it
    has gathered at each step, so it runs over `FOLD` matches, and sums of those move its spans."""
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        value = x["value"]
        varied = F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARS
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.md5(value.cast("binary")).alias("value"), varied.alias("varied"), (end - F.length(value)).alias("begin"))
        return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def fold(zipped: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(matches), F.lit(FOLD))
        return F.transform(first, lambda i: F.aggregate(F.slice(zipped, i, F.least(F.lit(FOLD), F.size(matches) - i + 1)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def moved(folds: Column) -> Column:
        ends = F.aggregate(F.transform(folds, lambda f: f["at"]), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        by = lambda n: lambda s: s.withField("start", s["start"] + n).withField("end", s["end"] + n).withField("begin", s["begin"] + n)
        return F.flatten(F.transform(F.arrays_zip(folds.alias("f"), ends.alias("n")), lambda x: F.when(x["f"].isNull(), none).otherwise(F.transform(x["f"]["out"], by(x["n"])))))

    # one piece more than there are matches: that after the last
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("match"), values.alias("value"))
    return F.when(F.size(matches) > 0, F.flatten(_once(F.flatten(_once(zipped, lambda z: fold(z))), lambda f: moved(f)))).otherwise(none)


def _once(value: Column, use) -> Column:  # noqa: ANN001
    """An array of one item, what `use` makes of a value that is evaluated once."""
    return F.transform(F.array(value), use)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, owner, repository, base, opaque) per row; the last two are arrays of
    spans. Opaque strings have a digit, an upper and a lower case letter, and do not
    overlap a base span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), text.alias("text"))
    patterns = {**BASE, "opaque": (OPAQUE, 0, 24)}
    keep = ["doc_id", "text_hash", "owner", "repository"]
    found = rows.select(*keep, "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, (p, _, _) in patterns.items()])
    values = {k: F.col(f"m_{k}") for k in patterns}
    values["assign"] = F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(BASE["assign"][0]), F.lit(2))).otherwise(F.col("m_assign"))
    likely = F.exists("m_opaque", lambda v: _mixed(v))
    spans = found.select(
        *keep,
        F.concat(*[_spans(F.col("text"), F.col(f"m_{k}"), values[k], p, k, n) for k, (p, _, n) in BASE.items()]).alias("base"),
        F.when(likely, _spans(F.col("text"), F.col("m_opaque"), F.transform("m_opaque", lambda v: F.when(_mixed(v), v).otherwise("")), OPAQUE, "opaque", 24)).otherwise(F.array().cast(_SPAN)).alias("opaque"),
    )
    free = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return spans.select(*keep, "base", free.alias("opaque"))


def _mixed(v: Column) -> Column:
    return v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, text_hash, base, added, live) per row, arrays of spans by start and kind.

    live holds the base and opaque spans whose value is not widely copied and has enough distinct
    characters. base holds the base kinds' spans; added those of opaque strings that are
    live, and one of kind live for each distinct place of a live value. A value that two base
    kinds find at one place is one place.
    Null or empty texts have none. A null owner or repository counts as one unknown
    owner or repository. Repeated rows give repeated rows.
    """
    found = written(candidates(docs, id_col, text_col, owner, repository), "candidates")
    each = found.select("doc_id", "text_hash", "owner", "repository", F.explode(F.concat("base", "opaque")).alias("s")).select("doc_id", "text_hash", "owner", "repository", F.col("s.value").alias("value"))
    by_owner = each.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    copied = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")).where((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
    hits = each.select("doc_id", "text_hash", "value").distinct().join(copied.select("value"), "value")
    shared = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("value").alias("shared")).select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "shared")
    joined = found.join(shared, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    own = lambda s: ~F.array_contains(F.coalesce(F.col("shared"), F.array().cast("array<string>")), s["value"]) & s["varied"]
    live = joined.select("doc_id", "text_hash", F.sort_array("base").alias("base"), F.sort_array(F.filter(F.concat("base", "opaque"), own)).alias("live"))
    places = F.array_distinct(F.transform("live", lambda s: F.struct(s["begin"].alias("start"), F.lit(KINDS.index("live")).alias("rank"), F.lit("live").alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["varied"].alias("varied"), s["begin"].alias("begin"))))
    opaque = F.filter("live", lambda s: s["kind"] == "opaque")
    return live.select("doc_id", "text_hash", "base", F.sort_array(F.concat(opaque, places)).alias("added"), "live")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", broadcast_spans: int = BROADCAST_SPANS, **params) -> DataFrame:
    """docs, all columns, with live-looking secrets replaced and size_col, if there, counted anew.

    Widely copied examples stay. Patterns run once over the texts, in scan; its spans come back
    by id and hash, broadcast while their counted number is within broadcast_spans, else by a
    shuffled join.
    """
    found = scan(docs, id_col, text_col, **params).where(F.size("live") > 0)
    places = F.transform("live", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    live = found.groupBy("doc_id", "text_hash").agg(F.first(places).alias(OWN)).select(F.col("doc_id").alias(f"{OWN}_id"), F.col("text_hash").alias(f"{OWN}_hash"), OWN)
    live = written(live, "live")
    few = (live.agg(F.sum(F.size(OWN) + 1)).first()[0] or 0) <= broadcast_spans
    text = F.col(text_col)
    key = docs[id_col].cast("long").eqNullSafe(F.col(f"{OWN}_id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(f"{OWN}_hash"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        cut = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(REDACTED))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, cut).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(OWN, begin, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    cleaned = docs.join(F.broadcast(live) if few else live, key, "left").withColumn(text_col, F.when(F.col(OWN).isNotNull(), clean).otherwise(text))
    if size_col in docs.columns:
        cleaned = cleaned.withColumn(size_col, F.when(F.col(OWN).isNotNull(), F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return cleaned.select(*docs.columns)
