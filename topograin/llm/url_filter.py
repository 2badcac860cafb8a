"""URL filters by a temporal list join.

A filter list is a log of dated entries: on a date a rule (a host with its subdomains, or a
URL prefix) is put to block or allow, or is removed. Entries of a rule, in order, become
validity intervals [from, to). A capture is matched, as of its fetch time, by every rule
active then; the most specific rule decides, and on equal ground block wins.

Plan, built-in functions only. From a URL come its lookup keys: the host's suffixes and the
prefixes of its path, no longer than the longest rule, both bounded by the URL. Keys are joined to
intervals by equality, with the time as a residual condition: a list whose counted size is
within `broadcast_rows` is broadcast, so that captures are not shuffled; a larger one
is a shuffled join, hot hosts being split by adaptive execution. Only ids, keys and times
move, never page bodies. Verdicts are a max per capture, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Rank of what an entry does; of entries of one rule at one time the highest holds.
ACTIONS = {"remove": 0, "allow": 1, "block": 2}


def normal_url(url: Column) -> Column:
    """Lower-case host and the path: scheme, user, port, query, fragment and leading www. are
    cut, as are closing slashes."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(bare, "/", 1), r"^[^@]*@", ""), r":\d*$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.when(bare.contains("/"), F.regexp_replace(bare, r"^[^/]*", "")).otherwise("")
    return F.struct(host.alias("host"), F.regexp_replace(path, r"/+$", "").alias("path"))


def intervals(entries: DataFrame, kind_col: str = "kind", rule_col: str = "rule", action_col: str = "action", at_col: str = "listed_at") -> DataFrame:
    """(kind, rule, action, specificity, valid_from, valid_to) from dated entries.

    kind is host or prefix. Entries with a null or unknown kind, rule, action or date are no
    entries. Of entries of a rule at one time block holds before allow before
    remove. valid_to is null for what still holds.
    """
    known = F.coalesce(*[F.when(F.col(action_col) == a, F.lit(r)) for a, r in ACTIONS.items()])
    url = normal_url(F.col(rule_col))
    clean = entries.select(
        F.col(kind_col).alias("kind"), F.when(F.col(kind_col) == "host", url["host"]).otherwise(F.concat(url["host"], url["path"])).alias("rule"),
        known.alias("rank"), F.col(at_col).cast("timestamp").alias("valid_from"),
    ).where("kind in ('host', 'prefix') and rule <> '' and rank is not null and valid_from is not null")
    one = clean.groupBy("kind", "rule", "valid_from").agg(F.max("rank").alias("rank"))
    ahead = F.lead("valid_from").over(Window.partitionBy("kind", "rule").orderBy("valid_from"))
    named = F.when(F.col("rank") == ACTIONS["block"], "block").otherwise("allow")
    return one.withColumn("valid_to", ahead).where("rank > 0").select(
        "kind", "rule", named.alias("action"), (F.length("rule") + F.when(F.col("kind") == "prefix", 10_000).otherwise(0)).alias("specificity"), "valid_from", "valid_to",
    )


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, url, fetched_at, verdict, rule, n_active) per distinct capture.

    verdict is block, allow or none (no rule active at the fetch); rule is that which
    decided, n_active the number of active rules that match. A null url or time
    matches nothing. Repeated rows count once. An empty list leaves every verdict none.
    """
    spans = intervals(entries)
    deepest = F.size(F.split("rule", "/")) - 1
    widest = F.size(F.split("rule", r"\."))
    stats = spans.agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "prefix", deepest)).alias("deep"), F.max(F.when(F.col("kind") == "host", widest)).alias("wide")).first()
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("at"))
    u, deep, wide = F.col("u"), F.lit(int(stats.deep or 0)), F.lit(int(stats.wide or 1))
    labels, parts = F.split(u["host"], r"\."), F.split(u["path"], "/")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - wide + 1), F.size(labels)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("rule")))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), deep + 1)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(u["host"], F.array_join(F.slice(parts, 1, i), "/")).alias("rule")))
    keys = base.where("url is not null and at is not null").withColumn("u", normal_url(F.col("url"))).where("u.host <> ''")
    keys = keys.select("id", "url", "at", F.explode(F.array_distinct(F.concat(hosts, paths))).alias("k")).select("id", "url", "at", "k.kind", "k.rule")
    side = F.broadcast(spans) if stats.n <= broadcast_rows else spans
    active = keys.join(side, ["kind", "rule"]).where("valid_from <= at and (valid_to is null or at < valid_to)")
    order = F.struct("specificity", F.when(F.col("action") == "block", 1).otherwise(0).alias("block"), "rule", "action")
    hits = active.select("id", "url", "at", order.alias("best"), F.struct("kind", "rule").alias("r"), F.lit(1).alias("one"))
    none = base.select("id", "url", "at", F.lit(None).cast(hits.schema["best"].dataType).alias("best"), F.lit(None).cast(hits.schema["r"].dataType).alias("r"), F.lit(0).alias("one"))
    # repeated captures repeat their keys: each rule counts once
    each = hits.groupBy("id", "url", "at", "r").agg(F.max("best").alias("best"), F.lit(1).alias("one"))
    out = each.drop("r").unionByName(none.drop("r")).groupBy("id", "url", "at").agg(F.max("best").alias("best"), F.sum("one").alias("n_active"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), F.coalesce(F.col("best.action"), F.lit("none")).alias("verdict"), F.col("best.rule").alias("rule"), F.col("n_active").cast("long").alias("n_active"))
