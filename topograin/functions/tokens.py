"""Repairs of tagged tokens, each a left fold over a sentence's array of tokens.

A token is a struct (word, entity, score, start, end) with a tag O, B-x or I-x; start is
inclusive, end exclusive, in code points of the sentence. Folds stay in the plan as
higher-order functions: a sentence is one row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<word:string,entity:string,score:double,start:int,end:int>"
#: Tokens that connect the parts of a name.
CONNECTORS = ["-", ",", ".", "’", "'", "?"]
_EMPTY = f"array<{TOKEN}>"


def _token(t: Column, **new: Column) -> Column:
    return F.struct(*[new.get(k, t[k]).alias(k) for k in ("word", "entity", "score", "start", "end")])


def _type(tag: Column) -> Column:
    return F.when(tag == "O", "O").otherwise(F.substring_index(tag, "-", -1))


def _fold(tokens: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Left fold; step(previous, current) gives the current token, previous null at first."""

    def add(acc: Column, t: Column) -> Column:
        return F.array_append(acc, step(F.try_element_at(acc, F.lit(-1)), t))

    return F.aggregate(tokens, F.array().cast(_EMPTY), add)


def restore_words(tokens: Column, sentence: Column) -> Column:
    """Words as the sentence spells them; a ## prefix stays."""
    own = lambda t: sentence.substr(t["start"] + 1, t["end"] - t["start"])
    return F.transform(tokens, lambda t: _token(t, word=F.when(t["word"].startswith("##"), F.concat(F.lit("##"), own(t))).otherwise(own(t))))


def join_pieces(tokens: Column) -> Column:
    """Pieces with ## join the token before: its tag and start, the later end, the mean of the
    running score and the piece's. A piece without a token before stays."""

    def add(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = _token(last, word=F.concat(last["word"], F.replace(t["word"], F.lit("##"), F.lit(""))), score=(last["score"] + t["score"]) / 2, end=t["end"])
        piece = t["word"].startswith("##") & (F.size(acc) > 0)
        return F.when(piece, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(F.array_append(acc, t))

    return F.aggregate(tokens, F.array().cast(_EMPTY), add)


def fix_connectors(tokens: Column) -> Column:
    """A token on either side of a connector or digit goes on with the span before it, if
    types agree, it starts in lower case, it is a number, or the two touch."""
    link = lambda w: w.isin(*CONNECTORS) | w.rlike("^[0-9]$")

    def step(p: Column, t: Column) -> Column:
        both = (p["entity"] != "O") & (t["entity"] != "O")
        first = F.substring(t["word"], 1, 1)
        lower = (first == F.lower(first)) & (first != F.upper(first))
        near = (_type(p["entity"]) == _type(t["entity"])) | lower | t["word"].rlike(r"^\d+$") | (p["end"] == t["start"])
        go_on = both & (link(p["word"]) | link(t["word"])) & near
        return F.when(p.isNotNull() & go_on, _token(t, entity=F.concat(F.lit("I-"), _type(p["entity"])))).otherwise(t)

    return _fold(tokens, step)


def fix_nested(tokens: Column) -> Column:
    """A tagged token after a tagged "of" goes on with its span."""

    def step(p: Column, t: Column) -> Column:
        go_on = (F.lower(p["word"]) == "of") & (p["entity"] != "O") & (t["entity"] != "O")
        return F.when(p.isNotNull() & go_on, _token(t, entity=F.concat(F.lit("I-"), _type(p["entity"])))).otherwise(t)

    return _fold(tokens, step)


def fix_starts(tokens: Column) -> Column:
    """An I- tag at the start, after O, or after another type becomes B-."""

    def step(p: Column, t: Column) -> Column:
        begins = p.isNull() | (p["entity"] == "O") | (_type(p["entity"]) != _type(t["entity"]))
        return F.when(t["entity"].startswith("I-") & begins, _token(t, entity=F.concat(F.lit("B-"), _type(t["entity"])))).otherwise(t)

    return _fold(tokens, step)


def repair(tokens: Column, sentence: Column) -> Column:
    """All repairs in the order in which they rest on each other."""
    return fix_starts(fix_nested(fix_connectors(join_pieces(restore_words(tokens, sentence)))))
