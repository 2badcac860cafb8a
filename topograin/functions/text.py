"""Text functions as columns: sentences, dashes, mention noise, wiki links, context words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that end no sentence.
ABBREVIATIONS = "St Mr Mrs Ms Dr Prof Rev Hon Gen Col Capt Lieut Sir Esq No Nos Vol vol viz etc Co Jun Sen Messrs".split()
#: Frequent words that carry no context.
STOP_WORDS = "about above after again also because been before being between both could does doing down during each from further have having here into itself just more most only other ought over same should some such than that their them then there these they this those through under until very were what when where which while whom will with would your yours".split()
PUNCTUATION = "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"
SENTENCE_END = r"""([.!?]+["')\]]*)\s+(["'(\[]*\p{Lu})"""
GUARDED = rf"(^|[^\p{{L}}])({'|'.join(ABBREVIATIONS)})\.(\s)"
_GUARD, _CUT = "\x02", "\x01"


def sentences(text: Column) -> Column:
    """Sentences of a text: a cut follows . ! or ? (and closing quotes) before white space and a
    capital letter, but not after an abbreviation. Texts stay whole; null gives null."""
    guarded = F.regexp_replace(text, GUARDED, f"$1$2{_GUARD}$3")
    cut = F.regexp_replace(guarded, SENTENCE_END, f"$1{_CUT}$2")
    return F.split(F.replace(cut, F.lit(_GUARD), F.lit(".")), _CUT)


def normal_dashes(sentence: Column) -> Column:
    """Em dashes after the first character become commas; null for at most one character."""
    rest = F.replace(sentence.substr(F.lit(2), F.length(sentence)), F.lit("—"), F.lit(","))
    return F.when(F.length(sentence) > 1, F.concat(F.substring(sentence, 1, 1), rest))


def is_mention(mention: Column) -> Column:
    """True unless a mention is one character or all its cased characters are lower-case."""
    lower = (mention == F.lower(mention)) & mention.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]")
    return (F.length(mention) != 1) & ~lower


def coarse_tag(tag: Column) -> Column:
    return F.when(tag.startswith("B-"), "B-LOC").when(tag.startswith("I-"), "I-LOC").otherwise(tag)


def wiki_link(url: Column) -> Column:
    """A wiki page name in one spelling: lower-case, decoded, blanks for underscores, without
    the fragment, encoded again (%20 for a blank; ~ and / stay)."""
    bare = F.lower(url)
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    page = F.split_part(F.replace(decoded, F.lit("_"), F.lit(" ")), F.lit("#"), F.lit(1))
    out = F.url_encode(page)
    for a, b in (("+", "%20"), ("%7E", "~"), ("%2F", "/"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def wiki_title(url: Column) -> Column:
    """The title that a page name stands for: decoded, underscores for blanks."""
    link = wiki_link(url)
    return F.replace(F.coalesce(F.try_url_decode(link), link), F.lit(" "), F.lit("_"))


def context_words(text: Column) -> Column:
    """Words of a text, punctuation but ' and - removed."""
    bare = F.trim(F.regexp_replace(F.translate(text, PUNCTUATION, ""), r"\s+", " "))
    return F.filter(F.split(bare, " "), lambda w: w != "")


def is_important(word: Column, stop_words: list[str] | None = None) -> Column:
    """False for three characters or less, stop words and numbers."""
    stops = F.array(*[F.lit(w) for w in stop_words or STOP_WORDS])
    number = word.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$") | F.lower(word).isin("nan", "infinity", "+infinity", "-infinity", "+inf", "-inf", "+nan", "-nan")
    return (F.length(word) > 3) & ~F.array_contains(stops, F.lower(word)) & ~number
