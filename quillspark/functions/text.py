"""Text expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stopwords of keyword search. Those with an apostrophe never match a token.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
yourself yourselves
""".split()

_SPACE = r"(?U)^\s+|\s+$"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Trim every kind of white space, not spaces alone."""
    return F.regexp_replace(col(x), _SPACE, "")


def present(x: str | Column) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce(col(x) != "", F.lit(False))


def none_if_empty(x: str | Column) -> Column:
    return F.when(present(x), col(x))


def tokenize(x: str | Column, stopwords: bool = True) -> Column:
    """Lower-cased words of Unicode letters, digits and underscores, without stopwords and single characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(r"(?U)\b(\w+)\b"), 1)
    if not stopwords:
        return words
    # A pruned list (entries with an apostrophe cannot be tokens), which becomes a hash set.
    stop = [w for w in STOPWORDS if "'" not in w]
    return F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(stop))


def word_count(x: str | Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(x), F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def sha12(x: str | Column) -> Column:
    """First twelve hex digits of the SHA-256 of the lower-cased, stripped text."""
    return F.substring(F.sha2(F.lower(strip(x)), 256), 1, 12)


def synthetic_id(prefix: str, x: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}_SYNTH_"), sha12(x))


def snippet(abstract: str | Column, title: str | Column, length: int = 200) -> Column:
    return F.when(present(abstract), F.concat(F.substring(col(abstract), 1, length), F.lit("..."))).otherwise(col(title))


def excerpt(text: str | Column, length: int = 250) -> Column:
    text = F.when(present(text), col(text)).otherwise("(No abstract)")
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def inverted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, inverted``: word to positions, the form in which abstracts arrive; undone by ``reconstruct``.

    Each row by itself: its words are sorted with their places and cut where the word changes, so
    nothing is shuffled, keys may repeat and a null text stays null.
    """
    pairs = F.sort_array(F.transform(F.split(col(text), " "), lambda w, i: F.struct(w.alias("word"), i.alias("place"))))
    first = lambda v, i: (i == 0) | (F.get(v, i - 1)["word"] != F.get(v, i)["word"])
    starts = lambda v: F.filter(F.transform(v, lambda x, i: F.when(first(v, i), i)), lambda i: i.isNotNull())
    entry = lambda v, s, i, k: F.struct(F.get(v, i)["word"].alias("word"), F.slice(v, i + 1, F.coalesce(F.get(s, k + 1), F.size(v)) - i)["place"].alias("places"))
    entries = let(pairs, lambda v: let(starts(v), lambda s: F.transform(s, lambda i, k: entry(v, s, i, k))))
    return docs.select(key, F.map_from_entries(entries).alias("inverted"))


def let(x: Column, body) -> Column:
    """``body`` of the value of ``x``, which is computed once however often ``body`` mentions it."""
    return F.get(F.transform(F.array(x), body), 0)


def reconstruct(index: str | Column) -> Column:
    """Text of an inverted index. Gaps leave empty words, of words that share a place the last entry
    wins, negative places are ignored, an empty result is null."""
    entries = F.map_entries(col(index))
    pairs = F.flatten(F.transform(entries, lambda e, k: F.transform(F.coalesce(e["value"], F.array()), lambda p: F.struct(p.cast("int").alias("p"), k.alias("k"), e["key"].alias("w")))))
    pairs = F.sort_array(F.filter(pairs, lambda x: x["p"] >= 0))
    # The highest k of a place comes last in the sorted order.
    winners = let(pairs, lambda v: F.filter(v, lambda x, i: F.coalesce(F.get(v, i + 1)["p"] != x["p"], F.lit(True))))
    # As many spaces before a word as places since the word before it.
    gap = lambda v, x, i: x["p"] - F.when(i > 0, F.get(v, i - 1)["p"]).otherwise(0)
    parts = let(winners, lambda v: F.transform(v, lambda x, i: F.concat(F.repeat(F.lit(" "), gap(v, x, i)), x["w"])))
    return let(strip(F.array_join(parts, "")), none_if_empty)
