"""Text helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def strip(x: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def head(x: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(x, 1, n)


def contains_any(x: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, contains one of the lower-case ``words``; null and empty texts don't."""
    low = F.coalesce(F.lower(x), F.lit(""))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def token_estimate(x: Column) -> Column:
    """A rough token count: a quarter of the code points, at least one; null stays null."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("bigint")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it; without it a chain of steps is written out again for each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def occurrences(x: Column, word: str, around: int = 500, case_sensitive: bool = False) -> Column:
    """Every place where ``word`` occurs, overlapping ones too: array of (position from 0, context).

    The text is cut before every place; the lengths of the parts give the positions.  The context reaches half of ``around`` code points to
    either side and keeps the text's own case.  Null or empty texts, and an empty word, give an empty array.
    """
    none = F.array().cast("array<struct<position: bigint, context: string>>")
    if not word:
        return none
    text, key = (x, word) if case_sensitive else (F.lower(x), word.lower())
    quoted = "\\Q" + key.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    half, k = around // 2, len(word)

    def places(text: Column) -> Column:
        # every part but the first begins at a place; an overlapping place may leave it shorter than the word
        first = text.startswith(key)
        empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when((a["at"] > 0) | first, F.concat(a["all"], F.array(a["at"]))).otherwise(a["all"]).alias("all"))
        return F.aggregate(F.split(text, f"(?={quoted})"), empty, step, lambda a: a["all"])

    def place(i: Column) -> Column:
        first = F.greatest(F.lit(1), i + 1 - half).cast("int")
        return F.struct(i.alias("position"), F.substr(x, first, (i + 1 + k + half - first).cast("int")).alias("context"))

    return F.coalesce(F.transform(let(text, places), place), none)


def snippet(x: Column, found: Column, around: int = 100) -> Column:
    """The text around the first place of ``found`` (any case), stripped; null where it doesn't occur."""
    at = F.instr(F.lower(x), F.lower(found))
    first = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, strip(F.substr(x, first, at + F.length(found) + around - first)))


def clean_json(x: Column) -> Column:
    """A model's reply without white space and code fences around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_object(x: Column) -> Column:
    """The reply as a VARIANT if it is a JSON object, else null.  NaN, Infinity and repeated keys aren't JSON here."""
    v = F.try_parse_json(clean_json(x))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
