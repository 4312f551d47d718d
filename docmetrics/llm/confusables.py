"""Look-alike characters: one prototype for every character that can be mistaken for another.

The table isn't typed in.  It is built from two public rules: the skeleton data of the Unicode
look-alike table, which the ICU library among Spark's own jars carries, and the compatibility
decompositions that only concern width, font, spacing or ligatures.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession

#: Decompositions that keep the look of a character: <super>, <sub>, <circle>, <fraction> don't.
SAME_LOOK = frozenset({"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>"})
#: Palochka is drawn as a bare stem; the public table takes it for an i.
OVERRIDES = {0x4CF: "l", 0x4C0: "I"}
#: Beyond the last one there are only private code points.
FIRST, LAST = 0x80, 0xF0000

_TABLES: dict[str, dict[int, str]] = {}


def _code_points() -> list[int]:
    return [c for c in range(FIRST, LAST) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and not chr(c).isspace()]


def _prototypes(spark: SparkSession) -> dict[int, str]:
    """Prototype of each character; one call into the JVM for all of them."""
    points = [*range(0x21, 0x7F), *_code_points()]
    if getattr(spark, "_jvm", None) is None:
        raise RuntimeError("the look-alike table is read from a library of the driver's JVM, which a Spark Connect session doesn't have")
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    parts = checker.getSkeleton("\n".join(map(chr, points))).split("\n")
    if len(parts) != len(points):
        raise RuntimeError("the look-alike table can't be read")
    return dict(zip(points, parts)) | OVERRIDES


def _cased(ch: str, prototype: str) -> str:
    """The prototypes l, O, rn and '' each stand for several ASCII forms; pick the one of the same kind."""
    kind = unicodedata.category(ch)
    if prototype == "l":
        return "I" if kind == "Lu" else "1" if kind == "Nd" else "l"
    if prototype == "O":
        return "0" if kind == "Nd" else "O"
    return {"rn": "m", "''": '"'}.get(prototype, prototype)


def _table(prototypes: dict[int, str], strict: bool) -> dict[int, str]:
    out = {}
    for cp in [*range(0x21, 0x7F), *range(FIRST, LAST)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co") or kind == "Cc" and cp != 0x85:
            continue
        if kind == "Cf" or cp == 0x34F:  # zero-width characters, soft hyphens, direction marks
            out[cp] = ""
        elif kind == "Zs":
            out[cp] = " "
        elif kind in ("Zl", "Zp") or cp == 0x85:
            out[cp] = "\n"
        else:
            tag = unicodedata.decomposition(ch).partition(" ")[0]
            parts = unicodedata.normalize("NFKD" if tag in SAME_LOOK else "NFD", ch)
            if strict:
                to = "".join(x if x.isascii() else _cased(x, prototypes.get(ord(x), x)) for x in parts)
            else:
                to = "".join(prototypes.get(ord(x), x) for x in parts)
            if to != ch:
                out[cp] = to
    return out


def tables(spark: SparkSession) -> tuple[dict[int, str], dict[int, str]]:
    """(skeleton, strict): the strict table leaves ASCII as it is, so that l, I and 1 or m and rn stay apart."""
    if not _TABLES:
        prototypes = _prototypes(spark)
        _TABLES.update(skeleton=_table(prototypes, False), strict=_table(prototypes, True))
    return _TABLES["skeleton"], _TABLES["strict"]


def skeleton(text: str, table: dict[int, str]) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
    text = text.translate(table)
    return text if text.isascii() else unicodedata.normalize("NFD", text)


def consistent_form(text: str, strict: dict[int, str]) -> str:
    """The text with the strict table applied, which changes no ASCII character."""
    return text if text.isascii() else skeleton(text, strict)
