"""Problem 9: texts that look the same but are written with different characters."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docmetrics.llm.confusables import consistent_form, skeleton, tables
from docmetrics.session import cut

LOOK = ["skeleton_key", "exact_key"]


def _digest(text: str, size: int) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _long(text: str) -> int:
    return int.from_bytes(_digest(text, 8), "big", signed=True)


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skeleton_key, exact_key, writing): digests of the skeleton, of the consistent text, of the text itself.

    The skeleton is that of the consistent text, so texts with the same consistent form never part in it.
    """
    loose, strict = tables(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast((loose, strict))  # fixed size: the look-alike table of Unicode
    base = df.select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = T.StructType([base.schema[0], T.StructField("skeleton_key", T.BinaryType()), T.StructField("exact_key", T.LongType()), T.StructField("writing", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_look, by_char = shipped.value
        for pdf in batches:
            looks, exact, writings = [], [], []
            for t in pdf["_text"]:
                form = consistent_form(t, by_char)
                looks.append(_digest(skeleton(form, by_look), 16))
                exact.append(_long(form))
                writings.append(_long(t) if form is not t else exact[-1])
            yield pd.DataFrame({key: pdf[key], "skeleton_key": looks, "exact_key": pd.Series(exact, dtype="int64"), "writing": pd.Series(writings, dtype="int64")})

    return base.where(F.col(key).isNotNull() & F.col("_text").isNotNull()).mapInPandas(run, schema)


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: equal skeleton, equal consistent text, different characters.

    Documents are grouped by a 128-bit digest of their skeleton.  The exact check that follows compares
    the consistent text, in which ASCII letters, figures and letter case stay apart (the skeleton alone
    takes 1, l and I for one).  Exact copies are no pair among themselves: pairs are found between distinct
    writings, so a group of copies isn't compared with itself.  Only digests are shuffled, never texts, and
    only groups with at least two writings reach the last join.  Rows with a null key or text take no part.
    """
    base = cut(_keys(df, key, text))
    writings = base.select(*LOOK, "writing").distinct()
    mixed = writings.groupBy(*LOOK).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*LOOK)
    members = base.join(mixed, LOOK, "left_semi").select(*LOOK, "writing", F.col(key).alias("_id"))
    some = members.select(*LOOK, "writing").distinct()
    a, b = (some.withColumnRenamed("writing", f"_w{x}") for x in "ab")
    pairs = a.join(b, LOOK).where("_wa < _wb")
    left, right = (members.select(*LOOK, F.col("writing").alias(f"_w{x}"), F.col("_id").alias(f"_i{x}")) for x in "ab")
    found = pairs.join(left, [*LOOK, "_wa"]).join(right, [*LOOK, "_wb"]).where("_ia <> _ib")
    return found.select(F.least("_ia", "_ib").alias(f"{key}_a"), F.greatest("_ia", "_ib").alias(f"{key}_b")).distinct()


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a text: (doc_id, class_id, class_documents, class_writings).

    ``class_id`` is the least id with that look; copies are members of the class, not pairs.
    """
    base = cut(_keys(df, key, text))
    per_writing = base.groupBy(*LOOK, "writing").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_n"))
    classes = per_writing.groupBy(*LOOK).agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_documents"), F.count(F.lit(1)).alias("class_writings"))
    return base.join(classes, LOOK).select(key, "class_id", "class_documents", "class_writings")


def consistent_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, consistent_text, changed): each document's text in the one form that equal-looking texts share.

    Width, font and look-alike forms become their ASCII or precomposed prototypes, zero-width characters go,
    every kind of space becomes an ordinary one.  A null text stays null and unchanged.
    """
    _, strict = tables(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(strict)

    @F.pandas_udf("string")
    def consistent(texts: pd.Series) -> pd.Series:
        table = shipped.value
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", consistent_form(t, table)))

    out = df.select(F.col(key).alias(key), F.col(text).alias("_text"), consistent(F.col(text)).alias("consistent_text"))
    return out.select(key, "consistent_text", (~F.col("_text").eqNullSafe(F.col("consistent_text"))).alias("changed"))
