"""Problem 7: passages of held-out evaluation items inside a training corpus."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmetrics.llm.confusables import skeleton, tables

WINDOW, MAX_REPLACED = 20, 2
#: Code points of items in one automaton.
BLOCK = 16_000_000
#: In place of a word's number: the pattern is the item's answer.
ANSWER = -1
_WORD = re.compile(r"\S+")


class _Alphabet(dict):
    """Translation of each character to its comparable form: look-alikes folded, case folded, no accents, nothing but letters and digits."""

    def __init__(self, strict: dict[int, str]) -> None:
        super().__init__()
        self.strict = strict

    def __missing__(self, cp: int) -> str:
        out = "".join(c for c in skeleton(chr(cp), self.strict).casefold() if c.isalnum())
        self[cp] = out
        return out


def _words(text: str, alphabet: _Alphabet) -> tuple[list[str], list[tuple[int, int]]]:
    """Comparable words (those with a letter or digit left) and their places in the text."""
    words, places = [], []
    for m in _WORD.finditer(text):
        if w := m.group().translate(alphabet):
            words.append(w)
            places.append(m.span())
    return words, places


def run_length(window: int, replaced: int) -> int:
    """With so many of ``window`` words replaced, some run of this many words is untouched (pigeonhole)."""
    return -(-(window - replaced) // (replaced + 1))


class Automaton:
    """Every run of ``n`` words of every item, and every answer, without spaces, in one Aho-Corasick automaton."""

    def __init__(self, items: list[tuple[object, str | None]], answers: dict[object, str], strict: dict[int, str], window: int, replaced: int) -> None:
        import ahocorasick

        self.alphabet, self.window, self.replaced = _Alphabet(strict), window, replaced
        n = run_length(window, replaced)
        self.items = {i: _words(t, self.alphabet)[0] for i, t in items if t}
        patterns: dict[str, list[tuple[object, int]]] = {}
        for i, words in self.items.items():
            if len(words) >= window:
                for k in range(len(words) - n + 1):
                    patterns.setdefault("".join(words[k : k + n]), []).append((i, k))
        for i, a in answers.items():
            if folded := a.translate(self.alphabet):
                patterns.setdefault(folded, []).append((i, ANSWER))
        self.n, self.machine = n, ahocorasick.Automaton()
        for pattern, where in patterns.items():
            self.machine.add_word(pattern, (len(pattern), where))
        if patterns:
            self.machine.make_automaton()
        self.empty = not patterns

    def spans(self, text: str) -> Iterator[tuple[object, bool, int, int, int, int]]:
        """(item, is an answer, first and last character, words, replaced words) of each passage and answer found, each once."""
        if self.empty:
            return
        stream = text.translate(self.alphabet)
        hits = list(self.machine.iter(stream))
        if not hits:
            return
        words, places = _words(text, self.alphabet)
        starts, ends, at = {}, {}, 0
        for j, w in enumerate(words):
            starts[at] = j
            at += len(w)
            ends[at] = j
        done: dict[object, set[tuple[int, int]]] = {}
        for end, (length, where) in hits:
            s, e = end - length + 1, end + 1
            for item, k in where:
                if k == ANSWER:
                    if s in starts and e in ends:
                        yield item, True, places[starts[s]][0], places[ends[e]][1], ends[e] - starts[s] + 1, 0
                    continue
                held = done.setdefault(item, set())
                if any(a <= s and end < b for a, b in held):
                    continue
                for a, b, n_words, n_replaced in self._grow(self.items[item], k, stream, s, e, words, starts, ends):
                    if (a, b) in held:
                        continue
                    held.add((a, b))
                    yield item, False, places[self._word_at(a, starts, words)][0], places[self._word_at(b - 1, starts, words)][1], n_words, n_replaced

    @staticmethod
    def _word_at(pos: int, starts: dict[int, int], words: list[str]) -> int:
        while pos not in starts:
            pos -= 1
        return starts[pos]

    def _grow(self, item: list[str], k: int, stream: str, s: int, e: int, words: list[str], starts: dict[int, int], ends: dict[int, int]) -> list[tuple[int, int, int, int]]:
        """Extend the run item[k:k+n] = stream[s:e] word by word to either side; the passages in it.

        A passage is a longest stretch in which every window holds few enough replaced words; it begins and ends with a window whose
        outer words agree.  Windows with more replaced words part two passages.
        """
        edges = {k + self.n: e}  # item word -> place in the stream where it starts; the last one ends it
        ok: dict[int, bool] = {}
        at = s
        for j in range(k, k + self.n):
            edges[j], ok[j] = at, True
            at += len(item[j])
        p, j, misses = e, k + self.n, 0
        while j < len(item) and misses <= self.replaced:  # to the right
            w = item[j]
            if stream.startswith(w, p):
                p, ok[j], misses = p + len(w), True, 0
            elif p in starts and not self._figure(w) and not self._figure(words[starts[p]]):
                p, ok[j], misses = p + len(words[starts[p]]), False, misses + 1
            else:
                break
            j += 1
            edges[j] = p
        hi = j
        p, j, misses = s, k - 1, 0
        while j >= 0 and misses <= self.replaced:  # to the left
            w = item[j]
            if p >= len(w) and stream.startswith(w, p - len(w)):
                p, ok[j], misses = p - len(w), True, 0
            elif p in ends and not self._figure(w) and not self._figure(words[ends[p]]):
                p, ok[j], misses = p - len(words[ends[p]]), False, misses + 1
            else:
                break
            edges[j] = p
            j -= 1
        lo = j + 1
        out, bad, stretch = [], 0, None
        for a in range(lo, hi - self.window + 2):  # one past the last window, to close the stretch
            b = a + self.window
            if b <= hi:
                bad = sum(not ok[x] for x in range(a, b)) if a == lo else bad - (not ok[a - 1]) + (not ok[b - 1])
            if b > hi or bad > self.replaced:
                if stretch:
                    x, y = stretch
                    out.append((edges[x], edges[y], y - x, sum(not ok[i] for i in range(x, y))))
                stretch = None
            elif ok[a] and ok[b - 1]:
                stretch = (stretch[0] if stretch else a, b)
        return out

    @staticmethod
    def _figure(word: str) -> bool:
        return any(c.isdigit() for c in word)


def _blocks(items: DataFrame, key: str, text: str) -> list[Column]:
    """Conditions that part the items into blocks of at most about BLOCK code points each."""
    size = items.agg(F.sum(F.length(text)).alias("n")).first()[0] or 0
    n = -(-size // BLOCK) or 1
    return [F.pmod(F.xxhash64(key), F.lit(n)) == k for k in range(n)]


def _found(documents: DataFrame, items: DataFrame, window: int, max_replaced: int, key: str, text: str, item_key: str, item_text: str, answer: str | None) -> DataFrame:
    """(doc_id, item_id, is_answer, start, end, words, replaced): passages and, with an ``answer`` column, answers, of one automaton for each block of items."""
    spark = documents.sparkSession
    _, strict = tables(spark)
    cols = [F.col(item_key).alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")]
    base = documents.select(F.col(key).alias(key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    held_out = items.select(*cols).where("i IS NOT NULL")
    item_type = items.select(item_key).schema[0].dataType
    fields = [base.schema[0], T.StructField(item_key, item_type), T.StructField("is_answer", T.BooleanType())] + [T.StructField(c, T.IntegerType()) for c in ("start", "end", "words", "replaced")]
    schema = T.StructType(fields)
    out = None
    for block in _blocks(held_out, "i", "t"):
        rows = held_out.where(block).collect()  # a block of the query set: at most about BLOCK code points
        shipped = spark.sparkContext.broadcast(([(r.i, r.t) for r in rows], {r.i: r.a for r in rows if r.a}, strict))
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], name: str = name, shipped: object = shipped) -> Iterator[pd.DataFrame]:
            machine = _machine(name, lambda: Automaton(*shipped.value, window, max_replaced))
            for pdf in batches:
                found = [(doc, *span) for doc, t in zip(pdf[key], pdf["_text"]) for span in machine.spans(t)]
                yield pd.DataFrame(found, columns=schema.fieldNames())

        part = base.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


_MACHINES: dict[str, Automaton] = {}


def _machine(name: str, make: Callable[[], Automaton]) -> Automaton:
    """One automaton for each worker and block, built by the first of its tasks."""
    if name not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[name] = make()
    return _MACHINES[name]


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, max_replaced: int = MAX_REPLACED, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and passage of an item in it: (doc_id, item_id, start, end, words, replaced).

    ``start`` and ``end`` are code points of the original text.  Words are separated by white space;
    case, punctuation, spacing, accents and look-alike forms don't count.  A passage holds at least ``window``
    consecutive words of the item with at most ``max_replaced`` replaced in any ``window`` of them, none of which is a figure,
    and begins and ends with words that agree.  Documents are never shuffled and are read once for each block of BLOCK code points of items: a
    held-out set, whose size doesn't depend on the corpus, is one block.  Null or empty texts contain nothing; items shorter than the window can't be found.
    """
    found = _found(documents, items, window, max_replaced, key, text, item_key, item_text, None)
    return found.drop("is_answer")


def leaked_answers(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str = "answer") -> DataFrame:
    """(doc_id, item_id, answers, passages): how often each document holds an item's answer as whole words, and passages of its text.

    Answers and runs of the texts are patterns of the same automaton.  An answer of a word or two says little by itself; together with a passage it says
    that question and answer leaked.  A null or empty answer has no pattern.
    """
    found = _found(documents, items, WINDOW, MAX_REPLACED, key, text, item_key, item_text, answer)
    return found.groupBy(key, item_key).agg(F.count_if("is_answer").alias("answers"), F.count_if(~F.col("is_answer")).alias("passages"))


def leaked_items(documents: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """Distinct (doc_id, item_id) of :func:`leaked_passages`."""
    found = leaked_passages(documents, items, **options)
    return found.select(*found.columns[:2]).distinct()
