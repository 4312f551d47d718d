"""Problem 6: noise in the text of scanned pages, found and repaired.

Four kinds: words hyphenated across lines (``hyphen``), wrongly recognised characters (``misread``), running
header or footer lines (``header``) and page numbers (``page_number``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docmetrics.session import cut

# What recognition makes of characters, right form first.
CONFUSIONS = [
    ("e", "c"), ("i", "l"), ("o", "0"), ("s", "5"), ("l", "1"), ("i", "1"), ("u", "ii"), ("m", "rn"), ("h", "b"), ("g", "q"),
    ("a", "4"), ("w", "vv"), ("in", "m"), ("b", "6"), ("b", "8"), ("li", "h"), ("g", "9"), ("z", "2"), ("l", "i"),
]
#: Letters that stand for figures in a number.
FIGURE_LETTERS = "OoIlbSBZ"
#: Words at least so frequent, and at most so many of them, go to every worker with their counts; all others are joined.
COMMON_FROM, COMMON_WORDS = 100, 50_000
#: A word is taken for a misreading of one so many times as frequent: by known confusions, the same for words under four characters, by one other edit.
RATIO, SHORT_RATIO, OTHER_RATIO = 3.0, 50.0, 200.0
#: Both parts of a word with a hyphen at a line end make up at least so much of all words: then it is a compound, unless the corpus writes it in one.
COMPOUND_PART = 1e-6
#: From this ratio on, a known confusion counts in every filing; below it only where the filing also has the right form.
SURE_RATIO = 50.0
#: Share of a word's occurrences that any neighbour has by chance; keeps an unseen neighbour from ruling a candidate out.
BY_CHANCE = 1e-3
#: Distinct words that a task counts at once.
HELD = 1_000_000
#: Bytes of word pairs that may go to every worker.
BROADCAST = 32 << 20
HYPHENS = "-­‐‑"

_LINE_END = re.compile(rf"[{HYPHENS}][ \t]*\n\s*")
#: A word that a line end cuts, and the rest of it; possessive, from the start of a run of letters only: linear in the length of any text.
_BROKEN = re.compile(rf"(?<![^\W\d_])[^\W\d_]++[{HYPHENS}][ \t]*+\n\s*+\S*+")
_TRIMMED = re.compile(r"(?s)[^\W_](?:.*[^\W_])?")
_WORD_END = re.compile(r"\S*[ \t]*\n?")
_WORD_START = re.compile(r"[^\W_]+")
#: Stripped from words, as the vocabulary does on the JVM.
_OUTER = "".join(c for c in map(chr, [*range(0x21, 0x250), *range(0x2010, 0x2070), *range(0x20A0, 0x20C0), 0x2212]) if not c.isalnum())
_NUMBER = re.compile(rf"(?=.*\d)(?=.*[{FIGURE_LETTERS}])[\d.,{FIGURE_LETTERS}]+")
_ORDINARY = re.compile(r"(?i)(?:q[1-4]|h[12]|\d+(?:st|nd|rd|th|s|m|bn|k|x|mm))")
_MARKS = re.compile(r"(?i)[\s|]*(?P<mark>page|p[.]?|f-|seite)?[\s\[|–-]*(?P<n>[\dOoIlSBb]{1,5})(?:\s*(?:of|/)\s*[\dOoIlSBb]+)?[\s\]|–-]*")
_ROMAN = re.compile(r"[\W_]*(?P<n>[ivxlcdm1]{1,15})[\W_]*")
_FIGURES = str.maketrans("OoIlSBb", "0011586")
_REPAIRED_FIGURES = str.maketrans("OoIlbSBZ", "00116582")
_LETTER = re.compile(r"[^\W\d_]")
_MIXED = re.compile(rf"[\d.,][{FIGURE_LETTERS}]|[{FIGURE_LETTERS}][\d.,]")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_COLUMNS = re.compile(r"\s{3,}|\t")
_ITEM = re.compile(r"(?:[•·▪*–—-]|\(?\w{1,3}[.)])\s")
_FOLD = str.maketrans({"c": "e", "i": "l", "1": "l", "|": "l", "0": "o", "5": "s", "4": "a", "6": "b", "h": "b", "8": "b", "q": "g"})


class Trie:
    """A vocabulary that an error-tolerant automaton walks through; each node knows the highest count below it."""

    def __init__(self, words: dict[str, int]) -> None:
        self.root: list = [{}, 0, 0]  # children, highest count at or below, count of the word that ends here
        for w, n in words.items():
            node = self.root
            node[1] = max(node[1], n)
            for c in w:
                node = node[0].setdefault(c, [{}, 0, 0])
                node[1] = max(node[1], n)
            node[2] = n

    def within(self, word: str, least: float = 1, other_least: float = 1, errors: int = 2) -> dict[str, tuple[int, bool, int]]:
        """Every vocabulary word that ``word`` may be a misreading of: word -> (errors, all of them known confusions, count).

        The automaton's states are (position, errors so far).  It accepts one edit of any kind, as a Levenshtein automaton
        does, or up to ``errors`` known confusions, where a pair such as m / rn is one.  Trie and automaton advance together;
        no candidate of at least the wanted count is missed.
        """
        out: dict[str, tuple[int, bool, int]] = {}
        stack = [(self.root, 0, 0, True, "")]
        end = len(word)
        while stack:
            (children, most, count), i, err, known, path = stack.pop()
            if most < (least if known else other_least):
                continue
            if i == end and count >= (least if known else other_least) and path != word:
                old = out.get(path)
                if old is None or (not known, err) < (not old[1], old[0]):
                    out[path] = (err, known, count)
            if i < end and word[i] in children:
                stack.append((children[word[i]], i + 1, err, known, path + word[i]))
            if not known or err >= errors:
                continue
            for right, wrong in CONFUSIONS:
                if word.startswith(wrong, i):
                    to = [children]
                    for c in right:
                        to = to[0].get(c)
                        if to is None:
                            break
                    else:
                        stack.append((to, i + len(wrong), err + 1, True, path + right))
            if err == 0 and most >= other_least:
                if i < end:
                    stack.append(([children, most, count], i + 1, 1, False, path))
                for c, to in children.items():
                    stack.append((to, i, 1, False, path + c))
                    if i < end and c != word[i]:
                        stack.append((to, i + 1, 1, False, path + c))
        return out


def page_texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, document_id, page_number, text): the page text, or its blocks in order where that is null (the latest delivery of each block).

    Pages with neither are left out.  Only the blocks of pages without a text pass the join.
    """
    base = pages.select("page_id", "document_id", "page_number", F.col("full_text").alias("text"))
    missing = base.where("text IS NULL").select("document_id", F.col("page_number").alias("page")).distinct()
    parts = blocks.select("document_id", "page", "block_index", "text", "parsed_at").join(missing, ["document_id", "page"], "left_semi")
    latest = parts.groupBy("document_id", "page", "block_index").agg(F.max_by("text", F.coalesce("parsed_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("text"))
    joined = latest.where("text IS NOT NULL").groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"]), "\n\n").alias("_blocks"))
    filled = base.where("text IS NULL").join(joined.withColumnRenamed("page", "page_number"), ["document_id", "page_number"])
    return base.where("text IS NOT NULL").unionByName(filled.select("page_id", "document_id", "page_number", F.col("_blocks").alias("text")))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts: lower case, without outer punctuation, words broken at a line end left out.

    Each task counts its texts' words before anything is shuffled, and hands on what it holds whenever that is HELD distinct words; they are trimmed once
    each, not at each place.  (The same on the JVM, by split, explode and regular expressions, took twice the time.)
    """

    def counted(counts: Counter[str]) -> pd.DataFrame:
        words: Counter[str] = Counter()
        for w, n in counts.items():
            if (m := _TRIMMED.search(w)) and any(map(str.isalpha, m.group())):
                words[m.group()] += n
        return pd.DataFrame(list(words.items()), columns=["word", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update((_BROKEN.sub(" ", text) if _LINE_END.search(text) else text).lower().split())
            if len(counts) >= HELD:
                yield counted(counts)
                counts = Counter()
        yield counted(counts)

    return texts.select("text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fold(word: Column) -> Column:
    """A key that any number of the known confusions leaves as it is: every confused character or pair becomes the same letters."""
    out = F.translate(word, "el1r05q942", "ciiiosggaz")
    for wide, narrow in (("m", "in"), ("h", "ii"), ("b", "ii"), ("6", "ii"), ("8", "ii"), ("u", "ii"), ("w", "vv")):
        out = F.replace(out, F.lit(wide), F.lit(narrow))
    return out


def _deletions(word: Column) -> Column:
    """The word and what is left of it without each one of its characters: two words an edit apart share one of these."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.transform(F.array_append(shorter, word), lambda w: F.xxhash64(w)))


def options(words: DataFrame) -> DataFrame:
    """(word, n, correct, n_correct, known, score): each word that may be a misreading of more frequent ones, with all its candidates.

    A word of two characters or more meets the words with the same :func:`fold`, which any misreading by known confusions has; one of five letters or more also those with
    which it shares a word by one deletion, as all words one edit apart do.  Of these only words so many times as frequent as it count (RATIO, OTHER_RATIO), and
    the automaton goes through the trie of each word's neighbours.  No word meets the rest of the vocabulary: the work grows with the number of distinct
    words.
    """
    usable = words.where(F.length("word") >= 2)
    right = usable.where(~F.col("word").rlike(r"\d") & (F.col("n") >= RATIO)).select(F.col("word").alias("c"), F.col("n").alias("m"))
    least = F.when(F.length("word") < 4, SHORT_RATIO).otherwise(RATIO) * F.col("n")
    a = usable.select("word", "n", F.xxhash64(fold(F.col("word"))).alias("key"))
    same = a.join(right.select("c", "m", F.xxhash64(fold(F.col("c"))).alias("key")), "key").where((F.col("m") >= least) & (F.col("word") != F.col("c")))
    long_ = usable.where((F.length("word") >= 5) & F.col("word").rlike(r"^\p{L}+$"))
    b = long_.select("word", "n", F.explode(_deletions(F.col("word"))).alias("key"))
    frequent = right.where(F.col("m") >= OTHER_RATIO).select("c", "m", F.explode(_deletions(F.col("c"))).alias("key"))
    near = b.join(frequent, "key").where((F.col("m") >= OTHER_RATIO * F.col("n")) & (F.col("word") != F.col("c")))
    met = same.select("word", "n", "c", "m").unionByName(near.select("word", "n", "c", "m"))
    neighbours = met.groupBy("word", "n").agg(F.collect_set(F.struct("c", "m")).alias("trie"))
    schema = "word string, n bigint, correct string, n_correct bigint, known boolean, score double"

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, n, trie in zip(pdf["word"], pdf["n"].astype(int), pdf["trie"]):
                other = OTHER_RATIO * n if len(word) >= 5 and word.isalpha() else float("inf")
                found = Trie({x["c"]: int(x["m"]) for x in trie}).within(word, (SHORT_RATIO if len(word) < 4 else RATIO) * n, other)
                rows += [(word, n, c, m, known, m * 0.05**err) for c, (err, known, m) in found.items()]
            yield pd.DataFrame(rows, columns=["word", "n", "correct", "n_correct", "known", "score"])

    return neighbours.mapInPandas(look_up, schema)


def corrections(found: DataFrame) -> DataFrame:
    """(word, n, correct, n_correct, known): the best of :func:`options`.  Known confusions rank before other edits, then the likelier of frequency and errors."""
    best = F.max_by(F.struct("n", "correct", "n_correct", "known"), F.struct("known", "score", "correct"))
    return found.groupBy("word").agg(best.alias("b")).select("word", "b.*")


def _key(line: str) -> str:
    """A header line's comparable form: figures and spaces out, look-alike recognitions folded together."""
    s = re.sub(r"[\W\d_]+", "", line.lower().translate(_FOLD))
    return s.replace("vv", "w").replace("ll", "u").replace("ln", "m").replace("rn", "m")


def _roman(s: str) -> int | None:
    """The value of a Roman numeral in its usual form (1 may stand for i), else None."""
    s = s.replace("1", "i")
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [value[c] for c in s]
    total = sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    usual, rest = "", total
    for size, form in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        usual += form * max(0, rest // size)
        rest %= size
    return total if usual == s else None


def _edges(lines: list[str]) -> Iterator[tuple[int, str, str | None, int | None, bool]]:
    """(line, part, header key, number, marked) of what may be furniture in the first and last lines of a page.

    The outermost line counts; the next one inwards only if the outermost may be a page number or header by itself
    and the inner line isn't a heading, which a caption in brackets or ordinary text follows.
    """
    full = [i for i, line in enumerate(lines) if line.strip()]
    if not full:
        return
    seen = set()
    for order in (full[:2], full[:-3:-1]):
        for depth, i in enumerate(order):
            if i in seen or depth and not any_number:
                break
            seen.add(i)
            any_number = False
            below = lines[full[full.index(i) + 1]].strip() if order == full[:2] and full.index(i) + 1 < len(full) else ""
            for part in re.split(r"\s{3,}|\t", lines[i].strip()):
                m = _MARKS.fullmatch(part)
                if m and any(c.isdigit() for c in part):
                    digits = m["n"].translate(_FIGURES)
                    marked = bool(m["mark"]) or not part.strip().isalnum()
                    any_number = True
                    if digits.isdigit():
                        yield i, part, None, int(digits), marked
                elif (m := _ROMAN.fullmatch(part)) and not m["n"].isdigit():
                    any_number = True
                    if (value := _roman(m["n"])) is not None:
                        yield i, part, None, value, False
                elif not part[0].islower() and not part.startswith("(") and not below.startswith("(") and len(part) <= 160 and sum(c.isalpha() for c in part) >= 4:
                    yield i, part, _key(part), None, False


def _broken(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, first part, second part) of the words that a hyphen at a line end cuts."""
    for m in _LINE_END.finditer(text):
        a = m.start()
        while a and text[a - 1].isalpha():
            a -= 1
        b = _WORD_START.match(text, m.end())
        if a < m.start() and b:
            yield a, b.end(), text[a : m.start()], b.group()


def _near(words: list[str], k: int) -> str:
    """The words before and after a word, comparable, separated by a space (either may be missing)."""
    return " ".join(words[j].strip(_OUTER).lower() if 0 <= j < len(words) else "" for j in (k - 1, k + 1))


def _misread_number(w: str) -> bool:
    rest = w[2:] if w.lower().startswith("fy") else w
    return any(c.isdigit() for c in w) and bool(_NUMBER.fullmatch(rest.rstrip("%"))) and not _ORDINARY.fullmatch(rest)


def marks(texts: DataFrame, common: dict[str, int], doubtful: set[str]) -> DataFrame:
    """What one reading of the pages finds: rows (page_id, document_id, page_number, kind, a, b, num).

    Decided here: ``hyphen`` (a, b: the parts; joined by the counts of common words) and ``misread`` (a: a number or word with
    letters and figures mixed).  For the joins that follow: ``word`` (a: not common), ``broken`` (a, b), ``number`` (num: offset from
    the page's place, a: line and part, b: marked as a page number) and ``head`` (a: key, b: part); num of head is the line.  b of ``word``
    and ``misread`` are the neighbouring words; a word has one row for each distinct pair of them on the page.  A page whose place in the filing
    is null has no ``number`` and no ``head``.
    """
    # at most COMMON_WORDS words; those with figures or with a correction are tested wherever they stand
    sound = {w for w in common if w not in doubtful and not any(c.isdigit() for c in w)}
    shipped = texts.sparkSession.sparkContext.broadcast((common, sound))
    schema = "page_id bigint, document_id string, page_number int, kind string, a string, b string, num bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, known = shipped.value
        for pdf in batches:
            out = []
            for page, doc, place, text in zip(pdf["page_id"], pdf["document_id"], pdf["page_number"], pdf["text"]):
                place = None if pd.isna(place) else int(place)
                at = (page, doc, place)
                chunks, last = [], 0
                for a, b, first, second in _broken(text):
                    if a < last:
                        continue
                    joined, split = (first + second).lower(), f"{first}-{second}".lower()
                    chunks.append(text[last:a])
                    if joined in counts or split in counts:
                        hyphen = counts.get(joined, 0) >= counts.get(split, 0)
                        chunks.append(joined if hyphen else split)
                        if hyphen:
                            out.append((*at, "hyphen", first, second, 0))
                    else:
                        out.append((*at, "broken", first.lower(), second.lower(), 0))
                        chunks.append(f"{first + second} ")
                    last = b
                chunks.append(text[last:])
                words = "".join(chunks).split()
                seen = set()
                for k, w in enumerate(words):
                    low = w.lower()
                    if low in known:
                        continue
                    w = w.strip(_OUTER)
                    low = w.lower()
                    if not w or low in known or w.isdigit():
                        continue
                    plain = low.isalpha()
                    if not plain and not _LETTER.search(w):
                        continue
                    near = _near(words, k)
                    if (low, near) in seen:
                        continue
                    seen.add((low, near))
                    if plain:
                        out.append((*at, "word", low, near, 0))
                        continue
                    digits, letters = sum(map(str.isdigit, w)), sum(map(str.isalpha, w))
                    rest = w[2:] if low.startswith("fy") else w
                    if _misread_number(w):
                        out.append((*at, "misread", w, near, 0))
                    elif digits and letters >= 2 and letters >= digits and rest == w and not _ORDINARY.fullmatch(w) and re.fullmatch(r"[^\W_]+", w):
                        out.append((*at, "misread", w, near, 0))
                    else:
                        out += [(*at, "word", x, near, 0) for x in re.split(r"[\W_]+", low) if x and not x.isdigit() and x not in known]
                for i, part, key, number, marked in _edges(text.split("\n")) if place is not None else ():
                    if number is not None:
                        out.append((*at, "number", f"{i}\t{part}", "marked" if marked else None, number - place))
                    elif key:
                        out.append((*at, "head", key, part, i))
            yield pd.DataFrame(out, columns=["page_id", "document_id", "page_number", "kind", "a", "b", "num"]).astype({"page_number": "Int64"})

    return texts.select("page_id", "document_id", "page_number", "text").mapInPandas(run, schema)


class Scan:
    """The tables that finding and repairing share; each is computed once."""

    def __init__(self, pages: DataFrame, blocks: DataFrame) -> None:
        self.texts = page_texts(pages, blocks)
        self.words = cut(vocabulary(self.texts))
        self.options = cut(options(self.words))
        self.corrections = cut(corrections(self.options))
        common = self.words.where(F.col("n") >= COMMON_FROM).join(self.corrections.select("word", F.lit(True).alias("doubtful")), "word", "left")
        common = common.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect()
        self.common = {r.word: r.n for r in common}
        self.marks = cut(marks(self.texts, self.common, {r.word for r in common if r.doubtful}))

    @cached_property
    def _misread(self) -> DataFrame:
        return cut(self.misread())

    def misread(self) -> DataFrame:
        """(page_id, word, correct): correct is null for numbers and words that mix letters and figures without a candidate."""
        m = self.marks.where("kind = 'word'").select("page_id", "document_id", F.col("a").alias("word"))
        hits = m.join(self.corrections, "word")
        sure = hits.where((F.col("n_correct") >= SURE_RATIO * F.col("n")) & (F.col("known") | (F.col("n_correct") >= OTHER_RATIO * F.col("n"))))
        unsure = hits.where(F.col("known") & (F.col("n_correct") < SURE_RATIO * F.col("n")))
        here = m.groupBy("document_id", "word").agg(F.countDistinct("page_id").alias("pages"))
        right = here.select("document_id", F.col("word").alias("correct"), F.col("pages").alias("right_pages"))
        wrong = here.select("document_id", "word", F.col("pages").alias("wrong_pages"))
        backed = unsure.join(right, ["document_id", "correct"]).join(wrong, ["document_id", "word"]).where("right_pages > wrong_pages")
        mixed = self.marks.where("kind = 'misread'").select("page_id", F.col("a").alias("word"), F.lit(None).cast("string").alias("correct"))
        cols = ("page_id", "word", "correct")
        return sure.select(*cols).unionByName(backed.select(*cols)).unionByName(mixed).distinct()

    def hyphens(self) -> DataFrame:
        """(page_id, a, b): parts of a word cut at a line end; compounds that are written with the hyphen aren't."""
        done = self.marks.where("kind = 'hyphen'").select("page_id", "a", "b")
        rest = self.marks.where("kind = 'broken'").select("page_id", "a", "b", F.concat("a", "b").alias("_j"), F.concat_ws("-", "a", "b").alias("_h"))
        n = {k: self.words.select(F.col("word").alias(k), F.col("n").alias(f"n{k}")) for k in ("_j", "_h", "a", "b")}
        for k, counts in n.items():
            rest = rest.join(counts, k, "left")
        joined, split = F.coalesce("n_j", F.lit(0)), F.coalesce("n_h", F.lit(0))
        rest = rest.crossJoin(F.broadcast(self.words.agg(F.sum("n").alias("_all"))))  # one row
        often = lambda c: F.coalesce(c, F.lit(0)) >= COMPOUND_PART * F.col("_all")
        compound = (joined == 0) & (split == 0) & F.col("na").isNotNull() & F.col("nb").isNotNull() & often("na") & often("nb")
        return done.unionByName(rest.where(((joined > 0) | (split == 0)) & (joined >= split) & ~compound).select("page_id", "a", "b"))

    def headers(self) -> DataFrame:
        """(page_id, line, part): running header and footer lines, by keys that recur on at least two pages of the filing.

        A key up to three edits away from a recurring one is the same line wrongly recognised.  The first page, a cover, has none.
        """
        heads = self.marks.where("kind = 'head' AND page_number > 1").select("document_id", "page_id", "page_number", F.col("a").alias("key"), F.col("num").alias("line"), F.col("b").alias("part"))
        keys = heads.groupBy("document_id", "key").agg(F.countDistinct("page_number").alias("_n"))
        recurring = keys.where("_n >= 2").select("document_id", F.col("key").alias("_key"))
        # each distinct key that doesn't recur meets the few of its filing that do; a recurring one is settled without
        odd = keys.where("_n < 2").select("document_id", "key").join(recurring, "document_id").where(F.levenshtein("key", "_key", 3) >= 0).select("document_id", "key").distinct()
        running = recurring.select("document_id", F.col("_key").alias("key")).unionByName(odd)
        return heads.join(running, ["document_id", "key"], "left_semi").select("page_id", "line", "part").distinct()

    def page_numbers(self) -> DataFrame:
        """(page_id, line, part): pages whose edge shows a number at the offset that other pages of the filing have too, or one marked as a page number."""
        m = self.marks.where("kind = 'number'").select("document_id", "page_id", "page_number", F.col("num").alias("offset"), (F.col("b") == "marked").alias("marked"), F.split("a", "\t", 2).alias("_at"))
        steady = m.groupBy("document_id", "offset").agg(F.countDistinct("page_number").alias("_n")).where("_n >= 2")
        return m.join(steady, ["document_id", "offset"], "left").where("_n IS NOT NULL OR marked").select("page_id", F.col("_at")[0].cast("bigint").alias("line"), F.col("_at")[1].alias("part")).distinct()

    def in_context(self) -> DataFrame:
        """(page_id, word, near, correct): the candidate that suits each place of a misread word best.

        Candidates by known confusions rank before others; then their frequency and errors count together with how often
        each of them follows the word before and precedes the word after, over all texts.
        """
        m = self.marks.where("kind IN ('word', 'misread')").select("page_id", F.lower("a").alias("word"), F.col("b").alias("near"))
        wrong = self._misread.select("page_id", F.lower("word").alias("word")).distinct()
        asked = m.join(wrong, ["page_id", "word"], "left_semi").join(self.options.drop("n"), "word")
        sides = F.split("near", " ")
        asked = cut(asked.select("*", F.concat_ws(" ", sides[0], "correct").alias("_l"), F.concat_ws(" ", "correct", sides[1]).alias("_r")))
        wanted = asked.select(F.explode(F.array("_l", "_r")).alias("pair")).distinct()
        wanted = cut(wanted)
        if (wanted.agg(F.sum(F.length("pair") + 16)).first()[0] or 0) <= BROADCAST:
            counts = _count_pairs(self.texts, wanted.toPandas()["pair"].tolist())
        else:  # too many to send: all pairs are counted before they are joined, so that each leaves a task once
            words = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_extract(w, r"[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)), lambda w: w != "")
            pairs = self.texts.select(words.alias("w")).select(F.explode(F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pair"))
            counts = pairs.where("pair IS NOT NULL").groupBy("pair").agg(F.count(F.lit(1)).alias("n")).join(wanted, "pair", "left_semi")
        counts = cut(counts)
        for c in ("_l", "_r"):
            asked = asked.join(counts.select(F.col("pair").alias(c), F.col("n").alias(f"n{c}")), c, "left")
        suits = F.col("score")
        for c in ("n_l", "n_r"):
            suits = suits * (F.coalesce(c, F.lit(0)) / F.col("n_correct") + BY_CHANCE)
        return asked.groupBy("page_id", "word", "near").agg(F.max_by("correct", F.struct("known", suits.alias("s"), "correct")).alias("correct"))

    def fixes(self) -> DataFrame:
        """(page_id, kind, a, b, c): what :func:`repair` needs of each page, each once."""
        none = F.lit(None).cast("string")
        lines = self.headers().unionByName(self.page_numbers()).select("page_id", F.lit("line").alias("kind"), F.col("line").cast("string").alias("a"), F.col("part").alias("b"), none.alias("c"))
        words = self.in_context().select("page_id", F.lit("word").alias("kind"), F.col("word").alias("a"), F.col("near").alias("b"), F.col("correct").alias("c"))
        hyphens = self.hyphens().select("page_id", F.lit("hyphen").alias("kind"), F.lower("a").alias("a"), F.lower("b").alias("b"), none.alias("c"))
        return lines.unionByName(words).unionByName(hyphens).distinct()

    @cached_property
    def _fixes(self) -> DataFrame:
        """Settled before the texts are read again: short plans keep the driver small."""
        return cut(self.fixes())

    def _in_order(self) -> DataFrame:
        """Pages and their fixes as rows, a filing's together and in order, the fixes of a page before its text (kind null): one shuffle, no join of the texts."""
        none = F.lit(None).cast("string")
        at = self.texts.select("page_id", "document_id", "page_number")
        fixes = self._fixes.join(at, "page_id").select("page_id", "document_id", "page_number", "kind", "a", "b", "c", none.alias("text"))
        pages = self.texts.select("page_id", "document_id", "page_number", none.alias("kind"), none.alias("a"), none.alias("b"), none.alias("c"), "text")
        filing = F.coalesce("document_id", F.col("page_id").cast("string"))  # pages of no filing are spread
        order = ["document_id", "page_number", "page_id", F.col("kind").asc_nulls_last()]
        return fixes.unionByName(pages).repartition(filing).sortWithinPartitions(*order)

    def repaired(self) -> DataFrame:
        """(page_id, document_id, page_number, text): every page that has a text, repaired.

        Misread words and numbers are put right, header lines and page numbers taken out, cut words joined and the lines of each paragraph
        made one; paragraphs are a blank line apart.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pages in _repaired_pages(batches):
                yield pd.DataFrame(pages, columns=["page_id", "document_id", "page_number", "text"]).astype({"page_number": "Int64"})

        return self._in_order().mapInPandas(run, "page_id bigint, document_id string, page_number int, text string")

    def paragraphs(self) -> DataFrame:
        """See :func:`paragraphs`."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            joiner = _Paragraphs()
            for pages in _repaired_pages(batches):
                yield pd.DataFrame(joiner.add(pages), columns=["document_id", "paragraph", "page_number", "text"])
            yield pd.DataFrame(joiner.end(), columns=["document_id", "paragraph", "page_number", "text"])

        return self._in_order().where("document_id IS NOT NULL AND page_number IS NOT NULL").mapInPandas(run, "document_id string, paragraph int, page_number int, text string")


def _count_pairs(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(pair, n): how often each wanted pair of neighbouring words stands in the texts; pairs that don't are left out.  ``wanted`` holds BROADCAST bytes at most."""
    shipped = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = frozenset(shipped.value)
        firsts = frozenset(p.partition(" ")[0] for p in pairs)
        counts: Counter[str] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                before = None
                for w in text.lower().split():
                    if not w.isalnum() and not (w := w.strip(_OUTER)):
                        continue
                    if before is not None and (pair := f"{before} {w}") in pairs:
                        counts[pair] += 1
                    before = w if w in firsts else None
        yield pd.DataFrame(list(counts.items()), columns=["pair", "n"])

    return texts.select("text").mapInPandas(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _repaired_pages(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(page_id, document_id, page_number, repaired text) of the pages in each batch of ordered rows; fixes wait for their page, also over batches."""
    fixes: list[tuple] = []
    for pdf in batches:
        out = []
        for page, doc, place, kind, a, b, c, text in pdf[["page_id", "document_id", "page_number", "kind", "a", "b", "c", "text"]].itertuples(index=False):
            if kind is not None:
                fixes.append((kind, a, b, c))
                continue
            out.append((page, doc, None if pd.isna(place) else int(place), repair(text, fixes)))
            fixes = []
        yield out


class _Paragraphs:
    """Puts the pages of filings, which come in order, together into paragraphs."""

    def __init__(self) -> None:
        self.page: tuple | None = None  # the last delivery so far of the page at hand
        self.doc, self.count, self.open = None, 0, None

    def add(self, pages: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for page in pages:
            if self.page and self.page[1:3] != page[1:3]:
                self._take(out)
            self.page = page
        return out

    def end(self) -> list[tuple]:
        out: list[tuple] = []
        if self.page:
            self._take(out)
        self._close(out)
        return out

    def _take(self, out: list[tuple]) -> None:
        _, doc, place, text = self.page
        if doc != self.doc:
            self._close(out)
            self.doc, self.count = doc, 0
        for k, p in enumerate(p for p in text.split("\n\n") if p):
            if not k and self.open and p[0].islower() and self.open[1][-1] not in ".!?:;":
                end = self.open[1]
                self.open = (self.open[0], end + ("" if end[-1] in HYPHENS else " ") + p)
            else:
                self._close(out)
                self.open = (place, p)

    def _close(self, out: list[tuple]) -> None:
        if self.open:
            self.count += 1
            out.append((self.doc, self.count, *self.open))
            self.open = None


def _as_written(correct: str, wrong: str) -> str:
    """The correction in the letter case of what it replaces."""
    letters = [c for c in wrong if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return correct.upper()
    return correct[:1].upper() + correct[1:] if wrong[:1].isupper() else correct


def _put_numbers(text: str) -> str:
    """Letters that stand for figures put right in every misread number.  Such a number has a figure, point or comma beside such a letter, which little else has."""
    chunks, last, n = [], 0, len(text)
    for m in _MIXED.finditer(text):
        a, b = m.span()
        if a < last:
            continue
        while a and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        w = text[a:b]
        core = w.strip(_OUTER)
        if _misread_number(core):
            head = core[:2] if core[:2].lower() == "fy" else ""
            w = w.replace(core, head + core[len(head) :].translate(_REPAIRED_FIGURES), 1)
        chunks += [text[last:a], w]
        last = b
    return "".join([*chunks, text[last:]])


def _put_words(text: str, by_place: dict[tuple[str, str], str], by_word: dict[str, str]) -> str:
    """Each misread word replaced wherever it stands between other characters than letters and figures, by the correction that suits its neighbours."""
    low, n = text.lower(), len(text)
    if len(low) != n:  # a few capitals have longer small forms
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    hits = []
    for key in by_word:
        i = low.find(key)
        while i >= 0:
            j = i + len(key)
            if not (i and low[i - 1].isalnum()) and not (j < n and low[j].isalnum()):
                hits.append((i, j, key))
            i = low.find(key, i + 1)
    chunks, last = [], 0
    for i, j, key in sorted(hits):
        a, b = i, j  # the word with what is written together with it
        while a and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        x = a - 1
        while x > 0 and text[x].isspace():
            x -= 1
        y = x
        while y > 0 and not text[y - 1].isspace():
            y -= 1
        before = text[y : x + 1] if a and not text[x].isspace() else ""
        x = b
        while x < n and text[x].isspace():
            x += 1
        y = x
        while y < n and not text[y].isspace():
            y += 1
        near = f"{before.strip(_OUTER).lower()} {text[x:y].strip(_OUTER).lower()}"
        chunks += [text[last:i], _as_written(by_place.get((key, near)) or by_word[key], text[i:j])]
        last = j
    return "".join([*chunks, text[last:]])


def repair(text: str, fixes: list[tuple]) -> str:
    """A page's text with its fixes: (line, number of the line, part), (word, word, neighbours, correction), (hyphen, first part, second part)."""
    furniture: dict[int, set[str]] = {}
    by_place, by_word, cut_words = {}, {}, set()
    for kind, a, b, c in sorted(fixes, key=str):
        if kind == "line":
            furniture.setdefault(int(a), set()).add(b)
        elif kind == "word":
            by_place[a, b] = c
            by_word.setdefault(a, c)
        else:
            cut_words.add((a, b))
    if furniture:
        lines = text.split("\n")
        for i, parts in furniture.items():
            lines[i] = None if set(all_ := _COLUMNS.split(lines[i].strip())) <= parts else "   ".join(p for p in all_ if p not in parts)
        text = "\n".join(line for line in lines if line is not None)
    if cut_words:
        chunks, last = [], 0
        for a, b, first, second in _broken(text):
            if a >= last and (first.lower(), second.lower()) in cut_words:
                chunks += [text[last:a], first, second]
                rest = _WORD_END.match(text, b)  # the line ends after the word instead of in it
                chunks.append(rest.group().rstrip() + "\n")
                last = rest.end()
        text = "".join([*chunks, text[last:]])
    text = _put_numbers(text)
    if by_word:
        text = _put_words(text, by_place, by_word)
    return reflow(text)


def reflow(text: str) -> str:
    """The lines of each paragraph made one; blank lines, headings, list items and rows of columns still end a paragraph."""
    out = []
    for block in _BLANK.split(text.strip("\n")):
        lines = [line for raw in block.split("\n") if (line := raw.strip())]
        if not lines:
            continue
        if len(lines) == 1:
            out.append(lines[0])
            continue
        least = 0.6 * max(map(len, lines))
        before, columns, joined = lines[0], bool(_COLUMNS.search(lines[0])), [lines[0]]
        for line in lines[1:]:
            wide = bool(_COLUMNS.search(line))
            if columns or wide or len(before) < least and not line[0].islower() or _ITEM.match(line):
                joined.append(line)
            else:
                joined[-1] += ("" if before[-1] in HYPHENS and len(before) > 1 and before[-2].isalnum() else " ") + line
            before, columns = line, wide
        out.append("\n".join(joined))
    return "\n\n".join(out)


def noise(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, kind): one row per page and kind of noise in its text (or its blocks where the text is null).

    Pages without any text have none; pages whose place in the filing is null have neither headers nor page numbers.  Repeated pages each have their own rows.
    """
    scan = Scan(pages, blocks)
    kinds = {"hyphen": scan.hyphens(), "misread": scan.misread(), "header": scan.headers(), "page_number": scan.page_numbers()}
    out = None
    for kind, df in kinds.items():
        part = df.select("page_id", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def paragraphs(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, paragraph, page_number, text): the repaired paragraphs of each filing in order, also across its pages; page_number is where one begins.

    Of a page that was delivered again the last delivery counts.  A paragraph goes on over a page break where it doesn't end like a sentence
    and the next page goes on in lower case.  Pages without filing or place are in none.  The texts are shuffled once, and a filing of any length passes
    through its task page by page.
    """
    return Scan(pages, blocks).paragraphs()
