"""Problem 4: variant spellings of company names, linked and clustered."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docmetrics.session import cut

# Legal forms, words that say what a firm does or is, their usual abbreviations, first names and their short forms.
LEGAL = {
    "plc": "plc", "llc": "llc", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co",
    "company": "co", "gmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "sa": "sa", "nv": "nv",
}
DESCRIPTORS = """associates brewing brothers chemicals communications daughters development energy engineering financial foods group holdings industries
instruments insurance international laboratories logistics manufacturing materials minerals packaging partners pharmaceuticals properties services shipping
sons technologies textiles""".split()
SHORT = {
    "assoc": "associates", "assocs": "associates", "brwg": "brewing", "brew": "brewing", "bros": "brothers", "chem": "chemicals", "chems": "chemicals",
    "comm": "communications", "comms": "communications", "dev": "development", "devt": "development", "engy": "energy", "eng": "engineering",
    "engrg": "engineering", "engg": "engineering", "fin": "financial", "fincl": "financial", "fds": "foods", "grp": "group", "hldg": "holdings",
    "hldgs": "holdings", "ind": "industries", "inds": "industries", "instr": "instruments", "instrs": "instruments", "ins": "insurance",
    "intl": "international", "lab": "laboratories", "labs": "laboratories", "log": "logistics", "logist": "logistics", "mfg": "manufacturing",
    "manuf": "manufacturing", "mat": "materials", "matls": "materials", "min": "minerals", "mins": "minerals", "pkg": "packaging", "ptnrs": "partners",
    "pharm": "pharmaceuticals", "pharma": "pharmaceuticals", "prop": "properties", "props": "properties", "serv": "services", "svc": "services",
    "svcs": "services", "shpg": "shipping", "ship": "shipping", "tech": "technologies", "technol": "technologies", "techs": "technologies", "text": "textiles",
    "txtl": "textiles", "txtls": "textiles",
}
FIRST_NAMES = {
    "alexander": "alex sandy", "charles": "charlie chas chuck", "edward": "ed eddie ned ted", "elizabeth": "liz beth betty eliza lizzie",
    "frederick": "fred freddie", "joseph": "joe joey jos", "katherine": "kate kathy katie kath", "margaret": "maggie peggy meg marge",
    "richard": "dick rick rich", "robert": "bob rob bobby robt", "theodore": "ted theo teddy", "william": "bill will billy wm",
}
_GIVEN: dict[str, set[str]] = {}
for _name, _shorts in FIRST_NAMES.items():
    for _s in [_name, *_shorts.split()]:
        _GIVEN.setdefault(_s, set()).add(_name)

#: q-grams, bands and rows of the signatures; see :func:`collision`.
Q, BANDS, ROWS = 3, 40, 2
#: Least Monge-Elkan similarity of the distinctive words.
SIMILAR = 0.88
_PRIME = (1 << 61) - 1
_SEPARATORS = re.compile(r"[\s,_;:/()\"-]+")


def collision(s: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of Jaccard similarity ``s`` share a band; 40 bands of 2 rows find 99 % of the pairs at 0.33 (two typos in a short name)."""
    return 1 - (1 - s**rows) ** bands


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between two words, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _near(word: str, lexicon: list[str]) -> str | None:
    """The lexicon's word with one typo (two in long ones), if there is one."""
    most = 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0
    return next((x for x in lexicon if most and x[0] == word[0] and edit_distance(word, x, most) <= most), None)


def signature(raw: str | None) -> tuple[str, str] | None:
    """(signature, initials) of a name, or None for names that say nothing (null, blank, unknown).

    The signature is "first names|distinctive words|descriptors|legal form": case, accents, punctuation, order, abbreviations and
    short forms of first names don't count.  A distinctive word cut off with a full stop keeps it.
    """
    if raw is None:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", raw.replace("&", " and ").replace("+", " and ")) if not unicodedata.combining(c)).casefold()
    words = [(w.replace(".", "").replace("'", "").replace("’", ""), w.endswith(".") and w.count(".") == 1) for w in _SEPARATORS.split(s) if w.strip(".'’")]
    if not words or [w for w, _ in words] in (["unknown"], ["na"], ["n", "a"]):
        return None
    if words[0][0] == "the" and len(words) > 1:
        words = words[1:]
    text = [w for w, _ in words]
    legal, out = "", []
    i = 0
    while i < len(text):
        w, dotted = words[i]
        if text[i : i + 3] == ["public", "limited", "company"]:
            legal, i = "plc", i + 3
        elif text[i : i + 2] == ["s", "a"] and i + 2 == len(text):
            legal, i = "sa", i + 2
        elif w in ("company", "co") and i and text[i - 1] == "and" and len(text) > 2:
            out.append(("andcompany", False))
            i += 1
        elif w in LEGAL or (len(w) >= 7 and (w2 := _near(w, ["incorporated", "corporation", "limited", "company", "aktiengesellschaft"])) and w2):
            form = LEGAL.get(w) or LEGAL[w2]
            legal, i = (form if not legal or form != "co" else legal), i + 1
        else:
            if w != "and":
                out.append((w, dotted))
            i += 1
    first, core, kinds, initials = set(), [], set(), ""
    for k, (w, dotted) in enumerate(out):
        initials += "c" if w == "andcompany" else w[0]
        if w == "andcompany" or w in DESCRIPTORS:
            kinds.add(w)
        elif w in SHORT:
            kinds.add(SHORT[w])
        elif w in _GIVEN:
            first |= _GIVEN[w]
        elif len(w) == 1:
            first.add(w)
        elif (x := _near(w, DESCRIPTORS)) and len(out) > 1:
            kinds.add(x)
        elif (x := _near(w, list(FIRST_NAMES))) and len(out) > 1:
            first.add(x)
        else:
            core.append(w + "." * dotted)
    if not core and not kinds and not first:
        return None
    return "|".join((" ".join(sorted(first)), " ".join(sorted(core)), " ".join(sorted(kinds)), legal)), initials


def word_similarity(a: str, b: str) -> float:
    """Inner similarity: 1 for a word cut off with a full stop and a word that it begins, else Jaro-Winkler within two edits."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 1.0
    short, long_ = sorted((x, y), key=len)
    if (a if short == x else b).endswith(".") and len(short) >= 3 and (long_.startswith(short) or edit_distance(short, long_[: len(short)], 1) <= 1):
        return 0.97
    most = 2 if len(short) >= 6 else 1
    return jaro_winkler(x, y) if edit_distance(x, y, most) <= most else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The lesser of both directions' mean best similarity: no word of either side may be left without a counterpart."""
    if not a or not b:
        return 0.0
    sims = [[word_similarity(x, y) for y in b] for x in a]
    return min(sum(map(max, sims)) / len(a), sum(max(row[j] for row in sims) for j in range(len(b))) / len(b))


def similarity(a: str, b: str) -> tuple[float, bool]:
    """(similarity, sure) of two signatures; 0 if they contradict each other.

    Different legal forms, descriptors or first names contradict; a missing part doesn't, but missing descriptors make the link unsure.
    """
    (first_a, core_a, kind_a, legal_a), (first_b, core_b, kind_b, legal_b) = ([p.split() for p in s.split("|")] for s in (a, b))
    if legal_a and legal_b and legal_a != legal_b or kind_a and kind_b and kind_a != kind_b:
        return 0.0, False
    if first_a and first_b:
        full, initial = ({x for x in [*first_a, *first_b] if len(x) > 1}, {x for x in [*first_a, *first_b] if len(x) == 1})
        if not set(first_a) & set(first_b) and not (initial and any(x[0] in initial for x in full)):
            return 0.0, False
    # names of general words only: compared by those, and by first names where there are none
    sim = monge_elkan(core_a, core_b) if core_a or core_b else float(kind_a == kind_b and (bool(kind_a) or bool(set(first_a) & set(first_b))))
    return sim, kind_a == kind_b and bool(first_a) == bool(first_b)


def _bands(core: list[str]) -> list[int]:
    """Keys of the bands of the MinHash signature over padded q-grams of the distinctive words."""
    grams = {p[i : i + Q] for w in core for p in ["#" * (Q - 1) + w.rstrip(".") + "#" * (Q - 1)] for i in range(len(p) - Q + 1)}
    x = np.array([zlib.crc32(g.encode()) for g in grams], dtype=np.uint64)
    # multiply-shift hashing: the high half of an odd multiple
    mins = ((x[:, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)).min(axis=0)
    mixed = mins.reshape(BANDS, ROWS)
    key = mixed[:, 0].copy()
    for r in range(1, ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[:, r]
    return key.view(np.int64).tolist()


_rng = np.random.default_rng(4)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signatures(names: DataFrame) -> DataFrame:
    """(company, sig, initials) of each distinct name that says something."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, *s) for n in pdf["company"] if (s := signature(n))]
            yield pd.DataFrame(rows, columns=["company", "sig", "initials"])

    return names.select("company").distinct().mapInPandas(run, "company string, sig string, initials string")


def _telling(sig: str) -> list[str]:
    """The words whose q-grams make the bands: the distinctive ones, else the descriptors, else the first names."""
    first, core, kinds, _ = sig.split("|")
    return (core or kinds or first).split()


def candidates(sigs: DataFrame, all_pairs: bool = False) -> DataFrame:
    """(a, b) pairs of signatures that share a band, ``b`` being one with is_hub, or with ``all_pairs`` any, each pair once.

    With hubs only, a name spelled in thousands of ways meets the few spellings of the reference list, not the other thousands.  All pairs are between distinct
    signatures, which spellings that differ in case, order, punctuation or abbreviations share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, hub, k, key) for s, hub in zip(pdf["sig"], pdf["is_hub"]) for k, key in enumerate(_bands(_telling(s)))]
            yield pd.DataFrame(rows, columns=["sig", "is_hub", "band", "key"])

    banded = sigs.select("sig", "is_hub").mapInPandas(run, "sig string, is_hub boolean, band int, key bigint")
    a = banded.select("band", "key", F.col("sig").alias("a"))
    if all_pairs:
        return a.join(banded.select("band", "key", F.col("sig").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()
    hubs = banded.where("is_hub").select("band", "key", F.col("sig").alias("b"))
    return a.join(hubs, ["band", "key"]).where("a <> b").select("a", "b").distinct()


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b, sim, sure) of the pairs that don't contradict each other and are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, b, s, sure) for a, b in zip(pdf["a"], pdf["b"]) for s, sure in [similarity(a, b)] if s >= SIMILAR]
            yield pd.DataFrame(rows, columns=["a", "b", "sim", "sure"])

    return pairs.mapInPandas(run, "a string, b string, sim double, sure boolean")


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sig, centre): star clustering of a graph given by its nodes (sig) and its edges (a, b, sim) in one direction or both.

    Again and again every node that outranks its unassigned neighbours (by links, then name) becomes a centre and its unassigned neighbours its
    satellites; in the end a satellite belongs to the most similar centre next to it.  The rounds are joins over all edges and
    stop when no node is left; nothing is collected but the count of what is left.
    """
    both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    both = cut(both.groupBy("a", "b").agg(F.max("sim").alias("sim")))
    degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("_d"))
    left = cut(nodes.select("sig").distinct().join(degrees.withColumnRenamed("a", "sig"), "sig", "inner").select("sig", "_d"))
    centres = None
    while True:  # the highest of what is left becomes a centre, so each round takes some nodes out
        rank = left.select(F.col("sig").alias("b"), F.struct("_d", "sig").alias("_rank"))
        best = both.join(rank, "b").join(left.select(F.col("sig").alias("a")), "a").groupBy("a").agg(F.max("_rank").alias("_best"))
        new = left.join(best.withColumnRenamed("a", "sig"), "sig", "left").where(F.col("_best").isNull() | (F.struct("_d", "sig") > F.col("_best"))).select("sig")
        new = cut(new)
        centres = new if centres is None else centres.unionByName(new)
        covered = both.join(new.withColumnRenamed("sig", "b"), "b").select(F.col("a").alias("sig")).unionByName(new)
        left = cut(left.join(covered.distinct(), "sig", "left_anti"))
        if left.isEmpty():
            break
    satellites = both.join(centres.select(F.col("sig").alias("b")), "b").join(centres.select(F.col("sig").alias("a")), "a", "left_anti")
    satellites = satellites.groupBy("a").agg(F.max_by("b", F.struct("sim", "b")).alias("centre")).select(F.col("a").alias("sig"), "centre")
    alone = nodes.select("sig").distinct().join(degrees.withColumnRenamed("a", "sig"), "sig", "left_anti").select("sig", F.col("sig").alias("centre"))
    return satellites.unionByName(centres.select("sig", F.col("sig").alias("centre"))).unionByName(alone)


class Names:
    """Names of two lists, linked through the spellings of the reference list, or with ``all_pairs`` also with one another."""

    def __init__(self, typed: DataFrame, reference: DataFrame, all_pairs: bool = False) -> None:
        both = typed.select("company", F.lit(False).alias("is_hub")).unionByName(reference.select("company", F.lit(True).alias("is_hub"))).where("company IS NOT NULL")
        flags = both.groupBy("company").agg(F.max("is_hub").alias("is_hub"))
        self.names = cut(signatures(flags).join(flags, "company"))
        self.sigs = self.names.groupBy("sig").agg(F.max("is_hub").alias("is_hub"))
        self.links = cut(verified(candidates(self.sigs, all_pairs)))
        self.clusters = cut(star_clusters(self.sigs, self.links.where("sure")))

    def unsure(self) -> DataFrame:
        """(sig, centre): names that may stand for the cluster: without the words that say what the firm does, or its initials only."""
        weak = self.links.where("NOT sure").select(F.col("a").alias("sig"), F.col("b").alias("hub"), "sim")
        legal, words = F.split("sig", "\\|")[3], F.split("sig", "\\|")
        short = self.names.where((words[0] == "") & (words[2] == "") & F.length(words[1]).between(2, 5)).select("sig", words[1].alias("initials"), legal.alias("legal")).distinct()
        full = self.names.where("is_hub").select("initials", legal.alias("hub_legal"), F.col("sig").alias("hub")).where(F.length("initials") >= 2).distinct()
        acronyms = short.join(full, "initials").where("(legal = '' OR hub_legal = '' OR legal = hub_legal) AND sig <> hub").select("sig", "hub", F.lit(0.95).alias("sim"))
        found = weak.unionByName(acronyms).join(self.clusters.select(F.col("sig").alias("hub"), "centre"), "hub")
        return found.groupBy("sig", "centre").agg(F.max("sim").alias("sim"))


def linked_rows(filings: DataFrame, records: DataFrame) -> DataFrame:
    """(filing_id, gt_id): rows of the same fiscal year and organisation whose company strings aren't identical.

    Sure links share a star.  Unsure ones count if the filing has no sure link at all and only one organisation of that
    year comes into question.  Names that are null, blank or unknown are never linked; identical strings are no pair.
    """
    names = Names(filings, records)
    sig = names.names.select("company", "sig")
    cluster = sig.join(names.clusters, "sig").select("company", "centre")
    left = filings.where("fiscal_year IS NOT NULL AND filing_id IS NOT NULL").select("filing_id", "company", "fiscal_year")
    right = records.where("fiscal_year IS NOT NULL AND gt_id IS NOT NULL").select("gt_id", F.col("company").alias("gt_company"), "fiscal_year")
    right = right.join(cluster.select(F.col("company").alias("gt_company"), "centre"), "gt_company")
    sure = left.join(cluster, "company").join(right, ["centre", "fiscal_year"])
    hubs = right.select("centre").distinct()
    settled = cluster.join(hubs, "centre", "left_semi").select("company")
    maybe = left.join(settled.distinct(), "company", "left_anti").join(sig, "company").join(names.unsure(), "sig").drop("sim")
    maybe = cut(maybe.join(right, ["centre", "fiscal_year"]))
    single = maybe.groupBy("filing_id").agg(F.min("centre").alias("_a"), F.max("centre").alias("_b")).where("_a = _b").select("filing_id")
    found = sure.select("filing_id", "gt_id", "company", "gt_company").unionByName(maybe.join(single, "filing_id", "left_semi").select("filing_id", "gt_id", "company", "gt_company"))
    return found.where("company <> gt_company").select("filing_id", "gt_id").distinct()


def name_clusters(filings: DataFrame, records: DataFrame) -> DataFrame:
    """(company, cluster, links): one row per distinct name of either list, its cluster and how many other signatures it resembles.

    Spellings of an organisation that the reference list doesn't have are clustered too.  Names that say nothing (null, blank, unknown) are left out.
    """
    names = Names(filings, records, all_pairs=True)
    both = names.links.select(F.col("a").alias("sig")).unionByName(names.links.select(F.col("b").alias("sig")))
    links = both.groupBy("sig").agg(F.count(F.lit(1)).alias("links"))
    out = names.names.select("company", "sig").join(names.clusters, "sig").join(links, "sig", "left")
    return out.select("company", F.col("centre").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"))
