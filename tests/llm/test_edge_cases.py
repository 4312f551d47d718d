"""Nulls in every column, empty tables, very long texts, ties, repeats and clashing names, for the operators of names and scans."""

import pytest

from docmetrics.llm import mixing, names, scans, skeletons, splitting

FILING = "filing_id bigint, company string, fiscal_year int, sig string, centre string, a string, key string"
RECORD = "gt_id bigint, company string, fiscal_year int, sig string, is_hub string"
PAGE = "page_id bigint, document_id string, page_number int, full_text string, text string, kind string, word string"
BLOCK = "document_id string, page int, block_index int, text string, parsed_at timestamp_ntz, _blocks string"


def test_names_with_nulls_and_clashing_columns(spark):
    filings = spark.createDataFrame([(1, "Beirlospaum Foods Inc.", 2022, "x", "x", "x", "x"), (2, None, 2022, None, None, None, None), (3, "", 2022, None, None, None, None), (None, "Beirlospaum Foods", 2022, None, None, None, None), (4, "BEIRLOSPAUM FDS INC", None, None, None, None, None), (5, "Unknown", 2022, None, None, None, None), (6, "BEIRLOSPAUM FDS INC", 2022, None, None, None, None)], FILING)
    records = spark.createDataFrame([(1, "Beirlospaum Foods Inc.", 2022, "x", "x"), (1, "Beirlospaum Foods Inc.", 2022, "x", "x"), (None, "Beirlospaum Foods", 2022, None, None), (2, None, 2022, None, None), (3, "Beirlospaum Foods Inc.", None, None, None)], RECORD)
    assert {tuple(r) for r in names.linked_rows(filings, records).collect()} == {(6, 1)}
    got = names.name_clusters(filings, records).collect()
    assert len({r.cluster for r in got}) == 1 and len(got) == 3


def test_names_without_rows(spark):
    filings, records = spark.createDataFrame([], FILING), spark.createDataFrame([], RECORD)
    assert names.linked_rows(filings, records).collect() == [] and names.name_clusters(filings, records).collect() == []


def test_spellings_outside_of_the_reference_list_cluster_too(spark):
    filings = spark.createDataFrame([(i, n, 2022, None, None, None, None) for i, n in enumerate(["Stialtrost Transport plc", "Stialtrsot Transport PLC", "Transport, Stialtrost plc", "Quobrindle Mining AG", "International Holdings Ltd", "Intl Hldgs Limited"])], FILING)
    records = spark.createDataFrame([(1, "Somebody Else", 2022, None, None)], RECORD)
    got = {r.company: r.cluster for r in names.name_clusters(filings, records).collect()}
    assert got["Stialtrost Transport plc"] == got["Stialtrsot Transport PLC"] == got["Transport, Stialtrost plc"] != got["Quobrindle Mining AG"]
    assert got["International Holdings Ltd"] == got["Intl Hldgs Limited"]


def test_recall_of_typos_in_unseen_words(spark):
    """Words that are in none of the lists, with one random edit each: candidates and similarity find at least nine in ten."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(3, 5)))
    right = [f"{word().title()} {word().title()} Ltd" for _ in range(150)]

    def typo(s):
        k = rng.randrange(1, len(s) - 5)
        return rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abcdefg") + s[k:], s[:k] + s[k + 1] + s[k] + s[k + 2 :]])

    filings = spark.createDataFrame([(i, typo(n), 2022, None, None, None, None) for i, n in enumerate(right)], FILING)
    records = spark.createDataFrame([(i, n, 2022, None, None) for i, n in enumerate(right)], RECORD)
    found = {tuple(r) for r in names.linked_rows(filings, records).collect()}
    true = {(r.filing_id, r.filing_id) for r in filings.collect() if r.company != right[r.filing_id]}
    assert len(found & true) >= 0.9 * len(true) and len(found - true) <= 0.05 * len(found)


def test_scans_with_nulls_and_clashing_columns(spark):
    rows = [(1, "d", 1, None, "x", "x", "x"), (2, "d", 2, "", None, None, None), (3, None, 1, "the bal-\nance", None, None, None), (4, "d", None, "the bal-\nance of 2o21", None, None, None), (5, "d", 3, "the balance " * 40000, None, None, None)]
    pages = spark.createDataFrame(rows, PAGE)
    blocks = spark.createDataFrame([("d", 1, 1, "the bal-\nance", None, "x"), ("d", 1, 0, None, None, None), (None, 1, 0, "x", None, None), ("d", None, 0, "x", None, None), ("d", 1, None, "tail", None, None)], BLOCK)
    found = {tuple(r) for r in scans.noise(pages, blocks).collect()}
    assert {(1, "hyphen"), (3, "hyphen"), (4, "hyphen"), (4, "misread")} <= found and not any(k in ("header", "page_number") for p, k in found if p == 4)
    text = {r.page_id: r.text for r in scans.Scan(pages, blocks).repaired().collect()}
    assert text[3] == "the balance" and text[4] == "the balance of 2021" and text[2] == "" and "the balance" in text[1] and len(text) == 5
    assert {r.document_id for r in scans.paragraphs(pages, blocks).collect()} == {"d"}


def test_scans_without_rows(spark):
    pages, blocks = spark.createDataFrame([], PAGE), spark.createDataFrame([], BLOCK)
    assert scans.noise(pages, blocks).collect() == [] and scans.paragraphs(pages, blocks).collect() == [] and scans.Scan(pages, blocks).repaired().collect() == []


def test_paragraphs_take_the_last_delivery(spark):
    pages = spark.createDataFrame([(1, "d", 1, "old text", *[None] * 3), (7, "d", 1, "The new text goes on", *[None] * 3), (2, "d", 2, "in small letters.\n\nEnd.", *[None] * 3), (3, "e", 1, "Other", *[None] * 3)], PAGE)
    got = [tuple(r) for r in scans.paragraphs(pages, spark.createDataFrame([], BLOCK)).orderBy("document_id", "paragraph").collect()]
    assert got == [("d", 1, 1, "The new text goes on in small letters."), ("d", 2, 2, "End."), ("e", 1, 1, "Other")]


@pytest.mark.parametrize("s", ["iv", "xc", "mcmxcix", "x1"])
def test_roman_numerals(s):
    assert scans._roman(s) == {"iv": 4, "xc": 90, "mcmxcix": 1999, "x1": 11}[s]


def test_what_isnt_a_roman_numeral():
    assert scans._roman("civil") is None and scans._roman("iiii") is None


def test_retrieval_is_complete(spark):
    """Every frequent word that the automaton reaches from a rare one, by going through the whole vocabulary, is among the options."""
    import random

    rng = random.Random(4)
    right = sorted({"".join(rng.choice("aeiohlmnrtubcdgsw") for _ in range(rng.randint(3, 9))) for _ in range(300)})
    rare = set()
    for w in right:
        for _ in range(3):
            x = w
            for a, b in rng.sample(scans.CONFUSIONS, len(scans.CONFUSIONS))[:6]:
                if a in x and rng.random() < 0.5:
                    x = x.replace(a, b, 1)
            k = rng.randrange(len(w))
            rare |= {x, w[:k] + w[k + 1 :], w[:k] + "x" + w[k + 1 :]}
    rare = sorted(r for r in rare - set(right) if len(r) >= 2)
    words = spark.createDataFrame([(w, 1000) for w in right] + [(w, 2) for w in rare], "word string, n bigint")
    got = {(r.word, r.correct) for r in scans.options(words).collect()}
    trie = scans.Trie(dict.fromkeys(right, 1000))
    want = set()
    for w in rare:
        other = scans.OTHER_RATIO * 2 if len(w) >= 5 and w.isalpha() else float("inf")
        want |= {(w, c) for c in trie.within(w, (scans.SHORT_RATIO if len(w) < 4 else scans.RATIO) * 2, other)}
    assert got == want and len(want) > 300


def test_clashing_columns_of_documents(spark):
    rows = spark.createDataFrame([(1, "a b", "s", 5, "x", "y"), (2, "a b", "s", 6, "x", "y")], "doc_id bigint, text string, source string, tokens int, skeleton_key string, rank string")
    goals = spark.createDataFrame([("s", 1.0, 2, "x")], "source string, target_share double, max_repeats int, tokens string")
    assert skeletons.look_alike_pairs(rows).count() == 0 and skeletons.look_alike_classes(rows).count() == 2
    assert sum(r.copies for r in mixing.Mixture(rows, goals).copies().collect()) == 4
    pages = spark.createDataFrame([(1, "x" * 30, 1, "p")], "page_id bigint, full_text string, item_id int, item_kind string")
    tables = spark.createDataFrame([], "table_id bigint, rows array<array<string>>, item_id int")
    limits = spark.createDataFrame([("page", 20, 5, None)], "item_kind string, max_chars int, overlap_chars int, overlap_rows int")
    assert [tuple(r) for r in splitting.oversized(pages, tables, limits).collect()] == [("page", 1)]


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 200_000), (2, "wоrd " * 200_000)], "doc_id bigint, text string")
    assert [tuple(r) for r in skeletons.look_alike_pairs(df).collect()] == [(1, 2)]
    spans = splitting.split_text("Some words here. " * 30_000, 6000, 300)
    assert all(b - a <= 6000 for a, b in spans)
