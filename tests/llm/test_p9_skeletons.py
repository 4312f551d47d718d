import unicodedata

from docmetrics.llm import skeletons as s
from docmetrics.llm.confusables import consistent_form, skeleton, tables


def pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {tuple(r) for r in s.look_alike_pairs(df).collect()}


def test_forms_that_look_the_same(spark):
    texts = ["Pay the Company", "Pаy the Company", "Pay the Com​pany", "Ｐay the Company", "Pay the company", "Pay the Company", "Pay the Сompany\U000e0061"]
    assert pairs(spark, texts) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (1, 5), (2, 5), (3, 5), (0, 6), (1, 6), (2, 6), (3, 6), (5, 6)}


def test_figures_case_and_accents_stay_apart(spark):
    assert pairs(spark, ["10 Il", "1O Il", "10 lI", "café", "cafe", "café"]) == {(3, 5)}


def test_a_stem_letter_links_to_the_capital(spark):
    assert pairs(spark, ["Income", "Ӏncome"]) == {(0, 1)}


def test_every_class_of_equal_forms_lies_in_one_skeleton(spark):
    loose, strict = tables(spark)
    seen = {}
    for c in range(0x20, 0xF0000):
        if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co"):
            form = consistent_form(chr(c), strict)
            assert seen.setdefault(form, skeleton(form, loose)) == skeleton(form, loose)
    assert not any(c in strict for c in range(0x80))


def test_classes_and_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (4, None), (None, "a b"), (5, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in s.look_alike_classes(df).collect()} == {(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (5, 5, 1, 1)}
    assert {r.doc_id: (r.consistent_text, r.changed) for r in s.consistent_texts(df).collect() if r.doc_id} == {1: ("a b", False), 2: ("a b", True), 3: ("a b", False), 4: (None, False), 5: ("", False)}
    assert pairs(spark, []) == set()
