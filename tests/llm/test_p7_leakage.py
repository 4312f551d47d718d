import random

from docmetrics.llm import leakage as k

ITEM = "item_id bigint, text string, answer string"
DOC = "doc_id bigint, text string"


def frames(spark, docs, items):
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)


def words(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def brute(doc, item, window=20, most=2):
    """Whether some 20 words in a row agree with the item but for two, outer words agreeing."""
    a, b = doc.lower().split(), item.lower().split()
    for i in range(len(a) - window + 1):
        for j in range(len(b) - window + 1):
            bad = [x != y for x, y in zip(a[i : i + window], b[j : j + window])]
            if sum(bad) <= most and not bad[0] and not bad[-1]:
                return True
    return False


def test_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(45, i)), None) for i in range(6)]
    docs = []
    for d in range(60):
        body = words(40, 100 + d)
        item = items[rng.randrange(6)][1].split()
        start, n = rng.randrange(20), rng.choice([12, 19, 20, 21, 25])
        quote = item[start : start + n]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            quote[rng.randrange(len(quote))] = "zzz"
        docs.append((d, " ".join(body[:10] + quote + body[10:])))
    found = {tuple(r) for r in k.leaked_items(*frames(spark, docs, items)).collect()}
    assert found == {(d, i) for d, t in docs for i, x, _ in items if brute(t, x)}
    assert found


def test_bad_windows_part_two_passages(spark):
    item = words(80, 3)
    doc = list(item)
    for p in (22, 25, 28, 31, 34, 37):
        doc[p] = "replaced"
    out = k.leaked_passages(*frames(spark, [(1, " ".join(doc))], [(1, " ".join(item), None)])).orderBy("start").collect()
    assert [(r.words, r.replaced) for r in out] == [(28, 2), (48, 2)]


def test_figures_may_not_be_replaced(spark):
    item = words(30, 4)
    item[10] = "725.3"
    other = [*item]
    other[10] = "725.4"
    docs, items = frames(spark, [(1, " ".join(item).upper()), (2, " ".join(other)[:150]), (3, " ".join(other))], [(1, " ".join(item), None)])
    assert [tuple(r) for r in k.leaked_items(docs, items).collect()] == [(1, 1)]


def test_form_spacing_and_offsets(spark):
    item = " ".join(words(25, 5))
    doc = "Before this: " + item.upper().replace(" ", ",\n ").replace("A", "Ａ") + "! after"
    out = k.leaked_passages(*frames(spark, [(1, doc), (2, None), (3, "")], [(1, item, None), (2, None, None)])).collect()
    assert len(out) == 1 and doc[out[0].start : out[0].end].split()[0].startswith(doc.split()[2][:3]) and out[0].words == 25


def test_answers_are_patterns_of_the_same_automaton(spark):
    item = " ".join(words(25, 6))
    docs, items = frames(spark, [(1, f"x {item} and 725.3 million"), (2, "it was 725.3 million or 1725.3 million"), (3, "nothing")], [(1, item, "725.3 million"), (2, "short", "")])
    assert {tuple(r) for r in k.leaked_answers(docs, items).collect()} == {(1, 1, 1, 1), (2, 1, 1, 0)}


def test_items_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(words(30, i)), None) for i in range(5)]
    docs = [(i, items[i][1]) for i in range(5)]
    monkeypatch.setattr(k, "BLOCK", 300)
    assert {tuple(r) for r in k.leaked_items(*frames(spark, docs, items)).collect()} == {(i, i) for i in range(5)}


def test_empty_tables(spark):
    assert k.leaked_items(*frames(spark, [], [(1, "a b", None)])).collect() == []
    assert k.leaked_items(*frames(spark, [(1, "a b")], [])).collect() == []
