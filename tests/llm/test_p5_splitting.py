import random

import pytest

from docmetrics.llm import splitting as s


def check_rows(lengths, limit, overlap):
    text = "\n".join("x" * n for n in lengths)
    spans = s.split_rows(text, lengths, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert b - a <= limit
    return text, spans


def test_pieces_of_texts_keep_limit_and_overlap():
    rng = random.Random(1)
    for _ in range(200):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 400))]
        text = " ".join(w + rng.choice(["", "", ".", ".\n\n", "\n"]) for w in words)
        limit = rng.randint(20, 300)
        overlap = rng.randint(0, limit // 4)
        spans = s.split_text(text, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= limit for a, b in spans)
        assert all(y[0] == x[1] - overlap for x, y in zip(spans, spans[1:]))


def test_rows_are_only_cut_where_they_must_be():
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(1, 60))]
        limit, overlap = rng.randint(40, 200), rng.randint(0, 3)
        text, spans = check_rows(lengths, limit, overlap)
        starts = [0]
        for n in lengths:
            starts.append(starts[-1] + n + 1)
        fits = all(starts[min(i + overlap + 1, len(lengths))] - 1 - starts[i] <= limit for i in range(max(1, len(lengths) - overlap)))
        if fits and len(text) > limit:
            for x, y in zip(spans, spans[1:]):  # the next piece begins overlap rows before the end of this one
                end = next(k for k in range(len(lengths)) if starts[k] + lengths[k] == x[1] and starts[k] >= x[0])
                assert y[0] in {starts[k] for k in range(len(lengths))}
                last = max(k for k in range(len(lengths)) if starts[k] + lengths[k] <= x[1])
                first = min(k for k in range(len(lengths)) if starts[k] >= y[0])
                assert last - first + 1 >= overlap and end <= last


def test_a_row_longer_than_the_limit_is_cut_at_words():
    text, spans = "a b\n" + " ".join(["word"] * 50) + "\nc", None
    spans = s.split_rows(text, [3, 249, 1], 100, 1)
    assert all(b - a <= 100 for a, b in spans) and spans[-1][1] == len(text)
    assert all(text[b - 1 : b + 1].strip() == "" or b == len(text) or text[b] in "\n " or text[b - 1] in "\n " for _, b in spans)


def test_an_overlap_without_room_is_an_error():
    with pytest.raises(ValueError):
        s.split_text("abc", 5, 5)
    with pytest.raises(ValueError):
        s.split_rows("abc", [3], 5, 4)


def test_cuts_fall_into_valleys():
    a, b = "The river flows past the old mill. ", "Interest rates rose in the third quarter. "
    text = a * 6 + b * 6
    assert s.split_text(text, len(a) * 6 + 60, 0)[0][1] == len(a) * 6


def test_items_from_tables(spark):
    pages = spark.createDataFrame([(1, "x" * 50), (2, None), (3, ""), (4, "short")], "page_id bigint, full_text string")
    tables = spark.createDataFrame([(1, [["a" * 30, None], None, ["b" * 30]]), (2, None), (3, [])], "table_id bigint, rows array<array<string>>")
    limits = spark.createDataFrame([("page", 20, 5, None), ("table", 40, None, 1)], "item_kind string, max_chars int, overlap_chars int, overlap_rows int")
    found = {tuple(r) for r in s.oversized(pages, tables, limits).collect()}
    assert found == {("page", 1), ("table", 1)}
    out = s.pieces(pages, tables, limits).where("item_kind = 'page'").orderBy("piece_no").collect()
    assert [r.piece for r in out] and all(len(r.piece) <= 20 for r in out)
