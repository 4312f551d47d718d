import __spark_entry__ as entry

PAGE = "page_id bigint, document_id string, page_number int, full_text string"
BLOCK = "document_id string, page int, block_index int, text string, parsed_at timestamp_ntz"
FILLER = "the settlement of the dispute eased the pressure on the balance of the company bought for the inventory in the region of the valley"


def write(spark, folder, pages):
    spark.createDataFrame(pages, PAGE).write.parquet(f"{folder}/parsed_pages.parquet")
    spark.createDataFrame([], BLOCK).write.parquet(f"{folder}/text_blocks.parquet")
    return str(folder)


def filler(n, per_page=200, doc="z", first=1000):
    return [(first + i, f"{doc}{i}", 1, "\n".join([FILLER] * per_page)) for i in range(n)]


def test_pages_come_out_as_running_text(spark, tmp_path):
    head = "Vamond Insurance Holdings Annual Report 2016"
    pages = [(1, "d", 1, "Cover of the annual report"),
             (2, "d", 2, f"{head}\n\nThe company b0ught the inventory for 1O,400 of the bal-\nance of the region, and\nthe settlement of the\n\n2"),
             (3, "d", 3, f"{head}\n\ndispute eased the pressure.\n\nThe region.\n\n3")]
    d = write(spark, tmp_path, pages + filler(1))
    out = {r.page_id: r.text for r in entry.queries()["p6_repaired"](spark, d).collect()}
    assert out[2] == "The company bought the inventory for 10,400 of the balance of the region, and the settlement of the"
    assert out[3] == "dispute eased the pressure.\n\nThe region."
    rows = [r.text for r in entry.queries()["p6_paragraphs"](spark, d).where("document_id = 'd'").orderBy("paragraph").collect()]
    assert rows == ["Cover of the annual report", f"{out[2]} dispute eased the pressure.", "The region."]


def test_neighbours_choose_between_candidates(spark, tmp_path):
    """ba1l may stand for ball or bail; the more frequent one isn't always right."""
    text = "\n".join(["they kicked the ball home"] * 300 + ["they posted more bail money"] * 200)
    d = write(spark, tmp_path, [(1, "d", 1, "they posted more ba1l money"), (2, "d", 2, "they kicked the ba1l home"), (3, "e", 1, text)])
    out = {r.page_id: r.text for r in entry.queries()["p6_repaired"](spark, d).collect()}
    assert (out[1], out[2]) == ("they posted more bail money", "they kicked the ball home")


def test_a_misread_number_counts_however_often_it_recurs(spark, tmp_path):
    pages = [(i, f"d{i}", 1, "the balance of 2o21 and of 20l9") for i in range(120)]
    found = entry.queries()["p6_found"](spark, write(spark, tmp_path, pages)).where("kind = 'misread'")
    assert {r.page_id for r in found.collect()} == set(range(120))


def test_short_and_very_long_words_are_looked_up(spark, tmp_path):
    long_word = "donaudampfschifffahrtsgesellschaft" * 2
    pages = [(1, "a", 1, "the balance 0f the company"), (2, "b", 1, "sold t0 the company"), (3, "c", 1, "the company rose in Q1 by 5m"), (4, "e", 1, f"the {long_word.replace('u', 'ii', 1)} rose")]
    text = "\n".join([f"the balance of the company was sold to the {long_word}"] * 300)
    d = write(spark, tmp_path, [*pages, (5, "f", 1, text)])
    q = entry.queries()
    assert {r.page_id for r in q["p6_found"](spark, d).where("kind = 'misread'").collect()} == {1, 2, 4}
    assert {r.page_id: r.text for r in q["p6_repaired"](spark, d).where("page_id < 3").collect()} == {1: "the balance of the company", 2: "sold to the company"}
