import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkprobe.operators import books, catalogue
from inkprobe.operators import sampling as sp
from inkprobe.sources import corpora, sinks


def one(df, col):
    return [r[col] for r in df.collect()]


def test_parse_books_bounds_and_errors(spark):
    files = spark.createDataFrame([
        (1, "Title: A: b\r\nskip\nTITLE : last\n*** START x\nl1\nl2\n*** END a\nmore\n*** END b\ntail"),
        (2, "Title: x\n*** END y"), (3, "Title: x\n*** START y\nbody"), (4, "*** END\n*** START y\nbody")],
        "id int, text string")
    rows = {r["id"]: r for r in books.parse_books(files).collect()}
    assert rows[1]["metadata"] == {"title": "last"}
    assert rows[1]["body"] == "l1\nl2\n*** END a\nmore\n"
    assert rows[1]["parse_error"] is None
    assert rows[2]["parse_error"] == "no start mark" and rows[2]["body"] is None
    assert rows[3]["parse_error"] == "no end mark"
    assert rows[4]["body"] == ""


def test_release_dates(spark):
    lines = ["Release Date: March 5, 2023 [eBook #70000]", "x\nrelease date: February 28, 2023",
             "Release Date: Feb 05, 2023", "nothing"]
    df = spark.createDataFrame([(x,) for x in lines], "h string").select(
        books.release_date(F.col("h")).alias("release_date"))
    assert one(df, "release_date") == [dt.date(2023, 3, 5), dt.date(2023, 2, 28), None, None]
    assert one(books.released_after(df), "release_date") == [dt.date(2023, 3, 5)]
    bad = spark.createDataFrame([("Feb 05, 2023",)], "v string").select(books.release_date_strict(F.col("v")))
    with pytest.raises(Exception, match="not a release date"):
        bad.collect()


def test_years(spark):
    df = spark.createDataFrame([("London: Smith, 1899",), ("n.d.",), (None,), ("12345 1901",)], "v string")
    assert one(df.select(books.publication_year(F.col("v")).alias("y")), "y") == ["1899", None, None, "1901"]
    years = spark.createDataFrame(
        [(i, v) for i, v in enumerate(["1849", "1850", "1910", "1911", None, "x"])], "doc_id bigint, y string")
    assert sorted(one(sp.filter_year(years, "y"), "y")) == ["1850", "1910"]
    with pytest.raises(Exception):
        sp.filter_year(years, "y", strict=True).collect()


def test_decode_header_matches_python(spark):
    raw = [b"plain", "é".encode("latin-1") + b"abc", ("é" * 600).encode(), ("a" + "é" * 600).encode()]

    def expected(b):
        try:
            return b[:1000].decode("utf-8")
        except UnicodeDecodeError:
            return b[:1000].decode("latin-1")

    df = spark.createDataFrame([(bytearray(b),) for b in raw], "content binary")
    assert one(df.select(books.decode_header(F.col("content")).alias("h")), "h") == [expected(b) for b in raw]


def test_book_folder(spark, tmp_path):
    head = "Title: T{0}\nRelease Date: {1}\nOriginal Publication: P, 18{0}9\n*** START\n{0}\n*** END\n"
    (tmp_path / "a.txt").write_text(head.format(4, "March 5, 2023 [eBook #1]"))
    (tmp_path / "b.txt").write_text(head.format(5, "January 5, 2023"))
    (tmp_path / "c.md").write_text(head.format(6, "March 5, 2024"))
    rows = corpora.read_book_corpus(spark, str(tmp_path)).collect()
    assert [(r["title"], r["original_publication"], r["text"]) for r in rows] == [("T4", "1849", "4\n")]


RECORD = ('<title>T &amp; x</title><div id="bibrec"><table><tr property="dcterms:language"><td>{lang}</td></tr>'
          '<td itemprop="headline">A\nB</td>{author}<td itemprop="datePublished">D</td>{down}</table></div>')


def test_pages(spark):
    author = '<a itemprop="creator">Me</a>'
    down = '<td itemprop="interactionCount">12 downloads in the last 30 days</td>'
    df = spark.createDataFrame([
        (1, RECORD.format(lang="English, French", author=author, down=down)),
        (2, RECORD.format(lang="French", author="", down="")), (3, "<html></html>")], "page_id int, html string")
    rows = {r["page_id"]: r for r in catalogue.page_bib(catalogue.page_downloads(catalogue.page_metadata(df))).collect()}
    assert (rows[1]["title"], rows[1]["language"], rows[1]["downloads"]) == ("T & x", "English", 12)
    assert (rows[1]["bib_title"], rows[1]["bib_author"], rows[1]["bib_published"]) == ("AB", "Me", "D")
    assert (rows[2]["language"], rows[2]["downloads"], rows[2]["bib_title"]) == ("French", 0, None)
    assert (rows[3]["title"], rows[3]["language"], rows[3]["downloads"]) == (None, None, 0)


def test_links(spark):
    a = '<a class="link" href="{0}">{1}</a>'
    df = spark.createDataFrame([
        (1, a.format("h", "HTML") + a.format("a", "Plain Text") + a.format("b", "Plain Text")),
        (2, a.format("h", "HTML")), (3, '<a href="x">Plain Text</a>')], "page_id int, html string")
    assert one(catalogue.pick_link(df).orderBy("page_id"), "link") == ["b", "h", ""]
    li = '<li><a href="/{0}">{1}</a></li>'
    top = spark.createDataFrame([(1, li.format("ebooks/1", "A") + li.format("other", "B")
                                  + li.format("ebooks/2", "A") + li.format("ebooks/3", "C"))], "page_id int, html string")
    got = {r["title"]: r["href"] for r in catalogue.list_links(top, limit=3).collect()}
    assert got == {"A": "/ebooks/2"}


def test_skip_collected_and_names(spark):
    titles = spark.createDataFrame([("a b",), ("c",), ("d",), ("e.txt",)], "title string")
    have = spark.createDataFrame([("a_b.txt",), ("c",), ("d.htm",)], "name string")
    assert sorted(one(catalogue.skip_collected(titles, have), "title")) == ["d", "e.txt"]
    assert one(catalogue.name_contains(have, "A_B"), "name") == ["a_b.txt"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"meta": {"b": 1}, "text": "t"}\nbad{\n{"meta": null, "text": null}\n')
    rows = corpora.read_jsonl_corpus(spark, str(tmp_path)).collect()
    assert sorted((r["meta"], r["text"]) for r in rows if r["text"]) == [('{"b":1}', "t")]
    assert len(rows) == 2
    lines = spark.createDataFrame([('{"text": "t"}',)], "value string")
    with pytest.raises(Exception, match="lacks"):
        corpora.parse_jsonl(lines).collect()
    assert corpora.parse_jsonl(lines, on_missing="skip").count() == 0
    assert one(corpora.parse_jsonl(lines, on_missing="null"), "text") == ["t"]


def test_sinks(spark, tmp_path):
    df = spark.range(10)
    sinks.save_corpus(df, str(tmp_path / "c"), max_records=2, writers=1)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 5
    for name, n in (("one", 3), ("two", 4), ("one", 5)):
        sinks.write_run(spark, name, {"n": n}, {"t": spark.range(n)}, str(tmp_path / "r"))
    assert sinks.read_run(spark, "t", str(tmp_path / "r"), "one").count() == 5
    assert sinks.read_run(spark, "t", str(tmp_path / "r")).count() == 9
    bib = spark.createDataFrame([("T", "A", "D"), (None, None, None)], "bib_title string, bib_author string, bib_published string")
    sinks.write_metadata_tsv(bib, str(tmp_path / "m"))
    sinks.write_metadata_tsv(bib, str(tmp_path / "m"))
    assert one(spark.read.text(str(tmp_path / "m")), "value") == ["T\tD,\tA"] * 2


def test_many_names_equal_a_plain_search(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aAbBcé") for _ in range(rng.randint(1, 5)))
    names = [(i, " ".join(word() for _ in range(6))) for i in range(200)] + [(900, None), (901, "")]
    asked = [word() + " " + word() for _ in range(40)] + ["", None, "AbA", "zz"]
    have = spark.createDataFrame(names, "id int, name string").repartition(3)
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    want = {i for i, n in names if n and any(q and q.lower() in n.lower() for q in asked)}
    assert 0 < len(want) < 200
    for per_block in (1_000, 7):
        got = catalogue.name_contains_any(have, queries, "id", per_block=per_block)
        assert {r["id"] for r in got.collect()} == want
        assert got.columns == have.columns
    assert catalogue.name_contains_any(have, queries.filter("query = ''"), "id").count() == 0
