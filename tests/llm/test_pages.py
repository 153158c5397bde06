"""WARC archives and main text of pages."""

import hashlib
import io
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc_zip, wrapper_html

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "é long payload " * 90 + "</p>"


def brute(rows, least=1000):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    head = {}
    for i, b in bodies:
        head[b] = max(head.get(b, -1), -1 if i is None else i)
    out = []
    for i, b in bodies:
        again = len(b) >= least and head[b] >= 0 and i != head[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", head[b] if again else None))
    return sorted(out, key=str)


ROWS = ([(i, f"http://h/{i}", BIG if i % 3 else f"<p>{i}</p>" * 200) for i in range(40)]
        + [(100, None, None), (101, "http://h/\r\nx: y", ""), (102, "u", "short"), (103, "u", "short"),
           (39, "http://h/39", ROW := f"<p>{39}</p>" * 200), (None, "n", BIG), (None, "n", "solo " * 300)])


@pytest.mark.parametrize("options", [{}, {"archive_records": 7}, {"archive_bytes": 4000}, {"force_zip64": True}])
def test_round_trip_matches_brute_force(spark, options):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("body", F.lit("mine")).withColumn("sha", F.lit(1))
    got = sorted((tuple(r) for r in warc_zip.round_trip(docs, **options).collect()), key=str)
    assert got == brute(ROWS)


def test_archives_are_plain_zip_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    paths = [r.path for r in warc_zip.write_archives(docs, str(tmp_path / "a")).collect()]
    for p in paths:
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert sorted(z.namelist()) == ["archive/data.warc.gz", "indexes/index.cdxj"]


def test_foreign_archives_without_index_and_with_comment(spark, tmp_path):
    records = [warc_zip._gzip(warc_zip.warc_record(i, "u", b"x" * (10 + i), hashlib.sha1(b"x" * (10 + i)).hexdigest(), None), 6) for i in range(5)]
    path = str(tmp_path / "foreign.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("notes.txt", "hello", zipfile.ZIP_DEFLATED)
        z.writestr("archive/part.warc.gz", b"".join(records))
        z.comment = b"PK\x05\x06 not the end"
    out = warc_zip.read_records(spark.createDataFrame([(path,)], "path string"), chunk_bytes=300)
    assert sorted((r.page_id, len(r.payload)) for r in out.collect()) == [(i, 10 + i) for i in range(5)]
    with pafs.LocalFileSystem().open_input_file(path) as f:
        names = [m[0] for m in warc_zip.stored_members(f)]
    assert names == ["archive/part.warc.gz"]


def test_zip64_directory_is_parsed():
    out = io.BytesIO()
    w = warc_zip.ZipWriter(out, force64=True)
    w.open("a.txt")
    w.append(b"hello")
    w.close_member()
    w.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.read("a.txt") == b"hello"
    import pyarrow as pa
    f = pa.BufferReader(out.getvalue())
    (name, first, size), = warc_zip.stored_members(f)
    assert (name, out.getvalue()[first:first + size]) == ("a.txt", b"hello")
    with pytest.raises(ValueError):
        warc_zip.stored_members(pa.BufferReader(b"no archive here"))


def test_empty_pages_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc_zip.round_trip(empty).count() == 0
    assert wrapper_html.main_text(empty).count() == 0


def page(i, body):
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
            f"<header><a href='/'>Site</a></header><nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>We use cookies</div>"
            f"{body}<aside>About us</aside><form><p>Sign up</p></form><section id='comments'><p>First!</p></section>"
            f"<footer>&copy; site</footer></body></html>")


def test_article_text():
    html = page(1, "<article><header><h1>Head&amp;line</h1><span>by me</span></header><div class=ad>Buy</div><p>One <b>two</b>\n  three"
                   "<br>four<p>Five &lt;tag&gt; &#233;<ul><li>x<li>y</ul><p hidden>no</p><div style='display: none'>no</div></article>")
    assert wrapper_html.extract_group([html]) == ["Head&line\nOne two three four\nFive <tag> é\nx\ny"]


def test_template_is_induced_where_no_article_is_marked():
    pages = [page(i, f"<div class=box><p>Welcome to our site</p><p>Story {i} begins</p><p>and ends {i * 7}</p></div>") for i in range(10)]
    assert wrapper_html.extract_group(pages) == [f"Story {i} begins\nand ends {i * 7}" for i in range(10)]
    alone = wrapper_html.extract_group(pages[:1])
    assert alone == ["Welcome to our site\nStory 0 begins\nand ends 0"]


def test_a_host_that_repeats_one_article_keeps_it():
    pages = [page(i, f"<article><h1>Same</h1><p>same long text</p><p>x{i}</p></article>") for i in range(10)]
    assert wrapper_html.extract_group(pages) == [f"Same\nsame long text\nx{i}" for i in range(10)]


@pytest.mark.parametrize("html", ["", "<", "<p", "a < b & c", "<!-- x", "<script>", "</div></p>", "<p>" * 3000 + "x", "<div>" * 3000 + "x",
                                  "<a href='x>unclosed", "<![CDATA[x]]>", "\x00<p>y</p>"])
def test_broken_markup_does_not_crash(html):
    assert len(wrapper_html.extract_group([html] * 2 + [html + str(i) for i in range(9)])) == 11


def test_main_text_of_a_table(spark):
    rows = [(i, "http://hot.example/a" if i % 2 else f"https://u@Other{i % 4}.example:80/x?y", page(i, f"<article><p>Text {i} é</p></article>"))
            for i in range(60)]
    rows += [(1, rows[1][1], rows[1][2]), (None, None, None), (70, None, ""), (71, "nonsense", "plain  words")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("mine")).withColumn("part", F.lit(1)).withColumn("text", F.lit("z"))
    out = wrapper_html.main_text(docs, group_pages=8).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    want = {i: f"Text {i} é" for i in range(60)} | {None: "", 70: "", 71: "plain words"}
    assert all(r.text == want[r.page_id] for r in out)


@pytest.mark.parametrize("html, text", [
    ("<body><article><p>one</p></article><nav>x</nav><article><p>two and more</p></article></body>", "one\ntwo and more"),
    ("<body><div class='has-sidebar'><p>the text of it</p></div></body>", "the text of it"),
    ("<body><article class='post comments-open'><p>the text of it</p></article></body>", "the text of it"),
    ("<body><div id='content' class='no-sidebar'><p>the text of it</p></div><div class='site-header'>x</div></body>", "the text of it"),
    ("<body><form><div><p>the text of it</p></div></form></body>", "the text of it"),
    ("<body><form><main><p>the text of it</p></main><div class='sidebar-left'>x</div></form></body>", "the text of it"),
    ("<body><div class='menu'><article><p>the text of it</p></article></div></body>", "the text of it"),
    ("<body><p>the text of it</p><form>search</form><div class='main-menu'>x</div><div id='comments'>y</div></body>", "the text of it"),
])
def test_main_text_is_not_lost(html, text):
    assert wrapper_html.extract_group([html]) == [text]
