"""Library table, packed check-outs, flows and diagnostics."""

from pyspark.sql import functions as F

from sitequill.operators import extract as X
from sitequill.operators import fusion as FU
from sitequill.operators.document_table import DocumentTable
from sitequill.plans import pipeline as PL
from sitequill.sources import markdown_files as MF

BLOCKS = "site string, part int, k1 decimal(38,0), k2 string, block string"


def _blocks(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(s, p, None if k is None else Decimal(k), None if k is None else "x", b) for s, p, k, b in rows], BLOCKS)


def test_versions_sizes_and_order(spark, tmp_path):
    head = "# A docs\n\n**Source:** https://a.org/x  \n---\n"
    first = _blocks(spark, [("a", 0, None, head)] + [("a", 1, i, f"## P{i}\né\n---\n") for i in range(40)] + [("b", 0, None, "no title\n")])
    library = DocumentTable(spark, str(tmp_path))
    assert library.snapshot().count() == 0 and library.read("a").count() == 0
    assert library.add(first, 0, "2024-01-01 00:00:00")
    assert not library.add(first, 0, "2024-01-09 00:00:00")  # a repeated run adds nothing
    assert library.add(_blocks(spark, [("a", 0, None, "# A new\n"), ("c", 0, None, "# C\n")]), 1, "2024-02-01 00:00:00")
    got = [(r.document, r.title, r.source, str(r.modified)[:10], str(r.created)[:10]) for r in library.metadata().orderBy("newest").collect()]
    assert got == [("a", "A new", "Unknown", "2024-02-01", "2024-01-01"), ("c", "C", "Unknown", "2024-02-01", "2024-02-01"),
                   ("b", "b", "Unknown", "2024-01-01", "2024-01-01")]
    old = {r.document: r for r in library.metadata(as_of_run=0).collect()}
    text = "".join(r.value + "\n" for r in library.read("a", as_of_run=0).collect())
    assert old["a"].title == "A docs" and old["a"].source == "https://a.org/x" and old["a"].size == len(text.encode())
    assert text.startswith("# A docs") and [x for x in text.split("\n") if x.startswith("## ")] == [f"## P{i}" for i in range(40)]
    assert [r.value for r in library.read("a").collect()] == ["# A new"]


def test_run_that_died_between_text_and_manifest(spark, tmp_path):
    library = DocumentTable(spark, str(tmp_path))
    blocks = _blocks(spark, [("a", 0, None, "# A\n")])
    library.text.append(blocks.select(F.col("site").alias("document"), "part", "k1", "k2", F.lit("# A").alias("value"), F.lit(0).alias("piece")), 0)
    assert library.snapshot().count() == 0
    assert library.add(blocks, 0) and library.snapshot().first()["size"] == 4


def test_unreadable_files_are_reported_and_the_rest_kept(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "good one.md").write_text("# Good é\nx")
    (tmp_path / "docs" / "bad.md").write_bytes(b"# Bad \xff\xfe")
    (tmp_path / "docs" / "empty.md").write_bytes(b"")
    (tmp_path / "skip.txt").write_text("x")
    got = {r.path: (r.title, r.content, r.error) for r in MF.scan_markdown_files(spark, str(tmp_path)).collect()}
    assert {v for v in got.values()} == {("Good é", "# Good é\nx", None), (None, None, "not UTF-8")}  # files of no bytes are passed over
    assert MF.scan_markdown_corpus(spark, str(tmp_path)).count() == 1
    files = spark.createDataFrame([("docs/a.md", b"# A"), ("docs/b.txt", b"x"), ("other/c.md", b"\xff")], "path string, content binary")
    MF.pack_checkout(files, str(tmp_path / "packed"))
    packed = lambda *a: {r.path: (r.title, r.error) for r in MF.scan_packed_checkout(spark, str(tmp_path / "packed"), *a).collect()}
    assert packed() == {"docs/a.md": ("A", None), "other/c.md": (None, "not UTF-8")}
    assert packed("docs") == {"docs/a.md": ("A", None)}


def test_universal_nodes_fall_back_to_links(spark):
    entry = spark.createDataFrame([("a.org", 1, "https://a.org/", "https://a.org"), ("b.org", 2, "https://b.org/", "https://b.org")], "site string, page_id long, url string, base_url string")
    smap = spark.createDataFrame([("a.org", "https://a.org/z"), ("a.org", "https://a.org/d/y")], "site string, url string")
    links = spark.createDataFrame([("a.org", "https://a.org/l", "L", 1), ("b.org", "https://b.org/l", "L", 1)], "site string, url string, title string, depth int")
    got = PL.universal_nodes(PL.Discovery(links, smap, links, links, entry)).collect()
    assert sorted((r.site, r.url, r.level, r.ord) for r in got) == [("a.org", "https://a.org/d/y", 2, 0), ("a.org", "https://a.org/z", 1, 1), ("b.org", "https://b.org/l", 1, 0)]


def test_titles_are_repaired_from_content(spark):
    hits = spark.createDataFrame([("s", "u1", "# One\nx"), ("s", "u2", 'x\ntitle: "Two"\n'), ("s", "u3", "# Three"), ("s", "u4", "none")], "site string, url string, content string")
    known = spark.createDataFrame([("s", "u3", "Kept"), ("s", "u2", "Untitled")], "site string, url string, title string")
    got = {r.url: r.title for r in FU.native_pages(hits, known).collect()}
    assert got == {"u1": "One", "u2": "Two", "u3": "Kept", "u4": "Untitled"}


def test_scan_diagnostics_by_site(spark):
    page = '<a href="/x">x</a><a href="/x#f">x</a><a href="/login">l</a><a href="https://q.org/">q</a><a name="n">n</a>'
    entry = spark.createDataFrame([("e.org", 1, "https://e.org/", page), ("f.org", 2, "https://f.org/", "")], "site string, page_id long, url string, html string")
    got = {r.site: (r.total_links, r.filtered_links, r.method) for r in PL.scan_diagnostics(entry).collect()}
    assert got == {"e.org": (4, 1, "heuristic_dom"), "f.org": (0, 0, "heuristic_dom")}


def test_pages_leave_arrow_in_slices(spark, monkeypatch):
    monkeypatch.setattr(X, "BATCH_CHARS", 50)
    pages = spark.createDataFrame([(i, f"https://e.org/{i}", None if i == 3 else "<a href='/a'>x</a>" * (i % 5)) for i in range(40)], "page_id long, url string, html string")
    assert X.anchors(pages).count() == sum(i % 5 for i in range(40) if i != 3)
