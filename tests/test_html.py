"""Golden tests for the HTML extraction rules on small hand-written pages."""

from sitequill.operators import extract as X
from sitequill.operators.htmltree import parse

PAGE = """<!DOCTYPE html><html><head><title>Guide | Acme Docs</title><script>var x="<p>";</script></head>
<body><header>Top</header><nav><a href="/skip">Skip</a></nav>
<main><h1>Install  Guide</h1><p>First <b>bold</b> words.</p>
<ul><li>one</li><li>two <i>2</i></li></ul>
<pre>code  block</pre>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>
<p>Math <span class="katex"><span class="katex-mathml"><annotation encoding="application/x-tex">x^2</annotation></span><span class="katex-html">x2</span></span> done</p>
<img src="/i.png" alt="pic"><div>loose text<span>inline</span></div>
<footer>bottom</footer></main></body></html>"""

SIDEBAR = """<html><body><aside><div data-testid="toc-scroll-container"><ul>
<li><a href="/">Home</a></li>
<li><div><a href="/guide#part">Guide</a></div></li>
<li><div>Reference</div><ul>
   <li><a href="/ref/api">API</a><ul><li><a href="/ref/api/auth">Auth</a></li></ul></li>
   <li><a href="/ref/cli">CLI</a></li>
   <li><a href="/guide">Guide again</a></li>
</ul></li>
<li><a href="https://other.example/x">External</a></li>
</ul></div></aside><div>footer <a href="/legal">Legal</a></div></body></html>"""


def test_markdown_of_main_content():
    content, title = X.page_markdown(PAGE)
    assert title == "Install  Guide"
    assert content == (
        "# Install  Guide\n\nFirst bold words.\n\n- one\n- two 2\n\n```\ncode  block\n```\n\n"
        "| A | B |\n| --- | --- |\n| 1 |  |\n\nMath $x^2$ done\n\n![pic](/i.png)\n loose text inline"
    )


def test_loose_text_joins_even_a_blank_line():
    assert X.page_markdown("<div class=content><p>a</p>tail</div>")[0] == "a\n tail"
    assert X.page_markdown("<main><p>a</p>tail<b>x</b></main>")[0] == "a\n\ntail x"
    assert X.page_markdown("<div class=content><p>a</p><b>bold</b> on</div>")[0] == "a\n\nbold on"


def test_plain_text_and_title():
    assert X.page_text(PAGE).startswith("Install  GuideFirst bold words.")
    assert X.html_title(parse(PAGE)) == "Install  Guide"
    assert X.extract_title("# Markdown Title\ntext") == "Markdown Title"
    assert X.extract_title("") == "Untitled Page"
    assert X.extract_title("<html><title>Only - Title</title></html>") == "Only"


def test_sidebar_walk():
    rows = X.sidebar_entries(parse(SIDEBAR), "https://docs.example/start")
    assert rows == [
        (0, 1, None, "https://docs.example/", "Home"),
        (1, 1, None, "https://docs.example/guide", "Guide"),
        (2, 2, "Reference", "https://docs.example/ref/api", "API"),
        (3, 3, "Reference", "https://docs.example/ref/api/auth", "Auth"),
        (4, 2, "Reference", "https://docs.example/ref/cli", "CLI"),
        (5, 1, None, "https://other.example/x", "External"),
    ]


def test_nav_selector_cutoff(spark):
    html = ("<div class='sidebar'>" + "".join(f"<a href='/s{i}'>S{i}</a>" for i in range(3)) + "</div>"
            "<div class='navigation'>" + "".join(f"<a href='/n{i}'>N{i}</a>" for i in range(4)) + "</div>"
            "<nav><a href='/late'>Late</a><a href='/s0'>dup</a></nav>"
            "<aside><a href='/login'>Login</a></aside>")
    from sitequill.operators import links as L
    pages = spark.createDataFrame([(1, "https://h.example/p", html)], "page_id long, url string, html string")
    got = [tuple(r) for r in L.nav_links(pages).orderBy("pos").select("pos", "url", "title").collect()]
    # .sidebar gives 3 (<= 5, continue), .navigation brings 7 (> 5, stop): nav and aside are not read.
    assert [g[1].rsplit("/", 1)[1] for g in got] == ["s0", "s1", "s2", "n0", "n1", "n2", "n3"]


def test_tables_job(spark):
    pages = spark.createDataFrame([(7, "https://h/p", PAGE)], "page_id long, url string, html string")
    rows = [tuple(r) for r in X.table_cells(pages).orderBy("row_no").collect()]
    assert rows == [(7, 0, 0, ["A", "B"]), (7, 0, 1, ["1"])]
