"""The selector compiler, its matching, and the SQL table function."""

import pytest

from sitequill.functions.elements import elements_function
from sitequill.operators import extract as X
from sitequill.operators.htmltree import parse, select, select_any
from sitequill.operators.selectors import compile_group, compile_list, compile_steps_of

PAGE = """<div id="top" class="a b"><nav aria-label="Breadcrumb"><ul><li class="x">1<ul><li>2</li></ul></li></ul></nav>
<p><a href="/u" title="see GitHub">u</a><a>no</a></p><section data-k="v w"><p class="a"><a href="http://q/r.png">r</a></p></section></div>"""


def texts(css):
    return [n.text(strip=False).strip() for n in select_any(parse(PAGE), compile_group(css))]


@pytest.mark.parametrize("css,want", [
    ("li", ["12", "2"]), ("nav li", ["12", "2"]), ("nav > li", []), ("nav > ul > li", ["12"]), ("li > ul li", ["2"]),
    ("ul ul > li", ["2"]), ("li li", ["2"]), ("a[href]", ["u", "r"]), ("p > a[href]", ["u", "r"]), (".a > p > a", ["u", "no"]),
    (".a.b a[href^='http']", ["r"]), ("a[href$=png], nav .x", ["12", "r"]), ("section[data-k~=w] a", ["r"]), ("section[data-k=w] a", []),
    ("#top > section p.a", ["r"]), ("div#top[class] nav[aria-label='Breadcrumb'] li", ["12", "2"]), ("* > a[title*=\"GitHub\"]", ["u"]),
    ("a[href='']", []), ("a[href^='']", []), ("NAV LI.x", ["12"]), ("div p a", ["u", "no", "r"]), ("section>p>a", ["r"])])
def test_matches(css, want):
    assert texts(css) == want


def test_a_child_step_tries_every_ancestor():
    page = parse('<div class="a"><b><div class="c"><div class="c"><i>x</i></div></div></b></div>')
    assert len(select(page, compile_group(".a > b .c i")[0])) == 1
    assert len(select(page, compile_group("b > .c i")[0])) == 1  # the nearer .c is no child of b
    assert len(select(page, compile_group("b > .c > i")[0])) == 0


@pytest.mark.parametrize("css", ["", "a:hover", "a + b", "a ~ b", "a >", "> a", "a,,b", "a[href", "a[href!=x]", ".", "a..b", "a > > b", ".x y|z", "a,"])
def test_unknown_syntax_raises(css):
    with pytest.raises(ValueError):
        compile_group(css)


def test_lists():
    assert compile_list(["nav a[href]"]) == [[(("tag", "nav"),), (("tag", "a"), ("has", "href"))]]
    assert compile_steps_of("h1, .x") == [(("tag", "h1"),), (("class", "x"),)]
    with pytest.raises(ValueError):
        compile_list(["a, b"])
    with pytest.raises(ValueError):
        compile_steps_of("a b")


def test_navigation_selectors_as_a_parameter():
    rows = list(X.nav_rows("https://e.org/d/", PAGE, compile_list(["section > p a[href]", "p a[href]"])))
    assert [(r[0], r[1], r[3]) for r in rows] == [(1, 0, "http://q/r.png"), (2, 0, "https://e.org/u"), (2, 1, "http://q/r.png")]


def test_table_function_from_sql(spark):
    elements_function(spark)
    spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>"), (4, PAGE)], "id int, html string").createOrReplaceTempView("captured")
    got = spark.sql("SELECT c.id, e.pos, e.tag, e.text, e.href, e.attrs['title'] t FROM captured c, LATERAL elements('p > a', c.html) e ORDER BY id, pos").collect()
    assert [tuple(r) for r in got if r.id == 1] == [(1, 0, "a", "u", "/u", "see GitHub"), (1, 1, "a", "no", None, None), (1, 2, "a", "r", "http://q/r.png", None)]
    assert {r.id for r in got} == {1, 4}
    assert spark.sql("SELECT * FROM elements(NULL, 'x')").collect() == []
