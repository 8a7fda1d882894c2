"""Sitemap indexes: deep chains, cycles, malformed bodies."""

from sitequill.operators import sitemaps as SM

FETCH = "site string, url string, status int, kind string, body string"


def _index(*children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def _urls(*locs):
    return "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in locs) + "</urlset>"


def test_deep_index_chain_loses_nothing(spark):
    depth = 20
    rows = [("s", f"i{i}", 200, "sitemap", _index(f"i{i + 1}", f"m{i}")) for i in range(depth)]
    rows += [("s", f"m{i}", 200, "sitemap", _urls(f"p{i}", f"q{i}")) for i in range(depth)]
    rows += [("s", f"i{depth}", 200, "sitemap", _index("i0", "i3", "gone")), ("s", "bad", 200, "sitemap", "<urlset><url>")]
    fetches = spark.createDataFrame(rows, FETCH)
    start = spark.createDataFrame([("s", "i0"), ("s", "bad")], "site string, url string")
    got = {r.url for r in SM.resolve_sitemap_index(fetches, start).collect()}
    assert got == {f"{c}{i}" for c in "pq" for i in range(depth)}


def test_listings_kept_or_merged(spark):
    fetches = spark.createDataFrame([("s", "a", 200, "sitemap", _urls("x", "y")), ("s", "b", 200, "sitemap", _urls("x"))], FETCH)
    start = spark.createDataFrame([("s", "a"), ("s", "b")], "site string, url string")
    assert sorted(r.url for r in SM.resolve_sitemap_index(fetches, start, distinct=False).collect()) == ["x", "x", "y"]
    assert sorted(r.url for r in SM.resolve_sitemap_index(fetches, start).collect()) == ["x", "y"]
    none = SM.resolve_sitemap_index(fetches, start.limit(0))
    assert none.count() == 0
