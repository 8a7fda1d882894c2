"""SQL table function ``elements(selector, html)``: the elements of a page that
a CSS selector matches, one row each.

    elements_function(spark)
    spark.sql("SELECT p.page_id, e.text FROM pages p, LATERAL elements('nav a[href]', p.html) e")

Pages reach it and elements leave it as Arrow batches. (Spark lets a function
over whole Arrow arrays stand alone, but not in a lateral join.)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "pos int, tag string, text string, href string, attrs map<string,string>"


class Elements:
    """(pos, tag, text, href, attrs) of the matches in document order; a null
    selector or page has none, a selector of unknown syntax is an error."""

    def eval(self, selector: str, html: str) -> Iterator[tuple]:
        from sitequill.operators.htmltree import parse, select_any
        from sitequill.operators.selectors import compile_group

        if selector is None or html is None:
            return
        for i, n in enumerate(select_any(parse(html), compile_group(selector))):
            yield i, n.tag, n.text(strip=False).strip(), n.get("href"), {k: v or "" for k, v in n.attrs.items()}


def elements_function(spark: SparkSession, name: str = "elements") -> None:
    """Make the function callable from SQL under ``name``."""
    spark.udtf.register(name, udtf(Elements, returnType=SCHEMA, useArrow=True))
