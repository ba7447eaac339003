"""Links are resolved as the standard library resolves them, without Python in the plan."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from reportlens.sources import pages as sp

BASES = ["http://a/b/c/d;p?q", "http://h.org", "https://h.org/", "http://h.org/x/y/", "HTTP://H.org/a/../b", "ftp://f/a", "mailto:x@y.z", "/only/path", "rel/path", "", None, "http://h/a//b///c", "file:///tmp/x", "http://h/a/;x", " http://h/q"]
#: Examples of RFC 3986, 5.4.
LINKS = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g",
         "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "http:g", "HTTP:g", "https://z.org/r.pdf", "///p", "////p", "a;", "..;x",
         " spaced.pdf", "tab\tbed.pdf", "é/ü.pdf?ä=ö#ß", "?", "#", "a b/c.pdf ", None, "javascript:void(0)", "//h2", "//h2?x", "http://h3"]


def test_resolution(spark):
    rng = random.Random(1)
    pairs = [(b, l) for b in BASES for l in LINKS]
    for _ in range(2500):
        pairs.append((rng.choice(BASES[:9]) if rng.random() < 0.7 else "http://h/" + "".join(rng.choice("ab/.;?") for _ in range(8)), "".join(rng.choice(["a", "b", "/", ".", "..", "?", "#", ";", "//", "x:"]) for _ in range(rng.randint(1, 7)))))
    df = spark.createDataFrame(pairs, "url string, href string").select("*", sp.absolute_url("url", "href").alias("link"))
    assert "Python" not in df._jdf.queryExecution().toString()
    off = [(r.url, r.href, r.link, urljoin(r.url or "", r.href or "")) for r in df.collect() if (r.link or "") != urljoin(r.url or "", r.href or "")]
    assert off == []


def test_link_extract_has_no_python(spark, sf):
    found = sp.link_extract(spark.read.parquet(f"{sf}/pages.parquet"))
    assert "Python" not in found._jdf.queryExecution().toString()
    for r in found.where(F.col("href").isNotNull()).collect():
        assert r.link == urljoin(r.url, r.href)
