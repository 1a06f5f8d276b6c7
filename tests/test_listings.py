"""Listing items of HTML pages."""

import pytest
from pyspark.sql import functions as F

from jobsift.sources import listings as LI

JOB = LI.Selectors(job_list=".job-list", item=".job-item", title=".job-title", company=".company-name", location=".job-location",
                   description=".job-description", url=".job-link", salary=".job-salary", posted_date=".job-date")


def items(spark, html, selectors):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html if isinstance(html, list) else [html])], "page_id long, html string")
    rows = LI.extract_listing_items(df, selectors).orderBy("page_id", "position").collect()
    return [{k: v for k, v in r.asDict().items() if v is not None and k != "page_id"} for r in rows]


def test_the_seven_fields(spark):
    page = """<div class="job-item">outside the list</div>
    <ul class='wide job-list'>
      <li class="job-item new"><a class="job-link" href="/p/1?a=1&amp;b=2"><h2 class=job-title>Data &amp; SQL
         Engineer</h2></a><span class="company-name">ACME</span> <span class="job-location">Berlin</span>
         <div class="job-description"><p>First.<p>Second <b>bold</b></div><i class="job-salary">5 &lt; 6</i><time class="job-date">2025-01-02</time></li>
      <li class="job-item"><h2 class="job-title">Second</h2><p class="job-link">see <a href=two.html>here</a></p>
      <li class="job-items">another class</li>
    </ul>"""
    assert items(spark, page, JOB) == [
        {"position": 0, "title": "Data & SQL Engineer", "company": "ACME", "location": "Berlin", "description": "First. Second bold",
         "url": "/p/1?a=1&b=2", "salary": "5 < 6", "posted_date": "2025-01-02"},
        {"position": 1, "title": "Second", "url": "two.html"}]


def test_nested_and_unclosed_elements(spark):
    page = """<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><p>one<p>two<div>three</div>four</p>five</i><p><b>six<br>seven"""
    texts = [r["title"] for r in items(spark, page, LI.Selectors(item="li", title=":scope"))]
    assert texts == ["a b c d", "b", "c", "e"]
    texts = [r["title"] for r in items(spark, page, LI.Selectors(item="p", title=":scope"))]
    assert texts == ["one", "two", "six seven"]
    rows = items(spark, "<table><tr><td>1<td>2<tr><td><table><tr><td>3</table>4</table>", LI.Selectors(item="tr", title="td"))
    assert [r.get("title") for r in rows] == ["1", "3 4", "3"]
    assert [r.get("title") for r in items(spark, "<dl><dt>x<dd>y<dt>z</dl>", LI.Selectors(item="dt,dd", title=":scope"))] == ["x", "y", "z"]


def test_what_is_no_element(spark):
    page = """<!-- <li>no</li> --><script>var x = "<li>no</li>";</script><STYLE>li{}</STYLE><li title="a > b" class="x">1 < 2 &nbsp; x</li>
    <img class="x" src="a.png"><br/><li>last<script>open"""
    assert items(spark, page, LI.Selectors(item="li", title=":scope")) == [{"position": 0, "title": "1 < 2 x"}, {"position": 1, "title": "last"}]
    assert [r["position"] for r in items(spark, page, LI.Selectors(item="[class]"))] == [0, 1]
    assert items(spark, [None, "", "no tags", "<", "<!-- open <li>"], LI.Selectors(item="li", title=":scope")) == []
    assert items(spark, '<a id="k" data-class="z">t</a>', LI.Selectors(item="a#k", title=":scope")) == [{"position": 0, "title": "t"}]
    assert items(spark, '<a id="k" data-class="z">t</a>', LI.Selectors(item=".z", title=":scope")) == []
    with pytest.raises(ValueError):
        items(spark, "", LI.Selectors(item="ul > li"))


def test_a_long_page(spark):
    """Two thousand items on one page: each field is looked for in its own item."""
    page = "<ul class=job-list>" + "".join(f"<li class=job-item><h2 class=job-title>t{i}</h2><a class=job-link href=/{i}>x</a>" for i in range(2000))
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    rows = LI.extract_listing_items(df, JOB)
    got = rows.select(F.count("*"), F.count_distinct("position"), F.sum((F.col("title") == F.concat(F.lit("t"), F.col("position"))).cast("int")),
                      F.sum((F.col("url") == F.concat(F.lit("/"), F.col("position"))).cast("int"))).first()
    assert tuple(got) == (2000, 2000, 2000, 2000)


def test_very_long_tags_and_texts(spark):
    """A hundred thousand signs in a tag, a quoted value, a comment, a text."""
    big = "x" * 100_000
    page = f"<!-- {big} --><li class='a' {big} title=\"{big}\" " + "k=v " * 20_000 + f">{big}</li><li {'y ' * 50_000} class=a>two</li><li class='a"
    got = items(spark, page, LI.Selectors(item="li.a", title=":scope"))
    assert [len(r["title"]) for r in got] == [100_000, 3]
