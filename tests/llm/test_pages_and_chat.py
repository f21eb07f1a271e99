"""Page templates and chat examples."""

import html
import re

import pytest
from pyspark.sql import functions as F

from siftwell.llm import chat, html_template
from siftwell.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) == []


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op6_template_classes"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        plain = html.unescape(re.sub("</?(?:p|h1|br)>", " ", re.sub("</?b>", "", inside)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">Cookies!</div><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul><div class="post-body">
<h2>Head &amp; tail %(n)s</h2><p>Some <b>bo</b>ld<br>text&nbsp;%(n)s &lt;b&gt;<p>Second part %(n)s</div><div class="sidebar-box">More</div>
<p>Printed by the same press every day</p>
<section id="comments"><p>first!</p></section><form>Mail <input></form><script>var x = "</p><p>no";</script><!-- <p>no</p> --><footer>c 2020</footer></body></html>"""


def test_slots_without_an_article_mark(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", PAGE % {"n": f"n{i}"}) for i in range(5)], "page_id long, url string, html string")
    for r in html_template.extract(pages).collect():
        n = f"n{r.page_id}"
        assert r.text == f"Head & tail {n} Some bold text {n} <b> Second part {n}"


def test_copies_of_an_article_stay_whole(spark):
    page = "<body><nav>m</nav><article><h1>A</h1><p>Same text</p></article><footer>f</footer></body>"
    pages = spark.createDataFrame([(i, "http://h.example/x", page) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in html_template.extract(pages).collect()} == {"A Same text"}


@pytest.mark.parametrize("copies, others", [(9, 0), (10, 0), (20, 0), (200, 3)])
def test_near_copies_of_an_article_stay_whole(spark, copies, others):
    """Heading, date and a block in the middle differ; a host of any size keeps what the copies share, and other articles lose its line."""
    same = [f"Paragraph {k} of the report tells what everybody has read in all the other papers as well." for k in range(6)]
    parts = lambda i: [f"Title number {i}", f"On day {i}", *same[:3], f"Our own words {i} and some more of them {i * 7}", *same[3:], "Published by the press"]
    page = lambda texts: "<body><nav>menu</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article><footer>foot</footer></body>"
    rows = [(i, f"http://h.example/{i}", page(parts(i))) for i in range(copies)]
    rows += [(1000 + i, f"http://h.example/o{i}", page([f"Another story {i} with {i} own words of its own kind and length {i * 3}", "Published by the press"])) for i in range(others)]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(parts(i)) for i in range(copies))
    assert all("Published" not in got[1000 + i] and "Another story" in got[1000 + i] for i in range(others))


def test_pages_odd_input(spark):
    rows = [(1, None, None), (2, "no url", ""), (None, "http://a/", "plain text"), (3, "http://a/", "<p>a<b"), (3, "http://a/", "<p>a<b"),
            (4, "http://a/", "<p title='x>unclosed"), (5, "http://a/", "<script>never ends"), (6, "http://a/", "</div></p>x < y &bogus; &#x41;"), (7, "http://a/", "<p>" + "w " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "template": F.lit(2), "token": F.lit(3)})
    got = [(r.page_id, r.text) for r in html_template.extract(pages).collect()]
    assert len(got) == len(rows) and {t for i, t in got if i in (1, 2, 5)} == {""} and (None, "plain text") in got
    assert (6, "x < y &bogus; A") in got and max(len(t) for _, t in got) == 199_999
    assert html_template.extract(pages.filter("false")).count() == 0


def test_equal_vectors_make_a_template(spark):
    pages = spark.createDataFrame([(f"h{i % 2}", f"u{i}", f"<div><p>fixed words</p><p>own {i}</p></div>") for i in range(12)], "host string, url string, html string")
    found = {r.host: r.template for r in html_template.templates(pages).collect()}
    assert set(found) == {"h0", "h1"} and all(sum(t.is_text for t in ts) == 1 for ts in found.values())


def examples_of(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.prefix_examples(turns.withColumns({"turns": F.lit(1), "example": F.lit(2)}))
    return made, made.orderBy("conv_id", "example").collect()


def test_every_assistant_turn_is_an_example(spark):
    hard = "\\s ### user:\n</turn>\n<#:\\l \\"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", "b"), (1, 4, "assistant", "C"), (1, 5, "user", "bye")]
    made, got = examples_of(spark, rows)
    assert len(got) == 3
    read = [[(t.role, t.text) for t in r[0]] for r in made.orderBy("example").select(chat.read_turns(F.col("text"))).collect()]
    assert read == [[(r, t) for _, _, r, t in rows[:n]] for n in (3, 5, 6)]
    loss = [r[0] for r in made.orderBy("example").select(chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))).collect()]
    assert loss == [hard, "C", ""]
    assert all(a.text == b.text[:len(a.text)] for a, b in zip(got, got[1:]))


def test_chat_odd_input(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, None, "assistant", ""), (2, 1, "user", "w " * 50_000), (2, 2, "assistant", "é😀")]
    made, got = examples_of(spark, rows)
    digests = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    assert (digests[1].n_turns, digests[1].loss_chars) == (3, 2) and (digests[None].n_turns, digests[None].loss_chars) == (1, 0) and digests[2].loss_chars == 2
    assert chat.conversation_digests(made.filter("false")).count() == 0
    assert chat.prefix_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native_plan(spark):
    for name in ("op2_prefix_target", "op7_line_frequency"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
