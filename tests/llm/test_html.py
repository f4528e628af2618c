import html
import re
import time

import pytest

from buildlens.llm import html_text

PAGE = """<html><body><header><h2>Site name</h2></header><div id="wrap"><div class="sidebar">some side links <a>x</a></div><div class="content"><h1>Title &eacute;</h1>
<p>One two three <a href="x>y">four</a>
 five&nbsp;six.</p><ul><li>item one</li><li>item two</ul><div class="advert"><p>Buy now now now</p></div><p>Last <i>par</i>agraph.<br>line</p></div>
<div class="comments"><p>nice post!</p></div></div><form>Name <input></form><footer>foot</footer>"""


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.main_text(pages).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_page_without_article(spark):
    weights = html_text.Weights()
    assert html_text.extract(PAGE, weights) == "Title é\n\nOne two three four five six.\n\nitem one\n\nitem two\n\nLast paragraph. line"


def test_parts_inside_an_article_do_not_break_it():
    page = f"<article><p>{'w ' * 10}<aside>{'n ' * 500}</aside><p>{'v ' * 5}<section class='comments'>no</section></article>"
    assert html_text.extract(page, html_text.Weights()) == f"{'w ' * 9}w\n\n{'v ' * 4}v"
    assert html_text.extract("<main><header><h1>T</h1></header><p>a b</main>", html_text.Weights()) == "T\n\na b"


def test_region_is_the_best_run():
    def brute(scores):
        return max((sum(scores[i:j]), 0) for i in range(len(scores)) for j in range(i, len(scores) + 1))[0]

    for scores in ([1.0, -2, 3, 4, -1, 2, -9, 5], [-1.0, -2], [], [2.0]):
        a, b = html_text.region(scores)
        assert sum(scores[a:b]) == max(0, brute(scores) if scores else 0)


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>broken <b"), (2, "u", "<script>x"), (3, "u", "<!-- open " + "x" * 100_000), (4, "u", "plain words")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((str(r.page_id), r.text) for r in html_text.main_text(pages).collect())
    assert found == [("1", ""), ("1", ""), ("2", ""), ("3", ""), ("4", "plain words"), ("None", "broken <b")]
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "".join(f"<div class='c{i}'>" for i in range(20_000)) + "<p>one two</p>",
    "<div>" + "<b>" * 20_000 + "<div>x</div></i>" * 5_000,
    "<p>one two</p>" + '<a ">"' * 20_000,
    "<p>one two</p>" + "<a '" * 20_000,
    "<p>one two</p>" + "<a <!-" * 20_000,
], ids=["deep", "inline", "quotes", "open quotes", "open tags"])
def test_work_grows_with_length_alone(page):
    begin = time.process_time()
    text = html_text.extract(page, html_text.Weights())
    assert time.process_time() - begin < 2
    assert text


def test_tags_with_odd_attributes():
    weights = html_text.Weights()
    assert html_text.extract('<p>a b<p title="x" <b>c d<p title=\'1 > 0\'>e f', weights) == "a b\n\nc d\n\ne f"
    assert html_text.extract("<p>a b</p><!-- <p>c</p> d", weights) == "a b"
    assert html_text.extract("<p>a b</p>c <!-- d", weights) == "a b\n\nc"
    assert html_text.extract("<p>a b</p><script>if (x > 1) d", weights) == "a b"


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>one two</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_text.main_text(pages).collect()] == [(1, "u", "one two", 7)]
