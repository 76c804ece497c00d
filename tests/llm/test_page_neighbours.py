"""Lines outside an article, and neighbours that are copies."""

from lodestone.llm.html_blocks import page_lines
from lodestone.llm.page_text import main_lines, main_text


def test_own_lines_outside_an_article_stay():
    one, two = (page_lines(f"<p>Site motto</p><p>Lead of {x}</p><main><p>{x} text of some length</p></main><p><a href='/'>All of {x}</a></p><p>Imprint</p>") for x in ("one", "two"))
    assert main_lines(one, two) == ["Lead of one", "one text of some length"]
    assert main_lines(one, None) == ["Site motto", "Lead of one", "one text of some length", "Imprint"]


def test_copies_are_passed_over(spark):
    page = lambda x: f"<p>Site motto</p><p>text {x}, which is long enough to be told apart</p><p>Imprint</p>"
    rows = [(k, f"http://a.org/x/{k}", page("first")) for k in range(4)] + [(k, f"http://a.org/x/{k}", page(f"{k} alone")) for k in (4, 5)] + [(k, f"http://a.org/x/{k}", page("last")) for k in (6, 7, 8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {f"text {x}, which is long enough to be told apart" for x in ("first", "4 alone", "5 alone", "last")} and len(got) == 9


def test_site_text_longer_than_the_stories_goes():
    """Pages without an article: six lines of the site's and one of their own."""
    page = lambda own: "".join(f"<p>A long line number {k} that stands on every page of the site</p>" for k in range(3)) + f"<p>{own}</p>" + "".join(f"<p>Another line {k} of the site's own</p>" for k in range(3))
    one, two = (page_lines(page(x)) for x in ("Short story.", "Other tale."))
    assert main_lines(one, two) == ["Short story."] and main_lines(two, one) == ["Other tale."]
    assert len(main_lines(one, one)) == 7


def test_single_linked_paragraphs_stay_and_menus_go():
    page = page_lines("<p><a href='/1'>One</a></p><p><a href='/2'>Two</a></p><p>Before it.</p><p><a href='/x'>A paragraph that is a link.</a></p><p>After it.</p>")
    assert main_lines(page, None) == ["Before it.", "A paragraph that is a link.", "After it."]


def test_differencing_decides_where_no_element_names_the_article(spark):
    """Every page's output changes without its neighbours."""
    page = lambda k: f"<p>Site name and motto</p><p>Rubric of all</p><div>Story {k} is told here.</div><p>Imprint and address of the site</p>"
    rows = [(k, f"http://a.org/x/{k}", page(k)) for k in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(frame).collect()}
    assert got == {k: f"Story {k} is told here." for k in range(30)}
    alone = {k: "\n".join(main_lines(page_lines(t), None)) for k, _, t in rows}
    assert all(got[k] != alone[k] for k in got)
