"""Articles inside wrappers with telling names, and runs of copies."""

from gapengine.llm.pages import main_text, page_lines


def test_articles_in_named_wrappers_keep_their_text():
    for wrapper in ('class="page with-sidebar"', 'id="search-page"', 'class="related-news"', 'class="content-header-layout"', 'title="The hidden valley"'):
        assert page_lines(f"<div {wrapper}><article><p>story</article></div>") == [("story", 0)], wrapper
    assert page_lines('<div title="The hidden valley">a</div>') == [("a", 1)]
    gone = ('<div hidden><article>x</article></div>', '<div class="comments"><article>x</article></div>', '<nav><article>x</article></nav>',
            '<div style="display: none">x</div>', '<div class="sidebar">x</div>', '<div role="navigation"><main>x</main></div>', '<article class="promo">x</article>')
    for page in gone:
        assert page_lines(page) == [], page


def test_copies_in_a_row_lose_the_template_alike(spark):
    page = "<div>Site name</div><div>{0}</div><p>tail {0}</p><div>All rights</div>"
    rows = [(0, "http://h.org/a/00", page.format("first")), (9, "http://h.org/a/99", page.format("last"))]
    rows += [(10 + i, f"http://h.org/a/{10 + i}", page.format("copy")) for i in range(6)]
    rows += [(30 + i, f"http://h.org/a/50?page={i}", page.format("query")) for i in range(6)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and got[0] == "first tail first" and got[9] == "last tail last"
    assert all(got[10 + i] == "copy tail copy" and got[30 + i] == "query tail query" for i in range(6))
