"""Main text of pages whose names mislead, of several layouts, and of wide or deep trees."""

from __future__ import annotations

import random

import pytest

from cutline.llm import html_main


def extract(spark, htmls, host="a.example"):
    rows = [(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)]
    out = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]


BODY = "This is the text of page {0}, long enough to be what the page is about."
NAMED = [
    ('<body class="right-sidebar"><div><h1>T{0}</h1><p>%s</p></div></body>', "T{0}\n%s"),
    ('<body><article class="post comments-closed"><p>%s</p></article></body>', "%s"),
    ('<body><article class="post social"><p>%s</p></article><p>Small print {0}</p></body>', "%s"),
    ('<body><main class="no-ad"><p>%s</p></main></body>', "%s"),
    ('<body><main class="search"><p>%s</p></main></body>', "%s"),
    ('<body><h1 class="post-title">T{0}</h1><div class="text">%s</div></body>', "T{0}\n%s"),
    ('<body><h1>T{0}</h1><div class="right-sidebar">%s</div></body>', "T{0}\n%s"),
    ('<body><article class="card"><h2>Other {0}</h2></article><main><div>%s</div></main></body>', "%s"),
    ('<body><main><div>%s</div><article class="card"><h2>O{0}</h2></article></main></body>', "%s\nO{0}"),
    ('<body><article class="post"><h1>T{0}</h1><p>%s</p></article><article class="comment">I like page {0}</article></body>', "T{0}\n%s"),
    ('<body><div class="post"><h1>T{0}</h1><p>%s</p></div><div class="comments">I like page {0}</div></body>', "T{0}\n%s"),
    ('<body><div class="ad">Buy {0}</div><article><h1>T{0}</h1></article></body>', "T{0}"),
]


@pytest.mark.parametrize("pages", [1, 8])
def test_names_only_vote(spark, pages):
    for k, (page, want) in enumerate(NAMED):
        got = extract(spark, [("<html>" + page.replace("%s", BODY) + "</html>").format(i) for i in range(pages)], f"h{k}.example")
        assert got == [want.replace("%s", BODY).format(i) for i in range(pages)], page


def test_constant_text_confirms_the_vote(spark):
    """What is open is the same on all pages, so the text that varies is the content whatever its name."""
    page = '<html><body><div class="box">All about us, and how to write to us at any time.</div><div class="promo">%s</div></body></html>' % BODY
    assert extract(spark, [page.format(i) for i in range(8)]) == [BODY.format(i) for i in range(8)]


def shape_of(page):
    tree = html_main.parse(page)
    marks = html_main._marks(tree)
    return html_main.skeleton(tree, marks, html_main._verdicts(tree, marks))


def test_every_layout_of_a_host_has_a_reference(spark):
    """Nine layouts, more than a host's own references: constant text goes from the pages of each."""
    pages, want = [], []
    for k in range(9):
        for i in range(6):
            pad = "<section>" * k
            pages.append(f'<html><body><div class="l{chr(97 + k)}">{pad}<div class="box"><p>All about site part {k}</p></div><div class="text">{BODY.format(f"{k} {i}")}</div></div></body></html>')
            want.append(BODY.format(f"{k} {i}"))
    assert extract(spark, pages) == want


def test_an_insertion_in_a_long_list_moves_nothing():
    old = [f"<p>row {i}" for i in range(700)]
    a, b = shape_of("<body>" + "".join(old)), shape_of("<body><p>new" + "".join(x + ("" if i % 2 else " changed") for i, x in enumerate(old)) + "<p>last")
    pairs = html_main.tree_match(a, b, html_main.WrapperConfig().match_cells)
    assert sum(a[2][x] == b[2][y] and a[2][x] > 0 for x, y in pairs.items()) == 350


def test_wide_lists_of_leaves_are_matched_as_by_the_table():
    rng = random.Random(3)
    weight = lambda a, b, pairs: sum(1.5 if a[2][x] == b[2][y] else 1.0 for x, y in pairs.items())
    for _ in range(60):
        a, b = (shape_of("<body>" + "".join(f"<{t}>{rng.randrange(5)}</{t}>" for t in rng.choices(["p", "h2", "pre"], k=rng.randrange(1, 20)))) for _ in range(2))
        table, wide = html_main.tree_match(a, b, 10**6), html_main.tree_match(a, b, 0)
        assert weight(a, b, table) == weight(a, b, wide)
        assert all(a[0][x] == b[0][y] for x, y in wide.items()) and [y for _, y in sorted(wide.items())] == sorted(wide.values())


def test_deep_pages_have_a_wrapper(spark):
    page = "<html><body>" + "<section>" * 600 + '<div class="box">All about us at any time</div><p>%s</p></body></html>' % BODY
    assert extract(spark, [page.format(i) for i in range(8)]) == [BODY.format(i) for i in range(8)]
