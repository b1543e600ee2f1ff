"""Main text of hand-made pages, and of pages with known articles."""

import pytest

from tessera.llm.html_text import extract, main_text

LONG = "The first of the paragraphs is about the weather and it is long enough to be decided by the words that are in it."
CASES = [
    (None, ""),
    ("", ""),
    ("plain text", "plain text"),
    ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;</p>", "a & b <c> é"),
    (f"<html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy now, the best of the best for you and for all of your friends today.</div><article><h1>Head</h1><p><b>{LONG}<br><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Head\n{LONG}\nShort."),
    (f"<main><!-- <p>no</p> --><p>{LONG}</p><section id='comments'><p>{LONG}</p></section><aside>{LONG}</aside><form><p>{LONG}</p></form></main>", LONG),
    (f"<div><p>{LONG}</p><p>tail</p></div><div><a href='/x'>one</a> <a href='/y'>two</a></div>", f"{LONG}\ntail"),
    (f"<nav><p>{LONG}</p>", LONG),
    (f"<article><p>x\n\n  y\t z</p><p title='a > b'>{LONG}</p></article>", f"x y z\n{LONG}"),
    (f"<article><table><tr><td>a</td><td>b</td></tr></table><p>{LONG}</p></article>", f"a b\n{LONG}"),
    (f"<body><header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{LONG}</p></article></body>", f"Head\n{LONG}"),
    (f"<article><p>{LONG}</p><p>cut <a hre", f"{LONG}\ncut"),
    ("<article>" + "<p>kx | qz | vw ### nonsense without any of those common little words, again and again</p>" * 2 + "</article>", "\n".join(["kx | qz | vw ### nonsense without any of those common little words, again and again"] * 2)),
    (f"<div role='dialog'><p>{LONG}</p></div><div hidden>{LONG}</div><div style='display: none'>{LONG}</div><article>{LONG}</article>", LONG),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    assert main_text(html) == text


def test_hostile_markup_ends():
    for html in ("<" * 100_000, '<a href="' * 20_000, "<div>" * 50_000 + "x", "<script>" * 20_000, "&amp" * 50_000, "<!--" * 30_000, "<p title='" + "a" * 200_000):
        main_text(html)


def test_query(spark):
    df = spark.createDataFrame([(1, "u", h, "c") for h, _ in CASES] + [(None, None, "<p>x", "c")], "page_id long, url string, html string, text string")
    rows = extract(df).collect()
    assert len(rows) == len(CASES) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert extract(df.limit(0)).count() == 0


def test_repeated_rows_and_a_very_long_page(spark):
    """Repeated rows come back as often as they stand; nothing of a long article is cut."""
    long = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>")] * 3 + [(2, "v", long)], "page_id long, url string, html string")
    rows = extract(df).collect()
    assert sorted(r.page_id for r in rows) == [1, 1, 1, 2] and {r.text for r in rows if r.page_id == 1} == {LONG}
    assert next(r.text for r in rows if r.page_id == 2) == "\n".join([LONG] * 5000)
