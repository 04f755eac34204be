"""Main text of hand-made pages."""

from __future__ import annotations

import pytest

from ticklens.llm.html_main import main_text, main_texts

A = "The first paragraph, which is long enough, has commas."
B = "The second paragraph, also long enough, has more of them, as you see."
C = "Some other text, as long as the others, with commas, which is not the article."

PAGES = {
    "marked article": (
        f"<body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{A}<p>Short.<p>{B}</article><footer>{C}</footer>",
        f"Title\n{A}\nShort.\n{B}",
    ),
    "best container without marks": (
        f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=x><p>{A}</p><p>No.</p><p>{B}</p></div>"
        "<div><a href=3>Terms</a> <a href=4>Imprint</a></div>",
        f"{A}\nNo.\n{B}",
    ),
    "siblings": (
        f"<main><section><p>{A}</p><p>{B}</p></section><section><p>Tiny.</p></section></main>",
        f"{A}\n{B}\nTiny.",
    ),
    "comments outweigh the article": (
        f"<div class=post><p>{A}</p></div><div id=comments>" + f"<p>{C}</p>" * 9 + "</div>",
        A,
    ),
    "nested articles of readers": (
        f"<article><header><h1>T</h1></header><p>{A}</p><section class='user-comments'>"
        f"<article class=comment><p>{C}</p></article></section></article>",
        f"T\n{A}",
    ),
    "names of the layout": (
        f"<body class='has-sidebar'><div id=leftSidebar>{C}</div><div class='cookie-notice'>{C}</div>"
        f"<div class='ad'>{C}</div><div class=text><p>{A}</p><aside>{C}</aside><p>{B}</p></div></body>",
        f"{A}\n{B}",
    ),
    "page header, article header": (
        f"<header><h1>Site</h1><p>{C}</p></header><article><div class='article-header'><h1>T</h1></div><p>{A}</p></article>",
        f"T\n{A}",
    ),
    "form": (f"<div><p>{A}</p><p>{B}</p><form><p>{C}</p><input></form></div>", f"{A}\n{B}"),
    "the page is a form": (f"<form id=f><div><p>{A}</p><p>{B}</p></div></form>", f"{A}\n{B}"),
    "links inside": (
        f"<article><p>{A}</p><p>See <a href=1>here</a> and <b>the<i>re</i></b>.</p>"
        "<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article>",
        f"{A}\nSee here and there.",
    ),
    "character references": (
        "<p>5 &lt; 6 &amp; 7 &#233;&#x4e2d; AT&T &bogus; &nbsp;&nbsp; end&hellip;</p>",
        "5 < 6 & 7 é中 AT&T &bogus; end…",
    ),
    "white space": (f"<article> one\n\t two<br>three <!-- no --> four<div>  five </div> six <p> </p></article>", "one two three four\nfive\nsix"),
    "scripts and styles": (
        f"<script>var a='<p>{C}</p>';</script><style>p{{}}</style><p>{A}</p><script>if (a<b) c()</SCRIPT ><p>{B}",
        f"{A}\n{B}",
    ),
    "hidden": (f"<div><p hidden>{C}</p><p style='display: none'>{C}</p><p>{A}</p></div>", A),
    "divs as paragraphs": (f"<div><div>{A}</div><div>{B}</div><div>{A}</div></div>", f"{A}\n{B}\n{A}"),
    "misnested": (f"<article><b><p>{A}</b> tail<p><i>{B}</article>", f"{A} tail\n{B}"),
    "quotes in attributes": (f"<p title='a > b' data-x=\"</p>\">{A}</p>", A),
    "cut off": (f"<article><p>{A}<p>cut <a href='x", f"{A}\ncut"),
    "unclosed comment": (f"<p>{A}</p><!-- {C}", A),
    "only text": ("no markup,\n at all", "no markup, at all"),
    "table": (f"<article><table><tr><td>1<td>2<tr><td>3</table><p>{A}</article>", f"1\n2\n3\n{A}"),
    "no text": ("<html><body><img src=x></body></html>", ""),
    "only a menu": ("<nav>a, b, c</nav>", ""),
    "empty": ("", ""),
    "missing": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page", ["<div>" * 50_000 + "x", "<" * 50_000, "<a b='" * 9_000, "<!--" * 50_000, "<td>" * 9_000 + "</p>" * 9_000]
)
def test_hostile_pages_end(page):
    main_text(page)


def test_long_pages_are_read_whole():
    paragraphs = [f"{A} {i}" for i in range(60_000)]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert main_text(page) == "\n".join(paragraphs)


def test_rows(spark):
    rows = [(i, f"u{i}", page, "t", 5) for i, (page, _) in enumerate(PAGES.values())]
    rows += [rows[0], (None, None, PAGES["siblings"][0], "t", 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    want = [w for _, w in PAGES.values()] + [PAGES["marked article"][1], PAGES["siblings"][1]]
    want = [(r[0], r[1], w, len(w)) for r, w in zip(rows, want)]
    assert sorted(map(tuple, main_texts(pages).collect()), key=repr) == sorted(want, key=repr)
    assert main_texts(pages.limit(0)).collect() == []
