"""Hosts that the given pages do not have: copies of pages, empty pages, several layouts, misleading names."""

from __future__ import annotations

from tillflow.llm import html_text


def texts(spark, rows):
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(found) == len(rows)
    return {r["page_id"]: r["text"] for r in found}


def page(i, body="<p>Terms</p>"):
    return f"<html><body><div><article><h1>Title {i}</h1><p>Text {i} goes on.</p>{body}</article></div></body></html>"


def test_copies_of_a_page_are_no_evidence(spark):
    rows = [(i, f"https://a.example/{i}", page(0)) for i in range(40)] + [(i, f"https://a.example/{i}", page(i)) for i in range(40, 50)]
    found = texts(spark, rows)
    for i in range(50):
        n = i if i >= 40 else 0
        assert found[i] == f"Title {n}\n\nText {n} goes on."
    rows = [(i, f"https://a.example/{i}", page(max(i, 3), "")) for i in range(7)]
    assert texts(spark, rows) == {i: f"Title {max(i, 3)}\n\nText {max(i, 3)} goes on." for i in range(7)}


def test_empty_pages_and_two_layouts(spark):
    def other(i):
        return f"<html><body><table class='frame'><tr><td><div class='box'><p>Ask us anything</p></div><div class='body'><p>Story {i}</p></div></td></tr></table><p>Made with care</p></body></html>"

    # Empty pages outnumber the others, so that any draw over all rows takes one; each layout has half of the rest.
    rows = [(i, f"https://a.example/{i}", [None, "", " ", "<p></p>"][i % 4]) for i in range(100, 160)]
    rows += [(i, f"https://a.example/{i}", page(i)) for i in range(8)] + [(i, f"https://a.example/{i}", other(i)) for i in range(8, 16)]
    found = texts(spark, rows)
    assert {found[i] for i in range(100, 160)} == {""}
    for i in range(8):
        assert found[i] == f"Title {i}\n\nText {i} goes on." and found[i + 8] == f"Story {i + 8}"


def test_rare_layouts_go_with_the_largest(spark):
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(8)] + [(8, "https://a.example/8", page(8).replace("<article>", "<section></section><article>"))]
    found = texts(spark, rows)
    assert all(found[i] == f"Title {i}\n\nText {i} goes on." for i in range(9))


def test_names_of_containers_do_not_hide_the_text(spark):
    story = "<h1>Title</h1><p>Text goes on.</p>"
    whole = [
        f"<body class='no-sidebar'><div class='has-sidebar'><article>{story}</article></div></body>",
        f"<body class='ad-free sidebar'><div class='content-with-nav'>{story}</div><div class='sidebar'>Left</div></body>",
        f"<div class='widget article-body'>{story}</div><div class='site-footer'>Foot</div>",
        f"<div class='widget'><article>{story}<div class='comments'>No</div></article></div>",
        f"<form id='form1'><main class='notice'>{story}</main></form>",
        f"<html role='navigation'><body id='header'><div class='widget'>{story}</div></body></html>",
        f"<article>{story}</article><div class='related'><article>Another</article></div><div class='ad'>Buy</div>",
        f"<div class='post'>{story}<div class='post-comments'>No</div><div class='cookie-notice top'>No</div></div>",
        f"<div>{story}</div><div class='comments'><article>No</article><article class='comment'>No</article></div>",
    ]
    found = texts(spark, [(i, f"https://a{i}.example/", h) for i, h in enumerate(whole)])
    assert found == {i: "Title\n\nText goes on." for i in range(len(whole))}
    formula = "<article><p>Let <math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><annotation>a+b</annotation></math> be.</p></article>"
    assert texts(spark, [(1, "https://m.example/", formula)]) == {1: "Let a+b be."}
