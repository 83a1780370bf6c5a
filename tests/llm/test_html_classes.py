"""Pages whose article is below a name that also marks boilerplate."""

import random
import time

import pytest

from tensorloom.llm.html_extract import main_text

BODY = "<p>First para, with commas, and length enough to count for points.</p><p>Second para, again, with commas and enough length.</p>"
WANT = "First para, with commas, and length enough to count for points. Second para, again, with commas and enough length."
SIDE = "<div class='sidebar'><p>Side story, long enough to be counted as a paragraph</p></div>"


@pytest.mark.parametrize("start,end", [("<div class='content has-sidebar'>", "</div>"), ("<div id='post' class='comments-open'>", "</div>"), ("<div class='content no-comments'>", "</div>"), ("<form><div>", "</div></form>"), ("<div class='has-sidebar'>", "</div>")])
def test_the_article_stays(start, end):
    assert main_text(f"<html><body>{start}{BODY}{end}{SIDE}</body></html>") == WANT


def test_header_by_class_in_an_article():
    assert main_text(f"<body><article><div class='article-header'><h1>Headline</h1></div>{BODY}</article>{SIDE}</body>") == "Headline " + WANT


def test_small_forms_and_boilerplate_go():
    page = f"<body><div class='content'>{BODY}<form><p>Sign up for our letter, it is free of charge</p></form><div class='related-content'><p>Read this other story, it is good too</p></div></div></body>"
    assert main_text(page) == WANT


def test_a_long_advertisement_beside_a_short_article_goes():
    assert main_text(f"<body><div class='ad'>{BODY}</div><article><h1>Headline</h1><p>Short.</p></article></body>") == "Headline Short."


def test_deep_pages_with_many_closing_tags_take_seconds():
    began = time.process_time()
    assert main_text("<div>" * 100_000 + "x</p>" * 100_000).startswith("x")
    assert main_text("<div>" * 50_000 + "</span></td>" * 50_000) == ""
    assert time.process_time() - began < 30


def paragraph(k):
    return f"Paragraph {k} of the article, with some commas, and enough words to count for points."


def comment(k):
    return f"Comment {k} says, rather loudly, that the writer is wrong, and goes on for long enough to score."


def ps(*ks):
    return "".join(f"<p>{paragraph(k)}</p>" for k in ks)


def cs(n):
    return "".join(f"<p>{comment(k)}</p>" for k in range(n))


def said(*ks):
    return " ".join(map(paragraph, ks))


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article>{ps(1, 2)}<section class='comments'>{cs(2)}</section></article>", said(1, 2)),
        (f"<article>{ps(1, 2)}<section class='comments'>{cs(8)}</section></article>", said(1, 2)),
        (f"<div class='post'>{ps(1, 2)}</div><div id='comments'>{cs(6)}</div>", said(1, 2)),
        (f"<div class='cookie-notice'>{cs(5)}</div><div class='text'>{ps(1)}</div>", said(1)),
        (f"<div class='cookie-notice'>{cs(5)}</div><div>{ps(1)}</div>", said(1)),
        (f"<main>{ps(1, 2)}<div class='related'>{cs(3)}</div></main>", said(1, 2)),
        (
            f"<div><div class=b>{ps(1, 2, 3, 4)}</div><ul><li>First item</li><li>Second</li></ul><table><tr><td>a cell</td></tr></table><div>closing words</div><dl><dt>Term</dt><dd>Meaning</dd></dl></div>",
            said(1, 2, 3, 4) + " First item Second a cell closing words Term Meaning",
        ),
        (f"<section>{ps(1, 2, 3)}</section><section><p>One short sentence.</p></section>", said(1, 2, 3) + " One short sentence."),
        (f"<div class=a>{ps(1, 2, 3)}</div><div class=b>{ps(4, 5, 6)}</div>", said(1, 2, 3, 4, 5, 6)),
        (f"<div><div>{ps(1, 2, 3)}</div><div>{ps(4, 5, 6)}</div></div><div class='footer'>{ps(9)}</div>", said(1, 2, 3, 4, 5, 6)),
        (f"<div class='comments'>{cs(2)}</div>", f"{comment(0)} {comment(1)}"),
        (f"<ul><li><a href=x>Home page of the site</a></li><li><a href=y>Another page of it</a></li></ul><div>{ps(1, 2)}</div>", said(1, 2)),
        (f"<div><ul><li><a href=x>Home page of the site, indeed</a></li><li><a href=y>Another page</a></li></ul><div>{ps(1, 2)}</div></div>", said(1, 2)),
        (f"<h1>Head</h1>{ps(1, 2)}<div id='comment-list'>{cs(4)}</div>", "Head " + said(1, 2)),
        (f"<article>{ps(1, 2)}</article><article class='comment'>{cs(1)}</article>", said(1, 2)),
        (f"<main><article>{ps(1, 2)}</article><div class='recommended-stories'>{cs(4)}</div></main>", said(1, 2)),
    ],
)
def test_whole_articles_without_comments(body, want):
    assert main_text(f"<html><body>{body}</body></html>") == want


def test_random_pages_equal_what_they_were_made_of():
    """Pages of random wrappers around paragraphs, lists and tables, with boilerplate of plain names anywhere between them."""
    rng = random.Random(5)
    for _ in range(300):
        want, n = [], 0

        def block():
            nonlocal n
            n += 1
            kind = rng.choice(["p", "p", "p", "ul", "table", "h2", "dl"])
            if kind == "p":
                want.append(paragraph(n))
                return ps(n)
            if kind == "h2":
                want.append(f"Heading {n}")
                return f"<h2>Heading {n}</h2>"
            want.extend([f"entry {n} one", f"entry {n} two"])
            if kind == "ul":
                return f"<ul><li>entry {n} one</li><li>entry {n} two</li></ul>"
            if kind == "dl":
                return f"<dl><dt>entry {n} one</dt><dd>entry {n} two</dd></dl>"
            return f"<table><tr><td>entry {n} one</td><td>entry {n} two</td></tr></table>"

        def noise():
            name = rng.choice(["comments", "related", "cookie-notice", "sidebar", "share-bar", "newsletter", "comment-list"])
            return rng.choice(["", f"<div class='{name}'>{cs(rng.randint(1, 3))}</div>", "<nav><a href=x>There</a></nav>"])

        def group(depth):
            parts = []
            for _ in range(rng.randint(1, 4)):
                parts += [noise(), group(depth - 1) if depth and rng.random() < 0.4 else block()]
            tag = rng.choice(["div", "section"])
            return f"<{tag}>{''.join(parts)}</{tag}>"

        outer = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
        n += 1
        want.append(paragraph(n))
        page = outer.format(ps(n) + "".join(noise() + group(2) for _ in range(rng.randint(1, 3))))
        assert main_text(f"<body><nav><a href=x>Home</a></nav>{noise()}{page}{noise()}<footer>End</footer></body>") == " ".join(want), page
