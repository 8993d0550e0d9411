"""Page extraction: linear time, names that do not decide alone, both passes against their plain definition, edge cases."""

import time

import numpy as np

from corvana.llm import pages

BODY = "This is the main text of the article and it has enough of the words that are in a list. " * 2


def timed(page):
    began = time.time()
    text = pages.main_text(page)
    return time.time() - began, text


def test_linear():
    for page in ("<a " * 350_000, "<a \" b>' " * 100_000, '<a "b>" ' * 100_000, "<svg>" * 200_000, "<b>" * 100_000 + "<hr>" * 100_000, "<!--" * 200_000, "< " * 400_000):
        assert timed(page)[0] < 8, page[:10]
    took, text = timed("<article>" + "".join(f"<p>short {k}</p>" for k in range(100_000)) + "</article>")
    assert took < 15 and text.count("\n\n") == 99_999
    took, text = timed("<div>" * 50_000 + f"<p>{BODY}</p>" + "</div>" * 50_000)
    assert took < 8 and text == BODY.strip()


def test_names_do_not_decide_alone():
    for name in ("legal analysis", "tags", "legal", "discussion of results", "search-theory essay"):
        assert pages.main_text(f"<article><p>{BODY}</p><div class='{name}'><p>{BODY}</p></div></article>") == "\n\n".join([BODY.strip()] * 2), name
    for name in ("cookie-notice", "ad", "comments", "share-links", "newsletter box", "side-bar", "related"):
        assert pages.main_text(f"<article><p>{BODY}</p></article><div class='{name}'><p>{BODY}</p></div>") == BODY.strip(), name
    assert pages.main_text(f"<article><p>{BODY}</p><div class='tags'>red, green</div></article>") == BODY.strip()


def test_strong_names_are_never_overruled():
    for name in ("reader-comments", "user-comments", "comment-thread", "post-comments", "article-comments", "ad-slot", "ad-unit", "google-ads", "cookie-law", "cookie-policy", "related-articles", "promo-card", "card social_share", "entry newsletter-signup-form"):
        assert pages.main_text(f"<article><p>{BODY}</p></article><div class='{name}'><p>{BODY}</p></div>") == BODY.strip(), name
    for name in ("post comments-open", "no-ads entry", "has-sidebar", "hentry share-enabled", "shared-history", "adsorption", "commentary"):
        assert pages.main_text(f"<div class='{name}'><p>{BODY}</p></div>") == BODY.strip(), name


def test_headings_and_links_of_an_article():
    long, by = f"<p>{BODY}</p>", "<p><a href='/j'>By John Smith</a></p>"
    for page in (f"<article><h1>Title</h1>{by}{long}</article>", f"<h1>Title</h1>{by}{long}", f"<div class='story'><h1>Title</h1>{by}{long}</div>"):
        assert pages.main_text(page) == "\n\n".join(["Title", "By John Smith", BODY.strip()]), page
    two = "<p><a>John</a>, <a>Jane</a></p>"
    assert pages.main_text(f"<h1>Title</h1>{two}{long}") == "Title\n\n" + BODY.strip()
    sources = "<h2>Sources</h2><ul><li><a>First source of all</a></li><li><a>Second one</a></li></ul>"
    assert pages.main_text(f"<article>{long}{sources}</article>").endswith("Sources\n\nFirst source of all\n\nSecond one")
    assert pages.main_text(f"<article>{long}<blockquote>{BODY}</blockquote><p><a>The quoted book</a></p></article>").endswith("The quoted book")
    menu = "<div><h3>Sections</h3><ul>" + "".join(f"<li><a>Section {k}</a></li>" for k in range(9)) + "</ul></div>"
    assert pages.main_text(f"{menu}<article><h1>T</h1>{long}</article>{menu}") == "T\n\n" + BODY.strip()
    assert pages.main_text(f"<article>{long}<p>Tags: <a>one tag</a> <a>another tag</a></p></article>") == BODY.strip()


def test_pages_without_a_decided_block():
    assert pages.main_text("<div class='post'><p>Kurz.</p><p>Auch kurz.</p></div>") == "Kurz.\n\nAuch kurz."
    assert pages.main_text("plain text &amp; no tags") == "plain text & no tags"
    assert pages.main_text("字" * 200) == "字" * 200
    assert pages.main_text("<article><h1>T</h1><p><a>one link</a></p></article>") == "T\n\none link"
    assert pages.main_text("<nav><a>Home</a></nav><p>Short.</p><footer>c</footer><div class='cookie-bar'>We use cookies</div>") == "Short."
    assert pages.main_text("<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>Short.</p>") == "Short."


def slow(found):
    """The second pass by its definition: over all decided blocks."""
    labels = [b.label for b in found]
    if not any(labels):
        return [not b.bad and b.label is None for b in found]
    every = [j for j, b in enumerate(found) if b.label is not None and b.bad != 3]
    for k, b in enumerate(found):
        if b.label is None:
            decided = [j for j in every if not (b.heading and found[j].row)]
            same = [j for j in decided if found[j].container == b.container] or [j for j in decided if found[j].in_article == b.in_article] or decided
            nearest = min(same, key=lambda j: (abs(j - k), (j < k) == b.heading), default=None)
            labels[k] = b.in_article if nearest is None else found[nearest].label
    return labels


def test_second_pass_by_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(200):
        found, first = [], {}
        for _ in range(rng.integers(1, 25)):
            b = pages.Block(int(rng.choice([0, 0, 3])), bool(rng.integers(2)), int(rng.integers(4)), bool(rng.integers(2)))
            first[id(b)] = False if b.bad else [None, True, False][rng.integers(3)]
            b.row = first[id(b)] is False and not b.bad and bool(rng.integers(2))
            found.append(b)
        monkeypatch.setattr(pages, "first_pass", lambda b: first[id(b)])  # noqa: B023
        pages.decide(found)
        got = [b.label for b in found]
        for b in found:
            b.label = first[id(b)]
        assert got == slow(found)


def test_frames(spark):
    """Nulls, repeats, an empty table, a very long page, and a column that has the result's name."""
    page = f"<article><p>{BODY}</p></article>"
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, None), (None, "u", "", "x"), (3, "u", page * 3000, "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in pages.extract(frame).collect())
    n = len(BODY.strip())
    assert got == [(0, 0), (1, n), (1, n), (2, 0), (3, 3000 * n + 2 * 2999)]
    assert pages.extract(frame.where("false")).count() == 0
