"""Pages of layout families that training does not write: class names of their own, one form, div paragraphs.

The features and shares of the training pages were chosen with these families in
view, so their figures are no unseen estimate; the pages drawn here are new ones.
"""

from __future__ import annotations

import random

import pytest

from paperloom.llm import html_crf

WORDS = (
    "the report says that people walk along quiet rivers when summer comes and many towns keep their old markets open"
).split()
FAMILIES = (
    "post body body_article form div hash comment thread story-header page-with-sidebar more-content has-comments post-feedback"
).split()


def sentence(rng, low=9, high=22):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."


def layout(rng, family):
    """A page of a family, and its content blocks."""
    paragraphs = [" ".join(sentence(rng) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 7))]
    title = sentence(rng, 3, 7)[:-1]
    tag = "div" if family == "div" else "p"
    nav = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(5)) + "</ul></nav>"
    notice = '<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>'
    replies = "".join(f'<div class="comment"><p>{sentence(rng)}</p></div>' for _ in range(2))
    replies = f'<div class="comments"><h3>Two replies</h3>{replies}</div>'
    footer = "<footer>Copyright 2020 by the town press</footer>"
    body = ' class="single-post has-sidebar header-fixed"' if family.startswith("body") else ""
    begin = {
        "body": '<div class="post">',
        "body_article": '<article class="post">',
        "form": "<div>",
        "hash": '<div class="x9k2">',
        "comment": '<article class="comment">',
        "thread": '<article class="thread">',
    }.get(family, f'<div class="{family}">')
    if family == "hash":
        notice = notice.replace("cookie-notice", "qx81")
        replies = replies.replace("comments", "zz7").replace("comment", "k2d")
        nav, footer = nav.replace("nav>", "div>"), footer.replace("footer", "div")
    main = f"{begin}<h1>{title}</h1>" + "".join(f"<{tag}>{p}</{tag}>" for p in paragraphs)
    main += "</article>" if begin.startswith("<article") else "</div>"
    page = notice + nav + main + replies + footer
    if family == "form":
        page = f'<form method="post" action="./p.aspx" id="form1">{page}</form>'
    return f"<html><head><title>t</title></head><body{body}>{page}</body></html>", [title, *paragraphs]


@pytest.mark.parametrize("family", FAMILIES)
def test_layouts_never_trained_on(family):
    field = html_crf.trained_field()
    rng = random.Random(f"new pages of {family}")
    right = wrong = lost = 0
    for _ in range(100):
        page, gold = layout(rng, family)
        got = html_crf.main_text(field, page).split("\n")
        right += sum(t in gold for t in got)
        wrong += sum(t not in gold for t in got if t)
        lost += sum(t not in got for t in gold)
    recall = 0.8 if family == "div" else 0.95  # paragraphs written as div are found less often
    assert right >= recall * (right + lost) and right >= 0.95 * (right + wrong), (right, wrong, lost)
