"""Main text of web pages by a linear-chain conditional random field.

The leaf blocks of a page are a sequence; every block is content or not. The
field has weights for features of a block (tags and class words of its
ancestors, shape of its text) and for two labels in a row. It is trained by
maximum likelihood on labelled pages, and the most likely labels of a page are
found by the Viterbi algorithm.

``training_pages`` writes the labelled pages: layouts of many kinds, whose
labels are known from their making.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import slices
from paperloom.llm.html_blocks import SHARES, Block, leaf_blocks

CONTENT, OTHER = 1, 0
TRAINING_PAGES, TRAINING_SEED = 1600, 5
#: shares of training pages with names without meaning, with class words of other parts on
#: what holds the content, and with paragraphs written as div
VARIED = (0.25, 0.5, 0.35)
_ENDS = (".", "!", "?", "…", ":", "。", '"', "”", "»")


_BARE = frozenset(level + f for _, level in SHARES for f in ("in:html", "in:body", "in:p"))


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of each block's features, but for those of its ancestors."""
    result = []
    for block in blocks:
        words = min((block.text.count(" ") + 1).bit_length(), 6)
        result.append(
            [
                f"parent:{block.parent}",
                f"words:{words}",
                f"links:{int(block.link_share * 4)}",
                "ends" if block.text.endswith(_ENDS) else "open",
                "copyright" if "©" in block.text else "plain",
                "bare" if block.ancestors <= _BARE else "nested",
                # steps that add up, so that more room never counts as something else
                *(f"room:{step}" for step in range(1, 6) if block.room * 6 > step),
                *(f"around:{step}" for step in range(1, 6) if block.around * 6 > step),
            ]
        )
    return result


class Field:
    """Weights of a trained field."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray) -> None:
        self.index, self.weights, self.pairs = index, weights, pairs
        self.known: dict[frozenset[str], float] = {}

    def _ancestors(self, names: frozenset[str]) -> float:
        score = self.known.get(names)
        if score is None:
            if len(self.known) > 50_000:
                self.known.clear()
            score = float(sum(self.weights[self.index[n]] for n in names if n in self.index))
            self.known[names] = score
        return score

    def scores(self, blocks: list[Block]) -> list[float]:
        """How much each block by itself speaks for content."""
        index, weights = self.index, self.weights
        result = []
        for block, names in zip(blocks, features(blocks), strict=True):
            score = self._ancestors(block.ancestors)
            for name in names:
                if name in index:
                    score += weights[index[name]]
            result.append(score)
        return result

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The most likely labels."""
        if not blocks:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back: list[tuple[int, int]] = []
        other, content = 0.0, None
        for score in self.scores(blocks):
            if content is None:
                content = score
                continue
            from_other = other + p00 >= content + p10
            to_other = other + p00 if from_other else content + p10
            from_content = content + p11 >= other + p01
            to_content = (content + p11 if from_content else other + p01) + score
            back.append((OTHER if from_other else CONTENT, CONTENT if from_content else OTHER))
            other, content = to_other, to_content
        label = CONTENT if content >= other else OTHER
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 400, decay: float = 0.00005) -> Field:
    """Fit a field to labelled pages: gradient steps on the penalised log-likelihood.

    Forward and backward sums run over all pages at once, position by position.
    """
    pages = [p for p in pages if p[0]]
    listed = [[[*b.ancestors, *own] for b, own in zip(blocks, features(blocks), strict=True)] for blocks, _ in pages]
    names = sorted({f for page in listed for block in page for f in block})
    index = {n: i for i, n in enumerate(names)}
    longest = max(len(b) for b, _ in pages)
    cells, columns = [], []
    gold = np.zeros((len(pages), longest), np.int64)
    used = np.zeros((len(pages), longest), bool)
    for p, (_, labels) in enumerate(pages):
        gold[p, : len(labels)], used[p, : len(labels)] = labels, True
        for t, block in enumerate(listed[p]):
            for f in block:
                cells.append(p * longest + t)
                columns.append(index[f])
    cells, columns = np.array(cells), np.array(columns)
    total = gold.size
    weights, pairs = np.zeros(len(names)), np.zeros((2, 2))
    both = used[:, 1:]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pairs), np.zeros_like(pairs)]
    blocks_used = used.sum()
    for step in range(1, rounds + 1):
        unary = np.zeros((len(pages), longest, 2))
        unary[:, :, CONTENT] = np.bincount(cells, weights[columns], total).reshape(used.shape)
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            reach = forward[:, t - 1, :, None] + pairs
            forward[:, t] = np.where(used[:, t, None], np.logaddexp(reach[:, 0], reach[:, 1]) + unary[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            reach = pairs + (unary[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(used[:, t + 1, None], np.logaddexp(reach[:, :, 0], reach[:, :, 1]), 0.0)
        partition = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        belief = np.exp(forward + backward - partition[:, None, None])[:, :, CONTENT]
        joint = np.exp(
            forward[:, :-1, :, None] + pairs + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - partition[:, None, None, None]
        )
        miss = np.where(used, gold - belief, 0.0).ravel()
        slopes = (
            np.bincount(columns, miss[cells], len(names)) / blocks_used - decay * weights / 4,
            (seen_pairs - joint[both].sum(axis=0)) / blocks_used - decay * pairs / 4,
        )
        for target, slope, m, v in ((weights, slopes[0], *moments[:2]), (pairs, slopes[1], *moments[2:])):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            target += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, weights, pairs)


# --- labelled pages -------------------------------------------------------

#: fixed values: class words that pages commonly use, by the part they mark
PARTS = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination toc skip links tabs".split(),
    "header": "header masthead top banner brand logo topbar site".split(),
    "footer": "footer bottom colophon copyright legal credits".split(),
    "sidebar": "sidebar aside widget related recommended trending popular rail secondary more".split(),
    "notice": "cookie consent notice alert popup modal gdpr overlay disclaimer warning".split(),
    "advert": "ad ads advert advertisement sponsored promo promotion adsense sponsor".split(),
    "form": "form newsletter subscribe signup search login register contact".split(),
    "comments": "comment comments reply replies discussion respond disqus thread reader feedback".split(),
    "share": "share social sharing follow tags meta byline buttons toolbar".split(),
    "content": "content article post entry story body text main page article-body post-content".split(),
}


class _Writer:
    """Writes pages with invented words and keeps the text of the content."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.gold = rng, [], []
        #: names without meaning; words of any part on what holds the content; paragraphs written as div
        self.hashed, self.noisy, self.plain = (rng.random() < share for share in VARIED)
        vowels, others = rng.choice(("aeiou", "aeéè", "aiouä")), "bcdfghklmnprstvw"
        self.words = ["".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(80)]

    def phrase(self, low: int, high: int, end: str = ".") -> str:
        n = self.rng.randint(low, high)
        words = [self.rng.choice(self.words) + ("," if self.rng.random() < 0.06 else "") for _ in range(n)]
        return " ".join(words).capitalize() + end

    def put(self, tag: str, text: str, attributes: str = "", content: bool = False) -> None:
        inner = text
        if self.rng.random() < 0.15 and " " in text:
            head, tail = text.split(" ", 1)
            inner = self.rng.choice((f"<b>{head}</b> {tail}", f'<a href="/x">{head}</a> {tail}', f"<em>{head} {tail}</em>"))
        # end tags are missing now and then, as on real pages
        self.out.append(f"<{tag}{attributes}>{inner}" + ("" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"))
        if content:
            self.gold.append(text)

    def hash(self) -> str:
        return "".join(self.rng.choice("bcdfghjkqvxz0123456789") for _ in range(self.rng.randint(5, 9)))

    def noise(self) -> str:
        """A class name with a word that marks some part elsewhere."""
        rng = self.rng
        word = rng.choice(PARTS[rng.choice(list(PARTS))])
        return rng.choice(
            (word, f"has-{word}", f"with-{word}", f"{word}-fixed", f"{word}-{rng.choice(self.words)}", f"{rng.choice(self.words)}-{word}")
        )

    def links(self, low: int, high: int) -> None:
        items = "".join(
            f'<li><a href="/{i}">{self.phrase(1, 3, "")}</a></li>' for i in range(self.rng.randint(low, high))
        )
        self.out.append(f"<ul>{items}</ul>")

    def open(self, part: str, tags: tuple[str, ...]) -> str:
        rng = self.rng
        tag = rng.choice(tags)
        names = PARTS[part]
        marked = tag in ("div", "section", "td", "ul") or rng.random() < 0.4
        word = rng.choice(names)
        if marked and rng.random() < 0.5:
            word = f"{word} {rng.choice(names)}" if rng.random() < 0.5 else f"{rng.choice(('c', 'box', 'block', 'l'))}-{word}"
        if self.hashed:
            tag = "div" if tag in ("nav", "aside", "header", "footer", "section", "dialog") and rng.random() < 0.7 else tag
            word = self.hash()
        elif part == "content" and self.noisy and rng.random() < 0.8:
            word, marked = rng.choice((self.noise(), f"{word} {self.noise()}")), True
        attribute = f' {rng.choice(("class", "class", "id"))}="{word}"' if marked else ""
        self.out.append(f"<{tag}{attribute}>")
        return tag

    def boilerplate(self, part: str) -> None:
        rng = self.rng
        tags = {
            "menu": ("nav", "nav", "div", "ul"),
            "header": ("header", "div"),
            "footer": ("footer", "footer", "div"),
            "sidebar": ("aside", "div"),
            "notice": ("div", "div", "section", "dialog"),
            "advert": ("div", "div", "aside", "section"),
            "form": ("form", "form", "div"),
            "comments": ("section", "div"),
            "share": ("div", "ul"),
        }[part]
        tag = self.open(part, tags)
        if part in ("menu", "share"):
            self.links(3, 8)
        elif part == "header":
            self.put(rng.choice(("div", "h1", "p", "h2")), self.phrase(1, 5, ""))
            if rng.random() < 0.5:
                self.boilerplate("menu")
        elif part == "footer":
            self.out.append(rng.choice(("", "&copy; ")) + self.phrase(1, 30))
            if rng.random() < 0.5:
                self.links(2, 5)
        elif part == "sidebar":
            self.put(rng.choice(("h2", "h3", "h4")), self.phrase(1, 3, ""))
            for _ in range(rng.randint(0, 3)):
                self.put("p", self.phrase(2, 30))
            if rng.random() < 0.7:
                self.links(2, 6)
        elif part == "comments":
            self.put("h3", self.phrase(1, 3, ""))
            for _ in range(rng.randint(1, 4)):
                inner = self.open("comments", ("div", "li", "article"))
                self.put(rng.choice(("span", "cite", "h4", "div")), self.phrase(1, 2, ""))
                for _ in range(rng.randint(1, 2)):
                    self.put("p", self.phrase(2, 60))
                self.out.append(f"</{inner}>")
        elif part == "form":
            self.put(rng.choice(("label", "p", "legend", "h3")), self.phrase(1, 12, ""))
            self.out.append(f'<input type="text" name="q"><button>{self.phrase(1, 2, "")}</button>')
            if rng.random() < 0.3:
                self.out.append(f"<select><option>{self.phrase(1, 1, '')}<option>{self.phrase(1, 1, '')}</select>")
        elif rng.random() < 0.6:
            self.out.append(self.phrase(1, 30))
        else:
            for _ in range(rng.randint(1, 2)):
                self.put("p", self.phrase(1, 40))
        self.out.append(f"</{tag}>")

    def content(self, depth: int = 0) -> None:
        rng = self.rng
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.66:
                end = rng.choice((".", ".", ".", "!", "", "", " |", "***"))
                self.put("div" if self.plain else "p", self.phrase(1, rng.choice((4, 20, 90)), end), content=True)
            elif kind < 0.76:
                self.put(rng.choice(("h2", "h3")), self.phrase(1, 8, ""), content=True)
            elif kind < 0.82:
                tag = rng.choice(("ul", "ol"))
                self.out.append(f"<{tag}>")
                for _ in range(rng.randint(1, 4)):
                    self.put("li", self.phrase(1, 15, rng.choice((".", ""))), content=True)
                self.out.append(f"</{tag}>")
            elif kind < 0.86:
                self.put(rng.choice(("blockquote", "pre", "figcaption")), self.phrase(2, 30), content=True)
            elif kind < 0.89:
                self.out.append("<table><tr>")
                for _ in range(3):
                    self.put("td", self.phrase(1, 4, ""), content=True)
                self.out.append("</tr></table>")
            elif kind < 0.92 and depth < 2:
                self.out.append(rng.choice(("<div>", '<div class="section">')))
                self.content(depth + 1)
                self.out.append("</div>")
            else:
                self.boilerplate(rng.choice(("advert", "share", "sidebar", "form", "notice")))

    def page(self) -> tuple[str, list[str]]:
        rng, out = self.rng, self.out
        title = self.phrase(2, 9, "")
        noise = " ".join(self.noise() for _ in range(rng.randint(1, 4))) if self.noisy and not self.hashed else ""
        body = f' class="{noise}"' if noise and rng.random() < 0.6 else ""
        out.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body{body}>")
        wrap = rng.choice(("div", "div", "div", "form")) if rng.random() < 0.4 else ""
        if wrap == "form":
            out.append('<form method="post" id="aspnetForm">')
        elif wrap and noise:
            out.append(f'<div class="{noise}">')
        elif wrap:
            out.append(rng.choice(('<div class="wrapper">', '<div id="page">', "<div>")))
        if rng.random() < 0.2:
            self.boilerplate("notice")
        for part, chance in (("header", 0.5), ("menu", 0.8), ("advert", 0.4), ("sidebar", 0.2), ("form", 0.15)):
            if rng.random() < chance:
                self.boilerplate(part)
        kind = rng.random()
        if kind < 0.4:
            tags = [self.open("content", ("article",))]
        elif kind < 0.55:
            out.append("<main>")
            tags = ["main"]
            if rng.random() < 0.5:
                tags.append(self.open("content", ("article", "div")))
        elif kind < 0.9:
            tags = [self.open("content", ("div", "div", "section", "td"))]
        else:
            tags = []
        if rng.random() < 0.8:
            self.put("h1", title, content=True)
        self.content()
        late = rng.random() < 0.15 and bool(tags)
        if late:
            self.boilerplate("comments")
        out.extend(f"</{t}>" for t in reversed(tags))
        for part, chance in (("comments", 0.3), ("sidebar", 0.4), ("form", 0.2), ("advert", 0.2), ("notice", 0.15)):
            if rng.random() < chance:
                self.boilerplate(part)
        if rng.random() < 0.85:
            self.boilerplate("footer")
        if wrap:
            out.append(f"</{wrap}>")
        if rng.random() < 0.85:
            out.append("</body></html>")
        return "".join(out), self.gold


def training_pages(count: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> list[tuple[str, list[str]]]:
    """Pages and the texts of their content blocks."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(count)]


def labelled(pages: list[tuple[str, list[str]]]) -> list[tuple[list[Block], list[int]]]:
    """Blocks of labelled pages with their labels: content blocks come in the order of the texts."""
    result = []
    for page, gold in pages:
        blocks, labels, at = leaf_blocks(page), [], 0
        for block in blocks:
            hit = at < len(gold) and block.text == gold[at] and block.parent != "title"
            at += hit
            labels.append(CONTENT if hit else OTHER)
        result.append((blocks, labels))
    return result


@lru_cache(maxsize=2)
def trained_field(count: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Field:
    return train(labelled(training_pages(count, seed)))


def main_text(field: Field, page: str | None) -> str:
    """Content blocks of a page, one line each."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.viterbi(blocks), strict=True) if label == CONTENT)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without content, give an empty text. Pages
    are independent: repeated rows and null ids give rows of their own; other
    columns are ignored; an empty table gives an empty result. Whole pages are
    read, whatever their length.
    """
    # the field's size is bounded by its training pages
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(shared.value, page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
