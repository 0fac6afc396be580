"""Labelled pages to train the main-text model on, made from the pages themselves.

A page that marks its article with one `article` element is a labelled page as it is. And the paragraphs and links of every sampled page
are laid out anew: as the article, menus, sidebars, notices, adverts, forms and reader comments of pages of many makes, of which it
is then known what is what. Which words are prose says nothing, as all parts take theirs from the same paragraphs.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import main_text
from catalogspark.llm.main_text import Training

# How sites name the parts of a page.
NAMES = {
    "menu": "nav navigation navbar menu main-menu topnav site-nav breadcrumb breadcrumbs tabs toc pagination pager skip-links toolbar",
    "header": "header site-header masthead top topbar branding logo hero-banner page-header",
    "footer": "footer site-footer bottom colophon copyright legal imprint page-footer footnav",
    "sidebar": "sidebar side aside rail widget widgets secondary related related-posts recommended popular trending more-stories sidebox",
    "notice": "cookie-notice cookie consent gdpr notice alert announcement banner-message privacy popup modal overlay message subscribe paywall warning",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner dfp adsbox ad-slot commercial teaser",
    "form": "form search search-form login signup newsletter contact-form subscribe-form feedback poll survey",
    "comments": "comments comment-list responses discussion replies disqus reader-comments comment respond talkback guestbook",
    "share": "share social social-share sharing follow tags meta post-meta tools actions print rating",
    "article": "article post content main-content entry-content article-body post-body story story-body entry main text body-text blog-post article-content page-content prose",
    "wrapper": "page wrapper container site outer inner row col grid layout wrap box center block section",
}
NAMES = {part: names.split(" ") for part, names in NAMES.items()}
# The elements that HTML has for the parts, and their roles.
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "article": "article", "comments": "section", "form": "form"}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "article": "main", "form": "search", "notice": "dialog"}
_PROSE = "It is a plain page about nothing in particular, and it has some words in it. Readers will find more of them below."

LABELLED = "html string, text string"


class Layout:
    """One way to lay out a page."""

    def __init__(self, rng: random.Random, prose: list[str], words: list[str]):
        self.rng, self.prose, self.words = rng, prose, words
        self.style = rng.choice(["semantic", "classes", "classes", "classes", "mixed", "mixed"])
        self.loose = rng.random() < 0.25
        self.camel = rng.random() < 0.2

    def sentence(self, most: int = 25) -> str:
        parts = self.rng.choice(self.prose).split(" ")
        start = self.rng.randrange(len(parts))
        return " ".join(parts[start : start + self.rng.randint(2, most)])

    def phrase(self, most: int = 3) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(1, most)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(10**6)}">{entities.escape(text)}</a>'

    def paragraph(self, text: str, tag: str = "p") -> str:
        body = entities.escape(text, quote=self.rng.random() < 0.5)
        return f"<{tag}>{body}" + ("" if self.loose and tag in ("p", "li") and self.rng.random() < 0.5 else f"</{tag}>")

    def name(self, part: str) -> str:
        name = self.rng.choice(NAMES[part])
        if self.camel:
            first, *rest = name.split("-")
            name = first + "".join(r.title() for r in rest)
        if self.rng.random() < 0.15:
            name = self.rng.choice(["site-", "js-", "c-", "x"]) + name
        if self.rng.random() < 0.15:
            name += self.rng.choice(["-1", "Box", "-inner", "2", "-wrap", " clearfix"])
        return name

    def part(self, part: str, body: str) -> str:
        named = self.style == "classes" or self.rng.random() < 0.4
        tag = ELEMENTS.get(part, "div") if self.style == "semantic" or (self.style == "mixed" and self.rng.random() < 0.5) else self.rng.choice(["div", "div", "section"])
        if part == "form":
            tag = "form"
        attributes = f' {self.rng.choice(["class", "class", "id"])}="{self.name(part)}"' if named or tag in ("div", "section") else ""
        if part == "article" and tag == "div" and self.rng.random() < 0.25:
            attributes = ""
        if part in ROLES and self.rng.random() < 0.1:
            attributes += f' role="{ROLES[part]}"'
        if self.rng.random() < 0.2:
            body = f"<div>{body}</div>"
        return f"<{tag}{attributes}>{body}</{tag}>"

    def links(self, least: int = 3, most: int = 9) -> str:
        found = [self.link(self.phrase()) for _ in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + ("" if self.loose else "</li>") for x in found) + "</ul>"
        return self.rng.choice([" ", " | ", " &middot; ", "<br>"]).join(found)

    def heading(self, text: str, level: int) -> str:
        return f"<h{level}>{entities.escape(text)}</h{level}>"

    def menu(self) -> str:
        return self.part("menu", self.links())

    def header(self) -> str:
        title = self.rng.choice([self.link(self.phrase()), self.heading(self.phrase(), 2), self.paragraph(self.phrase())])
        return self.part("header", title + (self.paragraph(self.sentence(8)) if self.rng.random() < 0.5 else "") + (self.menu() if self.rng.random() < 0.4 else ""))

    def footer(self) -> str:
        end = f"&copy; {self.phrase()}" + self.rng.choice([" &middot; ", " - ", ". "]) + entities.escape(self.sentence(15))
        return self.part("footer", self.rng.choice([end, f"<p>{end}</p>", f"{self.links(2, 5)}<p>{end}</p>"]))

    def sidebar(self) -> str:
        boxes = []
        for _ in range(self.rng.randint(1, 3)):
            body = self.rng.choice([self.links(2, 6), self.paragraph(self.sentence(30)), "".join(f"<p>{self.link(self.sentence(10))}</p>" for _ in range(3))])
            boxes.append(f"<div>{self.heading(self.phrase(), self.rng.randint(2, 4))}{body}</div>")
        return self.part("sidebar", "".join(boxes))

    def notice(self) -> str:
        return self.part("notice", self.rng.choice([self.paragraph(self.sentence(30)), entities.escape(self.sentence())]) + self.rng.choice(["", "<button>OK</button>", self.link(self.phrase())]))

    def advert(self) -> str:
        return self.part("advert", self.rng.choice([entities.escape(self.sentence()), self.paragraph(self.sentence()), self.link(self.sentence(10)), self.heading(self.phrase(), 4) + self.paragraph(self.sentence())]))

    def form(self) -> str:
        body = "".join(f'<label>{entities.escape(self.phrase())}</label> <input name="x">' for _ in range(self.rng.randint(1, 3)))
        return self.part("form", (self.paragraph(self.sentence(15)) if self.rng.random() < 0.6 else "") + body + "<button>Go</button>")

    def comments(self) -> str:
        one = lambda: self.part("comments", self.rng.choice([f"<b>{self.phrase()}</b> ", self.paragraph(self.phrase()), f"<span class=\"author\">{self.phrase()}</span>"]) + "".join(self.paragraph(self.sentence(60)) for _ in range(self.rng.randint(1, 2))))
        body = "".join(one() for _ in range(self.rng.randint(1, 5)))
        return self.part("comments", self.heading(self.phrase(), 3) + (f"<ol>{body}</ol>" if self.rng.random() < 0.3 else body))

    def share(self) -> str:
        return self.part("share", self.rng.choice([self.links(2, 4), entities.escape(self.phrase()) + " " + self.links(2, 3), self.paragraph(self.phrase(5))]))

    def article(self, text: list[str]) -> str:
        rng, out = self.rng, []
        for k, block in enumerate(text):
            if k == 0 and rng.random() < 0.8:
                out.append(self.heading(block, rng.choice([1, 1, 2])))
                continue
            form, body = rng.random(), entities.escape(block)
            if form < 0.06:
                out.append(self.heading(block, rng.randint(2, 4)))
            elif form < 0.1:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif form < 0.16:
                out.append(f"<ul><li>{body}</li></ul>")
            elif form < 0.2:
                out.append(f"<div>{body}</div>")
            elif form < 0.23:
                out.append(f"<pre>{body}</pre>")
            elif form < 0.26:
                out.append(f"<table><tr><td>{body}</td></tr></table>")
            elif form < 0.36:
                first, _, rest = block.partition(" ")
                out.append(f"<p>{self.link(first)} {rng.choice(['<em>', '<b>', '<i>'])}{entities.escape(rest)}</p>")
            elif form < 0.42 and self.loose:
                out.append(f"<p><b>{body}<br>")
            else:
                out.append(self.paragraph(block))
            if rng.random() < 0.04:
                out.append(rng.choice([self.advert, self.share, self.sidebar, self.notice])())
        if rng.random() < 0.15:
            out.insert(0, self.share())
        if rng.random() < 0.25:
            out.append(rng.choice([self.share, self.menu, self.comments, self.form])())
        return self.part("article", "".join(out))

    def page(self, text: list[str]) -> str:
        """A whole page around the article of these blocks."""
        rng = self.rng
        chance = lambda make, p: make() if rng.random() < p else ""
        before = [chance(self.notice, 0.35), chance(self.header, 0.7), chance(self.menu, 0.7), chance(self.advert, 0.4)]
        after = [chance(self.share, 0.25), chance(self.comments, 0.45), chance(self.form, 0.35), chance(self.advert, 0.25)]
        rng.shuffle(before)
        rng.shuffle(after)
        side = chance(self.sidebar, 0.5)
        middle = self.article(text)
        if rng.random() < 0.1:
            middle = f"<table><tr><td>{side}</td><td>{middle}</td></tr></table>"
        else:
            middle = side + middle if rng.random() < 0.4 else middle + side
        if rng.random() < 0.3:
            middle = f"<main>{middle}{''.join(after)}</main>"
            after = []
        body = "".join([*before, middle, *after, chance(self.footer, 0.8)])
        for _ in range(rng.randrange(3)):
            body = f'<div {rng.choice(["class", "id"])}="{self.name("wrapper")}">{body}</div>'
        head = f"<head><title>{entities.escape(text[0][:60])}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("" if self.loose else "</body></html>")


def own_article(html: str) -> str | None:
    """The text of a page's only `article` element; None if it has none or several."""
    if len(re.findall(r"<article[\s>]", html, re.I)) != 1:
        return None
    tree = main_text.parse(html)
    inside = [t == "article" for t in tree.tags]
    for i, parent in enumerate(tree.parents):
        inside[i] |= parent >= 0 and inside[parent] and tree.tags[i] not in ("nav", "aside", "footer", "form")
    return "\n".join(main_text.lines(tree, [k for k, run in enumerate(tree.runs) if inside[run[0]]])) or None


def labelled_from(html: str, seed: int, layouts: int = 2) -> Iterator[tuple[str, str]]:
    """(html, main text): the page itself if it marks its article, and new layouts of its paragraphs."""
    if text := own_article(html):
        yield html, text
    tree = main_text.parse(html)
    blocks = [(" ".join("".join(run[5]).split()), run[3] / run[2]) for run in tree.runs]
    prose = [t for t, linked in blocks if linked < 0.3 and len(t.split(" ")) >= 8] or [_PROSE]
    words = [w for t, linked in blocks for w in t.split(" ") if linked > 0.7] or _PROSE.split(" ")
    rng = random.Random(seed)
    for _ in range(layouts):
        layout = Layout(rng, prose, words)
        text = [layout.phrase(6)]
        for _ in range(rng.choice([1, 2, 4, 6, 9, 14])):
            whole = rng.choice(prose).split(" ")
            start = rng.randrange(len(whole))
            text.append(" ".join(whole[start : start + rng.choice([1, 3, 8, 20, 50, 120, 10**9])]))
        yield layout.page(text), "\n".join(text)


def labelled_pages(pages: DataFrame, training: Training = Training(), layouts: int = 2) -> list[tuple[str, str]]:
    """(html, main text) from a sample of at most `training.pages` pages of at most `page_bytes`, the same in every run.

    The sample is bounded, and so is what reaches the driver. Without any page of that size the layouts are of plain words.
    """
    order = F.xxhash64("page_id", "url", F.lit(5))
    small = pages.where(F.octet_length("html").between(1, training.page_bytes)).select("page_id", "url", "html", order.alias("place"))
    last = small.select("place").orderBy("place").limit(training.pages).agg(F.max("place")).first()[0]
    if last is None:
        return [pair for seed in range(100) for pair in labelled_from("", seed, layouts)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            made = [pair for place, html in rows for pair in labelled_from(html, place, layouts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in (0, 1)], names=["html", "text"])

    sample = small.where(F.col("place") <= last).select("place", "html").limit(training.pages)
    return sorted((r["html"], r["text"]) for r in sample.mapInArrow(make, LABELLED).collect())
