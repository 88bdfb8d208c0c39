"""Body text of HTML pages: block tags as line breaks, scripts and navigation set apart."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Tags that end a line, and tags whose text is no body.
BLOCKS = frozenset("p div br li ul ol table tr h1 h2 h3 h4 h5 h6 section article blockquote pre".split())
DROPPED = frozenset("script style nav header footer aside noscript form".split())
VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())


class Body(HTMLParser):
    """Collects body text and, separately, what was dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body, self.lost, self.depth = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.depth += 1
        if tag in BLOCKS:
            self.body.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED and self.depth:
            self.depth -= 1
        if tag in BLOCKS and tag not in VOID:
            self.body.append("\n")

    def handle_data(self, data):
        (self.lost if self.depth else self.body).append(data)


def clean(parts: list[str]) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


def parse(html: str | None) -> tuple[str, str]:
    p = Body()
    p.feed(html or "")
    p.close()
    return clean(p.body), clean(p.lost)


def extract_body(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, body, dropped, n_body, n_dropped). One Arrow-batched map over the rows."""
    kind = f"{id_} {dict(pages.dtypes)[id_]}, body string, dropped string, n_body long, n_dropped long"

    def run(frames):
        for f in frames:
            got = [parse(x) for x in f[html]]
            body, lost = [g[0] for g in got], [g[1] for g in got]
            yield pd.DataFrame({id_: f[id_], "body": body, "dropped": lost, "n_body": [len(x) for x in body], "n_dropped": [len(x) for x in lost]})

    return pages.select(id_, html).mapInPandas(run, kind)


#: Class tokens of the element that holds a document, of elements in it that are set apart, and tags that end a line in it.
CONTAINERS = ("document-page__content", "full-text")
SET_APART = (
    "document__insert", "doc-insert", "doc-roll", "document__roll", "full-text__wrapper", "full-text__button", "document-page__notes", "notes",
    "bn", "banner", "seo-links", "document-page__separator", "pages", "external-block", "cookies",
)
LINE_ENDS = ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "blockquote", "br")
#: Fixed value: how an editor's note begins.
NOTE = "КонсультантПлюс"


class Document(HTMLParser):
    """Text inside the containers; elements of a set-apart class (the outermost one) are kept beside it with their class. Open
    elements lie on a stack, so that one left open ends with the element around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.inside, self.parts, self.apart, self.aside = [], 0, [], [], None

    def _out(self, text):
        (self.parts if self.aside is None else self.aside[1]).append(text)

    def handle_starttag(self, tag, attrs):
        tokens = (dict(attrs).get("class") or "").split()
        holds = not self.inside and any(t in CONTAINERS for t in tokens)
        apart = next((t for t in tokens if t in SET_APART), None) if self.inside and self.aside is None and tag not in VOID else None
        if apart:
            self.aside = (apart, [])
        if self.inside and tag in LINE_ENDS:
            self._out("\n")
        if tag not in VOID:
            self.stack.append((tag, holds, apart is not None))
            self.inside += holds

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack):
            return
        while True:
            name, held, apart = self.stack.pop()
            if apart:
                self.apart.append((self.aside[0], " ".join("".join(self.aside[1]).split())))
                self.aside = None
            if self.inside and name in LINE_ENDS:
                self._out("\n")
            self.inside -= held
            if name == tag:
                return

    def handle_data(self, data):
        if self.inside and not any(t in ("script", "style") for t, _, _ in self.stack[-1:]):
            self._out(data)

    def close(self):
        super().close()
        if self.aside is not None:
            self.apart.append((self.aside[0], " ".join("".join(self.aside[1]).split())))


def document(html: str | None) -> tuple[str, list[str], list[tuple[str, str]]]:
    """(body, editor's notes, furniture with its class). A paragraph is a line, with an empty line between."""
    p = Document()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in entities.unescape("".join(p.parts)).replace("\xa0", " ").replace("\u200b", "").split("\n"))
    kept = [(c, t) for c, t in p.apart if t]
    return "\n\n".join(x for x in lines if x), [t for _, t in kept if t.startswith(NOTE)], [x for x in kept if not x[1].startswith(NOTE)]


def extract_document(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, body, notes, furniture): what stands in a page's document container, and what is set apart in it. No text is lost
    there: it is body, note or furniture. A page without a container has an empty body."""
    kind = f"{id_} {dict(pages.dtypes)[id_]}, body string, notes array<string>, furniture array<struct<class:string,text:string>>"

    def run(frames):
        for f in frames:
            got = [document(x) for x in f[html]]
            yield pd.DataFrame({id_: f[id_], "body": [g[0] for g in got], "notes": [g[1] for g in got], "furniture": [[{"class": c, "text": t} for c, t in g[2]] for g in got]})

    return pages.select(id_, html).mapInPandas(run, kind)
