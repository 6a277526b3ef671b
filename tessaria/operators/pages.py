"""Web pages: article extraction from HTML, extraction quality, pages that only ask for something."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.functions.text import plain_text

# Weights, targets and phrases of the quality score and of interstitial pages.
WEIGHTS = {"length": 0.30, "paragraphs": 0.20, "container": 0.15, "ratio": 0.15, "title": 0.10, "unique": 0.10}
TARGET_CHARS, TARGET_PARAGRAPHS, USABLE_CHARS, USABLE_CAP, INTERSTITIAL_CHARS = 600, 4, 80, 0.3, 1500
CAPTCHA = r"captcha|verify (?:that )?you are (?:a )?human|are you a robot|checking your browser|attention required|just a moment|ddos[- ]protection|browser challenge|prove you are human|security check to access|enable javascript and cookies to continue"
AUTH = r"sign in to continue|log ?in to continue|please (?:sign|log) ?in|login required|subscribers? only|subscribe to (?:read|continue)|create an account to|members only|authentication required|you must be logged in"
BLOCKED = r"access denied|request blocked|you have been blocked|error 1020|forbidden|not authorized to access|unusual traffic from your (?:computer|network)|rate limit exceeded"


def extraction_quality(text: Column, visible: Column, paragraphs: Column, container: Column, title: Column, repeated: Column, shell: Column) -> Column:
    """Weighted quality in 0..1, unrounded; 0 for empty texts and script shells; nulls count as nothing."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    t = F.trim(F.coalesce(text, F.lit("")))
    chars = F.length(t).cast("double")
    upto = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = (
        WEIGHTS["length"] * upto(chars / TARGET_CHARS)
        + WEIGHTS["paragraphs"] * upto(zero(paragraphs) / TARGET_PARAGRAPHS)
        + WEIGHTS["container"] * F.when(container, 1.0).otherwise(0.0)
        + WEIGHTS["ratio"] * F.when(zero(visible) > 0, upto(chars / zero(visible))).otherwise(0.5)
        + WEIGHTS["title"] * F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, 1.0).otherwise(0.0)
        + WEIGHTS["unique"] * (1 - upto(zero(repeated)))
    )
    capped = F.when(chars < USABLE_CHARS, F.least(score, F.lit(USABLE_CAP))).otherwise(score)
    return F.when((chars == 0) | F.coalesce(shell, F.lit(False)), 0.0).otherwise(upto(capped))


def interstitial(title: Column, text: Column) -> Column:
    """captcha, authentication or blocked for short pages that ask for it, else null."""
    t = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    kind = F.when(t.rlike(CAPTCHA), "captcha").when(t.rlike(AUTH), "authentication").when(t.rlike(BLOCKED), "blocked")
    return F.when(F.length(F.coalesce(text, F.lit(""))) <= INTERSTITIAL_CHARS, kind)


_NOISE_TAGS = {"script", "style", "noscript", "template", "svg", "iframe", "nav", "aside", "footer", "form", "button"}
_BLOCK_TAGS = {"p", "li", "blockquote", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track"}
_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|post|story|entry)(?:[\s_-]|$)", re.I)


class _Page(HTMLParser):
    """Text blocks of each possible container, in one pass over the markup."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int]] = []  # open tags with the number of the container each belongs to
        self.hidden = 0
        self.blocks: list[tuple[tuple[int, ...], str, str]] = []
        self.rank: list[tuple[int, int]] = [(-1, 0)]  # of each container: kind, depth
        self.open: list[int] = [0]
        self.buffer: list[str] = []
        self.tag = "p"
        self.title, self.canonical, self.meta = "", "", {}
        self.in_title = False

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.buffer)).strip()
        if text:
            self.blocks.append((tuple(self.open), self.tag, text))
        self.buffer.clear()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a.get("content", ""))
        if tag == "link" and "canonical" in a.get("rel", "").lower():
            self.canonical = self.canonical or a.get("href", "")
        if tag in _VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        own = -1
        if self.hidden or tag in _NOISE_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ("navigation", "banner", "contentinfo"):
            self.hidden += 1
        else:
            kind = 2 if tag == "article" else 1 if tag == "main" or a.get("role") == "main" or a.get("itemprop") == "articleBody" else 0 if tag in ("div", "section") and _HINT.search(f"{a.get('class', '')} {a.get('id', '')}") else None
            if kind is not None:
                self.flush()
                own = len(self.rank)
                self.rank.append((kind, len(self.path)))
                self.open.append(own)
            if tag in _BLOCK_TAGS or tag in ("div", "section", "br"):
                self.flush()
                self.tag = tag
        self.in_title = self.in_title or tag == "title"
        self.path.append((tag, own))

    def handle_endtag(self, tag):
        if tag not in {t for t, _ in self.path}:
            return
        while self.path:
            t, own = self.path.pop()
            if self.hidden:
                self.hidden -= 1
            elif t in _BLOCK_TAGS or own >= 0:
                self.flush()
                self.tag = "p"
            if own >= 0:
                self.open.remove(own)
            if t == "title":
                self.in_title = False
            if t == tag:
                return

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.buffer.append(data)


def extract_page(markup: str | None) -> dict:
    """Title, canonical link, text, headings, paragraph count and whether a semantic container was found."""
    p = _Page()
    p.feed(markup or "")
    p.close()
    p.flush()
    size: dict[int, int] = {}
    for inside, _, text in p.blocks:
        for c in inside:
            size[c] = size.get(c, 0) + len(text)
    best = max((c for c in size if c), key=lambda c: (size[c], p.rank[c][0], p.rank[c][1]), default=0)
    own = [(tag, text) for inside, tag, text in p.blocks if best in inside]
    heads = [t for tag, t in own if re.fullmatch(r"h[1-6]", tag)]
    first = next((t for tag, t in own if tag == "h1" and len(t) >= 4), "")
    text = "\n\n".join(("- " + t) if tag == "li" else t for tag, t in own)
    return {
        "title": first or p.meta.get("og:title", "") or p.title.strip(),
        "canonical_url": p.canonical or p.meta.get("og:url", ""),
        "article_text": plain_text(text.replace("<", " ")),
        "headings": heads[:40],
        "paragraph_count": sum(tag in ("p", "li", "blockquote", "td", "dd") and len(t.split()) >= 3 for tag, t in own),
        "article_container": p.rank[best][0] > 0,
    }


PAGE = "title string, canonical_url string, article_text string, headings array<string>, paragraph_count int, article_container boolean"


def extract_pages(df: DataFrame, row: str, markup: str) -> DataFrame:
    """(row, extracted fields) of pages in HTML; a null or empty page gives empty fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([extract_page(m) for m in f["markup"]], columns=[c.split()[0] for c in PAGE.split(", ")])
            out.insert(0, row, f["row"].to_numpy())
            yield out

    kind = dict(df.dtypes)[row]
    return df.select(F.col(row).alias("row"), F.col(markup).alias("markup")).mapInPandas(run, f"{row} {kind}, {PAGE}")


#: Growth of a text that counts as a change, in characters and as a share.
GROWTH_CHARS, GROWTH_SHARE = 300, 0.2


def changed_pages(articles: DataFrame) -> DataFrame:
    """(article_id, before, changed): each page fetched again against the fetch before: another content, and another title or length."""
    w = Window.partitionBy("canonical_url").orderBy(F.asc_nulls_first("updated_at"), "article_id")
    n, title = F.length(F.coalesce("article_text", F.lit(""))), F.lower(F.trim(F.coalesce("title", F.lit(""))))
    p = articles.filter("canonical_url is not null").select("canonical_url", "updated_at", "article_id", F.col("content_hash").alias("h"), title.alias("t"), n.alias("n"))
    p = p.select("*", *[F.lag(c).over(w).alias(a) for c, a in (("article_id", "before"), ("h", "ph"), ("t", "pt"), ("n", "pn"))]).filter("before is not null")
    grown = F.abs(F.col("n") - F.col("pn")) > F.greatest(F.lit(float(GROWTH_CHARS)), GROWTH_SHARE * F.col("pn"))
    return p.select("article_id", "before", (~F.col("h").eqNullSafe(F.col("ph")) & ((F.col("t") != F.col("pt")) | grown)).alias("changed"))
