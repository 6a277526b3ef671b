"""Main body of web pages: line-block distribution with surge and dive points.

Markup is stripped, then every line gets a weight: the length of running text, list sentences, command lines and
indicator values; nothing for menus, notices and other furniture, which are told by shape (truncated teasers,
separator-joined menus) and by cue phrases. Weights are summed over a sliding window of lines. The body
lies between the first surge of the sums and the last dive before the page's tail; the headline, named by
the page's title where it is known, opens it. Within the body, furniture lines are left out again.

Lines are numbered from 1 between LF characters of the original text; blank ones count but are never listed.

Defined results: null, empty and blank texts and pages without running text give no line; a null title only means
that the headline is looked for by place; equal pages give equal lines; extra columns are ignored; texts of any length
are taken whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.runtime import BLANKS

#: Lines in a window, the weight that makes a surge, and the lines without weight that a body may hold in a row.
WINDOW, SURGE, GAP = 3, 60, 6

BLANK, TEXT, ITEM, VALUE, SHORT, NOISE, TAIL = range(7)

# Cue phrases of page furniture, whole lines, by language. TAIL_CUES open the part after the body.
TAIL_CUES = [
    # English
    r"related stories", r"you may also like", r"trending now", r"most read", r"comments? ?\(\d+\)", r"leave a comment", r"follow us .*", r"back to top",
    r"all trademarks .*", r"no part of this site .*", r"privacy statement", r"terms of use", r"imprint.*", r"report an error", r"copyright\b.{0,60}\d{4}\.?", r"©.*",
    r"sign up for .{0,60}(digest|newsletter)\.?",
    # German
    r"mehr zum thema", r"meistgelesen", r"kommentare ?\(\d+\)", r"nach oben", r"impressum", r"datenschutzhinweise", r"nutzungsbedingungen", r"fehler melden",
    r"nachdruck .*", r"alle rechte vorbehalten.*",
    # French
    r"à lire aussi", r"les plus lus", r"commentaires ?\(\d+\)", r"haut de page", r"mentions légales", r"vie privée", r"signaler une erreur", r"toute reproduction .*",
    r"conditions d.utilisation", r"reproduction interdite.*",
    # Spanish
    r"también le puede interesar", r"lo más leído", r"comentarios ?\(\d+\)", r"volver arriba", r"aviso legal", r"privacidad", r"condiciones de uso", r"informar de un error",
    r"queda prohibida .*",
]
NOISE_CUES = [
    # English
    r"this site uses cookies\..*", r"we and our \d+ partners .*", r"pick which cookies .*", r"your privacy matters.*", r"consent is needed before .*", r"accept all", r"reject",
    r"manage choices", r"save my selection", r"advertisement", r"sponsored by .{1,60}", r"share this article", r"listen to this story.*", r"\d+ min read", r"posted .{3,40} views",
    r"by (the )?.{1,60}\d{4}", r"by the .{1,60} desk.*", r"image credit:.*", r"photo:.*", r"enjoying this\?.*", r"read also:.*", r"read more.*", r"first!", r"report comment.*",
    r"(last )?updated:? .{0,40}\d{4}.{0,20}", r"subscribe.{0,40}", r"skip to content", r"menu", r"search",
    # German
    r"mit der nutzung dieser seite .*", r"wir verwenden cookies.*", r"ihre auswahl zum datenschutz", r"speichern", r"alle annehmen", r"ablehnen", r"anzeige", r"artikel teilen",
    r"newsletter von .* bestellen\.?", r"lesen sie auch:.*", r"bild: .*", r"foto: .*", r"von der redaktion .*", r"\d+ min(uten)? lesezeit", r"gesponsert .*", r"einstellungen",
    # French
    r"en restant ici, .*", r"nous utilisons des cookies.*", r"vos choix .*", r"enregistrer", r"tout accepter", r"refuser", r"publicité", r"partager l.article",
    r"recevoir la lettre de .*", r"lire aussi ?:.*", r"à lire également ?:.*", r"crédit photo ?:.*", r"photo ?: .*", r"par la rédaction .*", r"\d+ min de lecture",
    # Spanish
    r"si sigue navegando .*", r"usamos cookies .*", r"sus opciones de privacidad", r"guardar", r"aceptar todo", r"rechazar", r"publicidad", r"compartir",
    r"reciba el boletín de .*", r"lea también:.*", r"foto ?: .*", r"imagen: .*", r"redacción de .{1,60}\d{4}", r"\d+ min de lectura",
]
_TAIL = re.compile("|".join(f"(?:{c})" for c in TAIL_CUES), re.I)
_NOISE = re.compile("|".join(f"(?:{c})" for c in NOISE_CUES), re.I)
_COMMENTS = re.compile(r"(?:comments?|kommentare|commentaires|comentarios) ?\(\d+\)", re.I)
_TAGS = re.compile(r"<(?:!--.*?--|/?[a-zA-Z][^<>\n]{0,500})>")
_CUT = re.compile(r"(?:…|\.\.\.|\bread more|\bweiterlesen|\blire la suite|\bseguir leyendo)\s*$", re.I)
_VALUE = re.compile(
    r"(?:\d{1,3}(?:\[?\.\]?|\(\.\))){3}\d{1,3}(?::\d+|/\d+)?|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:hxxps?|https?)://\S+"
    r"|[\w-]+(?:(?:\[\.\]|\(\.\)|\[dot\]|\.)[\w-]+)+(?:/\S*)?|cve-\d{4}-\d{4,}|[\w.+-]+(?:@|\[at\])[\w.-]+(?:\[\.\][\w.-]+)*|t\d{4}(?:\.\d{3})?",
    re.I,
)
_COMMAND = re.compile(r"(?:\$|#|>|PS [A-Z]:\\\S*>|C:\\\S*>)\s+\S.*")
_BULLET = re.compile(r"(?:[-*•‣–]|\d+[.)])\s+(.*)")
_MENU = re.compile(r"\s(?:[|»›>/·•—–]|\s)\s?(?=\S)")
_SENTENCE = re.compile(r"[.!?][\"'”»)]*$")


@lru_cache(maxsize=65_536)
def kind(line: str) -> int:
    """What a line, without outer blanks, looks like on its own."""
    if not line:
        return BLANK
    if _TAIL.fullmatch(line):
        return TAIL
    if _NOISE.fullmatch(line):
        return NOISE
    if _VALUE.fullmatch(line) or _COMMAND.fullmatch(line):
        return VALUE
    if _CUT.search(line):
        return NOISE
    ends = bool(_SENTENCE.search(line))
    if b := _BULLET.fullmatch(line):
        inner = b.group(1)
        if _VALUE.fullmatch(inner) or _COMMAND.fullmatch(inner):
            return ITEM
        return ITEM if ends and inner.count(" ") >= 2 and not line[0].isdigit() else NOISE
    if ends and line.count(" ") >= 5:
        return TEXT
    if len(_MENU.findall(line)) >= 2 and not ends:
        return NOISE
    return SHORT if len(line) <= 160 else TEXT


def titles(title: str | None) -> set[str]:
    """What the headline of a page with this title may read: the title, or its longer part beside the site's name."""
    t = (title or "").strip(BLANKS)
    if not t:
        return set()
    out = {t}
    for sep in re.finditer(r"\s+[-–—|·:»]\s+", t):
        out.add(max(t[: sep.start()], t[sep.end() :], key=len))
    return {x for x in out if x.count(" ") >= 1}


def body_lines(text: str | None, title: str | None) -> list[int]:
    """Numbers of the lines of the main body."""
    if not text:
        return []
    lines = [x.strip(BLANKS) for x in text.split("\n")]
    if "<" in text or "&" in text:
        lines = [html.unescape(_TAGS.sub(" ", x)).strip(BLANKS) for x in lines]
    at = [i for i, x in enumerate(lines) if x]
    kinds = [kind(lines[i]) for i in at]
    n = len(at)
    weight = np.array([len(lines[i]) if k in (TEXT, ITEM) else 20 if k == VALUE else 0 for i, k in zip(at, kinds, strict=True)], dtype=np.int64)
    for j in range(n - 1, -1, -1):  # comments close a page
        if kinds[j] == TAIL and _COMMENTS.fullmatch(lines[at[j]]):
            weight[j:] = 0
    if not weight.any():
        return []
    total = np.cumsum(np.concatenate([[0], weight]))
    ahead = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:-1]  # sum of the window that begins here
    behind = total[1:] - total[np.maximum(np.arange(n) + 1 - WINDOW, 0)]  # and of the one that ends here
    named = titles(title)
    heads = [j for j in range(n) if lines[at[j]] in named and kinds[j] in (SHORT, TEXT)]
    surges = np.flatnonzero((weight > 0) & (ahead >= SURGE))
    if not len(surges):
        return []
    # the headline is the last line that reads like the title before running text
    head, start = None, int(surges[0])
    for s in surges.tolist():
        if fits := [h for h in heads if 0 < s - h <= GAP + 2]:
            head, start = fits[-1], s
            break
    # the dive: on from the surge, while weight comes again within GAP lines and the tail has not begun
    end, j, idle = start, start, 0
    while j < n:
        if kinds[j] == TAIL:
            break
        if weight[j] > 0:
            if behind[j] >= SURGE or kinds[j] in (VALUE, ITEM):
                end = j
            idle = 0
        else:
            idle += 1
            if idle > GAP:
                break
        j += 1
    first = head if head is not None else start
    if head is None:
        for h in range(start - 1, max(-1, start - 5), -1):
            if kinds[h] == SHORT and lines[at[h]].count(" ") >= 2:
                first = h
                break
            if kinds[h] not in (NOISE, SHORT):
                break
    return [at[j] + 1 for j in range(first, end + 1) if kinds[j] in (TEXT, ITEM, VALUE, SHORT) or j == head]


def _pages(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, numbers = [], [], []
            for tbl, row, title, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = body_lines(text, title)
                names += [tbl] * len(found)
                ids += [row] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], schema=schema)

    return run


def main_body(pages: DataFrame) -> DataFrame:
    """(tbl, row_id, title, text) -> (tbl, row_id, line_no) of the lines of each page's main body."""
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("line_no", pa.int32())])
    rows = pages.select("tbl", F.col("row_id").cast("long"), "title", "text").filter("text is not null")
    return rows.mapInArrow(_pages(schema), "tbl string, row_id long, line_no int")
