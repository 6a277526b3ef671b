"""Evaluation texts leaking into training text: q-gram lemma filtering and banded alignment.

Texts are normalised to their words joined by single blanks. The passages' character q-grams form an index that
every worker holds. Each document's q-grams are looked up in it; hits of one document and passage are
counted in overlapping bands of diagonals (document place minus passage place). A stretch of ``need`` words with at
most ``max_edits`` changed words keeps a number of q-grams that the q-gram lemma bounds from below; bands that
reach the bound go on to a banded alignment over words, which decides. With ``max_edits=0`` the alignment asks for
``need`` equal consecutive words, exactly.

The documents are scanned once per block of passages and never shuffled. Passages are sent to the workers in blocks
of a bounded number of characters, so the evaluation set may be of any size.

Defined results: null and empty texts and passages without a word match nothing; passages with fewer than ``need``
words must occur wholly; repeated documents and passages each get their own rows, but no pair comes twice per row; very
long texts are searched whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm.words import Words, mix, parts, powers, prefix_hash

#: Longest q-gram; passages whose shortest stretch is shorter get shorter q-grams.
Q = 16
#: Width of a band of diagonals in characters; bands overlap by half.
BAND = 32
#: Characters of passages that one block sends to the workers.
BLOCK_CHARS = 20_000_000
#: Hits of q-grams expanded at once.
EXPAND = 2_000_000

_BITS = 22


class Normal:
    """Texts as words joined by single blanks, with a prefix hash over the bytes."""

    def __init__(self, texts: list[str]) -> None:
        w = Words(texts)
        self.word_text, self.word_hash = w.text, w.hashes()
        length = w.end - w.start
        keep = w.inside.copy()
        keep[w.end] = True
        data = w.data.copy()
        data[w.end] = 32
        self.data = data[keep]
        self.word_start = np.cumsum(length + 1) - (length + 1)
        self.word_length = length
        first = np.searchsorted(self.word_text, np.arange(w.texts + 1))
        self.first_word = first
        at = np.append(self.word_start, len(self.data))
        self.first_char = at[first]
        self.prefix = prefix_hash(self.data)

    def grams(self, q: int) -> np.ndarray:
        n = len(self.data) - q + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        _, down = powers(len(self.data) + 1)
        return mix((self.prefix[q:] - self.prefix[:n]) * down[:n])


class Index:
    """q-grams of the passages, by q; and what the lemma asks of each passage."""

    def __init__(self, passages: list[str], need: int, max_edits: int) -> None:
        self.normal = n = Normal(passages)
        self.need, self.max_edits = need, max_edits
        self.wanted = np.minimum(np.diff(n.first_word), need)
        shortest = np.zeros(len(passages), dtype=np.int64)
        longest_word = np.zeros(len(passages), dtype=np.int64)
        for i in range(len(passages)):
            a, b = n.first_word[i], n.first_word[i + 1]
            k = self.wanted[i]
            if k:
                starts, lengths = n.word_start[a:b], n.word_length[a:b]
                shortest[i] = (starts[k - 1 :] + lengths[k - 1 :] - starts[: b - a - k + 1]).min()
                longest_word[i] = lengths.max() + 1
        # a changed word spoils at most its own characters' q-grams and the q - 1 before
        self.by_q: dict[int, tuple] = {}
        fit = np.maximum(1, (shortest - max_edits * longest_word) // (max_edits + 1))
        q_of = np.where(shortest > 0, np.minimum(Q, fit), 0)
        q_of = np.where((q_of < Q) & (q_of > 8), 8, np.where((q_of < 8) & (q_of > 4), 4, np.where((q_of < 4) & (q_of > 1), 1, q_of)))
        self.least = np.maximum(1, shortest - q_of + 1 - max_edits * (q_of - 1 + longest_word))
        for q in sorted(set(q_of.tolist()) - {0}):
            items = np.flatnonzero(q_of == q)
            grams = n.grams(q)
            hashes, item, place = [], [], []
            for i in items:
                a, b = n.first_char[i], n.first_char[i + 1] - 1  # the last blank belongs to no passage
                if b - a >= q:
                    hashes.append(grams[a : b - q + 1])
                    item.append(np.full(b - a - q + 1, i))
                    place.append(np.arange(b - a - q + 1))
            if hashes:
                h, i, p = map(np.concatenate, (hashes, item, place))
                order = np.argsort(h, kind="stable")
                h, i, p = h[order], i[order], p[order]
                distinct, first = np.unique(h, return_index=True)
                bits = np.zeros(1 << _BITS, dtype=bool)
                bits[distinct >> np.uint64(64 - _BITS)] = True
                self.by_q[q] = (distinct, np.append(first, len(h)), i, p, bits)

    def candidates(self, docs: Normal, grams_of: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, passage, lowest and highest diagonal) of bands that reach the lemma's bound."""
        n_items = len(self.wanted)
        for q, (distinct, first, item, place, bits) in self.by_q.items():
            grams = grams_of.setdefault(q, docs.grams(q)) if q not in grams_of else grams_of[q]
            at = np.flatnonzero(bits[grams >> np.uint64(64 - _BITS)])
            k = np.searchsorted(distinct, grams[at])
            real = (k < len(distinct)) & (distinct[np.minimum(k, len(distinct) - 1)] == grams[at])
            at, k = at[real], k[real]
            doc = np.searchsorted(docs.first_char, at, side="right") - 1
            whole = at + q <= docs.first_char[doc + 1]
            at, k, doc = at[whole], k[whole], doc[whole]
            many = first[k + 1] - first[k]
            counts: dict[tuple[int, int, int], int] = {}
            cut = np.searchsorted(np.cumsum(many), np.arange(EXPAND, int(many.sum()) + EXPAND, EXPAND))
            a = 0
            for b in [*(cut + 1).tolist(), len(at)]:
                b = min(b, len(at))
                if a >= b:
                    continue
                m = many[a:b]
                run = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                e = np.repeat(first[k[a:b]], m) + run
                d = np.repeat(at[a:b] - docs.first_char[doc[a:b]], m) - place[e]
                pair = np.repeat(doc[a:b], m) * n_items + item[e]
                half = d // (BAND // 2)
                pair2, band2 = np.concatenate([pair, pair]), np.concatenate([half, half - 1])
                order = np.lexsort((band2, pair2))
                pair2, band2 = pair2[order], band2[order]
                new = np.flatnonzero(np.append(True, (pair2[1:] != pair2[:-1]) | (band2[1:] != band2[:-1])))
                size = np.diff(np.append(new, len(pair2)))
                if a == 0 and b == len(at):  # all in one go: only what reaches the bound needs a look
                    ok = size >= self.least[pair2[new] % n_items]
                    new, size = new[ok], size[ok]
                for p, w, c in zip(pair2[new].tolist(), band2[new].tolist(), size.tolist(), strict=True):
                    counts[p, w] = counts.get((p, w), 0) + c
                a = b
            for (p, w), c in counts.items():
                if c >= self.least[p % n_items]:
                    lo = w * (BAND // 2)
                    yield p // n_items, p % n_items, lo, lo + BAND - 1

    def aligned(self, docs: Normal, doc: int, item: int, lo: int, hi: int) -> bool:
        """Whether ``wanted`` words of the passage align within the band with at most ``max_edits`` word edits."""
        a, b = docs.first_word[doc], docs.first_word[doc + 1]
        p, r = self.normal.first_word[item], self.normal.first_word[item + 1]
        chars = docs.word_start[a:b] - docs.first_char[doc]
        own = self.normal.word_start[p:r] - self.normal.first_char[item]
        slack = self.max_edits * (1 + int(max(docs.word_length[a:b].max(), self.normal.word_length[p:r].max()))) if b > a and r > p else 0
        left = np.searchsorted(chars, own + lo - slack)
        right = np.searchsorted(chars, own + hi + slack, side="right")
        d, w = docs.word_hash[a:b], self.normal.word_hash[p:r]
        best: list[dict[int, int]] = [{} for _ in range(self.max_edits + 1)]
        goal = int(self.wanted[item])
        for i in range(len(w)):
            now: list[dict[int, int]] = [{} for _ in range(self.max_edits + 1)]
            for j in range(int(left[i]), int(right[i])):
                for e in range(self.max_edits + 1):
                    v = best[e].get(j - 1, 0) + 1 if d[j] == w[i] else 0
                    if e:
                        v = max(v, best[e - 1].get(j - 1, 0) + 1, best[e - 1].get(j, 0) + 1, now[e - 1].get(j - 1, 0))
                    now[e][j] = v
                    if v >= goal:
                        return True
            best = now
        return False


def _search(id_type: pa.DataType, item_type: pa.DataType, ids: list, index_of):
    schema = pa.schema([("doc_id", id_type), ("eval_id", item_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in parts(size):
                part = batch.slice(a, b - a)
                docs = Normal([t or "" for t in part.column(1).to_pylist()])
                found, tested = set(), set()
                for doc, item, lo, hi in index.candidates(docs, {}):
                    if (doc, item) not in found and (doc, item, lo) not in tested:
                        tested.add((doc, item, lo))
                        if index.aligned(docs, doc, item, lo, hi):
                            found.add((doc, item))
                if found:
                    pairs = sorted(found)
                    rows = part.column(0).take(pa.array([d for d, _ in pairs]))
                    yield pa.RecordBatch.from_arrays([rows, pa.array([ids[i] for _, i in pairs], item_type)], schema=schema)

    return run


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", passage: str = "passage",
    need: int = 10, max_edits: int = 0, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, eval_id) of documents that hold ``need`` consecutive words of a passage, or all of a shorter one."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("eval_id"), F.col(passage).cast("string").alias("passage")).filter("passage is not null and eval_id is not null")
    chars = wanted.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    out = None
    for k in range(blocks):
        # bounded: block_chars characters on average
        rows = wanted.filter(F.pmod(F.xxhash64("eval_id", "passage"), F.lit(blocks)) == k).collect() if blocks > 1 else wanted.collect()
        shared = spark.sparkContext.broadcast({"passages": [r.passage for r in rows]})

        def index_of(shared=shared):
            held = shared.value  # one object for all tasks of a worker, which keeps the index with it
            if "index" not in held:
                held["index"] = Index(held["passages"], need, max_edits)
            return held["index"]

        found = docs.mapInArrow(_search(pa.int64(), pa.int64(), [r.eval_id for r in rows], index_of), "doc_id long, eval_id long")
        out = found if out is None else out.unionByName(found)
    return out
