"""Encoding of a corpus with a byte-level BPE vocabulary, pre-tokenised without regex.

Per Arrow batch, all texts lie in one array of code points. Each code point gets a symbol (letter, number,
white space, other, and a few that look one or two places ahead: the last white space before a word, the
apostrophe that opens a contraction). An automaton over these symbols says where a piece begins. Its
transition functions are composed by a blocked associative scan: all blocks are folded side by side, block
functions are combined, and the states inside the blocks follow from their entry states. The boundary slices
are looked up by their bytes in a cache of merged pieces; only unseen pieces go through pair merging. With
``offsets=True`` the code point at which each token's piece starts is kept beside the ids.

Defined results: null and empty texts give an empty list; every code point sequence encodes, lone
surrogates as the replacement character; equal texts give equal ids; extra columns are ignored; texts of any
length are encoded whole (long batches are worked off in parts, each holding whole texts).
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of the operator.
VOCABULARIES = "/opt/tokenizers"

# Symbols of the automaton.
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_BEFORE, BLANK_BEFORE, SHORT, LONG, END = range(9)
# States: nothing open, in letters, in numbers, in others, in white space, after an attached space, one or two
# letters of a contraction to come.
START, IN_L, IN_N, IN_O, IN_S, ATTACHED, ONE, TWO = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next_state[symbol, state] and begins[symbol, state]: whether a piece begins at this code point."""
    nxt, begins = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=bool)
    for symbol, own in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        nxt[symbol] = own
        begins[symbol, [own, ATTACHED]] = False
    nxt[LETTER, TWO], nxt[LETTER, ONE] = ONE, START
    begins[LETTER, [ONE, TWO]] = False
    nxt[SPACE_RUN] = IN_S
    begins[SPACE_RUN, IN_S] = False
    nxt[SPACE_BEFORE] = ATTACHED
    nxt[BLANK_BEFORE] = START
    for symbol, own in ((SHORT, ONE), (LONG, TWO)):
        nxt[symbol] = own
        nxt[symbol, [IN_O, ATTACHED]] = IN_O
        begins[symbol, [IN_O, ATTACHED]] = False
    nxt[END] = START
    return nxt, begins


NEXT, BEGINS = _automaton()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (3) or other."""
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = NUMBER
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = 3
    return table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of the code points; ``ends`` are the places of separators between texts."""
    n = len(points)
    kind = _classes()[points]
    kind[ends] = END
    nxt = np.append(kind[1:], np.uint8(END))
    last = (kind == 3) & (nxt != 3) & (nxt != END)  # white space right before something else
    out = kind.copy()
    out[kind == 3] = SPACE_RUN
    out[last] = np.where(points[last] == 32, SPACE_BEFORE, BLANK_BEFORE)
    q = np.flatnonzero((points == 39) & (kind == OTHER))
    if len(q):
        a = points[np.minimum(q + 1, n - 1)]
        b = points[np.minimum(q + 2, n - 1)]
        a, b = np.where(q + 1 < n, a, 0), np.where(q + 2 < n, b, 0)
        o = lambda *x: [ord(c) for c in x]
        out[q[np.isin(a, o("s", "t", "m", "d"))]] = SHORT
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[q[two]] = LONG
    return out


def states_before(symbol: np.ndarray, width: int = 64) -> np.ndarray:
    """State of the automaton before each symbol, from START, by a blocked scan of transition functions."""
    n = len(symbol)
    if n <= width:
        out, s = np.empty(n, dtype=np.uint8), START
        for i, x in enumerate(symbol.tolist()):
            out[i] = s
            s = NEXT[x, s]
        return out
    blocks = -(-n // width)
    grid = np.full(blocks * width, OTHER, dtype=np.uint8)
    grid[:n] = symbol
    columns = np.ascontiguousarray(grid.reshape(blocks, width).T)
    flat = NEXT.ravel()
    # fold: the function of each block, for all entry states
    fold = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8)).copy()
    for column in columns:
        fold = flat[(column[:, None] << 3) + fold]
    entry = _entries(fold)
    out = np.empty((width, blocks), dtype=np.uint8)
    for i, column in enumerate(columns):
        out[i] = entry
        entry = flat[(column << 3) + entry]
    return np.ascontiguousarray(out.T).ravel()[:n]


def _entries(fold: np.ndarray) -> np.ndarray:
    """Exclusive associative scan of block functions, applied to START (doubling steps)."""
    scan = fold
    step = 1
    while step < len(scan):
        later = np.take_along_axis(scan[step:], scan[:-step], axis=1)  # later after earlier
        scan = np.concatenate([scan[:step], later])
        step *= 2
    return np.concatenate([np.array([START], dtype=np.uint8), scan[:-1, START]])


def boundaries(text_points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where a piece begins, separators included (each is a piece of its own)."""
    s = symbols(text_points, ends)
    return np.flatnonzero(BEGINS.ravel()[(s.astype(np.int64) << 3) + states_before(s)])


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and a cache of merged pieces."""

    #: Pieces kept merged per worker; beyond it the cache starts anew (it changes speed, not results).
    CACHE = 400_000

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.starts = [0]

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the pair with the lowest rank is merged first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 400:
            return self._merge_long(piece)
        pair = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 30:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i > 0:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for very long pieces, with a heap over a linked list."""
        import heapq

        n, ranks = len(piece), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == e):
                continue
            end[i], after[i], alive[j] = e, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, after[i], end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, i, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def add(self, piece: bytes) -> int:
        """Index of a piece in the cache, merged if it's new."""
        k = self.seen.get(piece)
        if k is None:
            ids = self.merge(piece)
            a = self.starts[-1]
            while a + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[a : a + len(ids)] = ids
            self.starts.append(a + len(ids))
            k = self.seen[piece] = len(self.starts) - 2
        return k

    def lookup(self, data: bytes, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the slices data[at:to] one after another, and the number of tokens of each."""
        if len(self.seen) > self.CACHE:
            self._reset()
        add, get = self.add, self.seen.get
        keys = [data[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)]
        index = np.fromiter((k if (k := get(p)) is not None else add(p) for p in keys), dtype=np.int64, count=len(keys))
        starts = np.array(self.starts, dtype=np.int64)
        first, many = starts[index], starts[index + 1] - starts[index]
        total = int(many.sum())
        run = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        return self.ids[np.repeat(first, many) + run], many


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, the number of tokens of each text, and for each token the code
    point of its text at which its piece starts."""
    joined = "\n".join(texts) + "\n"
    raw = joined.encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype="<u4")
    if ((points >= 0xD800) & (points < 0xE000)).any():
        points = np.where((points >= 0xD800) & (points < 0xE000), 0xFFFD, points).astype("<u4")
        joined = points.tobytes().decode("utf-32-le")
    ends = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64) + 1) - 1
    begin = boundaries(points, ends)
    data = joined.encode()
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(wide)])
    is_end = np.zeros(len(points), dtype=bool)
    is_end[ends] = True
    stop = np.append(begin[1:], len(points))
    keep = ~is_end[begin]
    ids, many = vocab.lookup(data, offset[begin[keep]], offset[stop[keep]])
    owner = np.searchsorted(ends, begin[keep])
    first = np.concatenate([[0], ends[:-1] + 1])
    places = np.repeat(begin[keep] - first[owner], many)
    return ids, np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64), places.astype(np.int32)


#: Code points worked off at once.
PART = 2_000_000


def _encoder(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            tokens, many, places = encode_texts(texts, vocab)
            cuts = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32()), type=schema.field(1).type) for x in (tokens, places)]
            return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), *lists[: len(schema) - 1]], schema=schema)

        for batch in batches:
            held, texts, chars = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(i)
                texts.append(t or "")
                chars += len(texts[-1])
                if chars > PART:
                    yield flush(held, texts)
                    held, texts, chars = [], [], 0
            if held:
                yield flush(held, texts)

    return run


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, starts array<int>]) of every row; the vocabulary must lie at this path on all executors."""
    rows = df.select(F.col(id_column).cast("long").alias(id_column), F.col(text).cast("string").alias("text"))
    kept = ["ids", "starts"][: 1 + offsets]
    schema = pa.schema([pa.field(id_column, pa.int64()), *(pa.field(c, pa.list_(pa.field("element", pa.int32()))) for c in kept)])
    out = ", ".join([f"{id_column} long", *(f"{c} array<int>" for c in kept)])
    return rows.mapInArrow(_encoder(os.path.join(folder, f"{name}.tiktoken"), schema), out)


def decode(ids: list[int], vocab: Vocabulary) -> str:
    back = {v: k for k, v in vocab.ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
