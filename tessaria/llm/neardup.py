"""Near-duplicate records with small edits: prefixes of rare shingles, inverted lists, short sketches, exact Jaccard.

1. One pass counts, in hashed cells of a fixed number, in how many records shingles occur. The counts
   only order the shingles: rare classes first, then by hash. Any fixed order gives right results; this one keeps
   boilerplate, which a third of all records may share, out of the inverted lists.
2. A second pass writes per record a signature of its shingle set, a sketch of 128 bits, and the prefix of its shingles
   under that order. Records with equal shingle sets form one class.
3. Inverted lists of the prefixes bring class representatives together. Each posting carries the sketch, so a pair is
   judged where it arises and most never leave the task. Lists over ``LIST`` postings are split into blocks that all
   meet pairwise.
4. Pairs whose sketches are within reach are joined with their texts and verified by exact Jaccard over the
   52-bit hashes of their shingles.

Prefixes: records of similarity t share at least t * n shingles of each one's n. So the first n - ceil(t * n) + 1 of both
hold a common one, the smallest they share, whatever the order, the lengths and the places of the edits (prefix filtering).

Defined results: null texts count as empty; texts without a shingle match nothing; rows with equal texts pair
with similarity 1; an empty table gives an empty result; extra columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.llm.words import HASH_BITS, Words, distinct_sorted, mix, packed, parts, shingles
from tessaria.runtime import Save, checked_broadcast, counted, materialize

#: Cells of the document frequencies: a fixed number, so the counts fit the driver and every worker.
CELLS = 1 << 22
CHUNK = 1 << 14
#: Runs of up to this many records are one class; above, each doubling is one.
RARE = 32
#: Shingles of a record up to which its sketch is of parities.
SHORT = 64
#: Chance that the sketches of two longer records at the threshold are taken for too different.
CHANCE = 1e-6
#: Postings that one inverted list holds at most before it is split.
LIST = 1000
#: Pairs judged at once.
PAIRS = 400_000

def joined_text(columns: list[str]) -> Column:
    """The columns joined by blanks, nulls as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _ranks(r: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (classes[_cells(r)].astype(np.uint64) << np.uint64(56)) | (r >> np.uint64(8))


def _cells(v: np.ndarray) -> np.ndarray:
    return (mix(v) >> np.uint64(64 - 22)).astype(np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in parts(size):
        part = batch.slice(a, b - a)
        yield part, Words([x or "" for x in part.column(column).to_pylist()])


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, words in _texts(batch, 0):
                h, _ = distinct_sorted(*shingles(words, size))
                np.add.at(total, _cells(mix(h ^ np.uint64(size))), 1)
        grid = total.reshape(-1, CHUNK)
        for i in np.flatnonzero(grid.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": pa.array([grid[i].astype("<i8").tobytes()], pa.binary())})

    return run


def _classes(rare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of the cells of each chunk, from the sums of its counts; a task holds one array per chunk it meets, of a fixed number."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(x, dtype="<i8")
                held[i] = held[i] + c if i in held else c
        for i, c in held.items():
            grade = np.ceil(np.log2(np.maximum(c / rare, 1) if rare else c + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "classes": pa.array([grade.tobytes()], pa.binary())})

    return run


ORDER = "chunk int, classes binary"


def shingle_order(texts: DataFrame, size: int, rare: int | None = None) -> DataFrame:
    """(chunk, classes): the class of each cell, from the counts over all texts: 0 up to ``rare`` records (RARE), then one per doubling.

    With ``rare`` 0, for counts over a part of the texts, what that part doesn't hold is a class of its own before all others.
    """
    counts = texts.select("text").mapInArrow(_count(size), "chunk int, counts binary")
    return counts.repartition(16, "chunk").mapInArrow(_classes(RARE if rare is None else rare), ORDER)


def broadcast_order(order: DataFrame):
    """The order for all workers: CELLS bytes, whatever the size of the collection."""
    total = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.uint8)
    for r in order.collect():  # CELLS bytes in all
        total[r.chunk] = np.frombuffer(r.classes, dtype=np.uint8)
    return order.sparkSession.sparkContext.broadcast(total.ravel())


SKETCHED = "id long, n int, sig1 long, sig2 long, sketch long, more long, vals array<long>, common array<long>"


def _first_per_text(order: np.ndarray, t: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of elements in this order (by text first), those among the first ``most`` of their text."""
    tt = t[order]
    start = np.searchsorted(tt, np.arange(len(most)))
    return order[np.arange(len(tt)) - start[tt] < most[tt]]


def _least_bits(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of hashes ordered by text and value: in the place of its bin, a bit of the smallest of each bin of a text, else 0."""
    b = h >> np.uint64(58)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
    return np.where(first, (h >> np.uint64(14)) & np.uint64(1), np.uint64(0)) << b


def _bits(h: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of 2 * 64 bits of the texts' distinct shingles, given in order.

    Of a record of up to SHORT shingles, a bit is the parity of one of 128 bins; else, a bit of the smallest shingle of a bin
    (0 of an empty one), 64 bins each under two orders.
    """
    long = (n > SHORT)[t]
    again, of = distinct_sorted(mix(h[long] + np.uint64(3)), t[long])
    parity, half = np.uint64(1) << (h >> np.uint64(58)), (h >> np.uint64(20)) & np.uint64(1)
    out = np.zeros((2, len(n)), dtype=np.uint64)
    for k, (least, lt) in enumerate(((_least_bits(h[long], t[long]), t[long]), (_least_bits(again, of), of))):
        here = ~long & (half == k)
        for mark, mt in ((parity[here], t[here]), (least, lt)):
            if len(mt):
                start = np.flatnonzero(np.append(True, mt[1:] != mt[:-1]))
                out[k, mt[start]] = np.bitwise_xor.reduceat(mark, start)
    return out[0], out[1]


def _lists_of(value: np.ndarray, of: np.ndarray, some: np.ndarray, texts: int) -> pa.ListArray:
    cuts = np.searchsorted(of, np.append(some, texts))
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(value.view(np.int64)))


def _leads(ids: np.ndarray, sig: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the texts at hand with equal shingles, the one of the smallest id; none of those without a shingle."""
    order = np.lexsort((ids, n, sig[1], sig[0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (n[order][1:] != n[order][:-1]) | (sig[:, order][:, 1:] != sig[:, order][:, :-1]).any(axis=0)
    out = np.zeros(len(n), dtype=bool)
    out[order[new]] = True
    return out & (n > 0)


def _sketch(size: int, threshold: float, classes, common_from: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _texts(batch, 1):
                h, t = distinct_sorted(*shingles(words, size))
                n = np.bincount(t, minlength=words.texts)
                some = np.arange(words.texts) if whole else np.flatnonzero(n)
                if not len(some):
                    continue
                full = np.flatnonzero(n)
                sig = np.zeros((2, words.texts), dtype=np.uint64)
                if len(full):
                    start = np.searchsorted(t, full)
                    for k in range(2):
                        sig[k, full] = np.add.reduceat(mix(h + np.uint64(k + 1)), start)
                v = mix(h ^ np.uint64(size))
                order = np.argsort(packed(_ranks(v, classes.value), t))
                kept = _first_per_text(order, t, np.floor((1 - threshold) * n + 1e-9).astype(np.int64) + 1)
                value, of = v[kept], t[kept]  # texts are in order
                common = classes.value[_cells(value)] >= common_from
                bits = [pa.array(b[some].view(np.int64)) for b in (*sig, *_bits(h, t, n))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some)), pa.array(n[some].astype(np.int32)), *bits, _lists_of(value, of, some, words.texts), _lists_of(value[common], of[common], some, words.texts),
                     *([pa.array(_leads(part.column(0).to_numpy(), sig, n)), *part.columns[1:]] if whole else [])],
                    names=["id", "n", "sig1", "sig2", "sketch", "more", "vals", "common", *(["leads", *part.schema.names[1:]] if whole else [])],
                )

    return run


def sketches(texts: DataFrame, size: int, threshold: float, order, carried: str | None = None) -> DataFrame:
    """(id, text) -> one row per record with a shingle: size, signature, sketch and prefix, of which ``common`` may be in over LIST records.

    With ``carried``, the schema of the columns behind id (text first), every record has a row and they go along; ``leads`` then marks, of
    the copies that came up together, the one with the smallest id.
    """
    common_from = next(c for c in range(256) if RARE << c > LIST)
    run = _sketch(size, threshold, order, common_from, carried is not None)
    return texts.mapInArrow(run, SKETCHED + (f", leads boolean, {carried}" if carried else ""))


def _most_differing(threshold: float) -> int:
    """Bits in which sketches of longer records of this similarity differ at most, but for a chance below CHANCE.

    The smallest shingle of a bin of either record is shared with the chance of the similarity; else half of the bits differ.
    """
    p, below = (1 - threshold) / 2, 0.0
    for k in range(128):
        below += comb(128, k) * p**k * (1 - p) ** (128 - k)
        if 1 - below < CHANCE:
            return k
    return 128


def _judge(key: np.ndarray, table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of each list (equal keys lie together) whose union sketch is within reach of the threshold."""
    ids = table.column("id").to_numpy()
    n = table.column("n").to_numpy()
    block = table.column("block").to_numpy()
    old = table.column("old").to_numpy(zero_copy_only=False)
    low, more = table.column("sketch").to_numpy(), table.column("more").to_numpy()
    reach, most = (1 - threshold) / (1 + threshold), _most_differing(threshold)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    later = np.repeat(new + size, size) - np.arange(len(key)) - 1
    upto = np.cumsum(later)
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        m = later[a:b]
        if total := int(m.sum()):
            x = np.repeat(np.arange(a, b), m)
            y = x + 1 + np.arange(total) - np.repeat(np.cumsum(m) - m, m)
            near = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
            near &= (ids[x] != ids[y]) & ~(old[x] & old[y]) & ((block[x] < 0) | (block[x] != block[y]))
            x, y = x[near], y[near]
            differing = np.bitwise_count((low[x] ^ low[y]).view(np.uint64)) + np.bitwise_count((more[x] ^ more[y]).view(np.uint64))
            # a parity that differs is one shingle more that only one of both has; sketches of different kinds tell nothing
            few = differing <= np.where(n[x] <= SHORT, reach * (n[x] + n[y]) + 1e-9, most)
            ok = few | ((n[x] <= SHORT) != (n[y] <= SHORT))
            lo, hi = np.minimum(ids[x[ok]], ids[y[ok]]), np.maximum(ids[x[ok]], ids[y[ok]])
            if len(lo):
                known = old[x[ok]] | old[y[ok]]  # at most one of both; it comes first
                lo, hi = np.where(old[x[ok]], ids[x[ok]], np.where(known, ids[y[ok]], lo)), np.where(old[x[ok]], ids[y[ok]], np.where(known, ids[x[ok]], hi))
                p = np.unique(np.stack([lo, hi, known], axis=1), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pa.array(p[:, 0]), "b": pa.array(p[:, 1]), "old": pa.array(p[:, 2].astype(bool))})
        a = b


def _pair_lists(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, rows = None, [], 0

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield from _judge(table.column("key").to_numpy(), table, threshold)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])  # the last list may go on
            yield from work(table.slice(0, cut))
            rest = table.slice(cut)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def hot_lists(common: DataFrame, save: Save) -> tuple[DataFrame, int]:
    """(key, blocks) of the lists over LIST, written, and their number; ``common`` has a row (key) for each posting whose list may be so long."""
    return save(common.groupBy("key").count().filter(F.col("count") > LIST).select("key", F.ceil(F.col("count") / LIST).cast("int").alias("blocks")), "hot")


def _lists(base: DataFrame, hot: DataFrame, many: int) -> DataFrame:
    """Postings (key, id, n, sketch, more, old) -> (key, id, n, sketch, more, old, block), lists of at most about LIST each.

    A longer list is dealt into blocks, and every two of its blocks meet in a list of their own: each pair of its postings
    stays together once.
    """
    plain = base.select("key", "id", "n", "sketch", "more", "old", F.lit(-1).alias("block"))
    if not many:
        return plain
    hot = checked_broadcast(hot, many)
    plain = plain.join(hot.select("key"), "key", "left_anti")
    split = base.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    split = split.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("block", "meets"), F.greatest("block", "meets")).alias("key"),
        "id", "n", "sketch", "more", "old", F.when(F.col("block") == F.col("meets"), -1).otherwise(F.col("block")).alias("block"),
    )
    return plain.unionByName(split)


def _verify(size: int, threshold: float):
    """Rows (a, b, old, second, text), the two sides of a pair one behind the other -> pairs whose texts are alike enough."""
    f = Fraction(threshold).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 3)])
            before = np.concatenate([keys[:, :1] - 1 if last is None else last, keys[:, :-1]], axis=1)
            last = keys[:, -1:]
            batch = batch.filter(pa.array((keys != before).any(axis=0)))  # an id that texts repeat counts once
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not whole:
                continue
            whole = whole[0]
            even = whole.num_rows // 2 * 2
            rest = whole.slice(even) if even < whole.num_rows else None
            sides = whole.slice(0, even)
            size_of = pc.fill_null(pc.binary_length(sides.column(4)), 0).to_numpy(zero_copy_only=False)
            for i, j in parts(size_of[::2] + size_of[1::2]):
                part = sides.slice(2 * i, 2 * (j - i))
                m = j - i
                words = Words([x or "" for x in part.column(4).to_pylist()])
                h, t = distinct_sorted(*shingles(words, size))
                n = np.bincount(t, minlength=2 * m)
                k = np.sort(packed(h, t >> 1))  # each side's shingles are distinct: equal neighbours are shared ones
                both = np.bincount((k[1:][k[1:] == k[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=m)
                union = n[::2] + n[1::2] - both
                ok = (both * f.denominator >= f.numerator * union) & (union > 0)
                yield part.select([0, 1, 2]).take(pa.array(np.flatnonzero(ok) * 2))

    return run


def postings(docs: DataFrame, old: bool = False) -> DataFrame:
    return docs.select("id", "n", "sketch", "more", F.explode("vals").alias("key"), F.lit(old).alias("old"))


def candidate_pairs(base: DataFrame, hot: DataFrame, many: int, threshold: float) -> DataFrame:
    """(a, b, old), as often as they meet: pairs of the posted records whose sketches are within reach, not both old; a is the old or the
    smaller one. ``hot`` are the many :func:`hot_lists` among them."""
    lists = _lists(base, hot, many).repartition("key").sortWithinPartitions("key")
    return lists.mapInArrow(_pair_lists(threshold), "a long, b long, old boolean")


def within_reach(threshold: float, x: str, y: str) -> str:
    """:func:`_judge`'s condition on columns n, sketch and more of two sides, in generated code."""
    n, m = f"{x}.n", f"{y}.n"
    differing = f"bit_count({x}.sketch ^ {y}.sketch) + bit_count({x}.more ^ {y}.more)"
    reach = (1 - threshold) / (1 + threshold)
    few = f"{differing} <= if({n} <= {SHORT}, {reach!r}D * ({n} + {m}) + 1e-9D, {_most_differing(threshold)})"
    return f"least({n}, {m}) >= {threshold!r}D * greatest({n}, {m}) - 1e-9D and (({n} <= {SHORT}) <> ({m} <= {SHORT}) or {few})"


def verified_pairs(near: DataFrame, many: int, texts: DataFrame, size: int, threshold: float, old_texts: DataFrame | None = None, buckets: int = 0) -> DataFrame:
    """Of at most so many distinct pairs (a, b, old), written already, those whose texts are at least ``threshold`` alike.

    The texts of old sides are looked up in ``old_texts``, if given, which lies in buckets by id and stays there but for the named ones.
    """
    sides = near.select("a", "b", "old", F.explode(F.array(F.struct(F.lit(False).alias("second"), F.col("a").alias("id")), F.struct(F.lit(True).alias("second"), F.col("b").alias("id")))).alias("s"))
    # the texts are read once: where the ids of the pairs are small enough to be sent to them, only the named texts move
    sides = sides.select("a", "b", "old", "s.second", "s.id")
    new = sides if old_texts is None else sides.filter("second or not old")
    named = texts.select("id", "text").join(checked_broadcast(new, 2 * many), "id").select("a", "b", "old", "second", "text")
    if old_texts is not None:
        known = sides.filter("old and not second").repartition(buckets, "id").hint("shuffle_hash")
        named = named.union(old_texts.join(known, "id").select("a", "b", "old", "second", "text"))
    return named.repartition("a", "b").sortWithinPartitions("a", "b", "second").mapInArrow(_verify(size, threshold), "a long, b long, old boolean")


def similar_pairs(base: DataFrame, common: DataFrame, texts: DataFrame, size: int, threshold: float, save: Save = counted) -> DataFrame:
    near, many = save(candidate_pairs(base, *hot_lists(common, save), threshold).distinct(), "near")
    return verified_pairs(near, many, texts, size, threshold) if many else near


def near_duplicates(df: DataFrame, id_column: str, columns: list[str], size: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b) of class representatives, and (id, rep) of the records that have copies.

    A class holds the records with equal shingle sets; its representative is the smallest id. Records without
    copies represent themselves and have no row in ``members``.
    """
    texts = df.select(F.col(id_column).cast("long").alias("id"), joined_text(columns).alias("text")).filter("id is not null")
    docs = materialize(sketches(texts, size, threshold, broadcast_order(shingle_order(texts, size))), "sketches")
    equal = ["sig1", "sig2", "n"]
    copied = docs.groupBy(*equal).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    members = materialize(docs.join(copied, equal).select("id", "rep"), "members")
    single = docs.join(members.filter("id <> rep").select("id"), "id", "left_anti")
    return similar_pairs(postings(single), docs.select(F.explode("common").alias("key")), texts, size, threshold).select("a", "b"), members


def all_pairs(pairs: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows: those of the representatives carried over to all members, and those inside a class."""
    member = lambda c: members.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id"))
    x, y = F.coalesce("a_id", "a"), F.coalesce("b_id", "b")
    across = pairs.join(member("a"), "a", "left").join(member("b"), "b", "left").select(F.least(x, y).alias(a), F.greatest(x, y).alias(b))
    inside = members.select("rep", F.col("id").alias(a)).join(members.select("rep", F.col("id").alias(b)), "rep").filter(F.col(a) < F.col(b)).select(a, b)
    return across.unionByName(inside)
