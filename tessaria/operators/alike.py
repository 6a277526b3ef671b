"""Pairs of alike token sets: prefix filtering with prefixes for each pair of lengths, judged exactly where the sets meet.

Sets travel once per token of their prefix, as short ids; pairs are counted, never moved, until they are known to be alike. So the
bytes shuffled and written follow the sets, however many of their pairs share a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.runtime import checked_broadcast, counted, materialize

#: Sets of one group and token up to which they meet in one task; more are split, and every two of the parts meet.
PART = 10_000
#: Pairs judged at once, and postings from which a task begins to judge.
PAIRS, HELD = 400_000, 50_000

POSTING = ["token", "grp", "block", "row", "ids", "bucket", "first", "last", "again"]


def ordered_sets(sets: DataFrame, row: str = "row", tokens: str = "tokens") -> DataFrame:
    """(row, ids): the tokens of each set as numbers, the rarest first; rows are distinct, and so are the tokens of a row."""
    each = sets.select(F.col(row).alias("row"), F.explode(tokens).alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n")).repartitionByRange("n", "token").sortWithinPartitions("n", "token")
    ids, many = counted(often.select("token", F.monotonically_increasing_id().alias("id")), "tokens")
    return materialize(each.join(checked_broadcast(ids, many), "token").groupBy("row").agg(F.array_sort(F.collect_list("id")).alias("ids")), "sets")


def kept(n: Column, threshold: float) -> Column:
    """How many of its n rarest tokens a set is met by: it shares one of them with each set alike; 0 where no other length or set can be."""
    shorter = F.ceil(n * threshold - 1e-9)
    return F.when((shorter < n) | ((n + 1) * threshold - 1e-9 <= n), n - shorter + 1).otherwise(0).cast("int")


def alike(sets: DataFrame, threshold: float, near: int = 0) -> DataFrame:
    """(a, b, score): rows of different sets that are alike by ``threshold``, each once per group, in no order.

    ``sets``: (row, ids, grp, bucket, first, last, again). Rows meet inside of ``grp`` only, in the same bucket, or in buckets one apart
    with at most ``near`` from the last of the earlier one to the first of the later one; of two rows marked ``again`` nothing is known.
    """
    posted = sets.select(F.explode(F.slice("ids", F.lit(1), kept(F.size("ids"), threshold))).alias("token"), "grp", F.lit(-1).alias("block"), *POSTING[3:])
    hot, many = counted(posted.groupBy("token", "grp").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1"), "hot")
    if many:
        hot = checked_broadcast(hot, many)
        split = posted.drop("block").join(hot, ["token", "grp"]).withColumn("part", F.pmod(F.xxhash64("row", "bucket"), "parts").cast("int"))
        split = split.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = split.withColumn("grp", F.xxhash64("grp", F.least("part", "meets"), F.greatest("part", "meets"))).withColumn("block", F.when(F.col("part") == F.col("meets"), -1).otherwise(F.col("part")))
        posted = posted.join(hot, ["token", "grp"], "left_anti").select(*POSTING).union(split.select(*POSTING))
    kind = sets.schema["row"].dataType.simpleString()
    return posted.repartition("token", "grp").sortWithinPartitions("token", "grp").mapInArrow(_alike(threshold, near), f"a {kind}, b {kind}, score double")


def _alike(threshold: float, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_begins(table))[-1])  # the last group may go on
            yield from _judge(table.slice(0, cut), threshold, near)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield from _judge(pa.Table.from_batches(held), threshold, near)

    return run


def _begins(table: pa.Table) -> np.ndarray:
    """Where a group of sets with one token begins."""
    token, group = (table.column(c).to_numpy() for c in ("token", "grp"))
    return np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1]))


def _sketches(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per set the parities of 64 bins of its tokens: bits that differ are at most as many as tokens that only one of two sets has."""
    bin_of = (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return np.bitwise_xor.reduceat(np.uint64(1) << bin_of, start)


def _judge(table: pa.Table, threshold: float, near: int) -> Iterator[pa.RecordBatch]:
    new = _begins(table) if table.num_rows else np.zeros(0, dtype=bool)
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(several):
        return
    table, group = table.take(pa.array(several)).combine_chunks(), group[several]
    lists = pa.concat_arrays(table.column("ids").chunks)
    start, value = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy()
    n = np.diff(np.append(start, len(value)))
    token = table.column("token").to_numpy()
    names, code = np.unique(np.concatenate([value, token]), return_inverse=True)  # ordered as the tokens are
    code, meets = code[: len(value)], code[len(value) :]
    place = np.flatnonzero(code == np.repeat(meets, n)) - start  # of the token they meet by, in each set
    order = np.lexsort((place, n, group))
    widest = int(n.max())
    # groups, then lengths, then places: the sets of one length that a set is compared with lie together
    line = ((group * (widest + 1) + n) * (widest + 1) + place)[order]
    sketch = _sketches(value, start)[order]
    group, n, place, meets, start = (x[order] for x in (group, n, place, meets, start))
    block, bucket, first, last = (table.column(c).to_numpy()[order] for c in ("block", "bucket", "first", "last"))
    again = table.column("again").to_numpy()[order]
    row = table.column("row").combine_chunks()
    row = (pa.concat_arrays(row.chunks) if isinstance(row, pa.ChunkedArray) else row).take(pa.array(order))

    for longer in range(int(np.floor(widest / threshold + 1e-9)) - widest + 1):
        shared = np.ceil((threshold * (2 * n + longer) - 1e-9) / (1 + threshold)).astype(np.int64)  # least number of common tokens
        x = np.flatnonzero((shared <= n - (longer == 0)) & (place <= n - shared) & (n + longer <= widest))
        at = (group[x] * (widest + 1) + n[x] + longer) * (widest + 1)
        begin = x + 1 if not longer else np.searchsorted(line, at)
        many = np.maximum(np.searchsorted(line, at + n[x] + longer - shared[x], side="right") - begin, 0)
        upto = np.cumsum(many)
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, side="right")))
            m = many[i:j]
            p = np.repeat(x[i:j], m)
            q = np.repeat(begin[i:j] - (np.cumsum(m) - m), m) + np.arange(len(p))
            i = j
            few = np.bitwise_count(sketch[p] ^ sketch[q]) <= 2 * (n[p] - shared[p]) + longer
            p, q = p[few], q[few]
            lower = bucket[p] <= bucket[q]
            gap = np.where(lower, first[q] - last[p], first[p] - last[q])
            apart = np.abs(bucket[p] - bucket[q])
            ok = ((apart == 0) | (apart == 1) & (gap <= near)) & ~(again[p] & again[q]) & ((block[p] < 0) | (block[p] != block[q]))
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            both, lead = _common(code, start, n, p, q, len(names))
            # each pair counts at the first token that both have, and equal sets are no pair
            ok = (both >= shared[p]) & (lead == meets[p]) & (both < n[q])
            p, q, both = p[ok], q[ok], both[ok]
            if len(p):
                yield pa.RecordBatch.from_arrays([row.take(pa.array(p)), row.take(pa.array(q)), pa.array(both / (n[p] + n[q] - both))], names=["a", "b", "score"])


def _common(code: np.ndarray, start: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sets, the number of common tokens and the first of them (-1 without one)."""
    side = np.concatenate([p, q])
    pair = np.repeat(np.tile(np.arange(len(p)), 2), n[side])
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n[side]) - n[side], n[side]) + np.repeat(start[side], n[side])
    mixed = np.sort(pair * codes + code[at])
    mixed = mixed[1:][mixed[1:] == mixed[:-1]]  # the tokens of a set are distinct: equal neighbours are common
    of = mixed // codes
    lead = np.full(len(p), -1, dtype=np.int64)
    new = np.append(True, of[1:] != of[:-1])[: len(of)]
    lead[of[new]] = mixed[new] % codes
    return np.bincount(of, minlength=len(p)), lead
