"""Deduplicating new batches against all history.

A store in the shared folder holds what was accepted so far: the values posted of each row (its exact key, the signature of its
content, its fingerprints: the prefix of the text's shingles, see :mod:`tessaria.llm.neardup`), dealt into buckets by value; the texts for
verification, in buckets by id; beside them, partitioned Bloom filters over all these values, and the order of shingles, counted over the first batch and kept from
then on. A batch goes through these steps:

1. Prescreen. The values of the batch travel to their filter's partition, behind the filter itself. Values that the
   filter doesn't know and that only one row of the batch has are done: nothing of the history is read for them.
   The same pass adds the values to the filter.
2. Lookup. Possible members go to the bucket of their value, where the store's postings lie; those never move, but for the postings of
   values that very many rows of the batch have. Shared keys and signatures are repeats at once; shared fingerprints bring up pairs of a new
   row with an accepted one or with another new row, which are judged by their sketches where they meet and verified by exact Jaccard over the whole texts.
3. Decision. Rows that repeat an accepted row of the history are decided. Among the others, rows are taken in order of id and
   accepted unless they repeat an accepted one: in one task while they are few, else in rounds over the cluster.
4. Update. The accepted rows and the filters become part of the store by one small file, which
   is written last: a batch is in the store whole or not at all, and a batch that is already there is not admitted again.

The history is never fingerprinted, counted or compared again, and a later batch is never looked at. Rows with equal
contents count once until the decision, so groups of copies cost as much as one row each.

Filters are scalable: a partition has layers of ``FILTER_BITS`` bits, of which the last one is open. It is closed at ``CAPACITY``
entries and never rewritten; then another is opened. So the share of false positives stays as it is while the history grows.

Defined results: a null or blank key and a text without a shingle match nothing; ids decide ties; a repeated id counts
once; an empty batch changes nothing; texts of any length are used whole; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.neardup import ORDER, broadcast_order, candidate_pairs, hot_lists, shingle_order, sketches, verified_pairs, within_reach
from tessaria.llm.words import mix
from tessaria.runtime import Save, checked_broadcast, delete_path, fresh_path, get_files, put_file, read_buckets, save, write_buckets

#: Partitions of the Bloom filters (the default of a store), bits of a layer, and the entries that close it (about 1 % false positives).
FILTER_PARTS, FILTER_BITS, CAPACITY = 8, 1 << 21, 200_000
FILTER_HASHES = 5
#: Buckets of the postings and of the texts (the default of a store).
BUCKETS = 12
#: Rows and pairs that one task decides; beyond, the cluster decides in rounds.
RESOLVE_ROWS = 1_000_000

#: Kinds of values: exact keys, signatures of whole texts, fingerprints; and of a line that holds a pair.
KEY, SIGNATURE, SHINGLE, PAIR = 0, 1, 2, 3
POSTING = "v long, kind int, id long, n int, a long, b long, s long"
POSTING_COLUMNS = ["v", "kind", "id", "n", "a", "b", "s"]
SCREENED = f"{POSTING}, dup boolean, known boolean, part int, layer int, entries long, bits binary, what int"
#: What a row of a screened batch is: the open layer of a filter, a layer just closed, or a posting.
OPEN, CLOSED, VALUE = 0, 1, 2


def _places(v: np.ndarray) -> np.ndarray:
    x = mix(v.view(np.uint64) + np.uint64(0x51ED270B))
    y = mix(x) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * y) & np.uint64(FILTER_BITS - 1) for i in range(FILTER_HASHES)]).astype(np.int64)


class _Filter:
    """The layers of one partition: those of the store for the question, a copy of the last for what comes in."""

    def __init__(self, part: int) -> None:
        self.part, self.layers, self.fresh, self.entries, self.done = part, {}, None, 0, []
        self.number = 0

    def load(self, layer: int, bits: bytes, entries: int) -> None:
        self.layers[layer] = np.frombuffer(bits, dtype=np.uint8)
        if layer >= self.number:
            self.number, self.entries = layer, entries

    def holds(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(places.shape[1], dtype=bool)
        for bits in self.layers.values():
            out |= ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)
        return out

    def add(self, places: np.ndarray) -> None:
        if not places.shape[1]:
            return
        if self.fresh is None:
            full = self.entries >= CAPACITY
            self.fresh = self.layers[self.number].copy() if self.number in self.layers and not full else np.zeros(FILTER_BITS // 8, dtype=np.uint8)
            if full:
                self.number, self.entries = self.number + 1, 0
        np.bitwise_or.at(self.fresh, (places >> 3).ravel(), np.left_shift(np.uint8(1), (places & 7).astype(np.uint8)).ravel())
        self.entries += places.shape[1]
        if self.entries >= CAPACITY:
            self.done.append((self.number, self.fresh, self.entries, CLOSED))
            self.number, self.entries, self.fresh = self.number + 1, 0, None

    def changed(self) -> list[tuple[int, np.ndarray, int, int]]:
        bits = self.fresh if self.fresh is not None else self.layers.get(self.number) if self.entries < CAPACITY else None
        return self.done + ([(self.number, bits, self.entries, OPEN)] if bits is not None else [])


def _screened(rows: int, /, **columns) -> pa.RecordBatch:
    schema = {"v": pa.int64(), "kind": pa.int32(), "id": pa.int64(), "n": pa.int32(), "a": pa.int64(), "b": pa.int64(), "s": pa.int64(), "dup": pa.bool_(), "known": pa.bool_(), "part": pa.int32(), "layer": pa.int32(), "entries": pa.int64(), "bits": pa.binary(), "what": pa.int32()}
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in schema.items()], names=list(schema))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (posting, part, layer, entries, bits), by partition, its layers first, then its values in order -> the values that the
    filter may know or that several rows have, and the filter with all values added."""
    now: _Filter | None = None
    held: pa.RecordBatch | None = None  # the last value so far, while no second row has it
    last: int | None = None
    text: np.ndarray | None = None

    def layers() -> Iterator[pa.RecordBatch]:
        if now is not None and (out := now.changed()):
            yield _screened(len(out), part=[now.part] * len(out), layer=[x[0] for x in out], bits=[x[1].tobytes() for x in out], entries=[x[2] for x in out], what=[x[3] for x in out])

    def single() -> Iterator[pa.RecordBatch]:
        if held is not None:
            yield from shown(held, np.zeros(1, dtype=bool))

    def shown(rows: pa.RecordBatch, dup: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = rows.column("v").to_numpy()
        places = _places(v)
        known = now.holds(places)
        first = np.append(True, v[1:] != v[:-1])
        now.add(places[:, ~known & first])
        if len(at := np.flatnonzero(known | dup)):
            some = rows.take(pa.array(at))
            columns = {c: some.column(c) for c in POSTING_COLUMNS}
            yield _screened(len(at), **columns, dup=pa.array(dup[at]), known=pa.array(known[at]), what=[VALUE] * len(at))

    for batch in batches:
        part = batch.column("part").to_numpy()
        for cut in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            if not len(cut):
                continue
            rows = batch.slice(int(cut[0]), len(cut))
            if now is None or part[cut[0]] != now.part:
                yield from single()
                yield from layers()
                now, held, last, text = _Filter(int(part[cut[0]])), None, None, None
            for r in rows.filter(rows.column("layer").is_valid()).select(["layer", "bits", "entries"]).to_pylist():
                now.load(r["layer"], r["bits"], r["entries"])
            rows = rows.filter(rows.column("layer").is_null())
            if not rows.num_rows:
                continue
            # of copies that came up in several places, the first one stands for all
            own = np.stack([rows.column(c).to_numpy() for c in ("v", "s", "kind")])
            before = np.concatenate([own[:, :1] - 1 if text is None else text, own[:, :-1]], axis=1)
            text = own[:, -1:]
            keep = (own[2] != SHINGLE) | (own != before).any(axis=0)
            rows = rows.filter(pa.array(keep))
            if not rows.num_rows:
                continue
            v = rows.column("v").to_numpy()
            if held is not None:
                if v[0] == last:
                    yield from shown(held, np.ones(1, dtype=bool))
                else:
                    yield from single()
                held = None
            same = v[1:] == v[:-1]
            dup = np.append(v[:1] == (v[0] - 1 if last is None else last), same) | np.append(same, False)
            last = int(v[-1])
            if not dup[-1]:
                held = rows.slice(len(v) - 1, 1)
                rows, dup = rows.slice(0, len(v) - 1), dup[:-1]
            if rows.num_rows:
                yield from shown(rows, dup)
    yield from single()
    yield from layers()


def _posted(docs: DataFrame, leads: str) -> DataFrame:
    """Postings of rows (id, key, n, sig1, sig2, sketch, more, vals): of the key, where there is one, of a text's signature, and of the
    fingerprints of rows that lead. Three plain scans, each of its own columns only and generated code throughout."""
    of_key = docs.filter("key is not null").selectExpr("xxhash64('key', key) v", f"{KEY} kind", "id", "0 n", "xxhash64(key, 'again') a", "0L b", "0L s")
    of_signature = docs.filter("n > 0").selectExpr("xxhash64('text', sig1, n) v", f"{SIGNATURE} kind", "id", "n", "sig1 a", "sig2 b", "0L s")
    of_text = docs.filter(leads).selectExpr("explode(vals) v", f"{SHINGLE} kind", "id", "n", "sketch a", "more b", "sig1 s")
    return of_key.union(of_signature).union(of_text)


class Store:
    """Accepted rows in a folder that all executors share; each batch adds one generation.

    A folder that holds a store already is opened as it is: what was admitted in other sessions stays in force, with the order of
    shingles, their size, the threshold and the numbers of filter partitions and buckets it was begun with.
    """

    POSTED = "v long, kind int, id long, n int, a long, b long"
    TEXTS = "id long, text string"
    DECIDED = "id long, kept long"

    def __init__(self, spark: SparkSession, path: str | None = None, filter_parts: int = FILTER_PARTS, buckets: int = BUCKETS) -> None:
        """``filter_parts``: about one for every ten million values that the store shall hold; ``buckets``: as many tasks read it."""
        self.spark, self.path, self.filter_parts, self.buckets = spark, path or fresh_path(spark, "store"), filter_parts, buckets
        self.commits = [json.loads(x) for x in get_files(spark, f"{self.path}/commits", ".json")]
        if self.commits:
            if "buckets" not in self.commits[0]:
                raise ValueError("the store was begun by a release that kept no buckets")
            self.filter_parts, self.buckets = self.commits[0]["filter_parts"], self.commits[0]["buckets"]
        self._order = None

    def _all(self, what: str, schema: str, by: str) -> DataFrame | None:
        paths = [f"{self.path}/{c['folder']}/{what}" for c in self.commits if c["accepted"]]
        return read_buckets(self.spark, paths, schema, self.buckets, by) if paths else None

    def posted(self) -> DataFrame | None:
        """What is posted of all accepted rows, in buckets by value; None while there are none."""
        return self._all("posted", self.POSTED, "v")

    def texts(self) -> DataFrame | None:
        """(id, text) of all accepted rows, in buckets by id; None while there are none."""
        return self._all("texts", self.TEXTS, "id")

    def filters(self) -> DataFrame | None:
        """The closed layers of all generations and the open ones of the last."""
        paths = [f"{self.path}/{c['folder']}/screened/what={CLOSED}" for c in self.commits if c["closed"]]
        paths += [f"{self.path}/{c['folder']}/screened/what={OPEN}" for c in self.commits[-1:] if c["open"]]
        return self.spark.read.schema("part int, layer int, entries long, bits binary").parquet(*paths) if paths else None

    def decisions(self, batch: int | str) -> DataFrame | None:
        """(id, kept) of the rows of an admitted batch that repeat an accepted row; None for a batch that isn't in the store."""
        for c in self.commits:
            if c["batch"] == batch:
                return self.spark.read.schema(self.DECIDED).parquet(f"{self.path}/{c['folder']}/decided")
        return None

    def order(self, size: int, threshold: float, texts: DataFrame, folder: str):
        """The order of shingles for all workers: the store's own, or one counted over these texts for a new store."""
        if self.commits and (self.commits[0]["size"], self.commits[0]["threshold"]) != (size, threshold):
            raise ValueError("the store was begun with another size or threshold")
        if self._order is None:
            kept = f"{self.path}/{self.commits[0]['folder'] if self.commits else folder}/order"
            if not self.commits:
                shingle_order(texts, size, 0).write.parquet(kept)
            self._order = broadcast_order(self.spark.read.schema(ORDER).parquet(kept))
        return self._order

    def commit(self, entry: dict) -> None:
        put_file(self.spark, f"{self.path}/commits/{len(self.commits):08d}.json", json.dumps(entry))
        self.commits.append(entry)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (v, kind, id, n, a, b, old) of one batch -> (id, kept): what shares keys and signatures, and pairs (kind PAIR, id and v)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    key_of: dict[int, tuple] = {}
    class_of: dict[int, int] = {}
    before: dict = {}  # smallest accepted row of the history, by key or class
    texts: dict[tuple, list[int]] = {}
    near: dict[int, list[int]] = {}
    seen: dict[tuple, int] = {}
    first = lambda d, k, i: d.__setitem__(k, min(i, d.get(k, i)))
    table = pa.Table.from_batches(held)
    for v, kind, i, n, a, b, old in zip(*(table.column(c).to_pylist() for c in ("v", "kind", "id", "n", "a", "b", "old")), strict=True):
        if kind == PAIR:
            if old:
                first(before, v, i)
            else:
                near.setdefault(i, []).append(v)
                near.setdefault(v, []).append(i)
            class_of.setdefault(v, v)
            if not old:
                class_of.setdefault(i, i)
        elif old:
            first(seen, (v, n, a, b), i)
        elif kind == KEY:
            key_of[i] = (v, n, a, b)
        else:
            texts.setdefault((v, n, a, b), []).append(i)
    for token, members in texts.items():
        lead = min(members)
        class_of |= dict.fromkeys(members, lead)
        if token in seen:
            first(before, lead, seen[token])
    accepted: dict = {}
    out = []
    for i in sorted(class_of.keys() | key_of.keys()):
        own, k = class_of.get(i, i), key_of.get(i)
        found = [d[t] for d, t in ((before, own), (seen, k)) if t in d] or [accepted[t] for t in (own, k, *near.get(own, ())) if t in accepted]
        if found:
            out.append((i, min(found)))
        else:
            accepted[own] = i
            if k is not None:
                accepted[k] = i
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["id", "kept"])


def _in_rounds(exact: DataFrame, pairs: DataFrame, keep: Save) -> DataFrame:
    """What :func:`_in_order` gives, decided on the cluster: in each round all rows are decided before which nothing is open."""
    by = ["v", "kind", "n", "a", "b"]
    groups = exact.groupBy(*by).agg(F.min(F.expr("if(old, id, null)")).alias("kept"), F.min(F.expr("if(old, null, id)")).alias("lead"))
    mine = exact.filter("not old").join(groups, by)
    keyed = mine.filter(F.col("kind") == KEY).groupBy("id").agg(F.min("v").alias("k"), F.min("kept").alias("key_kept"))
    links = pairs.filter("not old")
    ends = links.selectExpr("a id", "a rep").union(links.selectExpr("b", "b")).union(pairs.filter("old").selectExpr("b", "b"))
    classes = mine.filter(F.col("kind") == SIGNATURE).selectExpr("id", "lead rep").union(ends).groupBy("id").agg(F.min("rep").alias("rep"))
    class_kept = pairs.filter("old").selectExpr("b rep", "a kept").union(mine.filter(F.col("kind") == SIGNATURE).selectExpr("lead", "kept")).groupBy("rep").agg(F.min("kept").alias("class_kept"))
    met = classes.join(keyed, "id", "full").withColumn("rep", F.coalesce("rep", "id")).join(class_kept, "rep", "left")
    met, _ = keep(met.selectExpr("id", "rep", "k", "least(key_kept, class_kept) kept"), "met")
    both = links.select("a", "b").union(links.select("b", "a")).toDF("rep", "other")
    state, turn = met.filter("kept is null").selectExpr("id", "rep", "k", "0 state"), 0  # 0 open, 1 accepted, 2 a repeat
    first = lambda s, c: F.min(F.when(F.col("state") == s, F.col("id"))).alias(c)

    def around(rows: DataFrame) -> DataFrame:
        """Per row the smallest accepted and the smallest open row that it is compared with."""
        keys = state.filter("k is not null").groupBy("k").agg(first(1, "ka"), first(0, "ko"))
        own = state.groupBy("rep").agg(first(1, "ca"), first(0, "co"))
        near = both.join(own.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.min("ca").alias("na"), F.min("co").alias("no"))
        return rows.join(keys, "k", "left").join(own, "rep", "left").join(near, "rep", "left").selectExpr("id", "rep", "k", "state", "least(ka, ca, na) done", "least(ko, co, no) waits")

    while not state.filter("state = 0").isEmpty():
        state, _ = keep(around(state).selectExpr("id", "rep", "k", "case when state > 0 then state when done < id then 2 when waits >= id then 1 else 0 end state"), f"round{turn}")
        turn += 1
    # what a repeat repeats is known only when all before it are decided
    return met.filter("kept is not null").select("id", "kept").unionByName(around(state.filter("state = 2")).selectExpr("id", "done kept"))


def _meeting(posted: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """Lines of the store's postings that have the key or signature of an asked value, and of the pairs that share a fingerprint, judged
    where they meet. Joined by the value alone, by which the store lies in buckets."""
    same = "y.kind = x.kind and y.n = x.n and y.sketch = x.sketch and y.more = x.more"
    on = f"x.v = y.v and if(x.kind = {SHINGLE}, y.kind = {SHINGLE} and {within_reach(threshold, 'x', 'y')}, {same})"
    of_pair = lambda y, x: f"if(x.kind = {SHINGLE}, {y}, {x})"
    x = posted.selectExpr("v", "kind", "id", "n", "a sketch", "b more").alias("x")
    return x.join(asked.alias("y"), F.expr(on)).selectExpr(
        of_pair("y.id", "x.v") + " v", "x.kind kind", "x.id id", of_pair("0", "x.n") + " n", of_pair("0L", "x.sketch") + " a", of_pair("0L", "x.more") + " b", "true old"
    )


def admit(store: Store, batch: DataFrame, name: int | str, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Check a batch (id, key[, text]) against the store and itself; what is accepted becomes part of the store.

    Result: (id, kept) of the rows that repeat an accepted row, with the smallest accepted id they repeat. All ids
    of a batch are greater than those of the batches before that they are compared with. ``name`` names the batch: one that
    the store holds already changes nothing and gives the result it gave.
    """
    if (known := store.decisions(name)) is not None:
        return known
    spark, folder = store.spark, f"g-{name}-{uuid.uuid4().hex[:8]}"
    home = f"{store.path}/{folder}"
    keep = lambda df, what: save(df, f"{home}/tmp/{what}-{uuid.uuid4().hex[:8]}")
    batch = batch.filter("id is not null").selectExpr("id", "text" if "text" in batch.columns else "cast(null as string) text", "key")
    order = store.order(size, threshold, batch, folder)
    docs, many = keep(sketches(batch, size, threshold, order, "text string, key string"), "docs")

    asked = _posted(docs, "leads").selectExpr("*", f"cast(pmod(xxhash64(v), {store.filter_parts}) as int) part", "cast(null as int) layer", "cast(null as bigint) entries", "cast(null as binary) bits")
    if (layers := store.filters()) is not None:
        asked = layers.selectExpr(*[f"cast(null as {t}) {c}" for c, t in (x.split() for x in POSTING.split(", "))], "part", "layer", "entries", "bits").unionByName(asked)
    # a partition each; layers have no v and come first
    screened = asked.repartitionById(store.filter_parts, F.col("part")).sortWithinPartitions("v", "s", "id").mapInArrow(_screen, SCREENED)
    seen = Observation()
    count = {"open": f"what = {OPEN}", "closed": f"what = {CLOSED}", "known": "known", "exact": f"kind < {SHINGLE}", "shingles": f"kind = {SHINGLE}"}
    screened.observe(seen, *[F.expr(f"count_if({x}) {c}") for c, x in count.items()]).write.partitionBy("what").parquet(f"{home}/screened")
    seen = seen.get
    shown = f"{POSTING}, dup boolean, known boolean"
    found = spark.read.schema(shown).parquet(f"{home}/screened/what={VALUE}") if seen["exact"] + seen["shingles"] else spark.createDataFrame([], shown)

    stored = store.posted() if seen["known"] else None
    exact = found.filter(F.col("kind") < SHINGLE).selectExpr(*POSTING_COLUMNS, "false old")
    line = "v long, kind int, id long, n int, a long, b long, old boolean"  # of a pair: b as v, kind SHINGLE, a as id
    met, hot, many_hot = spark.createDataFrame([], line), None, 0
    if seen["shingles"]:
        dup = found.filter(f"dup and kind = {SHINGLE}").selectExpr("v key", "id", "n", "a sketch", "b more", "false old")
        hot, many_hot = hot_lists(dup.select("key"), keep)
        met = candidate_pairs(dup, hot, many_hot, threshold).selectExpr("b v", f"{SHINGLE} kind", "a id", "0 n", "0L a", "0L b", "old")
    if stored is not None:
        asked = found.filter("known").selectExpr("v", "kind", "id", "n", "a sketch", "b more")
        if many_hot:
            few = checked_broadcast(hot.selectExpr("key v"), many_hot)
            met = met.union(_meeting(stored.join(few, "v", "left_semi"), asked.join(few, "v", "left_semi").hint("shuffle_hash"), threshold))
            asked = asked.join(few, "v", "left_anti")
        met = met.union(_meeting(stored, asked.repartition(store.buckets, "v").hint("shuffle_hash"), threshold))
    pairs, linked = spark.createDataFrame([], "a long, b long, old boolean"), 0
    if stored is not None or seen["shingles"]:
        met, many_met = keep(met.distinct(), "met")
        exact = exact.union(met.filter(F.col("kind") < SHINGLE).selectExpr("v", "kind", "id", "n", "a", "b", "0L s", "old"))
        if many_met and seen["shingles"]:
            near = met.filter(F.col("kind") == SHINGLE).selectExpr("id a", "v b", "old")
            pairs, linked = keep(verified_pairs(near, many_met, docs, size, threshold, store.texts() if stored is not None else None, store.buckets), "pairs")
    if 2 * seen["exact"] + linked <= RESOLVE_ROWS:  # a key or signature is stored once
        lines = exact.union(pairs.selectExpr("b v", f"{PAIR} kind", "a id", "0 n", "0L a", "0L b", "0L s", "old"))
        decided = lines.repartition(1).mapInArrow(_in_order, "id long, kept long")
    else:
        decided = _in_rounds(exact, pairs, keep)
    decided, gone = save(decided, f"{home}/decided")

    if accepted := many - gone:
        taken = docs.join(checked_broadcast(decided.select("id"), gone), "id", "left_anti")
        write_buckets(_posted(taken, "true").drop("s"), f"{home}/posted", store.buckets, "v")
        write_buckets(taken.select("id", "text"), f"{home}/texts", store.buckets, "id")
    entry = {"batch": name, "folder": folder, "size": size, "threshold": threshold, "filter_parts": store.filter_parts, "buckets": store.buckets, "rows": many, "accepted": accepted}
    store.commit(entry | {c: seen[c] for c in ("open", "closed")})
    delete_path(spark, f"{home}/tmp")
    delete_path(spark, f"{home}/screened/what={VALUE}")
    return decided
