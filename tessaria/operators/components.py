"""Connected components for the core: spanning forests, and star contraction of labels until nothing changes.

Each task reduces its edges to a spanning forest first; what is left meets in one task while it fits, else the cluster works in rounds.
Each round gives every node the smallest label among itself and its neighbours and then follows labels to their
own labels (pointer jumping), so the rounds grow with the logarithm of the longest path in practice. Every
round is written to the shared folder, in place of the one before: plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.runtime import counted, delete_path, fresh_path, materialize, save

#: Edges of one forest of a task, and those that one task joins in the end.
BLOCK, LAST = 500_000, 2_000_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component; a, b: ends of the edges among nodes 0..n-1."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        a, b = label[a], label[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # hook the larger root
        while ((up := label[label]) != label).any():
            label = up
    return label


def _forests(most: int | None):
    """Edges (a, b) -> (a, b): each node of up to so many edges, or of all, with the smallest one that it is linked to among them."""

    def forest(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        names = pc.unique(pa.chunked_array(table.column("a").chunks + table.column("b").chunks))
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(table.column(c), names).to_numpy() for c in ("a", "b"))
        yield from pa.table({"a": names, "b": names.take(pa.array(_roots(a, b, len(names))))}).to_batches(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if most and rows >= most:
                yield from forest(held)
                held, rows = [], 0
        if rows:
            yield from forest(held)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node is linked to, over edges in both directions."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    spark, kind = e.sparkSession, e.union(e.select("b", "a")).schema["a"].dataType
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}"
    e, left = counted(e.select(F.col("a").cast(kind), F.col("b").cast(kind)).mapInArrow(_forests(BLOCK), schema), "forest")
    if left <= LAST:
        return materialize(e.coalesce(1).mapInArrow(_forests(None), schema), "components").toDF("node", "component")
    both = materialize(e.union(e.select("b", "a")).distinct(), "edges")
    path = None
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node")
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("near")).withColumnRenamed("a", "node")
        pulled = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        before, path = path, fresh_path(spark, "labels")
        moved, _ = save(pulled.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), path)
        if before:
            delete_path(spark, before)
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
