"""Connected components of undirected links between whole numbers.

Each task first replaces its links by a spanning forest of them, which has fewer rows than nodes. While that
is more than ``ONE_TASK`` rows, rounds of joins hand each node the smallest label in reach; otherwise one task
joins the forests, in memory that the bound limits. Both ways give the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._blocks import cut

#: Links that one task joins: 16 bytes each, and some five times that while it works.
ONE_TASK, AT_ONCE = 4_000_000, 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the links and the smallest end that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        differ = lo < hi
        if not differ.any():
            return nodes, nodes[label]
        x, y = x[differ], y[differ]
        np.minimum.at(label, hi[differ], lo[differ])
        while (label != (label := label[label])).any():
            pass


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (id, component) that connect what the links (a, b) do; AT_ONCE are held at a time."""

    def made(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, to = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(to)], names=["id", "component"])

    held, n = [], 0
    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        n += batch.num_rows
        if n >= AT_ONCE:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b["id"].to_numpy(), b["component"].to_numpy()) for b in batches]
    if held:
        nodes, to = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(to[i : i + 100_000])], names=["id", "component"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """id and component (its smallest id) of every id in links (a, b)."""
    forest = cut(links.select("a", "b").mapInArrow(_forest, "id long, component long"))
    if forest.count() <= one_task:
        return cut(forest.repartition(1).mapInArrow(_whole, "id long, component long"))
    both = cut(forest.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(forest.select(F.col("component").alias("a"), F.col("id").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("component")))
    while True:
        # the smallest label among the neighbours, and then the label of that label, so long chains halve
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        new = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "n").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("onward"))
        new = cut(new.join(jump, "to", "left").select("id", "old", F.least("to", F.coalesce("onward", "to")).alias("component")))
        done = new.where("component <> old").isEmpty()
        labels = new.select("id", "component")
        if done:
            return labels
