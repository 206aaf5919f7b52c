"""Connected components: by one task where the edges are few, else by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from dittograph.storage import dropped, written


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star: every node ends nearer to the least node of its component.

    Both rounds are a union, one aggregation for the least neighbour and one
    join on the node, so no neighbour list is ever gathered in one row.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
    large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
    down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    linked = down.join(least, "src")
    return linked.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()


#: Edges of 16 bytes up to which one task finds the components by itself; they are counted first.
LOCAL_EDGES = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component: labels spread and paths halve, all edges at once."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [(np.asarray(x.column("src"), np.int64), np.asarray(x.column("dst"), np.int64)) for x in batches if x.num_rows]
    if pairs:
        node, component = least_labels(*(np.concatenate(x) for x in zip(*pairs)))
        for k in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 100_000]), pa.array(component[k : k + 100_000])], ["node", "component"])


def _forest(most: int):
    """Task that gives edges of the same components, one for each node: labels of up to ``most`` edges at once, carried on while nodes are fewer."""

    def labelled(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return least_labels(*(np.concatenate(x) for x in zip(*pairs)))

    def out(node: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        # a root stands in its members' edges, or alone
        single = np.bincount(np.searchsorted(node, label), minlength=len(node))[np.searchsorted(node, label)] == 1
        kept = (node != label) | single
        for k in range(0, int(kept.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[kept][k : k + 100_000]), pa.array(label[kept][k : k + 100_000])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for x in batches:
            held.append((np.asarray(x.column("src"), np.int64), np.asarray(x.column("dst"), np.int64)))
            count += x.num_rows
            if count > most:
                node, label = labelled(held)
                held, count = [(node, label)], len(node)
                if count > most // 2:
                    yield from out(node, label)
                    held, count = [], 0
        if count:
            yield from out(*labelled(held))

    return run


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, component)`` for every node of an edge, ``component`` its component's least node.

    ``edges`` holds two comparable id columns; direction, self-loops, repeats and
    nulls in either end do not matter (rows with a null end are ignored, a
    self-loop alone makes a component of one). An empty table gives no rows.
    Each round is written to the shared folder, so lineage stays flat. Edges with integer ends are first cut down to one for each node of a
    partition, and again in fewer partitions as long as that helps. Up to
    ``local_edges`` distinct edges, which are counted first, are worked off by one task without rounds.
    """
    raw = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    whole = local_edges > 0 and isinstance(raw.schema["src"].dataType, LongType) and isinstance(raw.schema["dst"].dataType, LongType)
    if whole:
        raw = raw.mapInArrow(_forest(local_edges), "src long, dst long")
    now = written(raw.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    if whole:
        count, before = now.count(), None
        while count > local_edges and (before is None or count <= before // 2):
            fewer = now.repartition(-(-count // local_edges)).mapInArrow(_forest(2 * local_edges), "src long, dst long").distinct()
            last, now = now, written(fewer, "cc")
            dropped(last)
            before, count = count, now.count()
        if count <= local_edges:
            return now.repartition(1).mapInArrow(_at_once, "node long, component long")
    loops = now.filter("src = dst").select(F.col("src").alias("node"))
    last, state = now.filter("src <> dst"), None
    for _ in range(max_rounds):
        new = written(_stars(last), "cc")
        sums = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if last is not now and state is not None:
            dropped(last)
        last = new
        if tuple(sums) == state:
            break
        state = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = last.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = members.select(F.col("component").alias("node"), "component").distinct()
    found = members.unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
