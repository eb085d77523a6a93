"""Items of varying length into containers of fixed capacity, with little unused space.

First-fit decreasing, run independently in groups of items drawn at random by a hash. A tournament tree over the free
space of the containers of a group finds the first one with room in logarithmic time. An item is cut only if it is
longer than the capacity: into full containers and a rest, which is packed like any other item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items in a group on the average: enough for the last, half-filled containers to matter little.
GROUP_ITEMS = 4000


class Containers:
    """Free space of containers as a tournament tree: each node has the most free space below it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.n = capacity, 0
        self.width = 1 << max(0, (max(1, most) - 1).bit_length())
        self.tree = [0] * (2 * self.width)

    def _set(self, leaf: int, free: int) -> None:
        tree, i = self.tree, leaf + self.width
        tree[i] = free
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            top = a if a > b else b
            if tree[i] == top:
                break
            tree[i] = top
            i >>= 1

    def put(self, size: int) -> int:
        """Number of the first container with room; opens one where none has."""
        tree = self.tree
        if size == 0 and self.n:
            return 0
        if self.n == 0 or tree[1] < size:
            leaf = self.n
            self.n += 1
            self._set(leaf, self.capacity - size)
            return leaf
        i = 1
        while i < self.width:
            i *= 2
            if tree[i] < size:
                i += 1
        leaf = i - self.width
        self._set(leaf, tree[i] - size)
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(container of each item, number of containers); sizes are at most the capacity. Equal sizes keep their order."""
    bins = Containers(capacity, len(sizes))
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[i] = bins.put(sizes[i])
    return out, bins.n


def pieces_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first unit, length) of the pieces; items up to the capacity are one piece, also those of no length."""
    n = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), n)
    no = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    start = no * capacity
    return item, start, np.minimum(capacity, sizes[item] - start)


PACK_SCHEMA = T.StructType(
    [T.StructField("profile_id", T.IntegerType()), T.StructField("capacity", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("piece_no", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("start_unit", "n_units")]
    + [T.StructField("container_id", T.StringType())]
)


def pack(items: DataFrame, profiles: list[tuple[int, int]], id_col: str, size_col: str, n_items: int, group_items: int = GROUP_ITEMS, seed: int = 17) -> DataFrame:
    """Each piece of each item with its container, for every (profile, capacity).

    ``n_items`` (a count) sets the number of random groups, so a group keeps its size as the data grow. Items without
    length go into the first container of their group; null sizes count as 0; capacities below 1 are refused.
    """
    if any(c < 1 for _, c in profiles):
        raise ValueError("a capacity must be positive")
    groups = max(1, round(n_items / group_items))
    profiles = sorted(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group; a group is small by construction.
        held: list[pd.DataFrame] = []
        now = None

        def close() -> Iterator[pd.DataFrame]:
            d = pd.concat(held).sort_values("item_id", kind="stable")
            sizes = d["n"].to_numpy(np.int64)
            ids = d["item_id"].to_numpy(np.int64)
            for profile, capacity in profiles:
                item, start, length = pieces_of(sizes, capacity)
                where, _ = first_fit_decreasing(length.tolist(), capacity)
                yield pd.DataFrame(
                    {
                        "profile_id": np.int32(profile), "capacity": np.int64(capacity), "item_id": ids[item], "piece_no": (start // capacity).astype(np.int32),
                        "start_unit": start, "n_units": length, "container_id": [f"{profile}-{now}-{w}" for w in where],
                    }
                )

        for b in batches:
            for g, part in b.groupby("g", sort=False):
                if g != now and held:
                    yield from close()
                    held = []
                now = g
                held.append(part)
        if held:
            yield from close()

    src = items.select(
        F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(groups)).cast("int").alias("g"), F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n")
    )
    return src.repartition("g").sortWithinPartitions("g").mapInPandas(run, PACK_SCHEMA)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per profile: containers, pieces, units held and the share of the space that is filled."""
    per = packed.groupBy("profile_id", "capacity", "container_id").agg(F.sum("n_units").alias("held"), F.count("*").alias("n_pieces"))
    return per.groupBy("profile_id", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("held").alias("n_units"), F.round(F.sum("held") / (F.count("*") * F.first("capacity")), 4).alias("filled")
    )
