"""Blocks of nearby vectors: split points fitted on a bounded sample, every vector assigned, queries routed down the tree of splits.

The driver only ever sees the sample (at most `fit_rows`) and one row of ranges per block (at most `max_blocks`, about 13 MB at eight projections), which is also
all that is broadcast. Up to `block_rows` times `max_blocks` rows, 268 million by default, blocks keep their size; beyond that they grow with the data. The searches
inside a block use sorted arrays or a tree of their own, so what a query costs then grows more slowly than its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import cut


@dataclass(frozen=True)
class BlockSpec:
    block_rows: int = 4096
    max_blocks: int = 65_536
    fit_rows: int = 400_000
    queries_per_task: int = 8192
    seed: int = 3


DEFAULT = BlockSpec()


@dataclass(frozen=True)
class Splits:
    """A tree of split points: at node i vectors whose coordinate on `axis[i]` is below `edge[i]` go to `left[i]`, others to
    `left[i] + 1`; leaves have axis -1 and their number in `left`."""

    axis: np.ndarray
    edge: np.ndarray
    left: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        """The node of each block."""
        nodes = np.flatnonzero(self.axis < 0)
        return nodes[np.argsort(self.left[nodes])]

    def block(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), dtype=np.int64)
        rows = np.arange(len(vectors))
        while True:
            inner = self.axis[node] >= 0
            if not inner.any():
                return self.left[node]
            go_right = vectors[rows, np.maximum(self.axis[node], 0)] >= self.edge[node]
            node = np.where(inner, self.left[node] + go_right, node)

    def meets(self, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) for every block that the window of half-width `reach` around a query may touch: one walk down the tree, both ways where the window lies across an edge."""
        who, node = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
        found_who, found_block = [], []
        while len(who):
            leaf = self.axis[node] < 0
            found_who.append(who[leaf])
            found_block.append(self.left[node[leaf]])
            who, node = who[~leaf], node[~leaf]
            on, edge = at[who, self.axis[node]], self.edge[node]
            below, above = on - reach[who] < edge, on + reach[who] >= edge
            who, node = np.r_[who[below], who[above]], np.r_[self.left[node[below]], self.left[node[above]] + 1]
        return np.concatenate(found_who), np.concatenate(found_block)


def fit_splits(sample: np.ndarray, blocks: int) -> Splits:
    """Halve the largest part on its widest coordinate until there are `blocks` parts or nothing is left to part."""
    axis, edges, left = [-1], [0.0], [0]
    level: list[tuple[int, np.ndarray]] = [(0, np.arange(len(sample)))]
    parts = 1
    while level and parts < blocks:
        following: list[tuple[int, np.ndarray]] = []
        for node, members in sorted(level, key=lambda x: -len(x[1])):
            if parts >= blocks or len(members) < 2:
                continue
            part = sample[members]
            some = np.sort(part[:: max(1, len(part) // 256)], axis=0)  # enough to see which coordinate is widest
            last = len(some) - 1
            widest = int(np.argmax(some[round(0.95 * last)] - some[round(0.05 * last)] + 1e-12 * np.ptp(part, axis=0)))
            values = part[:, widest]
            middle = float(np.partition(values, len(values) // 2)[len(values) // 2])
            if not (values < middle).any():  # half of the values or more are the least one
                above = values[values > middle]
                if not len(above):
                    continue
                middle = float(above.min())
            below = values < middle
            axis[node], edges[node], left[node] = widest, middle, len(axis)
            axis += [-1, -1]
            edges += [0.0, 0.0]
            left += [0, 0]
            following += [(left[node], members[below]), (left[node] + 1, members[~below])]
            parts += 1
        level = following
    axis_a, left_a = np.array(axis), np.array(left)
    leaves = np.flatnonzero(axis_a < 0)
    left_a[leaves] = np.arange(len(leaves))
    return Splits(axis_a, np.array(edges), left_a)


def fit(rows: DataFrame, key: str, columns: list[str], project, spec: BlockSpec = DEFAULT) -> Splits:
    """Fit split points to `project`ed vectors of the rows of least hash: some dozens for each block, at most `fit_rows`."""
    total = rows.count()
    blocks = int(np.clip(-(-total // spec.block_rows), 1, spec.max_blocks))
    wanted = min(spec.fit_rows, 64 * blocks)
    place = F.pmod(F.xxhash64(F.lit(spec.seed), key), F.lit(1 << 40))
    likely = rows.filter(place < int(min(1.0, 1.5 * (wanted + 100) / max(1, total)) * (1 << 40)))  # so that few are ordered
    vectors = likely.orderBy(place, key).limit(wanted).select(*columns).toPandas().to_numpy(float).reshape(-1, len(columns))
    return fit_splits(project(vectors), blocks) if len(vectors) else Splits(np.array([-1]), np.array([0.0]), np.array([0]))


def assigned(rows: DataFrame, columns: list[str], splits: Splits, project) -> DataFrame:
    """Adds `_block`."""

    @F.pandas_udf("int")
    def block_of(*cols: pd.Series) -> pd.Series:
        return pd.Series(splits.block(project(np.stack([c.to_numpy(float) for c in cols], axis=1))), dtype="int32")

    return rows.withColumn("_block", block_of(*columns))


@dataclass(frozen=True)
class Ranges:
    """Of each block its number of rows and the least and greatest value in each of some expressions; an empty block has none."""

    splits: Splits
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(placed: DataFrame, splits: Splits, expressions: list[Column]) -> Ranges:
        ends = [f(e).alias(f"{name}{i}") for i, e in enumerate(expressions) for name, f in (("lo", F.min), ("hi", F.max))]
        known = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas()  # at most max_blocks rows
        n, at = len(splits.leaves), known["_block"].to_numpy(np.int64)
        rows, low, high = np.zeros(n, dtype=np.int64), np.full((n, len(expressions)), np.inf), np.full((n, len(expressions)), -np.inf)
        rows[at] = known["n"].to_numpy(np.int64)
        for name, side in (("lo", low), ("hi", high)):
            side[at] = known[[f"{name}{i}" for i in range(len(expressions))]].to_numpy(float)
        return Ranges(splits, rows, low, high)

    def part(self, expressions: slice) -> Ranges:
        return Ranges(self.splits, self.rows, self.low[:, expressions], self.high[:, expressions])

    def touch(self, who: np.ndarray, block: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """For each (query, block) whether the block's range meets the window of half-width `reach` in every expression."""
        out = np.ones(len(who), dtype=bool)
        for j in range(at.shape[1]):
            out &= (self.low[block, j] <= at[who, j] + reach[who]) & (self.high[block, j] >= at[who, j] - reach[who])
        return out

    def boxes(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For each block the corners of the smallest part of the tree around it that holds at least `wanted` rows; infinite where no part does."""
        axis, left = self.splits.axis, self.splits.left
        n, leaves = len(axis), self.splits.leaves
        rows, low, high = np.zeros(n, dtype=np.int64), np.full((n, self.low.shape[1]), np.inf), np.full((n, self.low.shape[1]), -np.inf)
        rows[leaves], low[leaves], high[leaves] = self.rows, self.low, self.high
        inner = np.flatnonzero(axis >= 0)
        depth = np.zeros(n, dtype=np.int64)
        for i in inner:  # parents come before their parts
            depth[left[i]] = depth[left[i] + 1] = depth[i] + 1
        levels = [inner[depth[inner] == d] for d in range(int(depth[inner].max()) + 1)] if len(inner) else []
        for level in reversed(levels):
            a, b = left[level], left[level] + 1
            rows[level], low[level], high[level] = rows[a] + rows[b], np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        holder = np.where(rows >= wanted, np.arange(n), -1)
        for level in levels:
            for part in (left[level], left[level] + 1):
                holder[part] = np.where(holder[part] >= 0, holder[part], holder[level])
        at = holder[leaves]
        return np.where(at[:, None] >= 0, low[at], -np.inf), np.where(at[:, None] >= 0, high[at], np.inf)


def far_corner(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest distance from each vector to its box."""
    return np.sqrt((np.maximum(np.abs(vectors - low), np.abs(vectors - high)) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9


def spread_over_copies(placed: DataFrame, visits: DataFrame, key: str, queries_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Adds `_share` to both sides: blocks that many queries visit are copied so that no task gets more than about so many of them."""
    load = visits.groupBy("_block").count()
    shares = load.select("_block", F.ceil(F.col("count") / queries_per_task).cast("int").alias("_shares"))  # at most max_blocks rows
    points = placed.join(F.broadcast(shares), "_block").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    wants = visits.join(F.broadcast(shares), "_block").withColumn("_share", F.pmod(F.xxhash64(key), F.col("_shares")).cast("int")).drop("_shares")
    return points, wants


LEAF_ROWS = 48  # of the tree inside a block


def nearest_in(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, other_id: np.ndarray) -> np.ndarray:
    """The squared distance of each query to the nearest vector (of another id where `other_id`) of one block; infinite if none is found within `bound`.
    A tree inside the block: each query meets its own leaf, then the leaves that its window touches."""
    splits = fit_splits(vectors, max(1, len(vectors) // LEAF_ROWS))
    leaf = splits.block(vectors)
    order = np.argsort(leaf, kind="stable")
    vectors, ids, leaf = vectors[order], ids[order], leaf[order]
    starts = np.searchsorted(leaf, np.arange(len(splits.leaves) + 1))
    best = np.full(len(queries), np.inf)

    def meet(who: np.ndarray, where: np.ndarray) -> None:
        if not len(who):
            return
        by = np.argsort(where, kind="stable")
        who, where = who[by], where[by]
        edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            rows = slice(starts[where[a]], starts[where[a] + 1])
            for s in range(a, b, 4096):
                some = who[s : min(b, s + 4096)]
                d2 = np.zeros((len(some), rows.stop - rows.start))
                for j in range(vectors.shape[1]):
                    d2 += (queries[some, j, None] - vectors[None, rows, j]) ** 2
                if other_id.any():
                    d2[other_id[some, None] & (query_ids[some, None] == ids[None, rows])] = np.inf
                if d2.shape[1]:
                    best[some] = np.minimum(best[some], d2.min(axis=1))

    home = splits.block(queries)
    meet(np.arange(len(queries)), home)
    reach = np.minimum(np.sqrt(best), bound) * (1 + 1e-9) + 1e-9
    low = np.full((len(splits.leaves), vectors.shape[1]), np.inf)
    high = np.full_like(low, -np.inf)
    np.minimum.at(low, leaf, vectors)
    np.maximum.at(high, leaf, vectors)
    for s in range(0, len(queries), 4096):
        who, where = splits.meets(queries[s : s + 4096], reach[s : s + 4096])
        who = who + s
        gap = np.maximum(np.maximum(low[where] - queries[who], queries[who] - high[where]), 0)
        close = (where != home[who]) & ((gap**2).sum(axis=1) <= reach[who] ** 2)
        meet(who[close], where[close])
    return best


class NearestIndex:
    """The exact Euclidean distance of query rows to the nearest of a table's rows, by an index that is built once and asked any number of times.

    Distances are sums of squared differences, so an exact copy is at 0. Copies of one vector beyond the two of smallest id can't change a
    result and are set aside map-side.

    Defined results: rows with a null, NaN or infinite coordinate or a null id take no part; a query without any other point has no row;
    repeated query rows are each answered."""

    def __init__(self, points: DataFrame, id_col: str, columns: list[str], spec: BlockSpec = DEFAULT) -> None:
        self.id_col, self.columns, self.spec = id_col, columns, spec
        self.v = [f"_v{i}" for i in range(len(columns))]
        self.kind = points.schema[id_col].dataType
        rows = self._clean(points).withColumn("_n", F.row_number().over(Window.partitionBy(*self.v).orderBy("_id"))).filter("_n <= 2").drop("_n")
        rows = cut(rows)
        self.splits = fit(rows, "_id", self.v, lambda x: x, spec)
        self.placed = cut(assigned(rows, self.v, self.splits, lambda x: x))
        self.ranges = Ranges.of(self.placed, self.splits, [F.col(c) for c in self.v])

    def _clean(self, df: DataFrame, *more: Column) -> DataFrame:
        out = df.select(F.col(self.id_col).alias("_id"), *more, *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(self.columns))).filter(F.col("_id").isNotNull())
        for c in self.v:
            out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        return out

    def nearest(self, queries: DataFrame, other_id: bool | str) -> DataFrame:
        """(id, distance) of each query row; a point with the query's own id is left out if `other_id`, never one at distance 0 for that.
        `other_id` may be the name of a boolean column that says so for each row, and is then kept."""
        v, splits, ranges = self.v, self.splits, self.ranges
        own = [("_id", self.kind), *((c, T.DoubleType()) for c in v), ("_skip", T.BooleanType()), ("_copies", T.LongType())]
        visit = T.StructType([*(T.StructField(n, t) for n, t in own), T.StructField("_bound", T.DoubleType()), T.StructField("_block", T.IntegerType())])
        found = T.StructType([*visit.fields, T.StructField("d2", T.DoubleType())])
        low, high = ranges.boxes(2)

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at = batch[v].to_numpy(float)
                block = splits.block(at)
                yield batch.assign(_bound=far_corner(at, low[block], high[block]), _block=block.astype("int32"))[visit.names]

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at, reach, at_home = batch[v].to_numpy(float), batch["_bound"].to_numpy(float) * (1 + 1e-9) + 1e-9, batch["_block"].to_numpy(np.int64)
                who, where = splits.meets(at, reach)
                hit = (where != at_home[who]) & ranges.touch(who, where, at, reach)
                yield batch.iloc[who[hit]].assign(_block=where[hit].astype("int32"))[visit.names]

        def probe(_key: tuple, block: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
            if not len(wants):
                return pd.DataFrame({f.name: [] for f in found.fields})
            best = np.full(len(wants), np.inf)
            if len(block):
                best = nearest_in(block[v].to_numpy(float), block["_id"].to_numpy(), wants[v].to_numpy(float), wants["_id"].to_numpy(), wants["_bound"].to_numpy(float), wants["_skip"].to_numpy(bool))
            return wants.assign(d2=best)[found.names]

        def searched(visits: DataFrame) -> DataFrame:
            at, wants = spread_over_copies(self.placed, visits, "_id", self.spec.queries_per_task)
            return at.groupBy("_block", "_share").cogroup(wants.groupBy("_block", "_share")).applyInPandas(probe, found)

        skip = F.col(other_id) if isinstance(other_id, str) else F.lit(other_id)
        names = [n for n, _ in own]
        asked = self._clean(queries, skip.alias("_skip")).groupBy(*names[:-1]).agg(F.count(F.lit(1)).alias("_copies"))
        first = cut(searched(cut(asked.select(*names).mapInPandas(home, visit))))
        visits = cut(first.withColumn("_bound", F.least("_bound", F.sqrt("d2"))).select(*visit.names).mapInPandas(route, visit))
        every = first.unionByName(searched(visits)).groupBy(*names).agg(F.min("d2").alias("d2")).filter(F.col("d2") != float("inf"))
        every = every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        kept = [F.col("_skip").alias(other_id)] if isinstance(other_id, str) else []
        return every.select(F.col("_id").alias(self.id_col), *kept, F.sqrt("d2").alias("distance"))


def nearest_distance(points: DataFrame, queries: DataFrame, id_col: str, columns: list[str], other_id: bool, spec: BlockSpec = DEFAULT) -> DataFrame:
    """The same for a single question."""
    return NearestIndex(points, id_col, columns, spec).nearest(queries, other_id)
