"""Most similar vectors for every vector: collision-counting hashing.

Each hash function is one projection on a random direction of unit length; its hash table is the array of all
vectors sorted by their projection. A query looks at a window around its own projection in every array and counts in how many windows each
vector falls. One that collides in at least `threshold` of the arrays is verified, that is its true distance is computed. Windows
grow by virtual rehashing (`growth` times as wide, nothing is hashed again) until k verified vectors lie within the radius searched.

A window's half-width is the radius divided by `stretch`. A projection never stretches a distance, so with a stretch of 1 a vector within the radius
is in all windows, and the answer is exact for any threshold. With a larger stretch the windows are narrower: a vector at the very radius is
then in each of them with a chance of 0.90 in four dimensions (stretch 1.25), a nearer one in more, and a threshold of 5 in 8 still finds it with a
chance of 0.994. Fewer vectors are looked at, and what is lost is measured: recall 1.000 against brute force (README).

Distribution: the arrays are cut into blocks by split points on the projections themselves, fitted on a bounded
sample (`fit_rows`), while every vector is put into a block. A query first searches its own block; the distance
of its k-th vector there bounds all that follows. Its window of that half-width then meets only the blocks whose
ranges it touches in all projections; they are found by walking down the tree of splits. That tree and the ranges of blocks are the only things broadcast: at most `max_blocks` rows.
Queries that share a block are spread over copies of it if they are many. Copies of one vector beyond the k + 1
with the smallest ids can't be among anyone's k nearest and are set aside before the blocks are made, already
map-side, so neither a hot value nor a crowded region makes a hot task.

Defined results: rows with a null, NaN or infinite feature or a null id take no part; a row is never its own
neighbour (same id); equal distances rank by the smaller id; with fewer than k other rows all of them come out; an
empty table gives no rows; repeated ids count as the separate rows they are. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators import blocks
from assay.session import cut


@dataclass(frozen=True)
class CollisionSpec:
    k: int = 10
    projections: int = 8
    threshold: float = 0.625  # share of the arrays in whose windows a vector has to fall
    stretch: float = 1.25
    growth: float = 1.6
    block_rows: int = 4096
    max_blocks: int = 65_536
    fit_rows: int = 400_000
    queries_per_task: int = 2048
    seed: int = 11

    @property
    def blocks(self) -> blocks.BlockSpec:
        return blocks.BlockSpec(self.block_rows, self.max_blocks, self.fit_rows, self.queries_per_task, self.seed)


DEFAULT = CollisionSpec()


def directions(dimensions: int, spec: CollisionSpec) -> np.ndarray:
    """Unit vectors, one row each."""
    raw = np.random.default_rng(spec.seed).standard_normal((spec.projections, dimensions))
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Arrays:
    """The sorted arrays of one block and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dirs: np.ndarray, spec: CollisionSpec) -> None:
        self.ids, self.vectors, self.spec = ids, vectors, spec
        self.turn = np.unique(ids, return_inverse=True)[1]  # the order of ids, of whatever type
        projected = vectors @ dirs.T
        self.order = [np.argsort(projected[:, j], kind="stable") for j in range(dirs.shape[0])]
        self.sorted = [projected[o, j] for j, o in enumerate(self.order)]
        self.dirs = dirs
        self.need = max(1, int(np.ceil(spec.threshold * dirs.shape[0])))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its up to k nearest rows within `bound`: the query's place, ids and squared distances."""
        k, n = self.spec.k, len(self.ids)
        at = queries @ self.dirs.T
        # First radius: half of what holds in the first array the share of rows that a box around k rows would be wide.
        first = self.sorted[0]
        place = np.searchsorted(first, at[:, 0])
        reach = max(k, int(n * (k / max(n, k)) ** (1 / self.vectors.shape[1]) / 4))
        width = np.minimum(np.abs(first[np.minimum(place + reach, n - 1)] - at[:, 0]), np.abs(at[:, 0] - first[np.maximum(place - reach, 0)]))
        width = np.minimum(np.maximum(width / 2, 1e-6), bound)
        active = np.arange(len(queries))
        while len(active):
            slack = width[active] * (1 + 1e-9) / self.spec.stretch + 1e-9
            lows = [np.searchsorted(s, at[active, j] - slack, "left") for j, s in enumerate(self.sorted)]
            highs = [np.searchsorted(s, at[active, j] + slack, "right") for j, s in enumerate(self.sorted)]
            again = []
            for i, q in enumerate(active):
                spans = [(int(lo[i]), int(hi[i])) for lo, hi in zip(lows, highs, strict=True)]
                whole = all(b - a == n for a, b in spans)
                if whole:
                    chosen = np.arange(n)
                else:
                    hits = np.concatenate([o[a:b] for o, (a, b) in zip(self.order, spans, strict=True)])
                    chosen = np.flatnonzero(np.bincount(hits, minlength=n) >= self.need) if len(hits) else hits
                difference = self.vectors[chosen] - queries[q]
                d2 = np.einsum("ij,ij->i", difference, difference)
                own = self.ids[chosen]
                mine = own != query_ids[q]
                inside = mine & (d2 <= width[q] * width[q] * (1 + 1e-12))
                if inside.sum() >= k or whole or width[q] >= bound[q]:
                    ids, d2 = own[mine], d2[mine]
                    best = np.lexsort((self.turn[chosen][mine], d2))[:k]
                    yield int(q), ids[best], d2[best]
                else:
                    again.append(q)
            active = np.array(again, dtype=np.int64)
            width[active] = np.minimum(width[active] * self.spec.growth, bound[active])


def _scaled(df: DataFrame, id_col: str, features: list[str], spread: dict[str, float]) -> DataFrame:
    values = [F.col(f).cast("double") / F.lit(float(spread[f])) for f in features]
    out = df.select(F.col(id_col).alias("_id"), *(v.alias(f"_v{i}") for i, v in enumerate(values)))
    for i in range(len(features)):
        v = F.col(f"_v{i}")
        out = out.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return out.filter(F.col("_id").isNotNull())


def similar(df: DataFrame, queries: DataFrame, id_col: str, features: list[str], spread: dict[str, float], spec: CollisionSpec = DEFAULT) -> DataFrame:
    """The k rows of `df` nearest to each row of `queries` by Euclidean distance, each feature divided by its spread:
    query_id, near_id, rank (from 1), distance."""
    kind = df.schema[id_col].dataType
    dims = len(features)
    v = [f"_v{i}" for i in range(dims)]
    dirs = directions(dims, spec)
    rows = _scaled(df, id_col, features, spread)
    copies = Window.partitionBy(*v).orderBy("_id")
    rows = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= spec.k + 1).drop("_n")
    rows = cut(rows)
    project = lambda vectors: vectors @ dirs.T
    splits = blocks.fit(rows, "_id", v, project, spec.blocks)
    placed = cut(blocks.assigned(rows, v, splits, project))
    asked = _scaled(queries, id_col, features, spread).distinct()

    def projection(j: int) -> Column:
        return sum((F.col(c) * float(dirs[j, i]) for i, c in enumerate(v)), F.lit(0.0))

    ranges = blocks.Ranges.of(placed, splits, [*(projection(j) for j in range(spec.projections)), *(F.col(c) for c in v)])
    hashed = ranges.part(slice(0, spec.projections))
    low, high = ranges.part(slice(spec.projections, None)).boxes(spec.k + 1)
    visit_schema = T.StructType([T.StructField("_id", kind), *(T.StructField(c, T.DoubleType()) for c in v), T.StructField("_bound", T.DoubleType()), T.StructField("_block", T.IntegerType())])
    found_schema = T.StructType([T.StructField("query_id", kind), *(T.StructField(c, T.DoubleType()) for c in v), T.StructField("near_id", kind), T.StructField("d2", T.DoubleType())])
    k = spec.k

    def first_bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's own block, and an upper bound of its k-th distance by the far corner of the part of the tree around it that holds enough rows."""
        for batch in batches:
            at = batch[v].to_numpy(float)
            block = splits.block(project(at))
            yield batch.assign(_bound=blocks.far_corner(at, low[block], high[block]), _block=block.astype("int32"))[visit_schema.names]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every other block that a query's window touches in all projections."""
        for batch in batches:
            at, own = project(batch[v].to_numpy(float)), batch["_block"].to_numpy(np.int64)
            reach = batch["_bound"].to_numpy(float) * (1 + 1e-9) + 1e-9
            for s in range(0, len(batch), 4096):
                who, where = splits.meets(at[s : s + 4096], reach[s : s + 4096])
                who = who + s
                hit = (where != own[who]) & hashed.touch(who, where, at, reach)
                yield batch.iloc[who[hit]].assign(_block=where[hit].astype("int32"))[visit_schema.names]

    def probe(points: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(wants):
            return pd.DataFrame({f.name: [] for f in found_schema.fields})
        arrays = Arrays(points["_id"].to_numpy(), points[v].to_numpy(float), dirs, spec)
        q = wants[v].to_numpy(float)
        who, near, d2 = [], [], []
        for at, ids, distances in arrays.search(wants["_id"].to_numpy(), q, wants["_bound"].to_numpy(float)):
            who.append(np.full(len(ids), at))
            near.append(ids)
            d2.append(distances)
        who = np.concatenate(who) if who else np.zeros(0, dtype=int)
        out = wants.iloc[who].reset_index(drop=True)
        out = out.rename(columns={"_id": "query_id"})
        out["near_id"] = np.concatenate(near) if near else []
        out["d2"] = np.concatenate(d2) if d2 else []
        return out[found_schema.names]

    def searched(visits: DataFrame) -> DataFrame:
        points, wants = blocks.spread_over_copies(placed, visits, "_id", spec.queries_per_task)
        return points.groupBy("_block", "_share").cogroup(wants.groupBy("_block", "_share")).applyInPandas(lambda _key, a, b: probe(a, b), found_schema)

    start = cut(asked.mapInPandas(first_bound, visit_schema))
    home = cut(searched(start))
    nearest = home.groupBy("query_id", *v).agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far"))
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in v]
    condition = F.col("a._id") == F.col("b.query_id")
    for one in keys:
        condition = condition & one
    bound = F.least("_bound", F.when(F.col("n") >= k, F.sqrt("far")))
    bounded = start.alias("a").join(nearest.alias("b"), condition, "left").select("_id", *(F.col(f"a.{c}").alias(c) for c in v), bound.alias("_bound"), "_block")
    visits = cut(bounded.mapInPandas(route, visit_schema))
    everything = home.unionByName(searched(visits))
    best = Window.partitionBy("query_id", *v).orderBy("d2", "near_id")
    ranked = everything.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "near_id", F.col("rank").cast("int").alias("rank"), F.sqrt("d2").alias("distance"))
