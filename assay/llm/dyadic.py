"""Percentiles of very large numeric columns: dyadic Count-sketches.

A value is encoded as an order-preserving integer code (sign, binary exponent, leading mantissa bits), so that a
code stands for values that differ by at most 2**-mantissa_bits of themselves. The code space is halved again
and again; every resolution has its own summary of how many rows fall in each interval. Coarse resolutions have
few intervals and are counted exactly (one exact level serves all of them), each finer one is a Count-sketch: `depth`
rows of `width` signed counters, an interval's count being the median of its signed counters. Sketches are
linear: those of partitions, days or loads are merged by addition, and rows are deleted by adding weight -1.
A rank is inverted by descending from the coarse level, at each step into the left or right half.

Bounds: the value's relative error is at most 2**-mantissa_bits; the rank's error is random, with a standard deviation that `invert` adds up
over the levels it descends (counters of other intervals that share a cell), and never leaves the exactly counted interval it starts from. The
size of a sketch is fixed by its `SketchSpec`, whatever it has counted.

Hot groups: rows are first counted by (group, code) with map-side partial aggregation; a code space is finite, so
however large a group is, at most `spec.universe` rows of it reach the one task that packs its sketch.

Defined results: null, NaN and infinite values are not counted; zero and magnitudes below 2**low_exponent share
one code, magnitudes from 2**(low_exponent+octaves) on are counted in the last code of their sign; null keys are
a group of their own; an empty table gives no sketches; a group whose weights sum to 0 or less gives null percentiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.ranks import few_or_shuffled, percentiles_within, same
from assay.session import cut


@dataclass(frozen=True)
class SketchSpec:
    low_exponent: int = -10
    octaves: int = 48
    mantissa_bits: int = 10
    exact_bits: int = 5  # mantissa bits of the finest exactly counted level
    depth: int = 3
    width: int = 512
    seed: int = 20240611

    @property
    def universe(self) -> int:
        """Codes: a centre for zero, and one half for each sign."""
        return 2 * (self.octaves << self.mantissa_bits) + 2

    @property
    def levels(self) -> int:
        """Sketched levels: from one bit below the exact one down to single codes."""
        return self.mantissa_bits - self.exact_bits

    @property
    def exact_cells(self) -> int:
        return (self.universe >> self.levels) + 1

    @property
    def cells(self) -> int:
        return self.exact_cells + self.levels * self.depth * self.width


DEFAULT = SketchSpec()


#: Fixed value: the variance of the median of three equal normal variables in units of theirs.
MEDIAN_OF_THREE = 0.4487


def code_column(value: Column, spec: SketchSpec = DEFAULT) -> Column:
    """The code of a double, computed in the JVM. Increasing in the value."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # log2 may be off by one at powers of two
    exponent = F.when(F.pow(F.lit(2.0), exponent) > size, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= size, exponent + 1).otherwise(exponent)
    steps = 1 << spec.mantissa_bits
    within = F.least(F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * steps), F.lit(steps - 1))
    octave = exponent - spec.low_exponent
    top = (spec.octaves << spec.mantissa_bits) - 1
    place = F.when(octave >= spec.octaves, F.lit(top)).otherwise(octave * steps + within)
    centre = (spec.octaves << spec.mantissa_bits)
    signed = F.when(size < 2.0**spec.low_exponent, F.lit(centre)).when(value > 0, centre + 1 + place).otherwise(centre - 1 - place)
    return signed.cast("int")


def code_low(code: np.ndarray, spec: SketchSpec = DEFAULT) -> np.ndarray:
    """The smallest value of a code's interval."""
    code = np.asarray(code, dtype=np.int64)
    centre = spec.octaves << spec.mantissa_bits

    def edge(place: np.ndarray) -> np.ndarray:
        octave, within = place >> spec.mantissa_bits, place & ((1 << spec.mantissa_bits) - 1)
        return np.ldexp(1.0 + within / (1 << spec.mantissa_bits), octave + spec.low_exponent)

    above = edge(np.maximum(code - centre - 1, 0))
    below = -edge(np.maximum(centre - code, 0))
    tiny = 2.0**spec.low_exponent
    return np.where(code > centre, np.where(code == centre + 1, tiny, above), np.where(code == centre, -tiny, below))


def code_high(code: np.ndarray, spec: SketchSpec = DEFAULT) -> np.ndarray:
    """An upper bound of a code's values; infinite for the last code."""
    code = np.asarray(code, dtype=np.int64)
    high = code_low(code + 1, spec)
    return np.where(code >= spec.universe - 2, np.inf, high)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, the same on every machine."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _cell(prefix: np.ndarray, level: int, row: int, spec: SketchSpec) -> tuple[np.ndarray, np.ndarray]:
    """Place of an interval's counter within the whole sketch, and its sign."""
    h = _mix(prefix, spec.seed + 97 * level + row)
    place = spec.exact_cells + (level * spec.depth + row) * spec.width + (h % np.uint64(spec.width)).astype(np.int64)
    return place, np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int64)


def empty_sketch(spec: SketchSpec = DEFAULT) -> np.ndarray:
    return np.zeros(spec.cells, dtype=np.int64)


def add(sketch: np.ndarray, codes: np.ndarray, weights: np.ndarray, spec: SketchSpec = DEFAULT) -> None:
    """Add rows to a sketch; a negative weight deletes."""
    codes, weights = np.asarray(codes, dtype=np.int64), np.asarray(weights, dtype=np.int64)
    np.add.at(sketch, codes >> spec.levels, weights)
    for level in range(spec.levels):
        prefix = codes >> (spec.levels - 1 - level)
        for row in range(spec.depth):
            place, sign = _cell(prefix, level, row, spec)
            np.add.at(sketch, place, sign * weights)


def estimate(sketches: np.ndarray, prefix: np.ndarray, level: int, spec: SketchSpec) -> np.ndarray:
    """Estimated counts of one interval in each of several sketches."""
    rows = np.arange(len(sketches))
    found = []
    for row in range(spec.depth):
        place, sign = _cell(prefix, level, row, spec)
        found.append(sketches[rows, place] * sign)
    return np.median(np.stack(found), axis=0)


def moments(sketches: np.ndarray, spec: SketchSpec = DEFAULT) -> np.ndarray:
    """(sketch, level): the sum of the squared counts of a level's intervals, read off the sketch as the median of its rows' sums of squares."""
    table = sketches[:, spec.exact_cells :].astype(np.float64).reshape(len(sketches), spec.levels, spec.depth, spec.width)
    return np.median((table**2).sum(axis=3), axis=2)


def invert(sketches: np.ndarray, ranks: np.ndarray, spec: SketchSpec = DEFAULT, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The code at a rank (from 0) of each sketch, by descending the levels, and the standard deviation of the rank's error on that way.

    A counter errs by the other intervals that share its cell: by the level's second moment (`known`, of `moments`) less the squares of the two halves looked at,
    over the width. Each half is the median of `depth` counters, and both together give the split, which halves the variance. No split errs by more than what the interval holds."""
    known = moments(sketches, spec) if known is None else known
    exact = sketches[:, : spec.exact_cells]
    below = np.cumsum(exact, axis=1)
    prefix = (below <= ranks[:, None]).sum(axis=1)
    prefix = np.minimum(prefix, spec.exact_cells - 1)
    rows = np.arange(len(sketches))
    held = exact[rows, prefix].astype(np.float64)
    left_over = ranks - (below[rows, prefix] - held)
    variance = np.zeros(len(sketches))
    of_median = MEDIAN_OF_THREE if spec.depth >= 3 else 1.0
    for level in range(spec.levels):
        left = prefix * 2
        count = np.clip(estimate(sketches, left, level, spec), 0, held)
        other = np.clip(estimate(sketches, left + 1, level, spec), 0, held)
        noise = np.maximum(known[:, level] - count**2 - other**2, 0) / spec.width * of_median / 2
        variance += np.minimum(noise, held**2)
        # The halves must add up to what the interval holds: share the disagreement.
        count = np.clip((count + (held - other)) / 2, 0, held)
        right = left_over >= count
        prefix = np.where(right, left + 1, left)
        left_over = np.where(right, left_over - count, left_over)
        held = np.where(right, held - count, count)
    return np.minimum(prefix, spec.universe - 1), np.sqrt(variance)


FEW_CODES = 1024  # a sketch of so few distinct codes is stored as the codes it is made of


def pack(sketch: np.ndarray) -> bytes:
    """Places and counts of the counters that aren't 0 while those are few, else all counters, compressed."""
    used = np.flatnonzero(sketch)
    if 3 * len(used) < len(sketch):
        return b"s" + used.astype("<u4").tobytes() + sketch[used].astype("<i8").tobytes()
    return b"d" + zlib.compress(sketch.astype("<i8").tobytes(), 1)


def _two_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 1) // 12
    return np.frombuffer(data, "<u4", n, 1).astype(np.int64), np.frombuffer(data, "<i8", n, 1 + 4 * n).astype(np.int64)


def add_packed(total: np.ndarray, data: bytes, spec: SketchSpec = DEFAULT) -> None:
    """Add a packed sketch to an unpacked one."""
    if data[:1] == b"d":
        total += np.frombuffer(zlib.decompress(data[1:]), dtype="<i8")
        return
    places, counts = _two_arrays(data)
    if data[:1] == b"s":
        total[places] += counts
    else:
        add(total, places, counts, spec)


def unpack(data: bytes, spec: SketchSpec = DEFAULT) -> np.ndarray:
    out = empty_sketch(spec)
    add_packed(out, data, spec)
    return out


class Gatherer:
    """The sum of rows and packed sketches of one group. Codes are kept as such while they are few; a sketch is a linear
    function of them, so nothing is lost by turning them into counters later."""

    def __init__(self, spec: SketchSpec) -> None:
        self.spec, self.counters = spec, None
        self.codes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.held = 0

    def rows(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes.append(codes)
        self.weights.append(weights)
        self.held += len(codes)
        if self.held > 16 * FEW_CODES:
            self._settle()

    def packed(self, data: bytes) -> None:
        if data[:1] == b"c":
            self.rows(*_two_arrays(data))
        else:
            self._to_counters()
            add_packed(self.counters, data, self.spec)

    def _settle(self) -> None:
        """Sum equal codes; more than a few become counters."""
        if not self.codes:
            return
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        weights = np.zeros(len(codes), dtype=np.int64)
        np.add.at(weights, at, np.concatenate(self.weights))
        codes, weights = codes[weights != 0], weights[weights != 0]
        self.codes, self.weights, self.held = [codes], [weights], len(codes)
        if self.counters is not None or self.held > FEW_CODES:
            self._to_counters()

    def _to_counters(self) -> None:
        if self.counters is None:
            self.counters = empty_sketch(self.spec)
        if self.codes:
            add(self.counters, np.concatenate(self.codes), np.concatenate(self.weights), self.spec)
            self.codes, self.weights, self.held = [], [], 0

    def result(self) -> bytes:
        self._settle()
        if self.counters is not None:
            self._to_counters()
            return pack(self.counters)
        codes, weights = (self.codes[0], self.weights[0]) if self.codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return b"c" + codes.astype("<u4").tobytes() + weights.astype("<i8").tobytes()


def _grouped(batches: Iterable[pd.DataFrame], n_keys: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal keys of a partition that is sorted by them, across batches. A run's parts come one by one, never gathered."""
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.iloc[:, :n_keys]
        changed = np.zeros(len(batch), dtype=bool)
        changed[0] = True
        for c in keys.columns:
            codes, _ = pd.factorize(keys[c], use_na_sentinel=True)
            changed[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(changed)
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            first = tuple(None if pd.isna(v) else v for v in keys.iloc[a])
            yield first, batch.iloc[a:b]


def _summing(n_keys: int, names: list[str], spec: SketchSpec, take):
    """One row per run of equal keys: the keys, the sum of weights, the extremes and the packed sketch."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, into, n, least, most = None, None, 0, np.inf, -np.inf
        done: list[tuple] = []
        for key, part in _grouped(batches, n_keys):
            if into is None or key != now:
                if into is not None:
                    done.append((*now, n, least, most, into.result()))
                    if len(done) >= 512:
                        yield pd.DataFrame(done, columns=names)
                        done = []
                now, into, n, least, most = key, Gatherer(spec), 0, np.inf, -np.inf
            more, low, high = take(into, part)
            n, least, most = n + more, min(least, low), max(most, high)
        if into is not None:
            done.append((*now, n, least, most, into.result()))
        if done:
            yield pd.DataFrame(done, columns=names)

    return run


def build(df: DataFrame, keys: list[str], value: str, weight: str | None = None, spec: SketchSpec = DEFAULT) -> DataFrame:
    """One sketch per group: the keys, `n` (sum of weights), `least` and `most` (smallest and largest value seen) and `sketch` (binary)."""
    number = F.col(value).cast("double")
    known = df.filter(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")))
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    coded = known.select(*(F.col(k) for k in keys), code_column(number, spec).alias("_code"), number.alias("_value"), w.alias("_w"))
    counted = coded.groupBy(*keys, "_code").agg(F.sum("_w").alias("_w"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
    # One row per group and code from here on.
    placed = counted.repartition(*keys).sortWithinPartitions(*keys) if keys else counted.coalesce(1)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType()), T.StructField("sketch", T.BinaryType())])
    n_keys = len(keys)

    def take(into: Gatherer, part: pd.DataFrame) -> tuple[int, float, float]:
        weights = part["_w"].to_numpy(np.int64)
        into.rows(part["_code"].to_numpy(np.int64), weights)
        return int(weights.sum()), part["_least"].min(), part["_most"].max()

    fill = _summing(n_keys, schema.names, spec, take)

    return placed.mapInPandas(fill, schema)


def merge(sketches: DataFrame, keys: list[str], spec: SketchSpec = DEFAULT, fan_in: int = 64) -> DataFrame:
    """Sketches of the same keys added up, in two steps: first in up to `fan_in` shares per key, so that no task takes all parts of a hot key."""
    schema = T.StructType([*(sketches.schema[k] for k in keys), *(sketches.schema[c] for c in ("n", "least", "most", "sketch"))])

    def summed(source: DataFrame, by: list[str], out: T.StructType) -> DataFrame:
        def take(into: Gatherer, part: pd.DataFrame) -> tuple[int, float, float]:
            for data in part["sketch"]:
                into.packed(data)
            return int(part["n"].sum()), part["least"].min(), part["most"].max()

        run = _summing(len(by), out.names, spec, take)
        return source.select(*out.names).repartition(*by).sortWithinPartitions(*by).mapInPandas(run, out)

    salted = sketches.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)).cast("int"))
    partial = summed(salted, [*keys, "_salt"], T.StructType([*(sketches.schema[k] for k in keys), T.StructField("_salt", T.IntegerType()), *schema.fields[len(keys) :]]))
    if not keys:
        partial = partial.coalesce(1)
        return summed(partial.withColumn("_all", F.lit(1)), ["_all"], T.StructType([T.StructField("_all", T.IntegerType()), *schema.fields])).drop("_all")
    return summed(partial, list(keys), schema)


def coarse_bounds(sketches: np.ndarray, low_ranks: np.ndarray, high_ranks: np.ndarray, spec: SketchSpec = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the values at two ranks from the exactly counted cells that hold them: certain, but as wide as a cell."""
    below = np.cumsum(sketches[:, : spec.exact_cells], axis=1)
    first, last = (np.minimum((below <= r[:, None]).sum(axis=1), spec.exact_cells - 1) for r in (low_ranks, high_ranks))
    lowest = first << spec.levels
    highest = np.minimum(((last + 1) << spec.levels) - 1, spec.universe - 1)
    return np.where(lowest <= 0, -np.inf, code_low(lowest, spec)), code_high(highest, spec)


def percentiles(sketches: DataFrame, probabilities: list[float], sigmas: float = 4.0, spec: SketchSpec = DEFAULT, certain: bool = False) -> DataFrame:
    """Adds, for each probability p (as per mille in the name: p500 for the median), `p.._low`, `p..` and `p.._high`:
    the estimate and a bracket that holds the true value unless the rank errs by more than `sigmas` standard deviations.
    With `certain` also `p.._least` and `p.._most`, wider bounds of the interpolated percentile that always hold; brackets never reach beyond them."""
    names = [f"p{round(p * 1000):03d}" for p in probabilities]
    kept = [f for f in sketches.schema.fields if f.name != "sketch"]
    all_ends = ("_low", "", "_high", *(("_least", "_most") if certain else ()))
    schema = T.StructType([*kept, *(T.StructField(f"{n}{end}", T.DoubleType()) for n in names for end in all_ends)])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 256):  # so many unpacked sketches at once
                batch = whole.iloc[start : start + 256]
                table = np.stack([unpack(d, spec) for d in batch["sketch"]])
                known = moments(table, spec)
                n = batch["n"].to_numpy(np.float64)
                last = np.maximum(n - 1, 0)
                out = {f.name: batch[f.name] for f in kept}
                least, most = batch["least"].to_numpy(float), batch["most"].to_numpy(float)
                for p, name in zip(probabilities, names, strict=True):
                    at = p * last
                    code, deviation = invert(table, np.clip(np.round(at), 0, last), spec, known)
                    slack = sigmas * deviation + 1
                    low = code_low(invert(table, np.clip(np.floor(at - slack), 0, last), spec, known)[0], spec)
                    high = code_high(invert(table, np.clip(np.ceil(at + slack), 0, last), spec, known)[0], spec)
                    low, high = np.where(at - slack <= 0, least, low), np.where(at + slack >= last, most, high)
                    bounds = coarse_bounds(table, np.floor(at), np.ceil(at), spec)
                    low, high = np.maximum(low, bounds[0]), np.minimum(high, bounds[1])
                    top = code_high(code, spec)
                    middle = np.where(np.isinf(top), most, (code_low(code, spec) + top) / 2)
                    sides = {"_low": np.clip(low, least, most), "": np.clip(middle, least, most), "_high": np.clip(high, least, most)}
                    if certain:
                        sides |= {"_least": np.clip(bounds[0], least, most), "_most": np.clip(bounds[1], least, most)}
                    for end, v in sides.items():
                        out[name + end] = np.where(n > 0, v, np.nan)
                done = pd.DataFrame(out)[schema.names].astype(object)
                yield done.where(done.notna(), None)

    return sketches.mapInPandas(run, schema)


def _bracketed(df: DataFrame, keys: list[str], value: str, brackets: DataFrame, probabilities: list[float]) -> DataFrame:
    """Percentiles by counting: null where a bracket misses its ranks."""
    number = F.col(value).cast("double")
    known = df.filter(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))).select(*keys, number.alias("_value"))
    return percentiles_within(known, keys, "_value", brackets, probabilities, [f"p{round(p * 1000):03d}" for p in probabilities])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, brackets: DataFrame, probabilities: list[float]) -> DataFrame:
    """Exact, linearly interpolated percentiles of the groups of `brackets` (the keys, n and the bounds of `percentiles`):
    keys, n, `name` (p500 for the median) and `percentile`.

    Rows below a bracket are only counted and those inside are looked at by value, so no group's rows are ever
    gathered. A bracket that turns out to miss its ranks is widened to the whole group, so the result doesn't depend on the brackets."""
    ends = [f"p{round(p * 1000):03d}{e}" for p in probabilities for e in ("_low", "_high")]
    names = [f"p{round(p * 1000):03d}" for p in probabilities]
    brackets = cut(brackets)  # used twice; one row per group
    found = cut(_bracketed(df, keys, value, brackets, probabilities).filter(F.col("percentile").isNotNull()))

    def left_out(of: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
        """Rows of `of` whose keys are not present; null keys are equal."""
        there = cut(present.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by))).distinct())
        return of.join(few_or_shuffled(there), same(by), "left_anti")

    asked = brackets.select(*keys, "n", F.explode(F.array(*(F.lit(n) for n in names))).alias("name"))
    missed = cut(left_out(asked, found, [*keys, "name"]).select(*keys, "n").distinct())
    if missed.isEmpty():
        return found
    widened = missed.withColumns({e: F.lit(float("-inf") if e.endswith("_low") else float("inf")) for e in ends})
    return left_out(found, missed, keys).unionByName(_bracketed(df, keys, value, widened, probabilities))
