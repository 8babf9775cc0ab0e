"""Filling fixed-capacity containers with items: bounded-space online packing.

Every partition packs its own items with at most `windows` open containers per capacity: an item goes where it leaves
the least room (best fit); where it fits nowhere and all windows are open, the fullest is emitted and a new one is
opened. What is still open at the end of the partitions, at most `windows` containers each, is merged: the items of those
windows are packed again, largest first, in groups of `merge_items`. So the work is one pass over the items and a
second one over a small rest, no task ever holds more than its windows or one group, and no key is hot because
there is none.

An item longer than the capacity is split into full containers and a rest, which is an item like any other; nothing else is split.

Defined results: items of size 0 or null join any open window (or open one); negative sizes count as 0; a container takes at most `container_items` items, so
that the empty ones, however many, neither gather in one window nor share one container; repeated
rows are packed as the separate items they are; null ids are kept; an empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import cut


@dataclass(frozen=True)
class PackSpec:
    windows: int = 256
    partition_items: int = 100_000
    merge_items: int = 200_000
    container_items: int = 50_000


DEFAULT = PackSpec()


class Windows:
    """Open containers of one capacity. Numbers are given in the order of opening."""

    def __init__(self, capacity: int, limit: int | None, most_items: int) -> None:
        self.capacity, self.limit, self.most_items = capacity, limit, most_items
        self.room: list[tuple[int, int]] = []  # (room left, number), sorted
        self.items: dict[int, int] = {}  # of the open ones
        self.opened = 0
        self.closed: set[int] = set()

    def _close(self, number: int) -> None:
        del self.items[number]
        self.closed.add(number)

    def place(self, size: int) -> int:
        """The number of the container that takes an item of at most the capacity."""
        at = len(self.room) - 1 if size == 0 and self.room else bisect_left(self.room, (size, -1))
        if at == len(self.room):
            if self.limit is not None and len(self.room) >= self.limit:
                self._close(self.room.pop(0)[1])
            number, left = self.opened, self.capacity
            self.opened += 1
        else:
            left, number = self.room.pop(at)
        left -= size
        self.items[number] = self.items.get(number, 0) + 1
        if left == 0 or self.items[number] >= self.most_items:
            self._close(number)
        else:
            insort(self.room, (left, number))
        return number


def split(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of an item: one part unless it exceeds the capacity."""
    size = max(size, 0)
    if size <= capacity:
        return [(0, size)]
    return [(s, min(capacity, size - s)) for s in range(0, size, capacity)]


def pack(items: DataFrame, id_col: str, size_col: str, capacities: dict[str, int], spec: PackSpec = DEFAULT) -> DataFrame:
    """Every part of every item and its container, for each named capacity: spec_id, container_id, the id, part_no (from 0), token_start, n_tokens."""
    for name, capacity in capacities.items():
        if capacity is None or capacity <= 0:
            raise ValueError(f"capacity of {name!r} must be positive")
    kind = items.schema[id_col].dataType
    schema = T.StructType([T.StructField("spec_id", T.StringType()), T.StructField("container_id", T.StringType()), T.StructField(id_col, kind), T.StructField("part_no", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("is_open", T.BooleanType())])
    order = sorted(capacities.items())

    def online(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_by = {name: Windows(capacity, spec.windows, spec.container_items) for name, capacity in order}
        held: dict[tuple[str, int], list[tuple]] = {}  # rows of windows that are still open
        types = [pa.string(), pa.string(), None, pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

        def rows_of(name: str, number: int, rows: list[tuple], is_open: bool) -> list[tuple]:
            return [(name, f"{name}-{part:06d}-{number:09d}", *r, is_open) for r in rows]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            types[2] = batch.schema.field(0).type
            out: list[tuple] = []
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, windows in open_by.items():
                    for no, (start, length) in enumerate(split(size, windows.capacity)):
                        number = windows.place(length)
                        held.setdefault((name, number), []).append((item, no, start, length))
                        if windows.closed:
                            for done in windows.closed:
                                out += rows_of(name, done, held.pop((name, done)), False)
                            windows.closed.clear()
            yield made(out)
        rest = [row for (name, number), rows in held.items() for row in rows_of(name, number, rows, True)]
        if rest:
            yield made(rest)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_by = {name: Windows(capacity, None, spec.container_items) for name, capacity in order}
        for batch in batches:
            named = batch.column(0).to_pylist()
            numbers = [open_by[name].place(size) for name, size in zip(named, batch.column(5).to_pylist(), strict=True)]
            for windows in open_by.values():
                windows.closed.clear()
            containers = [f"{name}-m{part:05d}-{number:09d}" for name, number in zip(named, numbers, strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[1], columns[6] = pa.array(containers, pa.string()), pa.array([False] * len(named), pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sized = items.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias(size_col))
    # Written down first: the packing must see the same items in the same order if a part of it has to run again.
    sized = cut(sized)
    parts = max(1, min(sized.rdd.getNumPartitions(), -(-sized.count() // spec.partition_items)))
    first = cut(sized.coalesce(parts).mapInArrow(online, schema))
    rest = first.filter("is_open")
    groups = max(1, -(-rest.count() // spec.merge_items))
    again = rest.repartition(groups, F.xxhash64("container_id")) if groups > 1 else rest.coalesce(1)
    again = again.sortWithinPartitions(F.col("n_tokens").desc(), F.col(id_col), "part_no", "container_id").mapInArrow(merged, schema)
    return first.filter("NOT is_open").unionByName(again).drop("is_open")
