"""Schemas that drift between files: tagged-union inference over JSON records.

1. `field_profiles` reads every record once and folds it into one row per file and field path: the JSON types
   seen there (the tagged union: alternatives are kept side by side and never widened into one another) and a
   fixed-size picture of the contents. Each task folds all it reads, the folds are merged by plain sums, minima
   and maxima, so a file that holds a third of all rows is summed up map-side like any other.
2. `changes` compares each file with the one before it in its feed. What it gathers per file is one row per
   field, not per record. `alternatives` reports every type that a path takes on or gives up between two files, be it the commonest one or not.
3. `unified` fuses the schemas: fields linked by renames get one canonical name, each alternative type of a
   field gets a typed branch column beside the canonical text, at any depth, and objects written as key-value lists become
   objects.

Defined results: payloads that are null, empty, cut off, not valid JSON (also NaN and Infinity) or not an object
have no fields; lines without feed, file_id or file_no can't be placed and are left out of the comparison; a
field that is only ever null has no type and is not compared by type; of several types in one file the most
frequent one is the field's type in `changes` (ties: the first in JSON_TYPES). Repeated lines change nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_TYPES = ("string", "number", "boolean", "object", "array")
FILE = ("feed", "file_no", "file_id")
SHAPES = ("empty", "hex", "digits", "time", "sentence", "word", "numbered", "dotted", "snake", "other")
KEPT_HASHES = 24  # smallest value hashes of a field in a file, to compare vocabularies

_SHAPE = (
    ("empty", re.compile(r"\s*\Z")),
    ("time", re.compile(r"\d{4}-\d\d-\d\d")),
    ("digits", re.compile(r"[+-]?\d+(\.\d+)?\Z")),
    ("hex", re.compile(r"(?=.*\d)[0-9a-f]{6,}\Z")),
    ("sentence", re.compile(r".*\s")),
    ("word", re.compile(r"[^\W\d_]+\Z")),
    ("numbered", re.compile(r"[\w.-]*[^\W\d][\w.-]*\d+\Z")),
    ("dotted", re.compile(r"\w+(\.\w+)+\Z")),
    ("snake", re.compile(r"[^\W\d]+([_-][^\W\d]+)+\Z")),
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> float | int:
    """A number beyond a double as the whole number that it is, of at most 4,000 digits."""
    number = float(text)
    if abs(number) != float("inf"):
        return number
    try:
        exact = Decimal(text)
        if exact.adjusted() < 4000:
            return int(exact)
    except ArithmeticError:
        pass
    return 10**3999 if number > 0 else -(10**3999)


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=_number)
_quick_decoder = json.JSONDecoder(parse_constant=_no_constant)


def parse_record(text: object, exact: bool = True) -> dict | None:
    """The object that a payload holds, or None. Unless `exact`, numbers beyond a double are infinite."""
    if not isinstance(text, str):
        return None
    try:
        value = (_decoder if exact else _quick_decoder).decode(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_type(value: object) -> int:
    """Index in JSON_TYPES, -1 for null."""
    if value is None:
        return -1
    if isinstance(value, str):
        return 0
    if isinstance(value, bool):
        return 2
    if isinstance(value, (int, float)):
        return 1
    return 3 if isinstance(value, dict) else 4


def shape_of(text: str) -> int:
    for at, (name, pattern) in enumerate(_SHAPE):
        if pattern.match(text):
            return SHAPES.index(name)
    return len(SHAPES) - 1


class _Fold:
    __slots__ = ("below", "hashes", "high", "low", "n", "shapes", "total", "types", "whole")

    def __init__(self) -> None:
        self.n = 0
        self.types = [0] * len(JSON_TYPES)
        self.shapes = [0] * len(SHAPES)
        self.whole = 0
        self.total = 0.0
        self.low, self.high = float("inf"), float("-inf")
        self.hashes: set[int] = set()
        self.below = 1 << 32  # hashes from here on can't be among the smallest

    def string(self, known: tuple[int, int]) -> None:
        shape, hashed = known
        self.types[0] += 1
        self.shapes[shape] += 1
        if hashed < self.below:
            self.hashes.add(hashed)
            if len(self.hashes) > 4 * KEPT_HASHES:
                self.hashes = set(sorted(self.hashes)[:KEPT_HASHES])
                self.below = max(self.hashes)

    def number(self, value: float) -> None:
        try:
            number = float(value)
        except OverflowError:
            number = float("inf") if value > 0 else float("-inf")
        number = min(max(number, -1.7e308), 1.7e308)
        self.types[1] += 1
        self.whole += number == int(number)
        self.total += number
        if number < self.low:
            self.low = number
        if number > self.high:
            self.high = number

    def row(self) -> tuple:
        return (self.n, *self.types, *self.shapes, self.whole, self.total, self.low, self.high, sorted(self.hashes)[:KEPT_HASHES])


class _Texts(dict):
    """Shape and hash of texts, remembered while they are not too many."""

    def __missing__(self, text: str) -> tuple[int, int]:
        made = shape_of(text), zlib.crc32(text.encode("utf-8", "surrogatepass"))
        if len(self) < 50_000 and len(text) < 1000:
            self[text] = made
        return made


def fold_record(record: dict, folds: dict[str, _Fold], texts: _Texts) -> None:
    """Add every field of a record to the folds of its file; elements of arrays come as `path[]`. Not recursive, so depth is no limit."""
    stack: list[tuple[str, object]] = [("", record)]
    while stack:
        at, holder = stack.pop()
        if type(holder) is dict:
            head = f"{at}." if at else ""
            fields = [(head + key, value) for key, value in holder.items()]
        else:
            inner = f"{at}[]"
            fields = [(inner, value) for value in holder]
        for path, value in fields:
            fold = folds.get(path)
            if fold is None:
                fold = folds[path] = _Fold()
            fold.n += 1
            kind = type(value)
            if kind is str:
                fold.string(texts[value])
            elif kind is float or kind is int:
                fold.number(value)
            elif kind is bool:
                fold.types[2] += 1
            elif kind is dict:
                fold.types[3] += 1
                stack.append((path, value))
            elif kind is list:
                fold.types[4] += 1
                stack.append((path, value))


_FOLDED = T.StructType(
    [T.StructField("feed", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("file_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("n", T.LongType())]
    + [T.StructField(f"t_{t}", T.LongType()) for t in JSON_TYPES]
    + [T.StructField(f"s_{s}", T.LongType()) for s in SHAPES]
    + [T.StructField("whole", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("hashes", T.ArrayType(T.LongType()))]
)


FOLDS_HELD = 100_000  # a task gives out its folds when it holds so many


def _fold_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts = _Texts()
    files: dict[tuple, dict[str, _Fold]] = defaultdict(dict)
    held = 0

    def given() -> pd.DataFrame:
        return pd.DataFrame([(*key, path, *fold.row()) for key, folds in files.items() for path, fold in folds.items()], columns=_FOLDED.names)

    for batch in batches:
        for feed, file_no, file_id, payload in zip(batch["feed"], batch["file_no"], batch["file_id"], batch["payload"], strict=True):
            folds = files[(feed, int(file_no), file_id)]
            before = len(folds)
            # A row for the file itself, so that a file without any valid record still is a file.
            if "" not in folds:
                folds[""] = _Fold()
            folds[""].n += 1
            record = parse_record(payload, exact=False)
            if record is not None:
                fold_record(record, folds, texts)
            held += len(folds) - before
            if held > FOLDS_HELD:
                yield given()
                files.clear()
                held = 0
    if files:
        yield given()


def field_profiles(lines: DataFrame, payload: str) -> DataFrame:
    """One row per file and path: counts of each JSON type and the picture of the contents. `path` '' is the file itself."""
    placed = lines.filter(F.col("feed").isNotNull() & F.col("file_no").isNotNull() & F.col("file_id").isNotNull())
    placed = placed.select("feed", F.col("file_no").cast("long").alias("file_no"), "file_id", F.col(payload).alias("payload"))
    folded = placed.mapInPandas(_fold_batches, _FOLDED)
    sums = ["n", *(f"t_{t}" for t in JSON_TYPES), *(f"s_{s}" for s in SHAPES), "whole", "total"]
    # One row per task and field comes in, each with at most KEPT_HASHES hashes.
    merged = folded.groupBy(*FILE, "path").agg(
        *(F.sum(c).alias(c) for c in sums), F.min("low").alias("low"), F.max("high").alias("high"), F.flatten(F.collect_list("hashes")).alias("hashes")
    )
    return merged.withColumn("hashes", F.slice(F.array_sort(F.array_distinct("hashes")), 1, KEPT_HASHES))


# ---------------------------------------------------------------- comparison of two files


def parent_of(path: str) -> str:
    return path.rpartition(".")[0]


def field_type(profile: dict) -> str | None:
    counts = [profile[f"t_{t}"] for t in JSON_TYPES]
    return JSON_TYPES[counts.index(max(counts))] if max(counts) > 0 else None


def _name_likeness(a: str, b: str) -> float:
    """Share of letter pairs that two names have in common, letter case and separators aside."""
    pairs = [{x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in (re.sub(r"[\W_]", "", n.rpartition(".")[2]).lower() for n in (a, b))]
    return 2 * len(pairs[0] & pairs[1]) / (len(pairs[0]) + len(pairs[1]))


def _beneath(path: str, names: Iterable[str]) -> set[str]:
    """Names directly beneath a field, whether it is an object or an array of objects."""
    out = set()
    for head in (f"{path}.", f"{path}[]."):
        out |= {n[len(head) :].split(".")[0].removesuffix("[]") for n in names if n.startswith(head)}
    return out


def _strings_alike(a: dict, b: dict) -> float:
    va, vb = [a[f"s_{s}"] for s in SHAPES], [b[f"s_{s}"] for s in SHAPES]
    norm = (sum(x * x for x in va) * sum(x * x for x in vb)) ** 0.5
    shape = sum(x * y for x, y in zip(va, vb, strict=True)) / norm if norm else 0.0
    ha, hb = set(a["hashes"]), set(b["hashes"])
    # As many hashes as are kept may be a cut of any vocabulary: both sides are known only up to the last hash of each cut.
    known = min((max(h) for h in (ha, hb) if len(h) >= KEPT_HASHES), default=None)
    ka, kb = ({x for x in h if known is None or x <= known} for h in (ha, hb))
    seen = min(len(ka), len(kb))
    shared = len(ka & kb) / max(1, seen)
    # A small vocabulary that repeats (labels, versions) has to recur; a large one (names, ids) need not.
    repeats = all(len(h) < KEPT_HASHES and p["t_string"] >= 3 * len(h) for p, h in ((a, ha), (b, hb)))
    wordy = min(len(ha), len(hb)) >= KEPT_HASHES // 2 and seen and max(va[SHAPES.index("word")], va[SHAPES.index("sentence")]) > 0.5 * sum(va)
    if not shared and (repeats or wordy):
        return 0.3 * shape
    return shape * (0.75 + 0.25 * shared)


def _numbers_alike(a: dict, b: dict) -> float:
    wa, wb = a["whole"] / a["t_number"], b["whole"] / b["t_number"]
    if abs(wa - wb) > 0.6:
        return 0.0
    overlap = min(a["high"], b["high"]) - max(a["low"], b["low"])
    width = min(a["high"] - a["low"], b["high"] - b["low"])
    if overlap < 0:
        return 0.0
    means = sorted((abs(a["total"] / a["t_number"]), abs(b["total"] / b["t_number"])))
    near = (means[0] + 1e-9) / (means[1] + 1e-9)
    return min(1.0, overlap / width if width > 0 else 1.0) * min(1.0, near * 2)


def content_likeness(old_path: str, old: dict, old_all: dict, new_path: str, new: dict, new_all: dict) -> float:
    """From 0 (another kind of content) to 1; of fields of one type."""
    kind = field_type(old)
    if kind == "string":
        return _strings_alike(old, new)
    if kind == "number":
        return _numbers_alike(old, new)
    if kind == "boolean":
        return 1.0
    a, b = _beneath(old_path, old_all), _beneath(new_path, new_all)
    if a or b:
        return min(1.0, 1.6 * len(a & b) / len(a | b))
    inner_old, inner_new = old_all.get(f"{old_path}[]"), new_all.get(f"{new_path}[]")
    if inner_old and inner_new and field_type(inner_old) == field_type(inner_new) and field_type(inner_old):
        return content_likeness(f"{old_path}[]", inner_old, old_all, f"{new_path}[]", inner_new, new_all)
    return 0.6 if not inner_old and not inner_new else 0.0


LIKE = 0.5  # least likeness of contents of a renamed field


def compare(old_all: dict[str, dict], new_all: dict[str, dict]) -> list[tuple[str, str, str]]:
    """The topmost changes between two files as (kind, old path, new path)."""
    out: list[tuple[str, str, str]] = []
    settled: set[str] = set()  # paths whose inside is not compared
    is_field = lambda p: p and not p.endswith("[]")

    def covered(path: str) -> bool:
        at = path
        while at:
            at = at[:-2] if at.endswith("[]") else at.rpartition(".")[0]
            if at in settled:
                return True
        return False

    by_depth: dict[int, dict[str, tuple[list[str], list[str], list[str]]]] = defaultdict(lambda: defaultdict(lambda: ([], [], [])))
    for path in sorted(old_all.keys() | new_all.keys()):
        if is_field(path):
            slot = 2 if path in old_all and path in new_all else 0 if path in old_all else 1
            by_depth[path.count(".")][parent_of(path)][slot].append(path)
    for depth in sorted(by_depth):
        for gone, come, both in by_depth[depth].values():
            gone, come, both = ([p for p in paths if not covered(p)] for paths in (gone, come, both))
            for path in both:
                was, now = field_type(old_all[path]), field_type(new_all[path])
                if was and now and was != now:
                    out.append(("type_changed", path, path))
                    settled.add(path)
            pairs = []
            for a in gone:
                for b in come:
                    if field_type(old_all[a]) and field_type(old_all[a]) == field_type(new_all[b]):
                        like = content_likeness(a, old_all[a], old_all, b, new_all[b], new_all)
                        if like >= LIKE:
                            pairs.append((like + _name_likeness(a, b), a, b))
            taken: set[str] = set()
            for _, a, b in sorted(pairs, reverse=True):
                if f"o{a}" not in taken and f"n{b}" not in taken:
                    taken |= {f"o{a}", f"n{b}"}
                    out.append(("renamed", a, b))
            out += [("removed", a, "") for a in gone if f"o{a}" not in taken]
            out += [("added", "", b) for b in come if f"n{b}" not in taken]
            settled |= set(gone) | set(come)
    return out


_CHANGE = "feed string, file_no long, file_id string, change_kind string, old_field string, new_field string"


def _compare_files(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for feed, file_no, file_id, old, new in zip(batch["feed"], batch["file_no"], batch["file_id"], batch["old"], batch["new"], strict=True):
            sides = [{p["path"]: p for p in (x.asDict() if hasattr(x, "asDict") else dict(x) for x in side) if p["path"] != ""} for side in (old, new)]
            rows += [(feed, file_no, file_id, *change) for change in compare(*sides)]
        yield pd.DataFrame(rows, columns=["feed", "file_no", "file_id", "change_kind", "old_field", "new_field"])


def changes(profiles: DataFrame) -> DataFrame:
    """Each file against the one before it in its feed. The first file of a feed has no changes."""
    files = profiles.filter(F.col("path") == "").select(*FILE)
    order = Window.partitionBy("feed").orderBy("file_no", "file_id")
    following = files.select("*", F.lead(F.struct(F.col("file_no").alias("file_no"), F.col("file_id").alias("file_id"))).over(order).alias("then"), F.row_number().over(order).alias("nth"))
    rest = [c for c in profiles.columns if c not in FILE]
    picture = F.struct(*rest)
    joined = profiles.join(following, list(FILE)).select(*FILE, "then", "nth", picture.alias("picture"))
    sides = F.array(
        F.struct(F.col("file_no").alias("no"), F.col("file_id").alias("id"), F.lit(True).alias("is_new")),
        F.struct(F.col("then.file_no").alias("no"), F.col("then.file_id").alias("id"), F.lit(False).alias("is_new")),
    )
    spread = joined.select("feed", "nth", "picture", F.explode(sides).alias("s")).filter(F.col("s.id").isNotNull() & ~(F.col("s.is_new") & (F.col("nth") == 1)))
    gathered = spread.groupBy("feed", F.col("s.no").alias("file_no"), F.col("s.id").alias("file_id")).agg(
        F.collect_list(F.when(~F.col("s.is_new"), F.col("picture"))).alias("old"), F.collect_list(F.when(F.col("s.is_new"), F.col("picture"))).alias("new")
    )
    return gathered.mapInPandas(_compare_files, _CHANGE)


def alternatives(profiles: DataFrame) -> DataFrame:
    """Every alternative type that a path takes on or gives up from one file of a feed to the next: feed, file_id (the file in which that began), path, change
    (`alternative_added`, `alternative_removed`), json_type and `records` (values of that type, in the file that has them). Only paths count that have a type in both files."""
    order = Window.partitionBy("feed").orderBy("file_no", "file_id")
    files = profiles.filter(F.col("path") == "").select(*FILE)
    before = files.select(*FILE, F.lag("file_no").over(order).alias("_old_no"), F.lag("file_id").over(order).alias("_old_id")).filter(F.col("_old_id").isNotNull())
    types = profiles.filter(F.col("path") != "").select(*FILE, "path", *(F.col(f"t_{t}").alias(t) for t in JSON_TYPES))
    known = types.filter(" + ".join(JSON_TYPES) + " > 0")
    old = known.select("feed", F.col("file_no").alias("_old_no"), F.col("file_id").alias("_old_id"), "path", F.struct(*JSON_TYPES).alias("_old"))
    pairs = known.join(before, list(FILE)).join(old, ["feed", "_old_no", "_old_id", "path"])
    sides = F.array(*(F.struct(F.lit(t).alias("json_type"), F.col(t).alias("now"), F.col(f"_old.{t}").alias("was")) for t in JSON_TYPES))
    each = pairs.select("feed", "file_id", "path", F.explode(sides).alias("s")).filter("(s.now > 0) <> (s.was > 0)")
    change = F.when(F.col("s.now") > 0, "alternative_added").otherwise("alternative_removed")
    return each.select("feed", "file_id", "path", change.alias("change"), "s.json_type", F.greatest("s.now", "s.was").alias("records"))


# ---------------------------------------------------------------- one consistent table


class Names:
    """Canonical names per canonical parent, from the renames of all files, the most frequent first. `together` are pairs of
    paths found in one file: their names are two fields wherever they stand, and no chain of renames unites them."""

    def __init__(self, renames: dict[tuple[str, str], int], counts: dict[str, int], together: Iterable[tuple[str, str]] = ()) -> None:
        self.root: dict[tuple[str, str], str] = {}
        apart: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for a, b in together:
            apart[a.count(".")].append((a, b))
        steps = sorted(renames, key=lambda r: (r[0].count("."), -renames[r], r))
        groups: dict[str, dict[str, set[str]]] = defaultdict(dict)
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for depth in sorted({a.count(".") for a, _ in steps}):
            both: dict[str, set[frozenset[str]]] = defaultdict(set)
            for a, b in apart[depth]:
                parent = self.canonical(parent_of(a))
                if parent == self.canonical(parent_of(b)):
                    both[parent].add(frozenset((a.rpartition(".")[2], b.rpartition(".")[2])))
            for a, b in (s for s in steps if s[0].count(".") == depth):
                parent = self.canonical(parent_of(a))
                one, two = a.rpartition(".")[2], b.rpartition(".")[2]
                left, right = groups[parent].get(one, {one}), groups[parent].get(two, {two})
                if left is not right and any(frozenset((x, y)) in both[parent] for x in left for y in right):
                    continue
                seen[(parent, one)] += counts.get(a, 0)
                seen[(parent, two)] += counts.get(b, 0)
                members = left | right
                for m in members:
                    groups[parent][m] = members
            for parent, names in groups.items():
                for name, members in names.items():
                    self.root[(parent, name)] = min(members, key=lambda m: (-seen[(parent, m)], m))

    def canonical(self, path: str) -> str:
        out = ""
        for step in path.split("."):
            if not step:
                continue
            bare = step.removesuffix("[]") if step.endswith("[]") else step
            tail = step[len(bare) :]
            key = "" if not out else out
            name = self.root.get((key, bare), bare)
            out = (f"{out}.{name}" if out else name) + tail
        return out


def _entries_to_object(value: list) -> dict | list:
    """[{"key": k, "value": v}, ...] as {k: v, ...}; any other list stays."""
    if value and all(isinstance(x, dict) and len(x) == 2 and isinstance(next(iter(x.values())), str) for x in value):
        pairs = [tuple(x.values()) for x in value]
        if all(not isinstance(v, (dict, list)) for _, v in pairs):
            return dict(pairs)
    return value


def canonical_value(value: object, at: str, names: Names, mixed: set[str]) -> object:
    """A value with canonical names all the way down; lists of entries become objects where the field is an object elsewhere."""
    if isinstance(value, list):
        if at in mixed:
            value = _entries_to_object(value)
        if isinstance(value, list):
            return [canonical_value(x, f"{at}[]", names, mixed) for x in value]
    if isinstance(value, dict):
        out = {}
        # Names that stay come first: where the canonical name is taken, a value keeps its own.
        for key, name in sorted(((k, names.root.get((at, k), k)) for k in value), key=lambda k: k[0] != k[1]):
            if name in out:
                name = key
            out[name] = canonical_value(value[key], f"{at}.{name}" if at else name, names, mixed)
        return out
    return value


def _together(profiles: DataFrame, linked_names: list[str]) -> list[tuple[str, str]]:
    """Pairs of paths with linked names that occur in one file, at most as many as there are pairs of names."""
    held = profiles.filter(F.element_at(F.split("path", r"\."), -1).isin(linked_names)).groupBy(*FILE).agg(F.array_sort(F.collect_set("path")).alias("held"))
    one = held.select("held", F.explode("held").alias("a"))
    pairs = one.select("a", F.explode(F.filter("held", lambda p: p > F.col("a"))).alias("b")).distinct()
    depth = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit("")))
    return [(r["a"], r["b"]) for r in _no_more_than(pairs.filter(depth("a") == depth("b")), MOST_PATHS)]


MOST_PATHS = 20_000  # names that may go to the driver: columns of the table, fields with several types, renamed fields


def _no_more_than(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} fields are columns, renamed or of several types: the keys of some objects look like data")
    return rows


def _values_at(record: dict, steps: list[tuple[str, int]]) -> object:
    """What is at a path of (name, arrays right below it): a list, nested as the arrays are, where it lies below arrays; None where something is in the way."""
    (name, arrays), rest = steps[0], steps[1:]
    value = record.get(name)

    def below(value: object, arrays: int) -> object:
        if arrays:
            return [below(x, arrays - 1) for x in value] if isinstance(value, list) else None
        if not rest:
            return value
        return _values_at(value, rest) if isinstance(value, dict) else None

    return below(value, arrays)


def _flat(value: object, arrays: int) -> list:
    """The members of nested arrays in one list; where an array is missing, none."""
    if not arrays:
        return [value]
    return [x for part in value for x in _flat(part, arrays - 1)] if isinstance(value, list) else []


def unified(lines: DataFrame, payload: str) -> DataFrame:
    """Every line as one row: the line's own columns, `is_valid`, and for each canonical top-level field its
    text and one branch column per JSON type that it ever has (`<field>__string`, `__number`, `__boolean`,
    `__json`). A field beneath another one that has several types gets such branches too, named by its path with `_`; below arrays they hold an array each, in order
    of the elements, with nulls for elements of another type. Names linked by a rename that occur together in any file stay two fields. Lines that can't be placed have
    their fields too, each payload as a file of its own. Names go to the driver, never records: those of top-level fields, of fields with several types and of renamed
    ones; more than `MOST_PATHS` are refused. A key that itself holds a dot is taken for a path, and a top-level one gets no column."""
    from assay.session import cut

    placed = cut(field_profiles(lines, payload))
    linked = _no_more_than(changes(placed).filter(F.col("change_kind") == "renamed").groupBy("old_field", "new_field").count(), MOST_PATHS)
    renames = {(r["old_field"], r["new_field"]): r["count"] for r in linked}
    loose = lines.filter(F.col("feed").isNull() | F.col("file_no").isNull() | F.col("file_id").isNull())
    loose = loose.select(F.lit("").alias("feed"), F.lit(0).alias("file_no"), F.xxhash64(payload).cast("string").alias("file_id"), payload)
    profiles = placed.unionByName(cut(field_profiles(loose, payload)).withColumn("feed", F.lit(None).cast("string")))
    kinds = cut(profiles.filter(F.col("path") != "").groupBy("path").agg(F.count(F.lit(1)).alias("files"), *(F.max((F.col(f"t_{t}") > 0).cast("int")).alias(t) for t in JSON_TYPES)))
    linked_names = sorted({p.rpartition(".")[2] for pair in renames for p in pair})
    together = _together(profiles, linked_names) if renames else []
    counts = {r["path"]: r["files"] for r in _no_more_than(kinds.filter(F.col("path").isin([p for pair in renames for p in pair])).select("path", "files"), MOST_PATHS)} if renames else {}
    names = Names(renames, counts, together)
    canonical = F.pandas_udf(lambda paths: paths.map(names.canonical), "string")
    fused = kinds.groupBy(canonical("path").alias("path")).agg(*(F.max(t).alias(t) for t in JSON_TYPES))
    tagged = F.greatest("string", F.lit(0)) + F.col("number") + F.col("boolean") + F.greatest("object", "array")
    top_level = ~F.col("path").contains(".") & ~F.col("path").endswith("[]")
    wanted = fused.filter(top_level | (tagged > 1) | ((F.col("object") == 1) & (F.col("array") == 1)))
    union = {r["path"]: {t for t in JSON_TYPES if r[t]} for r in _no_more_than(wanted, MOST_PATHS)}
    mixed = {p for p, types in union.items() if {"object", "array"} <= types}
    branch = {"string": ("string", T.StringType()), "number": ("number", T.DoubleType()), "boolean": ("boolean", T.BooleanType()), "object": ("json", T.StringType()), "array": ("json", T.StringType())}
    taken = {c.lower() for c in lines.columns} - {payload.lower()} | {"is_valid"}
    columns: list[tuple[str, str | None, str, T.DataType]] = []
    for p in sorted(union, key=lambda p: ("." in p or p.endswith("[]"), p)):
        nested = "." in p or p.endswith("[]")
        tags = list(dict.fromkeys(branch[t] for t in JSON_TYPES if t in union[p]))
        if nested and len(tags) < 2:
            continue
        for tag in tags if nested else [None, *tags]:
            plain = p.replace("[]", "").replace(".", "_")
            name = plain if tag is None else f"{plain}__{tag[0]}"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            kind = T.StringType() if tag is None else tag[1]
            columns.append((p, None if tag is None else tag[0], name, T.ArrayType(kind) if "[]" in p else kind))
    own = [f for f in lines.schema.fields if f.name != payload]
    schema = T.StructType([*own, T.StructField("is_valid", T.BooleanType()), *(T.StructField(n, t) for _, _, n, t in columns)])

    def text_of(value: object) -> str | None:
        return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)

    kind_of = {"json": pa.string(), "string": pa.string(), "number": pa.float64(), "boolean": pa.bool_(), None: pa.string()}
    tag_of = {-1: None, 0: "string", 1: "number", 2: "boolean", 3: "json", 4: "json"}
    steps = {p: [(s.replace("[]", ""), s.count("[]")) for s in p.split(".")] for p, _, _, _ in columns}

    def number_of(value: object) -> float:
        try:
            return float(value)
        except OverflowError:
            return float("inf") if value > 0 else float("-inf")

    def as_tag(value: object, tag: str | None) -> object:
        if value is None or (tag is not None and tag_of[json_type(value)] != tag):
            return None
        return number_of(value) if tag == "number" else value if tag == "boolean" else text_of(value)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.names.index
            for start in range(0, whole.num_rows, 1000):  # so many parsed records at once
                batch = whole.slice(start, 1000)
                records = [parse_record(x) for x in batch.column(place(payload)).to_pylist()]
                plain = [canonical_value(r, "", names, mixed) if r is not None else {} for r in records]
                made = [batch.column(place(f.name)) for f in own] + [pa.array([r is not None for r in records], pa.bool_())]
                last = None
                for field, tag, _, _ in columns:
                    if field != last:  # the branches of a field follow each other
                        last, (name, arrays) = field, steps[field][0]
                        if len(steps[field]) > 1 or arrays:
                            values = [_values_at(r, steps[field]) for r in plain]
                            arrays = sum(n for _, n in steps[field])
                        else:
                            values = [r.get(name) for r in plain]
                    if arrays:
                        made.append(pa.array([None if v is None else [as_tag(x, tag) for x in _flat(v, arrays)] for v in values], pa.list_(kind_of[tag])))
                    else:
                        made.append(pa.array([as_tag(v, tag) for v in values], kind_of[tag]))
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return lines.mapInArrow(convert, schema)
