"""Deeply nested records as related flat tables, by shared inlining.

The schema is read as a graph: a node per element, an edge per nesting. Elements that occur once below their
parent (structs) are inlined into the parent's table under dotted names joined by `_`. Elements that repeat
(arrays, maps) get a table of their own, and so does an element type of which several parents hold the same
kind of repeated child: those share one table that says which parent each row has. Spark schemas are trees, so
a recursive type only occurs unrolled to a fixed depth; its levels have the same shape and end up shared.

Each row of a child table carries the root's key columns (`key`), the positions of all repeated ancestors
(`<parent>_pos`) and its own position (`<table>_pos`, from 0; for a map the entry's key). Together they are the
foreign key of its parent's row.

Each table is one narrow projection over the source: no shuffle, and the scan reads only the columns beneath it.

Defined results: null members of an array count as positions but give no row; null or empty arrays and maps
give no rows; a map entry with a null value gives a row; a null struct is inlined as nulls. Rows are not
de-duplicated. A produced name that clashes with a key column gets a trailing underscore.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = tuple[str, str]  # ("field" | "array" | "map", name)


@dataclass
class TablePlan:
    """One flat table: the path from the root to its repeated element and the leaves inlined in it."""

    name: str
    parent: str | None
    path: tuple[Step, ...]
    element: T.DataType | None
    leaves: list[tuple[tuple[str, ...], T.DataType]] = field(default_factory=list)
    shared_as: str | None = None


def _inline(kind: T.DataType, at: tuple[str, ...], leaves: list, repeated: list) -> None:
    if isinstance(kind, T.StructType):
        for child in kind.fields:
            _inline(child.dataType, (*at, child.name), leaves, repeated)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        repeated.append((at, kind))
    else:
        leaves.append((at, kind))


def analyse(schema: T.StructType, key: tuple[str, ...], root: str) -> list[TablePlan]:
    """The tables of a schema, parents first."""
    plans: list[TablePlan] = []

    def visit(name: str, parent: str | None, path: tuple[Step, ...], element: T.DataType) -> None:
        plan = TablePlan(name, parent, path, element if parent else None)
        repeated: list = []
        _inline(element, (), plan.leaves, repeated)
        plans.append(plan)
        for at, kind in repeated:
            if isinstance(kind, T.ArrayType):
                step, inner = "array", kind.elementType
            else:
                step, inner = "map", kind.valueType
            child = "_".join((*([name] if parent else []), *(at or (step,))))
            visit(child, name, (*path, *(("field", x) for x in at), (step, child)), inner)

    visit(root, None, (), schema)
    plans[0].leaves = [leaf for leaf in plans[0].leaves if leaf[0] not in {(k,) for k in key}]
    same = Counter((p.path[-1][0], p.path[-2][1] if len(p.path) > 1 else "", p.element.simpleString()) for p in plans[1:])
    for p in plans[1:]:
        kind = (p.path[-1][0], p.path[-2][1] if len(p.path) > 1 else "", p.element.simpleString())
        if same[kind] > 1:
            p.shared_as = kind[1] or p.name
    return plans


def _leaf(base: Column | None, at: tuple[str, ...]) -> Column:
    if base is None:
        out = F.col(f"`{at[0]}`")
        at = at[1:]
    else:
        out = base
    for name in at:
        out = out.getField(name)
    return out


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def flat_table(df: DataFrame, plan: TablePlan, key: tuple[str, ...]) -> DataFrame:
    """The rows of one table of `analyse`."""
    if plan.parent is None:
        taken = {k.lower() for k in key}
        columns = [_leaf(None, at).alias(_free("_".join(at), taken)) for at, _ in plan.leaves]
        return df.select(*(F.col(f"`{k}`") for k in key), *columns)
    taken = {k.lower() for k in key}
    links = {f"_k{i}": k for i, k in enumerate(key)}
    first = plan.path[0][1]
    out = df.select(*(F.col(f"`{k}`").alias(alias) for alias, k in links.items()), F.col(f"`{first}`").alias("_node"))
    carried = list(links)
    names: dict[str, str] = {}
    for kind, name in plan.path[1:]:
        if kind == "field":
            out = out.withColumn("_node", F.col("_node").getField(name))
            continue
        pos = f"_p{len(carried)}"
        if kind == "array":
            out = out.select(*carried, F.posexplode("_node").alias(pos, "_node")).filter(F.col("_node").isNotNull())
        else:
            out = out.select(*carried, F.explode("_node").alias(pos, "_node"))
        names[pos] = _free(f"{name}_pos" if kind == "array" else f"{name}_key", taken)
        carried.append(pos)
    columns = [F.col(alias).alias(k) for alias, k in links.items()]
    columns += [F.col(pos).alias(name) for pos, name in names.items()]
    for at, _ in plan.leaves:
        columns.append(_leaf(F.col("_node"), at).alias(_free("_".join(at) or "value", taken)))
    return out.select(*columns)


def shred(df: DataFrame, key: tuple[str, ...], root: str) -> dict[str, DataFrame]:
    """All flat tables of a nested table by name; `root` names the table of the records themselves.

    Tables whose elements have the same name and type under several parents also come out united under the
    element's name prefixed by `shared_`, with `parent_table` and the path of positions as text in `parent_pos`.
    """
    plans = analyse(df.schema, key, root)
    out = {p.name: flat_table(df, p, key) for p in plans}
    groups: dict[str, list[TablePlan]] = {}
    for p in plans:
        if p.shared_as:
            groups.setdefault(p.shared_as, []).append(p)
    for name, members in groups.items():
        parts = []
        for p in members:
            flat = out[p.name]
            positions = [c for c in flat.columns[len(key) :] if c.endswith(("_pos", "_key"))][: sum(s != "field" for s, _ in p.path)]
            leaves = [c for c in flat.columns if c not in (*key, *positions)]
            where = F.concat_ws("/", *(F.col(c).cast("string") for c in positions))
            parts.append(flat.select(*key, F.lit(p.parent).alias("parent_table"), where.alias("parent_pos"), *leaves))
        united = parts[0]
        for part in parts[1:]:
            united = united.unionByName(part, allowMissingColumns=True)
        out[f"shared_{name}"] = united
    return out
