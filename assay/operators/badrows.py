"""Rows that fail to parse: delimited text is split, checked and typed inside one projection.

Every field is held as nullable text first. Rules, each a Catalyst expression, add an entry to an error
array, one for the layout or one for each column whose value breaks its rule; a row whose array is empty is valid and gets typed columns, any other comes out with its first
reason and the columns concerned. Nothing leaves the JVM and nothing is shuffled, so a table is parsed in a single scan however its
files are skewed.

Defined results: a null record counts as an empty one (one empty field); CR and LF at the very end do not
belong to a record; extra columns of the input are kept under their own names unless they clash with a
produced column, in which case the produced one wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.session import cut

# An escape that can't be confused with the text: any U+0001 of the text itself becomes U+0001 'e' first.
_ESC = "\u0001"

BROKEN_QUOTING, WRONG_COUNT, INVALID_VALUE = "broken_quoting", "wrong_count", "invalid_value"


@dataclass(frozen=True)
class NumberRule:
    """Plain ASCII digits with at most one inner point, between two bounds; empty text and the tokens of `missing` are null."""

    low: int
    high: int
    missing: tuple[str, ...] = ("", "NA")


@dataclass(frozen=True)
class ChoiceRule:
    allowed: tuple[str, ...]


@dataclass(frozen=True)
class DelimitedLayout:
    columns: tuple[tuple[str, str], ...]
    rules: dict[str, NumberRule | ChoiceRule] = field(default_factory=dict)
    missing: tuple[str, ...] = ("", "NA")
    verbatim: tuple[str, ...] = ()  # text columns that keep white space and spellings of a missing value, but for blank ones


CREDIT_LAYOUT = DelimitedLayout(
    columns=(
        ("duration", "double"),
        ("credit_amount", "double"),
        ("age", "double"),
        ("installment_rate", "int"),
        ("sex", "string"),
        ("target", "int"),
        ("remark", "string"),
    ),
    rules={
        "duration": NumberRule(4, 72),
        "credit_amount": NumberRule(250, 20000),
        "target": ChoiceRule(("0", "1")),
    },
    verbatim=("remark",),
)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once. The optimiser copies an ordinary column into every predicate that it pushes
    below it, and then it is computed anew for each use, within a lambda even for each element; it can't do so with a generator's output."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _pieces(record: Column) -> Column:
    """The record cut at its quotes: even pieces lie outside quotes, odd ones inside."""
    return F.split(F.regexp_replace(record, _ESC, _ESC + "e"), '"', -1)


def _quoting_is_sound(pieces: Column) -> Column:
    """A quote may open only at a field's start and close only at its end. An empty piece between two quoted
    ones is a doubled quote, which goes on with the same field."""
    count = F.size(pieces)

    def fits(piece: Column, at: Column) -> Column:
        first, last = at == 0, at == count - 1
        inside = (at % 2) == 1
        after_quote = first | piece.startswith(",")
        before_quote = last | piece.endswith(",")
        edge = (first | last) & (piece == "")
        return inside | edge | (~first & ~last & (piece == "")) | (after_quote & before_quote)

    checks = F.transform(pieces, lambda piece, at: fits(piece, at))
    return (count == 1) | (((count % 2) == 1) & F.forall(checks, lambda ok: ok))


def _fields(pieces: Column) -> Column:
    """The fields as text, quotes removed. Only right where the quoting is sound."""
    count = F.size(pieces)

    def plain(piece: Column, at: Column) -> Column:
        quoted = F.replace(piece, F.lit(","), F.lit(_ESC + "c"))
        doubled = (piece == "") & (at > 0) & (at < count - 1)
        return F.when((at % 2) == 1, quoted).when(doubled, F.lit(_ESC + "q")).otherwise(piece)

    joined = F.array_join(F.transform(pieces, plain), "")

    def restore(text: Column) -> Column:
        text = F.replace(text, F.lit(_ESC + "c"), F.lit(","))
        text = F.replace(text, F.lit(_ESC + "q"), F.lit('"'))
        return F.replace(text, F.lit(_ESC + "e"), F.lit(_ESC))

    return F.transform(F.split(joined, ",", -1), restore)


def _is_number(text: Column, rule: NumberRule) -> Column:
    """Bounds hold for the written digits, not only for the nearest double."""
    number = text.try_cast("double")
    shaped = text.rlike(r"\A[0-9]+(\.[0-9]+)?\z")
    above = F.when(number == rule.low, text.rlike(rf"\A0*{rule.low}(\.[0-9]+)?\z")).otherwise(number > rule.low)
    below = F.when(number == rule.high, text.rlike(rf"\A0*({rule.high}(\.0+)?|{rule.high - 1}\.[0-9]+)\z")).otherwise(number < rule.high)
    return text.isin(*rule.missing) | (shaped & above & below)


def check_records(df: DataFrame, text_col: str, layout: DelimitedLayout) -> DataFrame:
    """The input with `_values` (fields as text) and `_errors` (reason and column of every rule that a record breaks; the column is null for its layout)."""
    record = F.rtrim(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"))
    df = _held(df, "_pieces", _pieces(record))
    df = _held(df, "_sound", _quoting_is_sound(F.col("_pieces")))
    df = _held(df, "_values", F.when(F.col("_sound"), _fields(F.col("_pieces"))))
    counted = F.size("_values") == len(layout.columns)
    error = lambda reason, column: F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column"))
    errors = [
        F.when(~F.col("_sound"), error(BROKEN_QUOTING, None)),
        F.when(F.col("_sound") & ~counted, error(WRONG_COUNT, None)),
    ]
    for at, (name, _) in enumerate(layout.columns):
        rule = layout.rules.get(name)
        if rule is None:
            continue
        text = F.trim(F.get(F.col("_values"), F.lit(at)))
        fits = _is_number(text, rule) if isinstance(rule, NumberRule) else text.isin(*rule.allowed)
        errors.append(F.when(F.col("_sound") & counted & ~F.coalesce(fits, F.lit(False)), error(INVALID_VALUE, name)))
    return _held(df, "_errors", F.array_compact(F.array(*errors))).drop("_pieces", "_sound")


def checked_once(df: DataFrame, text_col: str, layout: DelimitedLayout) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected records, parsed once and written down for both."""
    held = cut(check_records(df, text_col, layout))
    return _typed(held, df.columns, text_col, layout), _reasons(held)


def _reasons(held: DataFrame) -> DataFrame:
    columns = F.array_compact(F.transform("_errors", lambda e: e["column"]))
    return held.filter(F.size("_errors") > 0).drop("reason", "columns").withColumns({"reason": F.element_at("_errors", 1)["reason"], "columns": columns}).drop("_values", "_errors")


def rejected(df: DataFrame, text_col: str, layout: DelimitedLayout) -> DataFrame:
    """Records that can't be parsed, with `reason` (the first one) and `columns` (those with a value that breaks its rule)."""
    return _reasons(check_records(df, text_col, layout))


def accepted(df: DataFrame, text_col: str, layout: DelimitedLayout) -> DataFrame:
    """Valid records as typed columns. Fields without a rule that do not fit their type are null."""
    return _typed(check_records(df, text_col, layout), df.columns, text_col, layout)


def _typed(held: DataFrame, given: list[str], text_col: str, layout: DelimitedLayout) -> DataFrame:
    produced = {name for name, _ in layout.columns}
    keep = [F.col(f"`{c}`") for c in given if c not in produced and c != text_col]
    typed = []
    for at, (name, kind) in enumerate(layout.columns):
        text = F.get(F.col("_values"), F.lit(at))
        trimmed = F.trim(text)
        known = F.when(~trimmed.isin(*layout.missing), trimmed)
        typed.append((F.when(trimmed != "", text) if name in layout.verbatim else known.try_cast(kind)).alias(name))
    return held.filter(F.size("_errors") == 0).select(*keep, *typed)
