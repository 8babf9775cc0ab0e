"""Token ids of a whole corpus by a public tokenizer: overlapping chunk encoding.

Short texts are one chunk each and are encoded where they lie, without any shuffle. A long text is cut into chunks
that overlap by `overlap` characters, and the chunks are pre-tokenised in parallel, each from its own start. Pre-tokenising
has no memory: what follows a boundary depends only on the text after it. So where a boundary found by one chunk
in the overlap is also found by the next one, the two agree from there on. They are right there if the earlier chunk is, and
that one is right from its first change of a non-space to a white space on, since no pre-token spans such a change, wherever it was begun.
The text is cut at that place, each chunk encodes its own piece, and the ids are put together in order. A text of which two chunks share no
such boundary within the overlap is put together again and encoded in the pieces that it has.

The corpus is scanned twice, once for the short and once for the long texts. A long text is shuffled once, as chunks, which are written down: what
is sent to them after that is only where to cut.

Defined results: an empty text and a null text both give an empty list; special-token strings in a text are ordinary
text; every input row gives one row, with repeated rows and null ids too; columns of the input that clash with
produced ones are replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.ranks import few_or_shuffled
from assay.session import cut

#: Where the public vocabularies lie; they are not part of this package.
TOKENIZERS = os.environ.get("ASSAY_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ChunkSpec:
    """Sizes in characters. Texts of up to `chunk` are not cut."""

    chunk: int = 16384
    overlap: int = 512
    folder: str = TOKENIZERS


DEFAULT = ChunkSpec()
ROWS_AT_ONCE = 512  # so many texts' ids are held as Python objects


@lru_cache(maxsize=4)
def byte_encoding(name: str, folder: str = TOKENIZERS):
    """A byte-level tokenizer without special tokens, once per Python worker."""
    import tiktoken

    path = os.path.join(folder, f"{name}.tiktoken")
    with open(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def send_vocabulary(spark: SparkSession, name: str, folder: str = TOKENIZERS) -> None:
    """Give executors that don't have the folder the driver's vocabulary file (about a megabyte), once per application."""
    sent = (spark.sparkContext.applicationId, name, folder)
    path = os.path.join(folder, f"{name}.tiktoken")
    if sent not in _sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
    _sent.add(sent)


_sent: set[tuple[str, str, str]] = set()


def decode_bytes(ids: Iterable[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The raw bytes of the ids, put together."""
    encoding = byte_encoding(name, folder)
    return b"".join(encoding.decode_single_token_bytes(int(i)) for i in ids)


def decode(ids: Iterable[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The same as text."""
    return decode_bytes(ids, name, folder).decode("utf-8", errors="replace")


_pre = regex.compile(PATTERN)


def boundaries(text: str, start: int, stop: int, first: int) -> list[int]:
    """Ends of the pre-tokens from `start`, at or after `first`; only those that don't hinge on text beyond `stop`."""
    ends = [m.end() for m in _pre.finditer(text, start, stop)]
    if stop < len(text):
        ends = ends[:-2]  # the last pre-tokens may go on or split differently beyond the end
    return [e for e in ends if e >= first]


_certain = regex.compile(r"\S(?=\s)")


def head_and_tail(part: str, first: bool, spec: ChunkSpec) -> tuple[list[int], list[int]]:
    """A chunk's boundaries within its overlap with the chunk before it, and those within the overlap with the one after it that are certain."""
    found = [0, *boundaries(part, 0, min(len(part), spec.chunk + spec.overlap), 0)]
    mark = _certain.search(part)
    certain = 0 if first else mark.end() if mark else len(part) + 1
    return _usable(part, [b for b in found if b <= spec.overlap]), _usable(part, [b for b in found if max(spec.chunk, certain) <= b <= spec.chunk + spec.overlap])


def _usable(part: str, found: list[int]) -> list[int]:
    """Boundaries to cut at: none after a white space, since how a run of them is split hinges on what follows it; where there are
    some before a plain space or line feed only those, as they don't hinge on any table of letters."""
    found = [b for b in found if b == 0 or not part[b - 1].isspace()]
    return [b for b in found if part[b : b + 1] in (" ", "\n")] or found


def shared_cut(tail: Iterable[int], head: Iterable[int]) -> int | None:
    common = set(tail) & set(head)
    return min(common) if common else None


CHUNKS_AT_ONCE = 256


def _chunked(keep: list[str], spec: ChunkSpec):
    """Rows of chunks: `_row` (a number of the text), `no`, `part`, and with the first chunk the columns to keep as `_k0`, `_k1`, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            made: list[tuple[int, int, str, int | None]] = []
            for i, text in enumerate(batch.column(at["_text"]).to_pylist()):
                for no, start in enumerate(range(0, len(text), spec.chunk)):
                    # What a chunk needs: itself, the overlap after it, and two characters to look ahead at.
                    made.append((row, no, text[start : start + spec.chunk + spec.overlap + 2], None if no else i))
                    if len(made) == CHUNKS_AT_ONCE:
                        yield _chunk_batch(made, batch, at, keep)
                        made = []
                row += 1
            if made:
                yield _chunk_batch(made, batch, at, keep)

    return run


def _chunk_batch(made: list[tuple], batch: pa.RecordBatch, at: dict[str, int], keep: list[str]) -> pa.RecordBatch:
    rows, numbers, parts, first = zip(*made, strict=True)
    origin = pa.array(first, pa.int64())
    kept = [batch.column(at[f"_k{i}"]).take(origin) for i in range(len(keep))]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.string()), *kept], names=["_row", "no", "part", *(f"_k{i}" for i in range(len(keep)))])


def _cuts(chunks: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Of each long text `cuts`: for each chunk but the first where its piece begins, in characters of the text, null where it shares no boundary with the chunk before."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [head_and_tail(part, no == 0, spec) for no, part in zip(batch["no"], batch["part"], strict=True)]
            yield pd.DataFrame({"_row": batch["_row"], "no": batch["no"], "head": [h for h, _ in found], "tail": [[b - spec.chunk for b in t] for _, t in found]})

    marks = chunks.select("_row", "no", "part").mapInPandas(marked, "_row long, no int, head array<int>, tail array<int>")
    agreed = F.array_min(F.array_intersect("head", F.lag("tail").over(Window.partitionBy("_row").orderBy("no"))))
    at = marks.select("_row", "no", (F.col("no") * spec.chunk + agreed).alias("at"))
    return at.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "at"))), lambda c: c["at"]).alias("cuts"))


def _pieces(spec: ChunkSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            cut_from = []
            for no, part, cuts in zip(batch.column(at["no"]).to_pylist(), batch.column(at["part"]).to_pylist(), batch.column(at["cuts"]).to_pylist(), strict=True):
                begin = cuts[no] - no * spec.chunk if no else 0
                cut_from.append(part[begin : cuts[no + 1] - no * spec.chunk if no + 1 < len(cuts) else len(part)])
            kept = [(n, batch.column(i)) for n, i in at.items() if n not in ("part", "cuts")]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(cut_from, pa.string())], names=[*(n for n, _ in kept), "piece"])

    return run


def _rejoined(spec: ChunkSpec):
    """Texts with a missing cut, each put together from its chunks and cut where it can be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, parts, cuts in zip(batch["_row"], batch["parts"], batch["cuts"], strict=True):
                text = "".join(p["part"][: spec.chunk] for p in parts)
                edges = [0, *(int(c) for c in cuts if c is not None and c == c), len(text)]
                some = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                yield pd.DataFrame({"_row": [row] * len(some), "no": range(len(some)), "piece": some})

    return run


def _arrow_encode(name: str, spec: ChunkSpec, keep: list[str], text: str, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(name, spec.folder)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                encoded = [encoding.encode_ordinary(t) if t else [] for t in batch.column(batch.schema.names.index(text)).to_pylist()]
                kept = [batch.column(batch.schema.names.index(k)) for k in keep]
                values = pa.array([len(e) for e in encoded], pa.int64()) if counted else pa.array(encoded, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept, values], names=[*keep, "n_tokens" if counted else "ids"])

    return run


def _encoded(df: DataFrame, text: str, name: str, spec: ChunkSpec, counted: bool) -> DataFrame:
    send_vocabulary(df.sparkSession, name, spec.folder)
    made = "n_tokens" if counted else "ids"
    value = T.StructField(made, T.LongType() if counted else T.ArrayType(T.IntegerType()))
    keep = [c for c in df.columns if c not in (text, made)]
    kept_fields = [df.schema[c] for c in keep]
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))
    quoted = [F.col(f"`{c}`") for c in keep]
    own = "_text"
    while own in keep:
        own += "_"
    short = df.filter(size <= spec.chunk).select(*quoted, F.col(f"`{text}`").alias(own)).mapInArrow(_arrow_encode(name, spec, keep, own, counted), T.StructType([*kept_fields, value]))
    long_texts = df.filter(size > spec.chunk).select(*(c.alias(f"_k{i}") for i, c in enumerate(quoted)), F.col(f"`{text}`").alias("_text"))
    head = [T.StructField("_row", T.LongType()), T.StructField("no", T.IntegerType())]
    carried = [T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(kept_fields)]
    chunks = long_texts.mapInArrow(_chunked(keep, spec), T.StructType([*head, T.StructField("part", T.StringType()), *carried]))
    # Written down: numbers of texts must not change if a part of this has to run again.
    chunks = cut(chunks.repartition("_row", "no"))
    cuts = cut(_cuts(chunks, spec))
    whole = ~F.exists(F.slice("cuts", 2, F.greatest(F.size("cuts") - 1, F.lit(0))), lambda c: c.isNull())
    names = [f.name for f in carried]
    pieces = chunks.join(few_or_shuffled(cuts.filter(whole)), "_row").mapInArrow(_pieces(spec), T.StructType([*head, *carried, T.StructField("piece", T.StringType())]))
    done = pieces.mapInArrow(_arrow_encode(name, spec, ["_row", "no", *names], "piece", counted), T.StructType([*head, *carried, value]))
    torn = chunks.join(few_or_shuffled(cuts.filter(~whole)), "_row")
    rejoined = torn.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("parts"), F.first("cuts").alias("cuts")).mapInPandas(_rejoined(spec), "_row long, no int, piece string")
    mended = rejoined.mapInArrow(_arrow_encode(name, spec, ["_row", "no"], "piece", counted), T.StructType([*head, value]))
    first_chunks = torn.filter("no = 0").select(F.col("_row"), F.lit(-1).alias("no"), *names)  # the columns to keep
    every = done.unionByName(mended, allowMissingColumns=True).unionByName(first_chunks, allowMissingColumns=True)
    if counted:
        put_together = F.coalesce(F.sum(made), F.lit(0)).alias(made)
    else:
        in_order = F.array_sort(F.collect_list(F.when(F.col("no") >= 0, F.struct("no", made))))
        put_together = F.flatten(F.transform(in_order, lambda p: p[made])).alias(made)
    texts = every.groupBy("_row").agg(put_together, *(F.first(n, ignorenulls=True).alias(n) for n in names))
    return short.unionByName(texts.select(*(F.col(n).alias(f.name) for n, f in zip(names, kept_fields, strict=True)), made))


def token_ids(df: DataFrame, text: str, name: str = "byte_bpe_50k", spec: ChunkSpec = DEFAULT) -> DataFrame:
    """All columns but the text, and `ids`."""
    return _encoded(df, text, name, spec, counted=False)


def token_counts(df: DataFrame, text: str, name: str = "byte_bpe_50k", spec: ChunkSpec = DEFAULT) -> DataFrame:
    """All columns but the text, and `n_tokens`; the ids themselves never leave the Python workers."""
    return _encoded(df, text, name, spec, counted=True)
