"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

What is classified is the sender's own wording (mailtext.py), sentence by sentence; a document has the subjects of which one of
its sentences speaks clearly enough. Labels, however, are given to whole documents, so training goes in rounds: sentences get soft
targets among their document's labels (or none), the classifiers are refitted on them, and so on.

1. `parsed` reads every message once: its own wording, its subject line and its address path.
2. The hand-made labels start the training.
3. Every document without a hand-made label is given weak labels from its metadata: what the first classifiers say of its subject line, weighed by
   the places on its address path (`Places`). The weakly labelled join the training.
4. Thresholds are calibrated per subject on a held-out fifth of the sampled labelled documents and on all labelled documents
   outside the sample, which are scored in a distributed pass.
5. Every document is classified over its whole text, without a shuffle.

Nothing is left out of a wording for the words in it: that notices at the foot of a message name subjects they are not about is
learned from their turning up beside any label.

Features are hashed on the executors, and the classifiers are fitted there too, side by side, some subjects and one part of the sample per task.
The sample is bounded by `labelled_docs` and `weak_docs`, the documents with the least hashes of their ids; its hashed features and the counts of the
calibration are all that goes to the driver. The model is a table of 2**bits rows, whatever it was trained on.

Defined results: null, empty and blank texts have no subject; labels are trimmed and lower-cased, unknown and null ones ignored;
`none` beside a subject is ignored; without any usable label no document gets a subject; repeated rows each get their result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.mailtext import address_path, own_wording, subject_line
from assay.operators.ranks import few_or_shuffled
from assay.session import cut

NONE = "none"


@dataclass(frozen=True)
class SubjectSpec:
    bits: int = 18
    labelled_docs: int = 6000  # bound of the sample of hand-labelled documents to fit on
    weak_docs: int = 3000  # bound of the sample of weakly labelled documents to fit on
    held_out: int = 5  # one in so many labelled documents calibrates
    rounds: int = 3
    steps: int = 40
    ridge: float = 0.4
    stray: float = 0.02  # weight of subjects that a document is not labelled with: labels err
    weak_above: float = 0.4
    least_docs: int = 2  # n-grams of fewer training sentences are left out
    most_subjects: int | None = None  # per document; None for any number
    subjects_per_task: int = 2
    place_bits: int = 16
    seed: int = 5


DEFAULT = SubjectSpec()

_WORD = re.compile(r"[^\W\d_]+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def sentences(wording: str) -> list[list[str]]:
    """The words of each sentence, lower case."""
    found = (_WORD.findall(sentence.lower()) for paragraph in _PARAGRAPH.split(wording) for sentence in _SENTENCE.split(paragraph))
    return [words for words in found if words]


def _crc(text: str, mask: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & mask


def hashed(words: list[str], mask: int) -> set[int]:
    """Hashed words, pairs of words and word beginnings."""
    grams = set(words)
    grams.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    grams.update("~" + w[:5] for w in words if len(w) > 5)
    return {_crc(g, mask) for g in grams}


def features(text: str | None, spec: SubjectSpec) -> tuple[list[int], list[int]]:
    """Of a text the number of n-grams of each sentence, and the n-grams themselves."""
    mask = (1 << spec.bits) - 1
    grams = [sorted(hashed(words, mask)) for words in sentences(text)] if text else []
    return [len(g) for g in grams], [x for g in grams for x in g]


@dataclass
class Bag:
    """Sentences of documents as parallel arrays: the document of each sentence, and (sentence, n-gram) pairs in order of sentences."""

    document: np.ndarray
    row: np.ndarray
    gram: np.ndarray
    documents: int

    @staticmethod
    def of_features(found: Iterable[tuple[Iterable[int], Iterable[int]]]) -> Bag:
        found = list(found)
        whole = lambda parts: np.concatenate([np.asarray(p, dtype=np.int32) for p in parts] or [np.zeros(0, dtype=np.int32)])
        sizes = whole(s for s, _ in found)
        document = np.repeat(np.arange(len(found), dtype=np.int32), [len(s) for s, _ in found])
        return Bag(document, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), whole(g for _, g in found), len(found))

    @staticmethod
    def of(texts: Iterable[str | None], spec: SubjectSpec) -> Bag:
        return Bag.of_features(features(t, spec) for t in texts)

    def only(self, documents: np.ndarray) -> Bag:
        """The part of the documents that are true in a mask; they keep their numbers."""
        kept = documents[self.document]
        number = (np.cumsum(kept) - 1).astype(np.int32)
        pairs = kept[self.row] if len(self.row) else np.zeros(0, dtype=bool)
        return Bag(self.document[kept], number[self.row[pairs]], self.gram[pairs], self.documents)


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # (2**bits + 1, subjects); the last row is the bias
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def sentence_scores(self, bag: Bag) -> np.ndarray:
        n = len(bag.document)
        z = np.tile(self.weights[-1], (n, 1))
        if len(bag.row):
            starts = np.flatnonzero(np.r_[True, bag.row[1:] != bag.row[:-1]])
            z[bag.row[starts]] += np.add.reduceat(self.weights[bag.gram], starts, axis=0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def document_scores(self, bag: Bag) -> np.ndarray:
        """The clearest sentence of each document, by subject."""
        out = np.zeros((bag.documents, len(self.subjects)), dtype=np.float32)
        if len(bag.document):
            starts = np.flatnonzero(np.r_[True, bag.document[1:] != bag.document[:-1]])
            out[bag.document[starts]] = np.maximum.reduceat(self.sentence_scores(bag), starts, axis=0)
        return out


def _fit(bag: Bag, targets: np.ndarray, start: np.ndarray, used: np.ndarray, spec: SubjectSpec) -> np.ndarray:
    """Independent logistic regressions on soft targets, by Adam, from `start`: the weights of the used n-grams and the bias, a column per subject."""
    n = len(bag.document)
    known = np.full((1 << spec.bits) + 1, -1, dtype=np.int32)
    known[used] = np.arange(len(used), dtype=np.int32)
    col = known[bag.gram]
    kept = col >= 0
    col, row = col[kept], bag.row[kept]
    out = np.vstack([start[used], start[-1:]]).astype(np.float32)
    if not len(row):
        return out
    row_of_col = row[np.argsort(col, kind="stable")]
    col_starts = np.r_[0, np.cumsum(np.bincount(col, minlength=len(used)))[:-1]]  # every used n-gram occurs
    row_starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows = row[row_starts]
    z = np.empty(n, dtype=np.float32)
    for s in range(out.shape[1]):
        w, target = out[:, s].copy(), targets[:, s]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, spec.steps + 1):
            z[:] = w[-1]
            z[rows] += np.add.reduceat(w[col], row_starts)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target).astype(np.float32)
            gradient = spec.ridge * w
            gradient[-1] = error.sum()
            gradient[:-1] += np.add.reduceat(error[row_of_col], col_starts)
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            pace = 0.15 if step < 0.6 * spec.steps else 0.05
            w -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        out[:, s] = w
    return out


def _shared_out(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Soft targets: each sentence speaks of one allowed subject or of none."""
    odds = scores / (1 - np.minimum(scores, 1 - 1e-6))
    odds = odds * allowed
    return (odds / (1 + odds.sum(axis=1, keepdims=True))).astype(np.float32)


def _first_targets(bag: Bag, labels: np.ndarray, allowed: np.ndarray, size: int) -> np.ndarray:
    """Before any model: a sentence speaks of the allowed subject that its purest n-gram points at."""
    count = np.bincount(bag.gram, minlength=size).astype(np.float32)
    share = labels[bag.document].mean(axis=0)
    best = np.zeros_like(allowed)
    starts = np.flatnonzero(np.r_[True, bag.row[1:] != bag.row[:-1]])
    for s in range(labels.shape[1]):
        hits = np.bincount(bag.gram, labels[bag.document[bag.row], s], minlength=size)
        purity = ((hits + 4 * share[s]) / (count + 4)) * (count >= 3)
        best[bag.row[starts], s] = np.maximum.reduceat(purity[bag.gram], starts)
    q = best**2 * allowed
    q = np.where(q >= q.max(axis=1, keepdims=True) * 0.999, q, 0.2 * q)
    return (q / (q.sum(axis=1, keepdims=True) + 0.25)).astype(np.float32)


GRID = np.round(np.arange(0.04, 0.72, 0.02), 2)


def tally(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """By grid value and subject: documents found, rightly found, and labelled. Tallies of parts add up to that of the whole."""
    found = scores[None, ...] > GRID.reshape(-1, 1, 1)
    right = labels > 0
    return np.stack([found.sum(axis=1), (found & right).sum(axis=1), np.tile(right.sum(axis=0), (len(GRID), 1))], axis=2).astype(np.int64)


def calibrate(counts: np.ndarray) -> np.ndarray:
    """From a tally, per subject the threshold of the best F1, in the middle of what is nearly as good; drawn to the common one where labels are few."""

    def middle(c: np.ndarray) -> float:
        curve = 2 * c[:, 1] / np.maximum(c[:, 0] + c[:, 2], 1)
        near = GRID[curve >= curve.max() - 0.004]
        return float((near.min() + near.max()) / 2)

    common = middle(counts.sum(axis=1))
    out = []
    for s in range(counts.shape[1]):
        support = counts[0, s, 2]
        own = middle(counts[:, s]) if support else common
        trust = support / (support + 60)
        out.append(trust * own + (1 - trust) * common)
    return np.array(out)


@dataclass
class Sample:
    """Hashed documents with their labels, one row per document; hand-labelled ones come first."""

    bag: Bag
    labels: np.ndarray  # (documents, subjects), 1 for a label
    hand: np.ndarray  # mask

    def join(self, other: Sample) -> Sample:
        a, b = self.bag, other.bag
        bag = Bag(np.r_[a.document, b.document + np.int32(a.documents)], np.r_[a.row, b.row + np.int32(len(a.document))], np.r_[a.gram, b.gram], a.documents + b.documents)
        return Sample(bag, np.vstack([self.labels, other.labels]), np.r_[self.hand, other.hand])


def _local(tasks: int, work: Callable[[int], np.ndarray]) -> list[np.ndarray]:
    return [work(i) for i in range(tasks)]


def on_executors(spark: SparkSession) -> Callable[[int, Callable[[int], np.ndarray]], list[np.ndarray]]:
    """Runs tasks as partitions of a small job; each gives an array of weights."""

    def run(tasks: int, work: Callable[[int], np.ndarray]) -> list[np.ndarray]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in batch["id"]:
                    yield pd.DataFrame({"id": [i], "made": [work(int(i)).astype("<f4").tobytes()]})

        rows = spark.range(0, tasks, 1, tasks).mapInPandas(each, "id long, made binary").collect()  # as large as the model, whatever the data
        made = {r["id"]: np.frombuffer(r["made"], dtype="<f4") for r in rows}
        return [made[i] for i in range(tasks)]

    return run


class _Sent:
    """What tasks share, sent once to each executor; plain where there are none."""

    def __init__(self, spark: SparkSession | None, value: object) -> None:
        self._held = spark.sparkContext.broadcast(value) if spark else None
        self._plain = None if spark else value

    @property
    def value(self) -> object:
        return self._held.value if self._held else self._plain

    def drop(self) -> None:
        if self._held:
            self._held.unpersist()


def learn(sample: Sample, parts: list[np.ndarray], starts: list[np.ndarray | None], rounds: int, spec: SubjectSpec, spark: SparkSession | None = None) -> list[np.ndarray]:
    """The weights of one model for each part of the sample (masks of documents), from its start or from nothing.

    Every round is one job with a task for each part and few subjects: logistic regressions of different subjects don't touch each other within a round."""
    size, n = (1 << spec.bits) + 1, sample.labels.shape[1]
    run = on_executors(spark) if spark else _local
    bags = [sample.bag.only(part) for part in parts]
    allowed = [np.where(sample.labels[b.document] > 0, 1.0, spec.stray).astype(np.float32) for b in bags]
    used = [np.flatnonzero(np.bincount(b.gram, minlength=size - 1) >= spec.least_docs) for b in bags]
    groups = [list(range(s, min(n, s + spec.subjects_per_task))) for s in range(0, n, spec.subjects_per_task)]
    weights, targets = [], []
    for bag, start, ok in zip(bags, starts, allowed, strict=True):
        if start is None:
            start = np.zeros((size, n), dtype=np.float32)
            start[-1] = -2 if len(bag.document) else -10
            targets.append(_first_targets(bag, sample.labels, ok, size - 1) if len(bag.document) else np.zeros((0, n), np.float32))
        else:
            targets.append(_shared_out(Model([], start).sentence_scores(bag), ok))
        weights.append(start)
    fixed = _Sent(spark, (sample.bag, parts, used))
    for at in range(rounds):
        now = _Sent(spark, (weights, targets))

        def work(i: int, now: _Sent = now) -> np.ndarray:
            part, group = divmod(i, len(groups))
            (bag, its_parts, its_used), (its_weights, its_targets) = fixed.value, now.value
            picked = groups[group]
            return _fit(bag.only(its_parts[part]), its_targets[part][:, picked], its_weights[part][:, picked], its_used[part], spec).ravel()

        made = run(len(parts) * len(groups), work)
        now.drop()
        for part, start in enumerate(weights):
            out = start.copy()
            for group, picked in enumerate(groups):
                out[np.ix_(np.r_[used[part], size - 1], picked)] = made[part * len(groups) + group].reshape(-1, len(picked))
            weights[part] = out
            if at + 1 < rounds:
                targets[part] = _shared_out(Model([], out).sentence_scores(bags[part]), allowed[part])
    fixed.drop()
    return weights


class Places:
    """How much oftener than elsewhere a subject is written about at a place of an address path, learned from labelled documents: a bounded table by the
    place's hash. A place that bears a subject's name counts as if that many labels said so."""

    NAMED, PRIOR, LEAST = 8, 4, 3

    def __init__(self, paths: list[list[str]], labels: np.ndarray, subjects: list[str], spec: SubjectSpec) -> None:
        self.mask = (1 << spec.place_bits) - 1
        share = (labels.sum(axis=0) + 1) / (len(labels) + len(subjects) + 1)
        hits, count = np.zeros((self.mask + 1, len(subjects))), np.zeros(self.mask + 1)
        for path, own in zip(paths, labels, strict=True):
            for h in {_crc(p, self.mask) for p in path}:
                hits[h] += own
                count[h] += 1
        for s, name in enumerate(subjects):
            for word in _WORD.findall(name):
                h = _crc("/" + word, self.mask)
                hits[h, s] += self.NAMED
                count[h] += self.NAMED
        ratio = (hits + self.PRIOR * share) / ((count[:, None] + self.PRIOR) * share)
        self.ratio = np.where(count[:, None] >= self.LEAST, ratio, 1.0).astype(np.float32)

    def ratios(self, paths: Iterable[Iterable[str]]) -> np.ndarray:
        """Of each path, by subject, the ratio at the place that says most."""
        out = []
        for path in paths:
            at = self.ratio[[_crc(p, self.mask) for p in path] if path is not None and len(path) else [0]]
            if path is None or not len(path):
                at = np.ones_like(at)
            out.append(at[np.abs(np.log(at)).argmax(axis=0), np.arange(at.shape[1])])
        return np.array(out).reshape(len(out), self.ratio.shape[1])


def weak_scores(model: Model, places: Places, lines: Bag, paths: Iterable[Iterable[str]]) -> np.ndarray:
    """By document and subject how likely its metadata make the subject: the classifiers' score of the subject line, its odds multiplied by the address path's ratio."""
    base = 1 / (1 + np.exp(-model.weights[-1]))  # of a line that says nothing
    scores = np.clip(np.maximum(model.document_scores(lines), base), 1e-6, 1 - 1e-6)
    odds = scores / (1 - scores) * places.ratios(paths)
    return odds / (1 + odds)


def train(sample: Sample, paths: list[list[str]], subjects: list[str], spec: SubjectSpec = DEFAULT, weak: Callable[[Model, Places], Sample] | None = None, outside: Callable[[Model], np.ndarray] | None = None, spark: SparkSession | None = None) -> Model:
    """From hand-labelled documents and their address paths. `weak` gives weakly labelled documents by a first model, `outside` a model's tally over labelled documents that aren't among these."""
    n = sample.bag.documents
    if not n or not subjects:
        return Model(subjects, np.zeros(((1 << spec.bits) + 1, len(subjects)), np.float32), np.ones(len(subjects)))
    every = np.ones(n, dtype=bool)
    turn = np.arange(n) % spec.held_out
    # Where a fifth is too few to calibrate on, each fifth in turn is scored by a model of the others.
    folds = [0] if n >= 10 * spec.held_out else list(range(spec.held_out))
    parts = [*(turn != k for k in folds), every]
    first = learn(sample, parts, [None] * len(parts), spec.rounds, spec, spark)
    if weak:
        more = weak(Model(subjects, first[0]), Places([p for p, kept in zip(paths, parts[0], strict=True) if kept], sample.labels[parts[0]], subjects, spec))
        if more.bag.documents:
            sample = sample.join(more)
            parts = [np.r_[part, np.ones(more.bag.documents, dtype=bool)] for part in parts]
            first = learn(sample, parts, first, 2, spec, spark)
    counts = sum(tally(Model(subjects, first[at]).document_scores(sample.bag)[:n][turn == k], sample.labels[:n][turn == k]) for at, k in enumerate(folds))
    thresholds = calibrate(counts + (outside(Model(subjects, first[0])) if outside else 0))
    return Model(subjects, first[-1], thresholds)


def chosen(model: Model, scores: np.ndarray, most: int | None = None) -> list[list[str]]:
    """The subjects above their thresholds, the clearest first; at most `most` of them if that is given."""
    over = scores / model.thresholds
    order = np.argsort(-over, axis=1, kind="stable")[:, :most]
    return [[model.subjects[s] for s in row if over[i, s] > 1] for i, row in enumerate(order)]


_PARSED = (("_id", T.LongType(), pa.int64()), ("_wording", T.StringType(), pa.string()), ("_line", T.StringType(), pa.string()), ("_path", T.ArrayType(T.StringType()), pa.list_(pa.string())))
TEXTS_AT_ONCE = 512


def parsed(documents: DataFrame, key: str, text: str, places: tuple[str, ...] = ()) -> DataFrame:
    """Every message read once: all columns but the text, and `_id`, `_wording`, `_line` and `_path`, written down for all that follows. `places` are columns that belong to the address path."""
    made = {name for name, _, _ in _PARSED}
    keep = [f for f in documents.schema.fields if f.name != text and f.name not in made]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t, _ in _PARSED)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = {n: i for i, n in enumerate(whole.schema.names)}
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                texts = batch.column(at["_text"]).to_pylist()
                extra = list(zip(*(batch.column(at[p]).to_pylist() for p in places), strict=True)) if places else [()] * len(texts)
                values = ([own_wording(t) for t in texts], [subject_line(t) for t in texts], [address_path(t, *x) for t, x in zip(texts, extra, strict=True)])
                columns = [*(batch.column(at[n]) for n in names), batch.column(at["_key"]), *(pa.array(v, t) for v, (_, _, t) in zip(values, _PARSED[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    rows = documents.select(*(F.col(f"`{n}`") for n in names), F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return cut(rows.mapInArrow(run, schema))


_FEATURES = "_id long, sizes array<int>, grams array<int>, _path array<string>"


def _hash_features(spec: SubjectSpec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b for b in batches if len(b)):
            made = [features(t, spec) for t in batch["_wording"]]
            yield pd.DataFrame({"_id": batch["_id"], "sizes": [s for s, _ in made], "grams": [g for _, g in made], "_path": batch["_path"]})

    return run


def _place(spec: SubjectSpec, salt: int):
    return F.xxhash64(F.lit(spec.seed + salt), "_id")


def _weak_sample(messages: DataFrame, usable: DataFrame, spec: SubjectSpec, model: Model, places: Places) -> Sample:
    """Weak labels for all messages; of the messages that get any, the `weak_docs` of least hash, without those that have hand-made labels."""
    spark = messages.sparkSession
    sent = spark.sparkContext.broadcast((model.subjects, model.weights, places))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subjects, weights, its_places = sent.value
        for whole in batches:
            for start in range(0, len(whole), TEXTS_AT_ONCE):
                batch = whole.iloc[start : start + TEXTS_AT_ONCE]
                found = weak_scores(Model(subjects, weights), its_places, Bag.of(batch["_line"], spec), batch["_path"]) > spec.weak_above
                some = found.any(axis=1)
                if some.any():
                    yield pd.DataFrame({"_id": batch["_id"].to_numpy()[some], "given": [np.flatnonzero(f).tolist() for f in found[some]]})

    weak = messages.filter(F.col("_id").isNotNull()).select("_id", "_line", "_path").mapInPandas(score, "_id long, given array<int>")
    # Labels alone are brought together by document; wordings are fetched for the sample only.
    picked = cut(weak.groupBy("_id").agg(F.min("given").alias("given")).orderBy(_place(spec, 1), "_id").limit(spec.weak_docs))
    named = usable.select("_id").join(F.broadcast(picked.select("_id")), "_id", "left_semi").distinct()
    free = cut(picked.join(named, "_id", "left_anti"))
    texts = messages.select("_id", "_wording", "_path").join(F.broadcast(free.select("_id")), "_id", "left_semi")
    once = texts.groupBy("_id").agg(F.min(F.struct("_wording", "_path")).alias("r")).select("_id", "r.*")
    rows = sorted(free.join(once.mapInPandas(_hash_features(spec), _FEATURES), "_id").collect(), key=lambda r: r["_id"])  # at most weak_docs
    labels = np.zeros((len(rows), len(model.subjects)), dtype=np.float32)
    for i, r in enumerate(rows):
        labels[i, r["given"]] = 1
    return Sample(Bag.of_features((r["sizes"], r["grams"]) for r in rows), labels, np.zeros(len(rows), dtype=bool))


LABELS_SENT = 300_000  # hand-made labels of more documents than these are joined by a shuffle of the wordings


def _outside(messages: DataFrame, given: DataFrame, spec: SubjectSpec, model: Model) -> np.ndarray:
    """A model's tally over labelled documents, in one pass: given(_id, given). Only counts are shuffled and go to the driver, as long as the labels are few enough to be sent to the wordings."""
    sent = messages.sparkSession.sparkContext.broadcast((model.subjects, model.weights))
    shape = (len(GRID), len(model.subjects), 3)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for whole in batches:
            for start in range(0, len(whole), TEXTS_AT_ONCE):
                batch = whole.iloc[start : start + TEXTS_AT_ONCE]
                marks = np.array([[s in set(g) for s in own.subjects] for g in batch["given"]], dtype=bool).reshape(-1, len(own.subjects))
                total = tally(own.document_scores(Bag.of(batch["_wording"], spec)), marks)
                yield pd.DataFrame({"place": np.arange(total.size), "n": total.ravel()})

    counted = messages.select("_id", "_wording").join(few_or_shuffled(given, LABELS_SENT), "_id").mapInPandas(score, "place long, n long")
    counts = np.zeros(int(np.prod(shape)), dtype=np.int64)
    for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():  # one row per cell of the tally
        counts[r["place"]] = r["n"]
    return counts.reshape(shape)


def fit(messages: DataFrame, labels: DataFrame, areas: DataFrame, spec: SubjectSpec = DEFAULT, key: str = "doc_id", subject: str = "subject") -> Model:
    """Train on bounded samples, calibrate on all labels: messages of `parsed`, labels(key, subject), areas(subject)."""
    spark = messages.sparkSession
    subjects = sorted({r[0].strip().lower() for r in areas.select(subject).distinct().collect() if r[0]})  # a fixed small table
    usable = labels.select(F.col(key).cast("long").alias("_id"), F.lower(F.trim(subject)).alias("_subject")).filter(F.col("_subject").isin(*subjects, NONE) & F.col("_id").isNotNull())
    given = cut(usable.groupBy("_id").agg(F.array_sort(F.collect_set("_subject")).alias("given")))
    picked = cut(given.orderBy(_place(spec, 0), "_id").limit(spec.labelled_docs))
    hand = messages.select("_id", "_wording", "_path").join(F.broadcast(picked), "_id")  # at most labelled_docs
    once = hand.groupBy("_id").agg(F.min(F.struct("given", "_wording", "_path")).alias("r")).select("_id", "r.*")
    hashed_rows = cut(once).select("_id", "_wording", "_path").mapInPandas(_hash_features(spec), _FEATURES).join(picked, "_id")
    rows = sorted(hashed_rows.collect(), key=lambda r: r["_id"])  # at most labelled_docs
    marks = np.array([[s in r["given"] for s in subjects] for r in rows], dtype=np.float32).reshape(len(rows), len(subjects))
    sample = Sample(Bag.of_features((r["sizes"], r["grams"]) for r in rows), marks, np.ones(len(rows), dtype=bool))
    rest = cut(given.join(F.broadcast(picked.select("_id")), "_id", "left_anti"))
    return train(sample, [r["_path"] for r in rows], subjects, spec, lambda m, p: _weak_sample(messages, given, spec, m, p), lambda m: _outside(messages, rest, spec, m), spark)


def assign(messages: DataFrame, model: Model, spec: SubjectSpec = DEFAULT) -> DataFrame:
    """All columns of the documents but the text, and `subjects`, an array that may be empty."""
    keep = [f for f in messages.schema.fields if f.name not in {n for n, _, _ in _PARSED} and f.name != "subjects"]
    schema = T.StructType([*keep, T.StructField("subjects", T.ArrayType(T.StringType()))])
    sent = messages.sparkSession.sparkContext.broadcast((model.subjects, model.weights, model.thresholds))  # 2**bits rows, fixed
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for whole in batches:
            at = {n: i for i, n in enumerate(whole.schema.names)}
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                bag = Bag.of(batch.column(at["_wording"]).to_pylist(), spec)
                found = chosen(own, own.document_scores(bag), spec.most_subjects)
                yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array(found, pa.list_(pa.string()))], names=[*names, "subjects"])

    return messages.select(*(F.col(f"`{n}`") for n in names), "_wording").mapInArrow(run, schema)
