"""Subject areas of documents, from a seeded non-negative factorisation.

The document-term matrix (all documents; terms are words hashed to a fixed
number of columns) is factored as X ~ W H under the Kullback-Leibler loss by
alternating multiplicative updates.  One component per subject is *anchored*:
it starts from the words of its description and of the documents labelled with
it, and in every update the labelled documents may load only on their own
subjects and on the background.  A few background components take up what all
notebooks share.  W is never kept: each pass over the corpus solves it per
document and adds up the update of H, which has a fixed size.

With H in place, a document's row of W is its subject mixture.  It is solved
over the document's different words, so a row adds up to their number, and a
subject's part of it is the number of words that the mixture gives to the
subject (its *mass*).  A document is about the subjects whose mass reaches
one bound for all subjects; a passing remark is a few words and stays below
it, however long or short the document.  The bound is where labelled documents
(a bounded number, ``LABEL_BOUND``) are told apart best.

Defined results: null, empty and blank texts have no subject and no row;
documents without subject words have none; labels of unknown documents or
subjects are left out, repeated labels count by their annotators; with no
labels at all the descriptions alone anchor the components and the bound is
``MASS``; without subjects no document has any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_table

COLUMNS = 1 << 15  # hashed terms, from 1 on
BACKGROUND = 6
ROUNDS = 3
LABEL_BOUND = 20_000
#: A word seen SEEN times in labelled documents can belong to a subject only with COMMON_SHARE times its even share there.
SEEN, COMMON_SHARE = 6.0, 3.0
#: Words' worth of a subject that make a document be about it, where too few labels tell.
MASS = 4.5
_INNER = 4  # updates of W per document and pass
_INNER_LAST = 8  # the same for the mixtures that count
_GROUP = 64  # partitions whose arrays are added up before they meet all others
_SMOOTH = 1e-3
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_NOISE = re.compile(r"[A-Za-z0-9+/=]{60,}")
_NO_TERM = 0xFFFF
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


class _Columns(dict):
    """Word -> column, without a plural ending; remembers a bounded number of words."""

    def __missing__(self, spelt: bytes) -> int:
        word = spelt.decode("utf-8", "replace")
        if not word.isalpha():
            column = _NO_TERM
        else:
            stem = word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith("ss") else word
            column = 1 + zlib.crc32(stem.encode("utf-8", "surrogatepass")) % (COLUMNS - 1)
        if len(self) > 300_000:
            self.clear()
        self[spelt] = column
        return column


_COLUMNS_OF = _Columns()


def terms(text: str) -> np.ndarray:
    """The columns of a text's words in order."""
    if max(map(len, text.split()), default=0) >= 60:
        text = _NOISE.sub(" ", text)  # base64 and the like
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    raw = text.lower().encode("utf-8", "surrogatepass").replace(b"\\n", b" ")
    of = _COLUMNS_OF
    found = np.array([of[w] for w in raw.translate(_BLANKS).split()], np.uint16)
    return found[found != _NO_TERM]


def bag(text: str) -> bytes:
    """A text's different columns and how often it has each."""
    columns, counts = np.unique(terms(text), return_counts=True)
    return np.concatenate((columns, np.minimum(counts, 0xFFFF).astype(np.uint16))).tobytes()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and not text.isspace():
                ids.append(doc_id)
                packed.append(bag(text))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "terms"])


class Matrix:
    """A slice of the document-term matrix in rows of (document, column, count)."""

    def __init__(self, packed: list[bytes], once: bool = False) -> None:
        """once: a word of a document counts once, else a little more for being repeated."""
        parts = [np.frombuffer(p, np.uint16).reshape(2, -1) for p in packed]
        self.n_docs = len(parts)
        self.doc = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        self.column, counts = np.concatenate(parts, axis=1).astype(np.int64) if parts else np.zeros((2, 0), np.int64)
        self.count = (np.ones(len(counts)) if once else 1.0 + np.log(counts)).astype(np.float32)

    def factor(self, h: np.ndarray, allowed: np.ndarray | None, inner: int = _INNER) -> tuple[np.ndarray, np.ndarray]:
        """(W, X / (W H) by entry) after the inner updates, for fixed H with rows that add up to 1."""
        k = h.shape[0]
        w = np.ones((self.n_docs, k), np.float32) if allowed is None else allowed.astype(np.float32)
        hc = np.ascontiguousarray(h.T.astype(np.float32)[self.column])  # entries x components
        starts = np.searchsorted(self.doc, np.arange(self.n_docs))
        empty = starts == np.append(starts[1:], len(self.doc))
        ratio = np.zeros(len(self.doc), np.float32)
        for _ in range(inner):
            ratio = self.count / np.maximum(np.einsum("ek,ek->e", w[self.doc], hc), 1e-12)
            if len(self.doc):
                gain = np.add.reduceat(hc * ratio[:, None], np.minimum(starts, len(self.doc) - 1), axis=0)
                gain[empty] = 0
                w *= gain
        if len(self.doc):
            ratio = self.count / np.maximum(np.einsum("ek,ek->e", w[self.doc], hc), 1e-12)
        return w, ratio


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list[int], list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column("doc_id").to_pylist(), part.column("terms").to_pylist()


def _allowed(ids: list[int], labels: dict[int, np.ndarray], n_subjects: int) -> np.ndarray:
    out = np.ones((len(ids), n_subjects + BACKGROUND), dtype=bool)
    for i, d in enumerate(ids):
        if d in labels:
            out[i, :n_subjects] = labels[d] > 0
    return out


def _pack(totals: np.ndarray) -> pa.RecordBatch:
    """Non-zero cells of a component-column array, in a fixed number of blocks."""
    rows = [(k, totals[k].astype(np.float32).tobytes()) for k in range(len(totals))]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["component", "cells"])


def _add_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(cells, np.float32)
            totals[k] = totals[k] + x if k in totals else x.astype(np.float64)
    for k, x in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["component", "cells"])


def _summed(parts: DataFrame, n: int) -> np.ndarray:
    """The sum of all partitions' arrays in two steps: groups of partitions, then all; the driver gets n arrays of fixed size."""
    cells = "component int, cells binary"
    grouped = parts.withColumn("group", F.floor(F.spark_partition_id() / _GROUP)).repartition("component", "group").select("component", "cells")
    reduced = grouped.mapInArrow(_add_blocks, cells).repartition(n, "component").mapInArrow(_add_blocks, cells)
    out = np.zeros((n, COLUMNS))
    for row in reduced.collect():
        out[row["component"]] += np.frombuffer(row["cells"], np.float32)
    return out


def _normal(h: np.ndarray) -> np.ndarray:
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1e-12)


def seed_counts(ids: list[int], packed: list[bytes], labels: dict[int, np.ndarray], n_subjects: int, totals: np.ndarray) -> None:
    """Adds a slice's words to the seeds: those of labelled documents by subject, all to the last row."""
    m = Matrix(packed)
    totals[-1] += np.bincount(m.column, m.count, minlength=COLUMNS)
    for i, d in enumerate(ids):
        if d in labels:
            share = labels[d] / labels[d].sum()
            mine = m.doc == i
            for k in np.flatnonzero(share):
                totals[k] += share[k] * np.bincount(m.column[mine], m.count[mine], minlength=COLUMNS)


def start(totals: np.ndarray, descriptions: list[str]) -> np.ndarray:
    """H before the first update: anchored components from the seeds, background from the whole corpus."""
    n = len(descriptions)
    overall = totals[-1] + _SMOOTH
    base = _normal(overall[None, :])[0]
    labelled = totals[:n].copy()
    for k, text in enumerate(descriptions):
        words = terms(text)
        np.add.at(labelled[k], words, 3.0)
    # each subject as heavy as the next, so that a frequent subject does not claim the words of all
    level = _normal(labelled + 1e-9) * labelled.sum() / n
    seen = labelled.sum(axis=0)
    share = (level + 0.5 / n) / (level.sum(axis=0) + 0.5)
    h = np.zeros((n + BACKGROUND, COLUMNS))
    h[:n] = level * np.clip(share - 1.5 / n, 0, None) ** 2 + base * 1e-3
    # multiplicative updates keep a zero: words that labelled documents of many subjects share stay in the background
    h[:n][(share < min(COMMON_SHARE / n, 0.5)) & (seen >= SEEN)] = 0
    h[n:] = base * np.random.default_rng(7).uniform(0.5, 1.5, (BACKGROUND, COLUMNS))
    return _normal(h)


def update_counts(ids: list[int], packed: list[bytes], labels: dict[int, np.ndarray], h: np.ndarray, totals: np.ndarray) -> None:
    """Adds a slice's part of the multiplicative update of H."""
    m = Matrix(packed)
    w, ratio = m.factor(h, _allowed(ids, labels, len(h) - BACKGROUND))
    w = w[m.doc] * ratio[:, None]
    for k in range(len(h)):
        totals[k] += np.bincount(m.column, w[:, k] * h[k, m.column], minlength=COLUMNS)


def mixtures(packed: list[bytes], h: np.ndarray, n_subjects: int) -> np.ndarray:
    """documents x subjects: the mass of each subject, in different words of the document."""
    w, _ = Matrix(packed, once=True).factor(h, None, _INNER_LAST)
    return np.nan_to_num(w[:, :n_subjects])


def bound_of(mass: np.ndarray, labelled: np.ndarray) -> float:
    """The mass that tells labelled documents apart best: the middle of the bounds whose F1 is all but the highest."""
    order = np.argsort(-mass, axis=None)
    x, true = mass.ravel()[order], np.cumsum(labelled.ravel()[order])
    if not len(true) or true[-1] < 20:
        return MASS
    f1 = 2 * true / (np.arange(1, len(true) + 1) + true[-1])
    best = np.flatnonzero(f1 >= f1.max() - 5e-4)
    return float(np.sqrt(x[best[0]] * x[best[-1]]))


# --------------------------------------------------------------------------- on DataFrames


def features(documents: DataFrame) -> DataFrame:
    """doc_id and bag of terms of every document with text, written to the shared folder (each later pass reads it)."""
    read = documents.select("doc_id", "text").mapInArrow(_read, "doc_id long, terms binary")
    return shared_table(read, "terms")


def _labels(labels: DataFrame, codes: list[str], bound: int) -> dict[int, np.ndarray]:
    """Label counts by subject of at most ``bound`` documents, chosen by a hash of their id."""
    rows = (
        labels.filter(F.col("subject_code").isin(codes) & F.col("doc_id").isNotNull())
        .groupBy("doc_id", "subject_code").agg(F.countDistinct("annotator").alias("n"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("subject_code", "n")).alias("found"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    )
    at = {c: i for i, c in enumerate(codes)}
    out: dict[int, np.ndarray] = {}
    for row in rows:
        out[row["doc_id"]] = counts = np.zeros(len(codes))
        for x in row["found"]:
            counts[at[x["subject_code"]]] += max(1, x["n"])
    return out


class Model:
    """What the factorisation gave: the components and the mass from which a document is about a subject."""

    def __init__(self, codes: list[str], h: np.ndarray, bound: float) -> None:
        self.codes, self.h, self.bound = codes, h.astype(np.float32), bound


def fit(spark: SparkSession, terms_table: DataFrame, subjects: DataFrame, labels: DataFrame, rounds: int = ROUNDS, bound: int = LABEL_BOUND) -> Model:
    """Factors the whole corpus; each round is one pass, of which the driver gets arrays of a fixed size."""
    # the subjects are a fixed list of a few codes
    listed = sorted((r["subject_code"], f"{r['subject_name']} {r['description']}") for r in subjects.collect() if r["subject_code"])
    codes, descriptions = [c for c, _ in listed], [d for _, d in listed]
    n = len(codes)
    if not n:
        return Model([], np.zeros((BACKGROUND, COLUMNS)), MASS)
    labelled = _labels(labels, codes, bound)
    known = spark.sparkContext.broadcast(labelled)

    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((n + 1, COLUMNS))
        for ids, packed in _slices(batches):
            seed_counts(ids, packed, known.value, n, totals)
        yield _pack(totals)

    h = start(_summed(terms_table.mapInArrow(seeds, "component int, cells binary"), n + 1), descriptions)
    for _ in range(rounds):
        current = spark.sparkContext.broadcast(h.astype(np.float32))

        def one_round(batches: Iterable[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((n + BACKGROUND, COLUMNS))
            for ids, packed in _slices(batches):
                update_counts(ids, packed, known.value, current.value, totals)
            yield _pack(totals)

        totals = _summed(terms_table.mapInArrow(one_round, "component int, cells binary"), n + BACKGROUND)
        h = _normal(totals + np.where(h > 0, 1e-9, 0))
    last = spark.sparkContext.broadcast(h.astype(np.float32))

    def of_labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, packed in _slices(batches):
            mass = mixtures(packed, last.value, n).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m.tobytes() for m in mass], pa.binary())], names=["doc_id", "mass"])

    rows = []
    if labelled:  # at most LABEL_BOUND documents are read, and no others reach Python
        wanted = spark.createDataFrame([(d,) for d in sorted(labelled)], "doc_id long")
        rows = terms_table.join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(of_labelled, "doc_id long, mass binary").collect()
    mass = np.stack([np.frombuffer(r["mass"], np.float32) for r in rows]) if rows else np.zeros((0, n))
    truth = np.stack([labelled[r["doc_id"]] > 0 for r in rows]) if rows else np.zeros((0, n), bool)
    return Model(codes, h, bound_of(mass, truth))


def assign(spark: SparkSession, terms_table: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject_code, share (of the mixture's subjects) and mass of every subject a document is about."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, packed in _slices(batches):
            mass = mixtures(packed, m.h, len(m.codes)).astype(np.float64)
            share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-12)
            doc, subject = np.nonzero(mass >= m.bound)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, dtype=np.int64)[doc]), pa.array([m.codes[k] for k in subject], pa.string()),
                 pa.array(share[doc, subject]), pa.array(mass[doc, subject])],
                names=["doc_id", "subject_code", "share", "mass"],
            )

    return terms_table.mapInArrow(run, "doc_id long, subject_code string, share double, mass double")


def subject_areas(spark: SparkSession, documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """The subjects of every document: see the module's text."""
    table = features(documents)
    return assign(spark, table, fit(spark, table, subjects, labels))


def composition(assigned: DataFrame) -> DataFrame:
    """subject_code, documents, weight: the corpus by subject (a document of two subjects counts by its shares)."""
    per_doc = assigned.groupBy("doc_id").agg(F.sum("share").alias("all_share"))
    return (
        assigned.join(per_doc, "doc_id")
        .groupBy("subject_code")
        .agg(F.count("*").alias("documents"), F.sum(F.col("share") / F.col("all_share")).alias("weight"))
    )
