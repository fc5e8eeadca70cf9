"""Repeated passages: MinHash banding of paragraphs, exact verification, and clusters of what to remove."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .near_dedup import PROFILE, Scheme, linked_groups, profile_columns
from .shared import forget, materialize

#: Words of a paragraph at least, and of its shingles; the similarity that links, in percent.
LEAST_WORDS, SHINGLE, PERCENT = 20, 5, 80
#: Words of a passage inside a paragraph, and of the stretch in which one is sure to begin. A stretch of more than 50
#: words that stands in two texts has a whole passage at the same place of both.
PASSAGE, STRETCH = 16, 32
#: A pair of paragraphs at Jaccard 0.8 shares no band with probability (1 - 0.8**3)**10 = 8e-4, at 0.9 with 2e-6. So few
#: minima say little of a pair: no signatures are compared, and all candidates are verified on their words.
PARAGRAPHS = Scheme(10, 3, 1.0)

_U = np.uint64
_GRAMS = STRETCH - 2
_LOW = (1 << 32) - 1


def _place(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Start and end byte in one number; texts are shorter than 2**31 bytes."""
    return starts << 32 | ends


def _start(at: Column) -> Column:
    return F.shiftright(at, 32)


def _end(at: Column) -> Column:
    return at.bitwiseAND(F.lit(_LOW))


def _anchors(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words at which a passage begins: those with the least hash of three words in some stretch of their text."""
    at = tv.within(first, STRETCH)
    if not len(at):
        return at
    bits = _U((1 << 24) - 1)
    least = grams & ~bits | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= _GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _GRAMS:
        least = np.minimum(least[: -(_GRAMS - width)], least[_GRAMS - width :])
    return np.unique((least[at] & bits).astype(np.int64))


def _hash_pair(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each run of word hashes (none empty): sums of words mixed with their places in the run."""
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    words, places = hashes[np.repeat(begin, size) + place], tv.mix(place.astype(np.uint64) + _U(1))
    coded = (tv.mix(words ^ tv.mix(places + _U(salt))) for salt in (0, 0x5851F42D4C957F2D))
    out = [tv.mix(np.add.reduceat(c, first) + size.astype(np.uint64)).view(np.int64) if len(size) else np.zeros(0, np.int64) for c in coded]
    return out[0], out[1]


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a slice of texts the bytes (A-Z lower-cased too), text offsets, and words with their hashes."""
    data, offsets = tv.utf8(part.column("text"))
    lower = tv.LOWER[data]
    starts, ends, first = tv.word_spans(lower, offsets, tv.NOT_SPACE)
    return data, lower, offsets, starts, ends, first, tv.word_hashes(lower, starts, ends)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (o, at, u1, u2): the passages of each text, where they stand, and two hashes of their words."""
    for batch in batches:
        for part in tv.text_slices(batch, "text"):
            _, _, offsets, starts, ends, first, hashes = _words(part)
            begin = _anchors(tv.combine(hashes, 3), first)
            begin = begin[np.isin(begin, tv.within(first, PASSAGE))]
            if not len(begin):
                continue
            doc = np.searchsorted(first, begin, side="right") - 1
            at = _place(starts[begin] - offsets[doc], ends[begin + PASSAGE - 1] - offsets[doc])
            u1, u2 = _hash_pair(hashes, begin, begin + PASSAGE)
            yield pa.RecordBatch.from_arrays([part.column("o").take(pa.array(doc)), *map(pa.array, (at, u1, u2))], names=["o", "at", "u1", "u2"])


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The profile of each paragraph with o and where it stands; doc_id and h are two hashes of its words."""
    names = [c.split()[0] for c in PROFILE.split(", ")] + ["o", "at"]
    for batch in batches:
        for part in tv.text_slices(batch, "text"):
            data, _, offsets, starts, ends, first, hashes = _words(part)
            lines = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
            bounds = np.searchsorted(starts, np.append(lines, len(data)))
            keep = np.flatnonzero(np.diff(bounds) >= LEAST_WORDS)
            if not len(keep):
                continue
            begin, end = bounds[keep], bounds[keep + 1]
            doc = np.searchsorted(first, begin, side="right") - 1
            at = _place(starts[begin] - offsets[doc], ends[end - 1] - offsets[doc])
            u1, u2 = _hash_pair(hashes, begin, end)
            runs = tv.combine(hashes, SHINGLE)
            sets = [np.unique(runs[x : y - SHINGLE + 1]) for x, y in zip(begin.tolist(), end.tolist())]
            profile = profile_columns(sets, PARAGRAPHS)[:-1]  # without signatures
            nothing = pa.nulls(len(doc), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(u1), pa.array(u2), *profile, nothing, part.column("o").take(pa.array(doc)), pa.array(at)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, wanted) the texts of the paragraphs that are asked for, by their hash."""
    for batch in batches:
        for part in tv.text_slices(batch, "text"):
            rows = [(w["doc_id"], raw[w["at"] >> 32 : w["at"] & _LOW]) for raw, wanted in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("wanted").to_pylist()) for w in wanted]
            ids, texts = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])


def _merge(spans: list[dict]) -> list[dict]:
    merged: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if merged and s["start"] <= merged[-1]["end"]:
            last = merged[-1]
            last["end"] = max(last["end"], s["end"])
        else:
            merged.append(dict(s))
    return merged


def _kept_and_removed(spans: DataFrame, owners: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Of spans (o, at, keys) those whose keys stand in several documents, with what stays of each group."""
    seen = spans.groupBy(*keys).agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo <> hi").select(*keys)
    shared = materialize(spans.join(seen, keys, "left_semi").join(owners, "o"), kind)
    keeper = shared.groupBy(*keys).agg(F.min(F.struct("doc_id", "o", "at")).alias("k"))
    kept = F.struct("doc_id", "o", "at").eqNullSafe(F.col("k"))
    return shared.join(keeper, keys).select(
        "doc_id", "o", F.lit(kind).alias("kind"), _start(F.col("at")).alias("start"), _end(F.col("at")).alias("end"), F.col(keys[0]).alias("cluster"), F.col("k.doc_id").alias("keeper"), (~kept).alias("removed")
    )


def repeated_passages(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, o, kind, start, end, cluster, keeper, removed) of what documents have in common.

    A row is a paragraph (a line of at least LEAST_WORDS words) that is alike in another document, or a passage of
    PASSAGE words that another document holds too; start and end are bytes of the UTF-8 text, o is a hash of the
    document. Paragraphs are alike if the Jaccard similarity of their shingles of five words is 0.8 or more, verified
    on full sets after MinHash banding, and clusters are the components of such links. Passages are equal word for word,
    found by two hashes; they begin at words chosen by the words around, so that the same text is cut alike wherever it
    stands, inside a line too. ``keeper`` is the doc_id whose copy stays: the smallest of (doc_id, o, start) of the
    cluster; ``removed`` is false on that one.

    What repeats within one document only is left alone. Null, empty and short texts have no rows. Equal rows are one
    document; documents with equal texts and different ids are alike whole. Rows with a null doc_id take part; further
    columns are ignored. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("o", F.xxhash64("doc_id", "text"))
    owners = docs.select("o", "doc_id").distinct()

    passages = materialize(docs.select("o", "text").mapInArrow(_passages, "o long, at long, u1 long, u2 long"), "passages")
    # by one hash first, which leaves few rows to be told apart by both
    often = passages.groupBy("u1").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo <> hi").select("u1")
    open_ = materialize(passages.join(often, "u1", "left_semi"), "open")
    forget(passages)
    one = _kept_and_removed(open_, owners, ["u1", "u2"], "passage")
    forget(open_)  # what is shared has a table of its own now

    found = materialize(docs.select("o", "text").mapInArrow(_paragraphs, f"{PROFILE}, o long, at long"), "paragraphs")

    def texts_of(ids: DataFrame) -> DataFrame:
        where = found.groupBy("doc_id").agg(F.min(F.struct("o", "at")).alias("x")).join(ids, "doc_id", "left_semi")
        wanted = where.groupBy("x.o").agg(F.collect_list(F.struct("doc_id", "x.at")).alias("wanted"))
        cut = docs.select("o", "text").join(wanted.hint("merge"), "o").select("text", "wanted").mapInArrow(_cut, "doc_id long, text string")
        return cut.dropDuplicates(["doc_id"])

    profile = found.drop("o", "at")
    classes, groups = linked_groups(profile, texts_of, shingle=SHINGLE, percent=PERCENT, scheme=PARAGRAPHS)
    rows = found.select("o", "at", "f1", "f2").join(classes, ["f1", "f2"]).join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("o", "at", F.coalesce("component", "rep").alias("cluster"))
    return one.unionByName(_kept_and_removed(rows, owners, ["cluster"], "paragraph"))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans in batch.column("spans").to_pylist():
            runs = _merge(spans)
            length = lambda some: sum(r["end"] - r["start"] for r in _merge(some))
            gone = [s for s in spans if s["removed"]]
            rows.append(
                (
                    len(runs), length(spans), length(gone), length([s for s in gone if s["kind"] == "paragraph"]), length([s for s in gone if s["kind"] == "passage"]),
                    ",".join(f"{r['start']}:{r['end']}:{r['cluster']}" for r in runs), sorted({s["keeper"] for s in spans if s["keeper"] is not None}),
                )
            )
        types = (*[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)]
        names = ["doc_id", "n_runs", "n_bytes", "n_removed_bytes", "n_paragraph_bytes", "n_passage_bytes", "runs", "keepers"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)


def repeat_report(documents: DataFrame) -> DataFrame:
    """One row for each document with something of repeated_passages(): doc_id, n_runs, n_bytes, n_removed_bytes,
    n_paragraph_bytes and n_passage_bytes (removed by each kind, which may overlap), runs (start:end:cluster of the
    maximal runs, comma-joined), keepers (the distinct ids of the copies that stay).

    A byte is removed where any of the spans that cover it is removed: another copy of that span stays, whatever else
    of this document stays beside it. Null, empty, short and unlike texts have no row, equal rows have one, and documents
    with a null doc_id one each; further columns are ignored, and an empty table gives no rows.
    """
    span = F.struct("start", "end", "cluster", "keeper", "removed", "kind")
    found = repeated_passages(documents).groupBy("doc_id", "o").agg(F.collect_set(span).alias("spans"))
    schema = "doc_id long, n_runs long, n_bytes long, n_removed_bytes long, n_paragraph_bytes long, n_passage_bytes long, runs string, keepers array<long>"
    return found.select("doc_id", "spans").mapInArrow(_report, schema)
