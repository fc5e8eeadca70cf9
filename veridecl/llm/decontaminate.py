"""Benchmark decontamination by a prefix-filtered set join of benchmark windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import materialize

#: Words of a window, and of the shingles that windows are sets of.
WINDOW, SHINGLE = 13, 5
#: Bits of the table that tells which shingles the benchmark may hold. Its 2**FILTER_BITS bits go to the executors,
#: whatever the size of the benchmark; a large benchmark only lets more shingles pass on to the join.
FILTER_BITS = 25
#: Windows of a batch of rows at most.
BATCH = 1 << 14

_WINDOWS = "size int, words string, shingles array<long>"
_TYPES = {"size": pa.int32(), "words": pa.string(), "shingles": pa.list_(pa.int64())}


def _shingle_size(size: int) -> int:
    return min(SHINGLE, size)


def _cut(hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """The windows of ``size`` words that begin at the words ``at``, a batch at a time: their places and _WINDOWS columns."""
    runs = tv.combine(hashes, _shingle_size(size)).view(np.int64)
    many = size - _shingle_size(size) + 1
    for begin in range(0, len(at), BATCH):
        some = at[begin : begin + BATCH]
        words = [b" ".join([raw[a:b] for a, b in zip(starts[w : w + size].tolist(), ends[w : w + size].tolist())]).decode() for w in some.tolist()]
        shingles = pa.ListArray.from_arrays(pa.array(np.arange(0, many * len(some) + 1, many, dtype=np.int32)), pa.array(runs[some[:, None] + np.arange(many)].reshape(-1)))
        yield some, [pa.array(np.full(len(some), size, np.int32)), pa.array(words, pa.string()), shingles]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, _WINDOWS) of benchmark rows (item, text)."""
    for batch in batches:
        for part in tv.text_slices(batch, "text"):
            data, offsets = tv.utf8(part.column("text"))
            lower = tv.LOWER[data]
            starts, ends, first = tv.word_spans(lower, offsets, tv.ALNUM)
            hashes, raw, counts = tv.word_hashes(lower, starts, ends), lower.tobytes(), np.diff(first)
            for size in np.unique(np.minimum(counts, WINDOW)).tolist():
                at = tv.within(first, size) if size else np.zeros(0, np.int64)
                row = np.searchsorted(first, at, side="right") - 1
                own = counts[row] >= WINDOW if size == WINDOW else counts[row] == size
                at, row = at[own], row[own]
                done = 0
                for some, columns in _cut(hashes, raw, starts, ends, at, size):
                    items = part.column("item").take(pa.array(row[done : done + len(some)]))
                    done += len(some)
                    yield pa.RecordBatch.from_arrays([items, *columns], names=["item", *_TYPES])


def _document_windows(table, filter_bits: int, sizes: list[int]):
    """Rows (doc_id, t1, t2, n_words, start, _WINDOWS) of documents (doc_id, t1, t2, text): one for the document, whose
    start is null, and one for each window whose shingles may all be the benchmark's."""
    names = ["doc_id", "t1", "t2", "n_words", "start", *_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        mask = np.uint64((1 << filter_bits) - 1)
        for batch in batches:
            for part in tv.text_slices(batch, "text"):
                data, offsets = tv.utf8(part.column("text"))
                lower = tv.LOWER[data]
                starts, ends, first = tv.word_spans(lower, offsets, tv.ALNUM)
                hashes, raw, counts = tv.word_hashes(lower, starts, ends), lower.tobytes(), np.diff(first)
                n = part.num_rows
                empty = [pa.nulls(n, t) for t in (pa.int64(), *_TYPES.values())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t1"), part.column("t2"), pa.array(counts), *empty], names=names)
                for size in sizes:
                    at = (tv.combine(hashes, _shingle_size(size)) & mask).astype(np.int64)
                    fails = np.zeros(len(at) + 1, np.int64)
                    np.cumsum((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 0, out=fails[1:])
                    many = size - _shingle_size(size) + 1
                    whole = np.flatnonzero(fails[many:] == fails[: len(fails) - many]) if len(at) >= many else at[:0]
                    row = np.searchsorted(first, whole, side="right") - 1
                    keep = whole + size <= first[row + 1]
                    whole, row, done = whole[keep], row[keep], 0
                    for some, columns in _cut(hashes, raw, starts, ends, whole, size):
                        own = row[done : done + len(some)]
                        done += len(some)
                        keys = [part.column(k).take(pa.array(own)) for k in ("t1", "t2")]
                        places = [pa.array(counts[own]), pa.array(some - first[own])]
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), part.schema.field("doc_id").type), *keys, *places, *columns], names=names)

    return run


def _filter_table(windows: DataFrame) -> np.ndarray:
    """Of the windows' shingles a bitmap by their low bits: at most 2**FILTER_BITS bits come to the driver."""
    bit = F.pmod("shingle", F.lit(1 << FILTER_BITS)) + 1
    parts = windows.select(F.explode("shingles").alias("shingle")).select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    table = np.zeros(max(1 << FILTER_BITS >> 3, 4096), np.uint8)
    for row in parts.collect():
        begin = (row["bucket"] - 1) * 4096
        table[begin : begin + 4096] = np.frombuffer(row["map"], np.uint8)
    return table


def _key(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("w1"), F.xxhash64(F.lit(1), words).alias("w2")]


def _rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (w1, w2, size, words, shingle, offset): of each window its rarest shingle, the prefix of its set.

    A window is contained whole or not at all, so a prefix of one shingle is enough, and its place in the window must
    be the same. Windows with a shingle that no document has are left out.
    """
    each = windows.select("w1", "w2", "size", F.posexplode("shingles").alias("offset", "shingle")).join(counts, "shingle", "left")
    best = each.groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("x"))
    best = best.filter("x.n > 0").select("w1", "w2", "x.shingle", "x.offset")
    return windows.select("w1", "w2", "size", "words").join(best, ["w1", "w2"])


def _text_keys(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def occurrences(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows of the benchmark stand in documents, as three tables.

    Rows (doc_id, t1, t2, n_words) for each document, t1 and t2 being hashes of its text; (t1, t2, start, size, w1, w2)
    for each occurrence, by text, start and size in words, w1 and w2 being hashes of the window; (w1, w2, item).

    Documents are scanned once, and of them only windows whose shingles may all be the benchmark's go on. Equal windows
    are one row on both sides, however many documents or items hold them. The shingles, ordered by how often they
    stand in documents, give each window its rarest one; windows of both sides are joined on that shingle, its place
    and the length, and their words are compared.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    known = materialize(items.mapInArrow(_item_windows, f"item string, {_WINDOWS}").select("item", "size", "words", "shingles", *_key(F.col("words"))), "windows")
    sizes = [row["size"] for row in known.select("size").distinct().collect()]  # WINDOW at most
    table = spark.sparkContext.broadcast(_filter_table(known))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    found = _text_keys(documents).mapInArrow(_document_windows(table, FILTER_BITS, sorted(sizes)), f"doc_id {id_type}, t1 long, t2 long, n_words long, start long, {_WINDOWS}")
    found = materialize(found.select("*", *_key(F.col("words"))), "found")

    there = found.filter("start is not null")
    counts = there.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    one = lambda windows: _rarest(windows.select("w1", "w2", "size", "words", "shingles").dropDuplicates(["w1", "w2"]), counts)
    ours, theirs = one(there), one(known).select("size", "shingle", "offset", F.col("words").alias("same"))
    matched = ours.join(theirs, ["size", "shingle", "offset"]).filter("words = same").select("w1", "w2")
    matched = materialize(matched, "matched")
    hits = there.join(matched, ["w1", "w2"], "left_semi").select("t1", "t2", "start", "size", "w1", "w2").dropDuplicates(["t1", "t2", "start", "size"])
    of_items = known.filter("item is not null").join(matched, ["w1", "w2"], "left_semi").select("w1", "w2", "item").distinct()
    return found.filter("start is null").select("doc_id", "t1", "t2", "n_words"), hits, of_items


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``documents``: how much of it stands in the benchmark.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. A window is 13
    consecutive words of an item, or the whole of an item with fewer. Returns doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items (items with occurring windows), items_sha256 (of their ids, sorted as strings
    and comma-joined), contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null or empty texts, and texts or items without words: nothing found. Repeated documents get equal results,
    a repeated item counts once, and an item without an id marks words but is not counted. An empty benchmark
    finds nothing. Further columns of either table are ignored.
    """
    return _judged(documents, benchmark).drop("t1", "t2")


def _judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, hits, of_items = occurrences(documents, benchmark)
    hits = materialize(hits, "hits")
    # words that occurrences cover: of each one what reaches beyond all before it
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reached"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["reached"]))).alias("n"), F.greatest(acc["reached"], s["end"]).alias("reached"))
    covered = hits.groupBy("t1", "t2").agg(F.aggregate(spans, zero, step)["n"].alias("n_hit"))
    # windows with the same items count as one: a passage that many items share is looked up once for each text
    print_ = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "item"))
    sets = of_items.groupBy("w1", "w2").agg(F.count("*").alias("many"), print_(1).alias("p1"), print_(2).alias("p2"))
    first = sets.groupBy("many", "p1", "p2").agg(F.min(F.struct("w1", "w2")).alias("w"))
    sets = sets.join(first, ["many", "p1", "p2"]).select("w1", "w2", F.col("w.w1").alias("v1"), F.col("w.w2").alias("v2"))
    by_text = hits.select("t1", "t2", "w1", "w2").distinct().join(sets, ["w1", "w2"]).select("t1", "t2", "v1", "v2").distinct()
    items = by_text.join(of_items.withColumnsRenamed({"w1": "v1", "w2": "v2"}), ["v1", "v2"]).select("t1", "t2", "item")
    items = items.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(covered, ["t1", "t2"], "left").join(items, ["t1", "t2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "t1", "t2", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without those whose text is contaminated, whatever their ids and further columns.

    Rows with null, empty or wordless texts stay, and all rows do if the benchmark is empty; an empty table gives no rows.
    """
    bad = _judged(documents, benchmark).filter("contaminated").select("t1", "t2").distinct()
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    same = (F.xxhash64(text) == F.col("b.t1")) & (F.xxhash64(F.lit(1), text) == F.col("b.t2"))
    return documents.alias("d").join(bad.alias("b"), same, "left_anti")
