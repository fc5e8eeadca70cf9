"""Removal of long byte strings that occur more than once, by sorting sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import forget, join_spread, materialize

#: Bytes of the strings that may occur once only; bytes of the tokens whose least hash marks a string's anchor.
LENGTH, TOKEN = 400, 128
#: Tokens that a string of LENGTH bytes holds.
TOKENS = LENGTH - TOKEN + 1
#: Words of the passages that are looked for in other rows; words of the grams whose least hash marks a passage's anchor.
WORDS, GRAM = 51, 8
#: Blocks with one leading token that are sorted in one task at most; the strings of more are counted by fingerprint.
HOT = 8192

_U = np.uint64
_POSITION_BITS = 22
_BLOCK = "h1 long, h2 long, anchor int, kinds long, low long, high long, block binary"


def anchors(data: np.ndarray, prefix: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Of every string of LENGTH bytes that starts in begin .. end - 1, where its anchor is: the token of the least hash,
    the leftmost of equal ones. The anchor's place within the string follows from its bytes alone."""
    at = np.arange(begin, end + TOKENS - 1)
    return _least(tv.span_hashes(prefix, at, at + TOKEN), TOKENS) + begin


def _least(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of every run of ``size`` hashes, where the least one is, the leftmost of equal ones."""
    least = hashes & ~_U((1 << _POSITION_BITS) - 1) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < size:
        rest = size - width
        least = np.minimum(least[:-rest], least[rest:])
    return (least & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)


def _word_blocks(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The text, first byte, end, and hashes of the anchor and of all bytes of the blocks of passages of WORDS words."""
    starts, ends, first = tv.word_spans(data, offsets, tv.NOT_SPACE)
    grams = tv.combine(tv.word_hashes(data, starts, ends), GRAM)
    whole = tv.within(first, WORDS)
    for begin in range(0, len(starts) - WORDS + 1, 1 << 20):
        end = min(begin + (1 << 20), len(starts) - WORDS + 1)
        at = whole[np.searchsorted(whole, begin) : np.searchsorted(whole, end)]
        if not len(at):
            continue
        place = _least(grams[begin : end + WORDS - GRAM], WORDS - GRAM + 1)[at - begin] + begin
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = at[np.append(new[1:], len(at)) - 1] + WORDS - 1
        s, e = starts[at[new]], ends[last]
        yield np.searchsorted(offsets, s, side="right") - 1, s, e, tv.mix(grams[place[new]] + _U(WORDS)), tv.span_hashes(prefix, s, e)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t1, t2, start, n, anchor, h1, h2) of the blocks of each text: n consecutive strings with one anchor.

    h1 is the hash of the anchor's token, h2 of all bytes of the block. Blocks of consecutive passages of WORDS words with
    one anchor have an ``anchor`` of -1, and such n that they too have n + LENGTH - 1 bytes.
    """
    names = ["t1", "t2", "start", "n", "anchor", "h1", "h2"]
    for batch in batches:
        for part in tv.text_slices(batch, "text"):
            data, offsets = tv.utf8(part.column("text"))
            t1, t2 = (part.column(k).to_numpy() for k in ("t1", "t2"))
            if not len(data):
                continue
            prefix = tv.prefix_hashes(data)
            for d, s, e, h1, h2 in _word_blocks(data, offsets, prefix):
                columns = [t1[d], t2[d], s - offsets[d], (e - s - LENGTH + 1).astype(np.int32), np.full(len(s), -1, np.int32), h1.view(np.int64), h2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            for begin in range(0, len(data) - LENGTH + 1, 1 << 20):
                end = min(begin + (1 << 20), len(data) - LENGTH + 1)
                place = anchors(data, prefix, begin, end)
                at = np.arange(begin, end)
                doc = np.searchsorted(offsets, at, side="right") - 1
                keep = np.flatnonzero(at + LENGTH <= offsets[doc + 1])
                if not len(keep):
                    continue
                at, place, doc = at[keep], place[keep], doc[keep]
                first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
                n = np.diff(np.append(first, len(at)))
                s, a, d = at[first], place[first], doc[first]
                h1 = tv.span_hashes(prefix, a, a + TOKEN)
                h2 = tv.span_hashes(prefix, s, s + n + LENGTH - 1)
                columns = [t1[d], t2[d], (s - offsets[d]).astype(np.int64), n.astype(np.int32), (a - s).astype(np.int32), h1.view(np.int64), h2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks that a text is asked for."""
    for batch in batches:
        rows: list[tuple] = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode()
            rows += [(w["h1"], w["h2"], w["anchor"], w["kinds"], w["low"], w["high"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]) for w in wanted]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=["h1", "h2", "anchor", "kinds", "low", "high", "block"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each passage of WORDS words of each block: h1, h2, low, high, and a hash of its words beside h1's of its anchor."""
    for batch in batches:
        data, offsets = tv.utf8(batch.column("block"))
        starts, ends, first = tv.word_spans(data, offsets, tv.NOT_SPACE)
        at = tv.within(first, WORDS)
        block = np.searchsorted(first, at, side="right") - 1
        prints = tv.combine(tv.word_hashes(data, starts, ends), WORDS)[at]
        columns = [batch.column(k).take(pa.array(block)) for k in ("h1", "h2", "low", "high")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], names=["h1", "h2", "low", "high", "w"])


def multikey_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and of each but the first how many bytes it shares with the one before.

    Multikey quicksort with machine words of eight bytes as keys: strings are parted by a word, and only those that
    share it go on to the next word, so each string is read as far as it is like another.
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    width = -(-max(int(lengths.max(initial=0)), 1) // 8) * 8
    words = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64) if n else np.zeros((0, 1), np.uint64)
    order, common = np.arange(n), np.zeros(n, np.int64)
    begins = np.zeros(n, bool)  # where in the order a group of strings alike so far begins
    begins[:1] = True
    for w in range(words.shape[1]):
        group = np.cumsum(begins)
        alone = begins & np.append(begins[1:], True)
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        keys = words[order[active], w]
        moved = np.lexsort((keys, group[active]))
        order[active] = order[active][moved]
        keys = keys[moved]
        new = np.flatnonzero((keys[1:] != keys[:-1]) & ~begins[active[1:]]) + 1
        differing = keys[new] ^ keys[new - 1]
        same = np.zeros(len(new), np.int64)
        for byte in range(1, 8):
            same += (differing >> _U(64 - 8 * byte)) == 0
        begins[active[new]] = True
        common[active[new]] = 8 * w + same
    # strings alike in all words: the shorter first
    group = np.cumsum(begins)
    order = order[np.lexsort((lengths[order], group))]
    common[~begins] = width
    if n:
        common[1:] = np.minimum(common[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
        common[0] = 0
    return order, common


def repeated(blocks: list[bytes], anchor: np.ndarray, lead: np.ndarray) -> list[list[int]]:
    """Of each block the runs start, end, start, end ... of its strings that another block of the same lead holds too.

    Two strings are equal if they lie alike around their anchors and the bytes before and after these are equal. So the
    suffixes from the anchors, and the bytes before them read backwards, are sorted, and for each place of the anchor
    the strings are told apart by how much their blocks share with the next ones in both orders.
    """
    n = len(blocks)
    size = np.array([len(b) for b in blocks], np.int64) - LENGTH + 1  # strings of the block
    code = np.unique(lead, return_inverse=True)[1]
    tag = [int(c).to_bytes(8, "big") for c in code]
    right, right_common = multikey_sort([t + b[a:] for t, b, a in zip(tag, blocks, anchor.tolist())])
    left, left_common = multikey_sort([t + b[:a][::-1] for t, b, a in zip(tag, blocks, anchor.tolist())])
    low, high = anchor - size + 1, anchor
    twice = np.zeros((n, TOKENS), bool)
    for d in range(max(0, int(low.min())), int(high.max()) + 1):
        held = np.flatnonzero((low <= d) & (d <= high))
        if len(held) < 2:
            continue
        before, after = np.empty(n, np.int64), np.empty(n, np.int64)
        before[left] = np.cumsum(left_common < 8 + d)
        after[right] = np.cumsum(right_common < 8 + LENGTH - d)
        _, kind, count = np.unique(before[held] * (n + 1) + after[held], return_inverse=True, return_counts=True)
        again = held[count[kind] > 1]
        twice[again, anchor[again] - d] = True
    edges = np.diff(np.pad(twice.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return [np.flatnonzero(row).tolist() for row in edges]


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings in the blocks of a bucket; the blocks come in the order of their leading bytes."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h1, h2, anchor, block = zip(*rows)
        runs = repeated(list(block), np.array(anchor, np.int64), np.array(h1, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["h1", "h2", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("h1", "h2", "anchor", "block"))):
            if len(held) >= HOT and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of each block: h1, h2, at, and 128 bits of its hash."""
    for batch in batches:
        for h1, h2, block in zip(*(batch.column(k).to_pylist() for k in ("h1", "h2", "block"))):
            data = np.frombuffer(block, np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            one = tv.span_hashes(tv.prefix_hashes(data), at, at + LENGTH)
            two = tv.span_hashes(tv.prefix_hashes(data[::-1]), len(data) - LENGTH - at, len(data) - at)
            columns = [np.full(len(at), h1), np.full(len(at), h2), at.astype(np.int32), one.view(np.int64), two.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "at", "w1", "w2"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text once the covered spans are taken out."""
    for batch in batches:
        rows: list[tuple] = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, merged = text.encode(), []
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [x for s in merged for x in s], kept))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
        columns = zip(*rows) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types)), batch.column("repeats")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "repeats"])


def _with_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text, spans: for each string that occurs elsewhere, or run of such, the bytes a .. b that it covers; repeats."""
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    # a passage of WORDS words has 2 * WORDS - 1 bytes at least
    blocks = materialize(docs.select("text", "t1", "t2").filter(F.octet_length("text") >= min(LENGTH, 2 * WORDS - 1)).mapInArrow(_blocks, "t1 long, t2 long, start long, n int, anchor int, h1 long, h2 long"), "blocks")
    # a string whose anchor's token stands nowhere else occurs once
    again = materialize(blocks.groupBy("h1").count().filter("count > 1"), "again")
    open_ = materialize(join_spread(blocks.withColumn("at", F.hash("t1", "start")), again.select("h1"), again, ["h1"], "at").drop("at"), "open")
    forget(blocks)
    forget(again)
    kinds = open_.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("t1").alias("low"), F.max("t1").alias("high"), F.min(F.struct("t1", "t2", "start", "n", "anchor")).alias("one"))
    kinds = materialize(kinds, "kinds")
    # blocks alike as a whole are repeated as a whole; of tokens with unlike blocks, one block of each kind is sorted
    unlike = materialize(kinds.groupBy("h1").count().filter("count > 1"), "unlike")
    wanted = join_spread(kinds, unlike.withColumnRenamed("count", "kinds"), unlike, ["h1"], "h2")
    wanted = wanted.select("one.t1", "one.t2", F.struct("h1", "h2", "one.anchor", "one.start", "one.n", "kinds", "low", "high").alias("w"))
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted"))
    # rows of one text, a third of all perhaps, are dealt by their ids
    equal = materialize(docs.groupBy("t1", "t2").count().filter("count > 1"), "equal")
    texts = join_spread(docs, wanted, equal, ["t1", "t2"], "doc_id").select("text", "wanted")
    cut = materialize(texts.mapInArrow(_cut_blocks, _BLOCK).dropDuplicates(["h1", "h2"]), "cut")
    passages = cut.filter("anchor < 0").select("h1", "h2", "low", "high", "block").mapInArrow(_passages, "h1 long, h2 long, low long, high long, w long")
    strings = cut.filter("anchor >= 0")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lead = F.substring("block", F.col("anchor") + 1, F.lit(32))
    ordered = strings.filter(F.col("kinds") <= HOT).withColumn("lead", lead).repartitionByRange(parts, "lead", "h1").sortWithinPartitions("lead", "h1")
    runs = ordered.select("h1", "h2", "anchor", "block").mapInArrow(_sort_bucket, "h1 long, h2 long, runs array<int>")
    ranges = F.transform(F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda k: k % 2 == 0), lambda k: F.struct(F.get("runs", k).alias("a"), (F.get("runs", k + 1) - 1).alias("z")))
    runs = runs.filter(F.size("runs") > 0).select("h1", "h2", ranges.alias("ranges"))
    prints = strings.filter(F.col("kinds") > HOT).mapInArrow(_fingerprints, "h1 long, h2 long, at int, w1 long, w2 long")
    common = prints.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    hot = prints.join(common, ["w1", "w2"], "left_semi").groupBy("h1", "h2").agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("z"))).alias("ranges"))
    # passages that stand in blocks of different texts; a block that stands in several texts has but such passages
    met = passages.groupBy("h1", "w").agg(F.count("*").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
    met = materialize(met.filter("count > 1 and low < high").select("h1", "w", "count"), "met")
    told = join_spread(passages.filter("low = high").select("h1", "h2", "w"), met.select("h1", "w"), met, ["h1", "w"], "h2")
    told = told.select("h1", "h2").distinct().withColumn("ranges", F.array().cast("array<struct<a:int,z:int>>"))
    found = materialize(runs.unionByName(hot).unionByName(told), "found")
    for table in (unlike, cut, met):
        forget(table)

    rows = open_.select("t1", "t2", "start", "n", "h1", "h2", (F.col("anchor") < 0).alias("words")).dropDuplicates(["t1", "t2", "start", "words"])
    judged = kinds.select("h1", "h2", "copies", (F.col("low") < F.col("high")).alias("apart")).join(found, ["h1", "h2"], "left").filter("copies > 1 or ranges is not null")
    rows = join_spread(rows, judged, kinds.select("h1", "h2", F.col("copies").alias("count")), ["h1", "h2"], "t1")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("z")))
    ranges = F.when(F.col("words"), None).when(F.col("copies") > 1, whole).otherwise(F.col("ranges"))
    rows = rows.select("t1", "t2", "start", "words", (F.col("words") & (F.col("apart") | F.col("ranges").isNotNull())).alias("apart"), F.explode_outer(ranges).alias("r"))
    span = F.when(~F.col("words"), F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.z") + LENGTH).alias("b")))
    spans = rows.groupBy("t1", "t2").agg(F.collect_list(span).alias("spans"), F.max("apart").alias("apart"), F.max("words").alias("words"))
    # texts that two rows have, and that have passages: these stand in either row
    spans = spans.join(equal.select("t1", "t2", F.lit(True).alias("equal")), ["t1", "t2"], "left")
    spans = spans.select("t1", "t2", "spans", (F.col("apart") | F.col("words") & F.coalesce("equal", F.lit(False))).alias("repeats"))
    spans = materialize(spans, "spans")
    for table in (open_, kinds, found):
        forget(table)
    return join_spread(docs, spans, equal, ["t1", "t2"], "doc_id", "left").select("doc_id", "text", "spans", F.coalesce("repeats", F.lit(False)).alias("repeats"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept, repeats.

    Of the text's UTF-8 bytes each one is removed that lies in a string of 400 bytes that also starts anywhere else, in
    this or another row; strings overlap, and all are judged on the input. ``spans`` holds start, end, start, end ... of
    the maximal removed runs, ``kept`` the other bytes, ``kept_sha256`` their digest in lower-case hex.

    ``repeats`` tells whether another row has a passage of over 50 of the text's words too, whatever white space is
    between them. Such a passage may have under 400 bytes; then it is told, but not removed.

    Null texts are empty; texts under 400 bytes lose nothing; repeated rows lose all of 400 bytes or more. Null or equal
    doc_ids don't matter, and further columns are ignored. An empty table gives no rows.

    Only suffixes at anchors are kept: every string of 400 bytes has one, chosen by its bytes. Strings whose anchor's
    token is unique in the corpus are left out by counting tokens. The rest is range-partitioned by the leading bytes
    with the splitters that Spark samples, sorted in each bucket by multikey quicksort, and compared with its
    neighbours; equal leading tokens never part, except those of over HOT unlike blocks, which are dealt by the
    fingerprints of their strings instead.
    """
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary, repeats boolean"
    return _with_spans(documents).mapInArrow(_keep, schema)
