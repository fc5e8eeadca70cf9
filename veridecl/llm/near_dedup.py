"""MinHash near-duplicate documents: many universal hash minima, banding, verification, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .components import connected_components
from .shared import materialize, passing_tables

TextsOf = Callable[[DataFrame], DataFrame]

_U = np.uint64
_seeds = tv.mix(np.arange(1, 2049, dtype=np.uint64))
_MULTIPLY = (_seeds[::2] >> _U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_seeds[1::2] >> _U(32)).astype(np.uint32)


class Scheme(NamedTuple):
    """Bands, minima of each, and how far below the similarity the share of equal minima of a pair may lie (from 1 on,
    minima are not compared, and signatures may be null)."""

    bands: int
    rows: int
    slack: float


#: A pair at Jaccard 0.85 shares no band with probability (1 - 0.85**5)**32 = 7e-9, at 0.8 with 3e-6. At 0.85 the share
#: of equal minima is 0.85 with a standard deviation of 0.028, so 0.15 less is over 5 deviations.
DOCUMENTS = Scheme(32, 5, 0.15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, words: np.ndarray = tv.NOT_SPACE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``size`` words (A-Z lower-cased); of all words if there are fewer."""
    lower = tv.LOWER[data]
    starts, ends, first = tv.word_spans(lower, offsets, words)
    hashes = tv.word_hashes(lower, starts, ends)
    runs = tv.combine(hashes, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        else:
            sets.append(tv.combine(hashes[a:b], b - a) if b > a else runs[:0])
    return sets


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``size`` universal hash minima of each set, which must not be empty."""
    out = np.empty((len(sets), size), np.uint32)
    if sets:
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        flat = np.concatenate(sets)
        flat = (flat ^ (flat >> _U(32))).astype(np.uint32)
        for k in range(size):
            out[:, k] = np.minimum.reduceat(flat * _MULTIPLY[k] + _ADD[k], starts)
    return out


def band_keys(minima: np.ndarray, scheme: Scheme) -> np.ndarray:
    """One hash for each row's band; different bands never share a key on purpose."""
    grouped = minima.reshape(len(minima), scheme.bands, scheme.rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, scheme.bands + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93), grouped.shape[:2]).copy()
    for k in range(scheme.rows):
        total = tv.mix(total + grouped[:, :, k])
    return total.view(np.int64)


#: What is known of a text: its key, set size, two fingerprints of its set, band keys and signature.
PROFILE = "doc_id long, h long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary"


def profile_columns(sets: list[np.ndarray], scheme: Scheme) -> list[pa.Array]:
    """The columns of PROFILE from n_shingles on."""
    counts = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(counts)
    minima = signatures([sets[i] for i in full], scheme.bands * scheme.rows)
    prints = np.zeros((2, len(sets)), np.uint64)
    for i in full:
        prints[0, i], prints[1, i] = tv.mix(sets[i]).sum(), tv.mix(sets[i] ^ _U(0xA5A5A5A5A5A5A5A5)).sum()
    sizes = np.zeros(len(sets) + 1, np.int32)
    sizes[full + 1] = scheme.bands
    bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(band_keys(minima, scheme).reshape(-1)))
    signs: list[bytes | None] = [None] * len(sets)
    for i, row in zip(full, minima.astype(np.uint16)):
        signs[i] = row.tobytes()
    return [pa.array(counts), *(pa.array(p.view(np.int64)) for p in prints), bands, pa.array(signs, pa.binary())]


def _profiles(size: int, scheme: Scheme):
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.text_slices(batch, "text"):
                sets = shingle_sets(*tv.utf8(part.column("text")), size)
                columns = [part.column("doc_id"), part.column("h"), *profile_columns(sets, scheme)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _likely(threshold: float):
    """Keeps pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = (a == b).mean(axis=1) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _linked(size: int, percent: int):
    """Keeps pairs (a, b) whose full sets reach the similarity; the rows of one a follow each other, and its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.text_slices(batch, "tb"):
                a = part.column("a").to_numpy()
                fresh = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                left = shingle_sets(*tv.utf8(part.column("ta").take(pa.array(fresh))), size)
                right = shingle_sets(*tv.utf8(part.column("tb")), size)
                run_of = np.cumsum(np.isin(np.arange(len(a)), fresh)) - 1
                keep = np.zeros(len(a), bool)
                for i, r in enumerate(run_of):
                    common = len(np.intersect1d(left[r], right[i], assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(left[r]) + len(right[i]) - common)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, b, ta, tb): pairs with both texts, which both grow with the documents: no broadcast."""
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int, slack: float) -> DataFrame:
    """Candidate pairs (a, b) of representatives: first by size and signature, then by their full sets."""
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("signature").alias(f"s{k}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    if slack < 1:
        pairs = pairs.select("a", "b", "sa", "sb").mapInArrow(_likely(percent / 100 - slack), "a long, b long")
    likely = materialize(pairs.select("a", "b"), "pairs")
    return _with_texts(likely, texts).mapInArrow(_linked(size, percent), "a long, b long")


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.text_slices(batch, "text"):
                sets = shingle_sets(*tv.utf8(part.column("text")), size)
                rep = np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(sets).view(np.int64) if sets else rep)], names=["rep", "shingle"])

    return run


def _in_common(docs: DataFrame, size: int) -> DataFrame:
    """Rows (rep, common): how many shingles of each document another of ``docs`` has too.

    No other document can share more with it, so two documents whose smaller number is too small for their sizes are
    no link, however alike their minima. In a large group of texts that differ too much this leaves few pairs.
    """
    rows = docs.mapInArrow(_shingle_rows(size), "rep long, shingle long")
    shared = rows.groupBy("shingle").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("shingle")
    return rows.join(shared, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("common"))


def _still_open(placed: DataFrame) -> DataFrame:
    """The rows (bucket, rep, c ..) of the buckets that hold several components."""
    spread = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return placed.join(spread.filter("lo < hi").select("bucket"), "bucket", "left_semi")


def _centres(left: DataFrame) -> DataFrame:
    """Rows (z, rep, c, cz): each bucket's plainest member z, its component, and the bucket's other members.

    The plainest member has the largest share of shingles in common with others: the fewest edits, where a group
    stems from one text. So it is near to all that can be near to anything.
    """
    order = F.struct(F.col("common") / F.col("n_shingles"), -F.col("rep"))
    centre = left.groupBy("bucket").agg(F.max_by(F.struct("rep", "c"), order).alias("z"))
    rows = left.join(centre, "bucket").filter("rep <> z.rep")
    return rows.select(F.col("z.rep").alias("z"), "rep", "c", F.col("z.c").alias("cz")).distinct()


def _differences(size: int):
    """Rows (z, rep, n, differs): how many shingles rep has, and which only one of z and rep has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.text_slices(batch, "tb"):
                z = part.column("a").to_numpy()
                fresh = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
                left = shingle_sets(*tv.utf8(part.column("ta").take(pa.array(fresh))), size)
                right = shingle_sets(*tv.utf8(part.column("tb")), size)
                run_of = np.searchsorted(fresh, np.arange(len(z)), side="right") - 1
                apart = [np.setxor1d(left[r], own, assume_unique=True).view(np.int64) for r, own in zip(run_of, right)]
                counts = pa.array([len(own) for own in right], pa.int64())
                lists = pa.array(apart, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in "ab"), counts, lists], names=["z", "rep", "n", "differs"])

    return run


def _possible(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one centre that can be linked: a prefix-filtered join of their differences from it.

    Let d be the number of shingles that only one of a text of n shingles and the centre has. Two texts are linked if
    their differences share o shingles with 2 * (100 + percent) * o >= g + g', g = (100 + percent) * d - (100 - percent) * n;
    this is over 0 where one of the two is not linked with the centre. What stands in one difference only is left out, the
    rest is ordered by rarity. Then two differences of m and m' shingles share one of the first m - o + 1 and m' - o + 1.
    A group of texts that stem from one and are all a little too far from each other so makes few pairs, not all.
    """
    placed = _centres(left)
    pairs = placed.select(F.col("z").alias("a"), F.col("rep").alias("b")).distinct()
    apart = _with_texts(pairs, texts).mapInArrow(_differences(size), "z long, rep long, n long, differs array<long>")
    apart = materialize(apart, "apart")
    g = ((100 + percent) * F.size("differs") - (100 - percent) * F.col("n")).cast("long")
    rows = apart.select("z", "rep", g.alias("g"), F.explode("differs").alias("e"))
    rows = rows.withColumn("f", F.count("*").over(W.partitionBy("z", "e"))).filter("f > 1")
    lists = rows.groupBy("z", "rep", "g").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("es"))
    lists = materialize(lists.join(placed.select("rep", "c").distinct(), "rep"), "lists")
    least = lists.groupBy("z").agg(F.min("g").alias("least"))
    shared = lambda g: F.greatest(F.ceil(g / (2 * (100 + percent))), F.lit(1))
    first = F.greatest(F.size("es") - shared(F.col("g") + F.col("least")) + 1, F.lit(0))
    heads = lists.join(least, "z").withColumn("head", F.slice("es", F.lit(1), first.cast("int")))
    heads = heads.select("z", "rep", "c", "g", F.size("es").alias("m"), F.posexplode("head").alias("at", "x"))
    side = lambda k: heads.select("z", F.col("x.e").alias("e"), *(F.col(n).alias(n + k) for n in ("rep", "c", "g", "m", "at")))
    o = shared(F.col("gx") + F.col("gy"))
    near = (F.col("cx") < F.col("cy")) & (F.col("atx") <= F.col("mx") - o) & (F.col("aty") <= F.col("my") - o)
    found = side("x").join(side("y"), ["z", "e"]).filter(near)
    return found.select(F.least("repx", "repy").alias("a"), F.greatest("repx", "repy").alias("b")).distinct()


def _joined(left: DataFrame, groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``left`` and ``groups`` (node, component) with the components that more links (a, b) make."""
    if links.isEmpty():
        return left, groups
    ends = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
    ends = ends.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = materialize(connected_components(ends), "groups")
    left = left.drop("c").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    return left.withColumn("c", F.coalesce("component", "rep")).drop("component"), groups


def linked_groups(profile: DataFrame, texts_of: TextsOf, *, shingle: int, percent: int, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """Classes (f1, f2, rep) of texts with equal sets, and components (node, component) of linked ones, a table of its own.

    profile: a written table of PROFILE rows. texts_of: of rows (doc_id), those ids' texts as rows (doc_id, text).
    """
    classes = profile.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    with passing_tables():
        groups = _groups(profile, classes, texts_of, shingle, percent, scheme)
        return classes, materialize(groups.select("node", "component"), "components", lasting=True)


def _groups(profile: DataFrame, classes: DataFrame, texts_of: TextsOf, shingle: int, percent: int, scheme: Scheme) -> DataFrame:
    usable = profile.filter("n_shingles > 0 and doc_id is not null")
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "doc_id"], "left_semi")
    reps = reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "signature").dropDuplicates(["rep", "bands"])
    reps = materialize(reps, "reps")

    members = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    pairs = materialize(members.join(buckets, "bucket").filter("rep > a").select("a", F.col("rep").alias("b")).distinct(), "first")
    # all that is compared from here on stands in one of these pairs
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialize(texts_of(ends), "texts")
    links = materialize(_confirm(pairs, reps, texts, shingle, percent, scheme.slack), "links")
    groups = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")

    # what the first round leaves open: buckets that still hold several components
    placed = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("c"))
    left = materialize(_still_open(placed), "open")
    if left.isEmpty():
        return groups
    common = _in_common(texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle)
    left = left.join(common, "rep").filter(f"100 * common >= {percent} * n_shingles")
    left = materialize(_still_open(left), "common")
    if left.isEmpty():
        return groups
    plain = _centres(left).filter("c <> cz").select(F.least("rep", "z").alias("a"), F.greatest("rep", "z").alias("b")).distinct()
    more = plain.join(pairs, ["a", "b"], "left_anti")
    second = materialize(_confirm(more, reps, texts, shingle, percent, scheme.slack), "second")
    left, groups = _joined(left, groups, second)
    late = _possible(_still_open(left), texts, shingle, percent)
    late = materialize(_confirm(late, reps, texts, shingle, percent, scheme.slack), "late")
    _, groups = _joined(left, groups, late)
    return groups


def _texts_of(docs: DataFrame) -> TextsOf:
    # the ids grow with the documents: no broadcast, whatever their number is here
    return lambda ids: docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")


def _judged(documents: DataFrame, shingle: int, percent: int, scheme: Scheme) -> DataFrame:
    """near_duplicates() with h, a hash of each row's text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    profile = materialize(hashed.mapInArrow(_profiles(shingle, scheme), PROFILE), "profile")
    classes, groups = linked_groups(profile, _texts_of(docs), shingle=shingle, percent=percent, scheme=scheme)
    rows = profile.select("doc_id", "h", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left")
    rows = rows.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return rows.select("doc_id", "h", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80, scheme: Scheme = DOCUMENTS) -> DataFrame:
    """Components of documents that near-duplicate links join.

    Words are runs of other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles of ``shingle`` words, or, with fewer words, its whole word sequence as one. Two documents are linked
    if 100 * intersection >= ``percent`` * union. Returns, for every row of ``documents``: doc_id, n_shingles,
    component_id (the smallest doc_id reachable), kept (doc_id = component_id).

    How: a scan gives each document the size, fingerprint and minima of its set (``scheme``). Documents of one fingerprint
    are one class, of which only the smallest doc_id goes on, so exact copies never meet in a bucket. In each
    band bucket members are paired with the smallest member only; pairs are confirmed on full sets and
    components formed. In buckets whose members then lie in several components, these are paired with the plainest
    member, and what is still apart goes through a prefix-filtered join of the differences from that member, so that
    no link is lost that could join components.

    Empty or null texts, and texts without words: n_shingles 0, alone, kept. A null doc_id: alone, with a null
    component, kept. Repeated rows get equal results. Rows of one doc_id with different texts are judged each by
    itself. Further columns are ignored.
    """
    return _judged(documents, shingle, percent, scheme).drop("h")


def keep_one_each(documents: DataFrame, *, shingle: int = 5, percent: int = 80, scheme: Scheme = DOCUMENTS) -> DataFrame:
    """The rows of ``documents`` that near_duplicates() keeps: one doc_id of each group, and one of several rows with
    that doc_id and equal texts.

    Rows without a doc_id, and those without words, stay all. Rows of one doc_id with different texts are judged each
    by itself. All columns come back as they are, whatever their names; an empty table gives no rows.
    """
    judged = materialize(_judged(documents, shingle, percent, scheme), "judged")
    same = (F.col("d.doc_id") == F.col("j.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("j.h"))
    kept = documents.alias("d").join(judged.filter("not kept").alias("j"), same, "left_anti")
    again = judged.filter("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id", "h").count().filter("count > 1")
    if again.isEmpty():
        return kept
    once = kept.alias("d").join(again.alias("j"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.alias("d").join(again.alias("j"), same, "left_anti").unionByName(once)
