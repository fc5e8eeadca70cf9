"""Spelling variants of words: exact neighbours at one edit, by pairs of trie nodes.

The nodes of the trie of all words, and of the trie of all reversed words, are numbered. A word with one position skipped
is then a pair of integers, the node of what stands before it and the node of what stands behind, and so is a word with a
gap between two letters. Two words with an equal pair of skips differ by one replaced letter; a skip of one and a gap of
another make the first the second with one letter more. Equal pairs mean equal strings, so nothing has to be verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import materialize, passing_tables

#: Code points of a word, and occurrences, at least; how many times as frequent a form is as its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: A run of one in so many loses a letter, to measure by.
DROPPED = 31
#: Characters of distinct words that a task counts before it hands them on.
HELD = 1 << 23
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NODES = "array<long>"


def _counted(drop: bool):
    letters = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for part in tv.text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    found = Counter(letters.findall(text.encode().lower().decode()))  # of bytes: A-Z only
                    start = zlib.crc32(f"{doc_id}:".encode()) if drop and doc_id is not None else None
                    for word, n in found.items():
                        if start is not None and (h := zlib.crc32(word.encode(), start)) % DROPPED == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        if word not in counts:
                            held += len(word)
                        counts[word] += n
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=_COUNTS)
                    counts.clear()
                    held = 0
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=_COUNTS)

    return run


def word_counts(documents: DataFrame, drop: bool = False) -> DataFrame:
    """Words (runs of letters, A-Z lower-cased) of LEAST_LENGTH code points with how often they stand in all texts, from
    LEAST_COUNT on. Counts are added up in each task before they are shuffled. ``drop``: see spelling_variants()."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counted(drop), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class TrieNumbers:
    """Numbers for the nodes of a trie whose words are dealt to tasks by ranges.

    A node that lies in two ranges is a prefix of the first word of the later one, so the nodes on the way to first words
    (``firsts``, in order) are numbered for all beforehand, below zero; every other node belongs to one range, which
    numbers it in the order of its words. The root is 0.
    """

    def __init__(self, firsts: list[str]) -> None:
        self.firsts, self.known = firsts, []
        used = 0
        for k, word in enumerate(firsts):
            shared = _common(firsts[k - 1], word) if k else -1
            old = self.known[-1][: shared + 1] if k else [0]
            self.known.append(old + [-(used + d) for d in range(1, len(word) + 2 - len(old))])
            used += len(self.known[-1]) - len(old)

    def begin(self, part: int, number: int) -> None:
        """part: which range; number: what its own nodes are numbered from."""
        self.part, self.next, self.word, self.path = part, number, "", [0]

    def nodes(self, word: str) -> list[int]:
        """The nodes of all prefixes of the next word of the range, the empty one first."""
        path = self.path[: _common(self.word, word) + 1]
        deep = 0
        for k in (self.part, self.part + 1):
            if k < len(self.firsts) and (shared := _common(self.firsts[k], word)) > deep:
                deep, path = shared, self.known[k][: shared + 1] + path[shared + 1 :]
        more = len(word) + 1 - len(path)
        path = path + list(range(self.next, self.next + more))
        self.next += max(0, more)
        self.word, self.path = word, path
        return path


def _sorted_parts(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, dict[int, int], list[str]]:
    """Rows in ranges of ``key``: a table with the range as ``part``, the ranges in order, and the first key of each."""
    table = materialize(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), name)
    firsts = sorted(map(tuple, table.groupBy("part").agg(F.min(key)).collect()))  # one for each range
    return table.repartition("part").sortWithinPartitions("part", key), {part: k for k, (part, _) in enumerate(firsts)}, [first for _, first in firsts]


def _numbered(key: str, others: list[pa.Field], ranges: dict[int, int], firsts: list[str], forward: bool):
    """Adds the nodes of each word; forward: an id in the order of the words too, and where a letter isn't as the one before."""
    fields = [pa.field(key, pa.string()), *others, pa.field("nodes", pa.list_(pa.int64()))]
    if forward:
        fields += [pa.field("id", pa.int64()), pa.field("fresh", pa.list_(pa.bool_()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part, place = TrieNumbers(firsts), None, 0
        for batch in batches:
            words, nodes, ids, fresh = batch.column(key).to_pylist(), [], [], []
            for word, of in zip(words, batch.column("part").to_pylist()):
                if of != part:
                    part, place = of, 0
                    trie.begin(ranges[of], (ranges[of] + 1) << 40)
                nodes.append(trie.nodes(word))
                if forward:
                    ids.append((ranges[of] << 40) + place)
                    fresh.append([k == 0 or word[k] != word[k - 1] for k in range(len(word))])
                    place += 1
            columns = [batch.column(key), *(batch.column(f.name) for f in others), pa.array(nodes, pa.list_(pa.int64()))]
            if forward:
                columns += [pa.array(ids, pa.int64()), pa.array(fresh, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def trie_nodes(words: DataFrame) -> DataFrame:
    """Distinct words (word, n) with ids in code-point order and the nodes of all prefixes (``before``) and suffixes
    (``behind``, the empty one first) of each; ``fresh`` tells where a letter isn't the one before it."""
    rows, ranges, firsts = _sorted_parts(words, "word", "words")
    forward = rows.mapInArrow(_numbered("word", [pa.field("n", pa.int64())], ranges, firsts, True), f"word string, n long, nodes {_NODES}, id long, fresh array<boolean>")
    forward = materialize(forward.withColumnRenamed("nodes", "before"), "forward")
    rows, ranges, firsts = _sorted_parts(forward.select("id", F.reverse("word").alias("reversed")), "reversed", "reversed")
    back = rows.mapInArrow(_numbered("reversed", [pa.field("id", pa.int64())], ranges, firsts, False), f"reversed string, id long, nodes {_NODES}")
    return forward.join(back.select("id", F.col("nodes").alias("behind")), "id")


def near_words(tries: DataFrame) -> DataFrame:
    """Rows (id, n_near, best) for the words with a near one: how many, and the most frequent of them (n, id), the first
    of equals in order.

    A pair of nodes is met by one word with a gap there at most, and with a skip there by one for each letter, so a group
    holds as many rows as there are letters and one more, at any size of the input. A word is near another through
    exactly one pair: of a letter that repeats only the first may be skipped to meet a gap. Pairs of words are never
    made: each member of a group takes its count and its best from the group's.
    """
    size = F.size("before")
    gaps = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get("before", i).alias("p"), F.get("behind", size - 1 - i).alias("s"), F.lit(0).alias("side")))
    skips = F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.struct(F.get("before", i).alias("p"), F.get("behind", size - 2 - i).alias("s"), F.when(F.get("fresh", i), 2).otherwise(1).alias("side")))
    rows = tries.select("id", "n", F.inline(gaps)).unionByName(tries.select("id", "n", F.inline(skips)))
    groups = rows.groupBy("p", "s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "side"))).alias("all")).filter(F.size("all") > 1)
    of = lambda test: F.filter("all", test)
    groups = groups.select("all", of(lambda x: x["side"] > 0).alias("skips"), of(lambda x: x["side"] == 2).alias("fresh"), of(lambda x: x["side"] == 0).alias("gaps"))
    first = lambda rows, k=0: F.get(rows, k)
    each = groups.select("skips", "fresh", "gaps", F.inline("all"))
    other = F.when(first("skips")["id"] == F.col("id"), first("skips", 1)).otherwise(first("skips"))
    best = F.when(F.col("side") == 0, first("fresh")).when(F.col("side") == 1, other).otherwise(F.array_min(F.array_compact(F.array(other, first("gaps")))))
    count = F.when(F.col("side") == 0, F.size("fresh")).when(F.col("side") == 1, F.size("skips") - 1).otherwise(F.size("skips") - 1 + F.size("gaps"))
    each = each.select("id", count.alias("c"), F.struct(best["less"].alias("less"), best["id"].alias("id")).alias("b")).filter("c > 0")
    found = each.groupBy("id").agg(F.sum("c").alias("n_near"), F.min("b").alias("b"))
    return found.select("id", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.id").alias("id")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """Links (id, to) of which none makes a circle to rows (id, root), where ``root`` has no link.

    Every round each link takes over the link of its end, so a chain is halved; a form is TIMES as frequent as its
    variant, so no chain has more links than a count has digits.
    """
    now = materialize(links, "links")
    while True:
        ends = now.select(F.col("id").alias("to"), F.col("to").alias("on"))
        after = materialize(now.join(ends, "to", "left").select("id", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "links")
        if after.filter("moved").isEmpty():
            return after.select("id", F.col("to").alias("root"))
        now = after.drop("moved")


def spelling_variants(documents: DataFrame, drop: bool = False) -> DataFrame:
    """The words of all texts of ``documents`` (doc_id, text), each with the form that it is a variant of.

    Words are those of word_counts(). Two are near if one inserted, deleted or replaced code point makes one the other.
    A word's form is its most frequent near word (the first of equals in code-point order), if that stands TIMES as
    often or more. Returns word, form (or null), root (at the end of the forms; the word itself without one), n, n_near,
    form_n (null without a form).

    ``drop`` first takes a letter out of one run in DROPPED, by a checksum of doc_id and run: made variants to measure
    by; documents without a doc_id are left as they are then.

    Null and empty texts have no words; repeated rows count each; an empty table, or one without words that stand twice,
    gives no rows; further columns are ignored. A word of any length is taken whole, with rows in proportion to it.
    """
    with passing_tables():
        tries = materialize(trie_nodes(word_counts(documents, drop)), "tries")
        words = tries.select("id", "word", "n")
        near = materialize(near_words(tries), "near")
        found = words.join(near, "id", "left").withColumn("to", F.when(F.col("best.n") >= TIMES * F.col("n"), F.col("best.id")))
        ends = roots(found.filter("to is not null").select("id", "to"))
        name = lambda id_, as_: words.select(F.col("id").alias(id_), F.col("word").alias(as_))
        out = found.join(ends, "id", "left").join(name("to", "form"), "to", "left").join(name("root", "end"), "root", "left")
        form_n = F.when(F.col("to").isNotNull(), F.col("best.n"))
        return materialize(out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")), "variants", lasting=True)
