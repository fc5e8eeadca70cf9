"""Runs of words that repeat themselves, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words whose smallest period fits into it three times or more, and that no neighbouring
word extends. Words of a document are appended one by one; the suffixes that end at the new word are the path of suffix
links from its state to the root, and every state on it remembers where its strings ended last. The path falls into a
few segments of one last end each. A segment whose longest string is at least as long as the distance to that end shows
a square; when it is twice as long, three periods, and the run grows as long as the next words show it again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Words of a run at least, and periods in it.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window that must stand twice in a stretch for its words to be looked at. A run has its period more words
#: than the window: it holds LEAST_WORDS and LEAST_PERIODS periods, so each of its words lies in a window that stands
#: again a period before or after.
WINDOW = LEAST_WORDS // LEAST_PERIODS

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_kept", pa.int64())]
)


class SuffixAutomaton:
    """The states of a sequence's substrings: ``length`` of the longest of each, its suffix ``link``, and the state of
    each prefix (``ends``)."""

    def __init__(self, words: list[int]) -> None:
        length, link, steps, ends = [0], [-1], [{}], []
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            steps.append({})
            at = last
            while at >= 0 and word not in steps[at]:
                steps[at][word] = state
                at = link[at]
            if at >= 0:
                next_ = steps[at][word]
                if length[next_] == length[at] + 1:
                    link[state] = next_
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[next_])
                    steps.append(steps[next_].copy())
                    link[state] = link[next_] = copy
                    while at >= 0 and steps[at].get(word) == next_:
                        steps[at][word] = copy
                        at = link[at]
            last = state
            ends.append(state)
        self.length, self.link, self.ends = length, link, ends

    def paths(self) -> list[int]:
        """The top state of each state's preferred path: from every state the path goes on to its largest subtree."""
        n, link = len(self.length), self.link
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        size, best, heavy = [1] * n, [0] * n, [-1] * n
        for state in reversed(order[1:]):
            up = link[state]
            size[up] += size[state]
            if size[state] > best[up]:
                best[up], heavy[up] = size[state], state
        top = list(range(n))
        for state in order:
            if heavy[state] >= 0:
                top[heavy[state]] = top[state]
        return top


def three_fold_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start and period.

    The automaton is built first, so that links no longer change: a state's path to the root then crosses few preferred
    paths, and last ends along one of these are kept as a stack of segments, the nearest to the root on top. Appending a
    word gives the part of each stack above its path the word's place, which takes away whole segments and shortens one.
    """
    automaton = SuffixAutomaton(words)
    length, link, top = automaton.length, automaton.link, automaton.paths()
    stacks: list[list[tuple[int, int]] | None] = [None] * len(length)
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(automaton.ends):
        while state > 0:
            head, deep = top[state], length[state]
            stack = stacks[head]
            if stack is None:
                stack = stacks[head] = []
            reach = 0
            # segments: (length of the longest string in it, last end); those that end above the state are recoloured
            while stack and stack[-1][0] <= deep:
                reach, end = stack.pop()
                period = i - end
                if reach >= 2 * period and reach + period >= LEAST_WORDS:
                    found[i - reach - period + 1, period] = i
            if stack and reach < deep:
                period = i - stack[-1][1]
                if deep >= 2 * period and deep + period >= LEAST_WORDS:
                    found[i - deep - period + 1, period] = i
            stack.append((deep, i))
            state = link[head]
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def candidate_stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of LEAST_WORDS words or more that can hold a run, by 64-bit hashes of the words.

    A word stays if it lies in a window that stands twice in its stretch; what is left falls into shorter stretches,
    which are judged again until none changes. No run and no neighbour that would extend one is lost; equal hashes of
    unlike windows only keep more.
    """
    bounds = [(0, len(hashes))]
    if len(hashes) < LEAST_WORDS:
        return []
    windows = tv.combine(hashes, WINDOW)
    stretch = np.zeros(len(windows), np.uint64)
    alive = np.ones(len(windows), bool)
    while True:
        at = np.flatnonzero(alive)
        if not len(at):
            return []
        key = tv.mix(windows[at] + stretch[at])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        alive = np.zeros(len(windows), bool)
        alive[at[twice]] = True
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        step = np.diff(np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        keep = ends - starts >= LEAST_WORDS
        now = list(zip(starts[keep].tolist(), ends[keep].tolist()))
        if now == bounds:
            return bounds
        bounds, inside = now, np.zeros(len(windows), bool)
        for start, end in bounds:
            inside[start : end - WINDOW + 1] = True
            stretch[start : end - WINDOW + 1] = start + 1
        alive &= inside


def document_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a document's words."""
    runs = []
    # of equal words equal hashes: the sum of a run's products can't be told from chance, and is only used to look closer
    for start, end in candidate_stretches(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)):
        numbers: dict[bytes, int] = {}
        runs += [(start + s, n, p) for s, n, p in three_fold_runs([numbers.setdefault(w, len(numbers)) for w in words[start:end]])]
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the tail made periodic in one document of ten, by the checksum of its id; a null id has none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _rows(plant: bool, collapsed: bool):
    schema = SCHEMA.append(pa.field("collapsed", pa.string())) if collapsed else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.text_slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = (text or b"").split()  # of bytes: at space, tab, line feed, vertical tab, form feed and return
                    words = planted(doc_id, words) if plant else words
                    runs = document_runs(words)
                    left = collapse(words, runs)
                    start, length, period = strongest(runs) or (None, None, None)
                    kept = b" ".join(left)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    row = (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words), len(left))
                    rows.append((*row, kept.decode()) if collapsed else row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def periodic_runs(documents: DataFrame, plant: bool = False, collapsed: bool = False) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): its runs, and its words without their repeats.

    Words are what stands between the ASCII white space; a run has LEAST_WORDS words and LEAST_PERIODS periods at least.
    Returns doc_id, n_runs, the run of the greatest length over period (start, length, period, exponent_milli: 1000 times
    that, floored; the first of equals by start, then period; nulls without a run), runs_sha256 (of every run's
    ``start,length,period`` and a line feed), collapsed_sha256 (of the words left, joined by one space), n_words, n_kept,
    and with ``collapsed`` that text. A word goes if any run holds it after the run's first period.

    ``plant`` first makes the tail of one document in ten periodic (see planted()), to measure by.

    Null and empty texts have no words and no run; a null doc_id stays null and is not planted. Repeated rows get equal
    rows, further columns are ignored, and an empty table gives no rows. Each text is judged whole, where it is read, and
    nothing is shuffled: the memory needed is some hundred bytes for a word of its candidate stretches.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
    return docs.mapInArrow(_rows(plant, collapsed), out + (", collapsed string" if collapsed else ""))
