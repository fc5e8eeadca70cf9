"""Order-preserving packing of documents into sequences: cuts at the least cost, by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Tokens of a sequence at most; the id that ends a document.
LENGTH, END = 1024, 0
#: Penalties, in tokens of padding, of a cut after a sentence and of a cut elsewhere inside a document.
AT_SENTENCE, ANYWHERE = 1, 6
#: Of WindowCuts: the penalty of a full window that ends elsewhere, and how far the last place to cut must be before that.
TRUNCATED = NEAR = 24
#: Tokens after which cuts that are settled are looked for and laid out.
BLOCK = 1 << 17

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def padding(length: int) -> int:
    """Tokens that fill up a sequence: none at a power of two."""
    return 0 if length & (length - 1) == 0 else LENGTH - length


def best_cuts(boundaries: list[tuple[int, int]], total: int) -> list[int]:
    """Ends of the windows that cut tokens 0..total into pieces of at most LENGTH at the least cost.

    boundaries: (position, penalty) of the places at which a document or sentence ends, in order. A window costs its
    padding and the penalty of its end; every other position is a place to cut too, at ANYWHERE. Of equal cuts the one
    with the longest last windows is taken.

    f(j), the least cost up to j, is the penalty of j plus the least of f(i) at a power of two before j, and of
    f(i) + i over the LENGTH positions before j plus LENGTH - j. This is worked out for LENGTH positions at a time: what
    comes from before them at once, by minima from the right, and what comes from among them again and again, by minima
    from the left, until nothing changes, which takes one round for each window that ends among them.
    """
    if not total:
        return []
    never = 1 << 40
    penalty = np.full(total + 1, ANYWHERE, np.int64)
    if places := [b for b in boundaries if 0 < b[0] < total]:
        at, extra = np.array(places, np.int64).T
        penalty[at] = extra
    penalty[total] = 0
    cost = np.full(LENGTH + total + 1, never, np.int64)  # of position j at LENGTH + j
    cost[LENGTH] = 0
    steps = np.arange(LENGTH)
    powers = [1 << k for k in range(LENGTH.bit_length())]
    for low in range(1, total + 1, LENGTH):
        size = min(LENGTH, total + 1 - low)
        here, at = cost[LENGTH + low : LENGTH + low + size], steps[:size]
        # distances count from low: of the positions before it -LENGTH..-1
        before = cost[low : LENGTH + low]
        outer = np.minimum.accumulate((before + steps)[::-1])[::-1][:size] - at
        for p in powers:
            n = min(p, size)
            np.minimum(outer[:n], before[LENGTH - p : LENGTH - p + n], out=outer[:n])
        outer += penalty[low : low + size]
        here[:] = outer
        while size > 1:
            inner = np.minimum.accumulate(here[:-1] + at[:-1]) + (LENGTH - at[1:])
            for p in powers:
                if p < size:
                    np.minimum(inner[p - 1 :], here[:-p], out=inner[p - 1 :])
            inner += penalty[low + 1 : low + size]
            if not (inner < here[1:]).any():
                break
            np.minimum(here[1:], inner, out=here[1:])
    pads = np.array([padding(n) for n in range(LENGTH, 0, -1)])
    ends, j = [], total
    while j:
        ends.append(j)
        j += int(np.argmin(cost[j : LENGTH + j] + pads)) - LENGTH
    return ends[::-1]


class WindowCuts:
    """The cuts of a row of tokens into windows of LENGTH at most, whose padding and penalties cost least, as it goes on.

    Places to cut are the ends of documents and sentences, and the end of a full window from any place, if no place lies
    within NEAR tokens before it. Every window is taken to be padded to LENGTH, so f(j), the least cost up to place j, is
    its penalty plus LENGTH - j plus the least f(i) + i of the places in the LENGTH tokens before it. Those that can be
    the least for some later place stand in a monotone queue: by rising position and by rising f(i) + i.

    A cut is settled when the best ways to all places in the queue go through it, as later ones come from there.
    """

    def __init__(self) -> None:
        self.place, self.cost, self.back = [0], [0], [-1]
        self.queue, self.full = deque([0]), deque([LENGTH])
        self.laid = 0  # of these, all up to it are given

    def add(self, position: int, penalty: int) -> None:
        """The end of a document or sentence; positions must rise."""
        while self.full and self.full[0] < position:
            full = self.full.popleft()
            if full - self.place[-1] >= NEAR:
                self._try(full, TRUNCATED)
        if self.full and self.full[0] == position:
            self.full.popleft()
        self._try(position, penalty)

    def _try(self, position: int, penalty: int) -> None:
        place, cost, queue = self.place, self.cost, self.queue
        while place[queue[0]] < position - LENGTH:
            queue.popleft()
        i = queue[0]
        least = penalty + LENGTH - position + cost[i] + place[i]
        # of equal ones the earlier stays in front: the longer window
        while queue and cost[queue[-1]] + place[queue[-1]] > least + position:
            queue.pop()
        queue.append(len(place))
        place.append(position)
        cost.append(least)
        self.back.append(i)
        self.full.append(position + LENGTH)

    def _way(self, at: int) -> list[int]:
        way = []
        while at > self.laid:
            way.append(at)
            at = self.back[at]
        return way[::-1]

    def settled(self) -> list[int]:
        """More cuts that no later place can change."""
        ways = [self._way(i) for i in self.queue]
        same = 0
        while all(same < len(w) and w[same] == ways[0][same] for w in ways):
            same += 1
        return self._give(ways[0][:same])

    def last(self) -> list[int]:
        """All cuts that are left, up to the last place."""
        return self._give(self._way(len(self.place) - 1))

    def _give(self, way: list[int]) -> list[int]:
        if not way:
            return []
        cuts = [self.place[i] for i in way]
        # places before the last cut given are done with
        drop = way[-1]
        self.place, self.cost = self.place[drop:], self.cost[drop:]
        self.back = [max(0, b - drop) for b in self.back[drop:]]
        self.queue = deque(i - drop for i in self.queue)
        return cuts


class AnywhereCuts:
    """Cuts at any token, by best_cuts() for some BLOCK tokens at a time: less padding, more sentences cut."""

    def __init__(self) -> None:
        self.places, self.begin = [], 0

    def add(self, position: int, penalty: int) -> None:
        self.places.append((position, penalty))

    def _cuts(self, keep: int) -> list[int]:
        total = self.places[-1][0] - self.begin if self.places else 0
        cuts = [c for c in best_cuts([(p - self.begin, x) for p, x in self.places], total) if c <= total - keep]
        if cuts:
            cuts = [c + self.begin for c in cuts]
            self.begin = cuts[-1]
            self.places = [x for x in self.places if x[0] > self.begin]
        return cuts

    def settled(self) -> list[int]:
        return self._cuts(2 * LENGTH)

    def last(self) -> list[int]:
        return self._cuts(0)


class _Packer:
    """Lays documents out in the order in which they come, in sequences numbered from ``first``."""

    def __init__(self, first: int, stops: np.ndarray, cuts: WindowCuts | AnywhereCuts) -> None:
        self.sequence, self.stops, self.cuts = first, stops, cuts
        self.pieces: deque[tuple[int | None, int, np.ndarray, int]] = deque()  # doc, ids before, ids, ids of the whole document
        self.begin = self.total = self.looked = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """Takes a document; returns the rows that are settled, now and then."""
        self.pieces.append((doc_id, 0, ids, len(ids)))
        for place in (np.flatnonzero(self.stops[ids[:-1]]) + 1 + self.total).tolist():
            self.cuts.add(place, AT_SENTENCE)
        self.total += len(ids)
        self.cuts.add(self.total, 0)
        if self.total - self.looked < BLOCK:
            return []
        self.looked = self.total
        return self.lay(self.cuts.settled())

    def lay(self, ends: list[int]) -> list[tuple]:
        """Rows of the sequences that end there."""
        rows = []
        for end in ends:
            offset = 0
            while offset < end - self.begin:
                doc_id, before, ids, whole = self.pieces[0]
                part = ids[: end - self.begin - offset]
                rows.append((doc_id, before, len(part), zlib.crc32(part.astype("<u4").tobytes()), whole, self.sequence, offset))
                offset += len(part)
                if len(part) == len(ids):
                    self.pieces.popleft()
                else:
                    self.pieces[0] = (doc_id, before + len(part), ids[len(part) :], whole)
            self.begin, self.sequence = end, self.sequence + 1
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def _pack(tokenizer: str, anywhere: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import load

        encode, stops = load(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 36, stops, AnywhereCuts() if anywhere else WindowCuts())
        for batch in batches:
            for part in tv.text_slices(batch, "text"):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    rows += packer.add(doc_id, np.append(encode(text or ""), END))
                if rows:
                    yield _batch(rows)
        if rows := packer.lay(packer.cuts.last()):
            yield _batch(rows)

    return run


def pack(documents: DataFrame, tokenizer: str, anywhere: bool = False) -> DataFrame:
    """All tokens of all documents in sequences of at most 1024 with little padding; one row for each piece.

    ``tokenizer`` is the place of a tokenizer file that every executor has. A document is its ids and then id 0.
    Returns doc_id, start (ids of the document before the piece), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset (in the sequence, without gaps from 0).

    Documents keep the order in which the partitions hold them, and each partition packs its own, so nothing is
    shuffled; a task that runs again makes the same rows. Sequences end at document or sentence ends, or with a full
    window where none is near, at the least padding and penalty over the whole partition (WindowCuts); what is settled is
    laid out as it goes, so a task holds some windows and a document. ``anywhere`` cuts at any token instead (AnywhereCuts).

    Empty or null texts: the one id 0. Repeated rows are packed each; a null doc_id stays null. A very long text is
    cut into as many pieces as it needs. An empty table gives no rows. Further columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, anywhere), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
