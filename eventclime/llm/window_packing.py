"""Packing by best-fit decreasing into windows.

``pieces`` tokenises documents and cuts the overlong ones into full windows;
what is left of them, and every shorter document, is one piece.  ``pack``
deals the pieces by a hash of their document row to partitions of bounded
size and packs each by best-fit decreasing: a segment tree indexed by
remaining capacity finds the tightest open window.  Windows that end up with
room are then filled by cutting the pieces of the least filled ones, and the
tokens of the one window left become sequences at powers of two, so that no
partition needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import default_ranks, token_ids

CAPACITY = 2048            # tokens of a window
END_ID = 1                 # appended to every document
PARTITION_PIECES = 10_000  # pieces packed by one task (their ids are with them: 80 MB at most)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the full windows of ``n`` tokens, then of the rest."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def _piece_rows(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = np.array([*token_ids(path, text.as_py() or ""), end_id], "<u4")
                rows += [(doc_id, rid, s, n, len(ids), ids[s:s + n].tobytes()) for s, n in cuts(len(ids), capacity)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "rid", "start", "length", "doc_tokens", "ids"])
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, rid (of the document's row), start, length, doc_tokens, ids
    (little-endian unsigned 32-bit) of every piece.

    Null text counts as empty: one piece, the end id alone.  Repeated rows
    each give their pieces; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_piece_rows(ranks or default_ranks(), capacity, end_id),
                           "doc_id long, rid long, start long, length long, doc_tokens long, ids binary")


class OpenWindows:
    """Open windows by remaining capacity: leaf ``r`` of a segment tree stands
    for the windows with ``r`` tokens of room, an inner node says whether any
    leaf below it has one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        v = room + self.leaves
        while v and not self.any[v]:
            self.any[v] = True
            v >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for ``size``, which
        is open no longer; None if there is none."""
        some, v = self.any, size + self.leaves
        if not some[v]:
            while v & 1 or not some[v + 1]:      # up, until what lies to the right has one
                v >>= 1
                if v <= 1:
                    return None
            v += 1
            while v < self.leaves:               # down to its least room
                v = 2 * v if some[2 * v] else 2 * v + 1
        room = v - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            some[v] = False
            while v > 1 and not some[v ^ 1]:
                v >>= 1
                some[v] = False
        return room, window


def best_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of item numbers; ``sizes`` descending, each at most ``capacity``."""
    tree, windows = OpenWindows(capacity), []
    for item, size in enumerate(sizes):
        found = tree.take(size)
        if found is None:
            found = capacity, len(windows)
            windows.append([])
        room, w = found
        windows[w].append(item)
        if room > size:
            tree.add(room - size, w)
    return windows


def unpadded(n: int, capacity: int) -> bool:
    """Whether a sequence of ``n`` tokens is left as it is."""
    return n == capacity or n & (n - 1) == 0


def fill(windows: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) without any that needs padding.

    The least filled windows give their pieces, cut where needed, to the room
    of the fullest; the tokens of the last one are cut at powers of two.
    """
    total = lambda w: sum(n for _, _, n in w)
    done = [w for w in windows if unpadded(total(w), capacity)]
    rest = sorted((list(w) for w in windows if not unpadded(total(w), capacity)), key=total, reverse=True)
    i, j = 0, len(rest) - 1
    while i < j:
        room = capacity - total(rest[i])
        while room and i < j:
            item, start, n = rest[j].pop()
            part = min(room, n)
            rest[i].append((item, start, part))
            room -= part
            if part < n:
                rest[j].append((item, start + part, n - part))
            if not rest[j]:
                j -= 1
        if not room:
            done.append(rest[i])
            i += 1
    if i == j:
        last = rest[i][::-1]
        left = total(last)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                item, start, n = last.pop()
                part = min(room, n)
                window.append((item, start, part))
                room -= part
                if part < n:
                    last.append((item, start + part, n - part))
            done.append(window)
    return done


def _pack_group(capacity: int, no_padding: bool, names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        part, size = t["part"][0].as_py(), t["length"].to_numpy()
        t = t.take(pa.array(np.lexsort((t["start"].to_numpy(), t["rid"].to_numpy(), -size))))
        size = t["length"].to_pylist()
        windows = [[(i, 0, size[i]) for i in w] for w in best_fit_decreasing(size, capacity)]
        if no_padding:
            windows = fill(windows, capacity)
        places = [(item, start, n, (part << 32) | w) for w, window in enumerate(windows) for item, start, n in window]
        item, start, n, window = (np.array(c, np.int64) for c in zip(*places))
        ends = np.cumsum(n)
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        offset = ends - n - np.repeat((ends - n)[first], np.diff(np.r_[first, len(n)]))
        ids = [x.as_py() for x in t["ids"]]
        t = t.take(pa.array(item))
        put = {"start": t["start"].to_numpy() + start, "length": n, "sequence_id": window, "offset": offset,
               "ids": pa.array([ids[i][4 * s:4 * (s + k)] for i, s, k, _ in places], pa.binary())}
        return pa.table({c: put[c] if c in put else t[c] for c in names})
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, no_padding: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset of every
    piece in its place; offsets run without gaps from 0 in each sequence.

    Without ``no_padding`` windows stay as best-fit decreasing leaves them and
    only documents longer than a window are cut.  The number of partitions
    follows the texts' bytes (a token has at least one), so a partition holds
    about ``PARTITION_PIECES`` pieces however long the documents are.  Null
    texts, repeated rows and other columns as in ``pieces``; an empty table
    gives no rows.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col).cast("long"))).first()
    parts = max(1, -(-(n + (size or 0) // capacity) // PARTITION_PIECES))
    rows = pieces(docs, id_col, text_col, ranks, capacity, end_id)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rid", "start"), F.lit(parts)).cast("long"))
    long = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in long] + [T.StructField("ids", T.BinaryType())])
    return dealt.groupBy("part").applyInArrow(_pack_group(capacity, no_padding, schema.names), schema)
