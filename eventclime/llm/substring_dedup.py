"""Suffix-array dedup: remove every byte covered by a string that repeats.

A string of ``LENGTH`` bytes repeats exactly if two suffixes share a prefix of
that length.  Only suffixes at *anchors* are compared: of the grams of
``GRAM`` bytes inside a string of ``LENGTH`` bytes the one with the smallest
hash (leftmost on ties) is its anchor, so equal strings have the same anchor
at the same place, and anchors are about one byte in 85.  Anchors whose gram
occurs once in the corpus cannot lie in a repeated string.  The context of an
anchor is all that its strings cover.  Anchors whose whole context occurs
again (told by a 128-bit hash) lose all of it; each such class of copies then
takes part once, as the partner of the contexts that occur once.  For these
and the single ones, the bytes after the anchor (its suffix) and before it
(reversed) are dealt by the gram and sorted by suffix: each gram's run is an
enhanced suffix array.
A stack scan walks its common-prefix interval tree; inside each interval the
left contexts, in sorted order, tell every occurrence its longest left
extension shared with any other occurrence of the interval (the test of left
diversity), so all occurrences of a maximal repeat are found, not just
neighbours in the array.  All repeated strings with the same anchor contain
it, so their union in a document is one interval around the anchor.

Grams with more than ``MAX_GROUP`` different contexts are not gathered: the strings
around them are counted by a 128-bit hash of all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, written

LENGTH = 200            # bytes of a repeated string
GRAM = 32               # bytes of an anchor (a power of two)
MAX_GROUP = 50_000      # different contexts of a gram that one task sorts

_A = 0x9E3779B97F4A7C15
_B = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _byte_table(seed: int) -> np.ndarray:
    """256 64-bit numbers by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * seed)) * np.uint64(_A)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTES = [_byte_table(0), _byte_table(1)]


def gram_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of each ``length`` bytes of ``data``, by doubling."""
    base = (_A, _B)[seed]
    power = _BYTES[seed][data]
    out, done, bit, span = None, 0, length, 1
    while bit:
        if bit & 1:   # append this power-of-two block to what is hashed already
            if out is None:
                out, done = power, span
            else:
                tail = power[done:]
                m = min(len(out), len(tail))
                out, done = out[:m] * np.uint64(pow(base, span, 1 << 64)) + tail[:m], done + span
        bit >>= 1
        if bit:
            power = power[:-span] * np.uint64(pow(base, span, 1 << 64)) + power[span:]
            span *= 2
    out = out[:max(0, len(data) - length + 1)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(_B)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all strings of ``length`` bytes: positions, hashes, and
    the first and last start of the strings that have this anchor."""
    if len(data) < length:
        return (none := np.empty(0, np.int64)), np.empty(0, np.uint64), none, none
    h = gram_hashes(data, gram)
    low = np.uint64(32)
    least = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]     # the place never moves back
    last = np.append(first[1:], len(at)) - 1
    at = at[first]
    return at, h[at], first, last


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid and len(value.as_buffer()) else np.empty(0, np.uint8)


def _anchor_rows(length: int, gram: int):
    """(id, th, pos, s, e, h, c) of each anchor: its place, its context's start
    and end, the hash of the gram and that of the context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = np.empty(0, np.int64)
            at, starts, ends, hashes, row, contexts = [none], [none], [none], [np.empty(0, np.uint64)], [none], []
            for k, text in enumerate(b.column(2)):
                data = text.as_buffer() if text.is_valid else b""
                p, h, first, last = anchors(_bytes(text), length, gram)
                at.append(p), starts.append(first), ends.append(last + length), hashes.append(h), row.append(np.full(len(p), k))
                data = memoryview(data)
                contexts += [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(first.tolist(), (last + length).tolist())]
            row = pa.array(np.concatenate(row))
            places = [pa.array(np.concatenate(x).astype(np.int32)) for x in (at, starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), *places, pa.array(np.concatenate(hashes).view(np.int64)),
                 pa.array(contexts, pa.binary())], ["id", "th", "pos", "s", "e", "h", "c"])
    return run


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([press.compress(t.as_buffer()) for t in b.column(2)], pa.binary())], b.schema.names)


def _open(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def _context_rows(length: int, gram: int):
    """(h, id, th, pos, before, after) of each listed anchor: the bytes around
    it that its strings cover; ``before`` reversed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, hashes, before, after = [], [], [], [], []

            def out():
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())),
                     pa.array(at, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                    ["h", "id", "th", "pos", "before", "after"])

            for k, (text, spots) in enumerate(zip(b.column(2), b.column(3))):
                data = _open(text)
                pos, h, first, last = anchors(np.frombuffer(data, np.uint8), length, gram)
                listed = np.isin(pos, spots.values.to_numpy())
                hashes.append(h[listed])
                for p, s, e in zip(pos[listed].tolist(), first[listed].tolist(), last[listed].tolist()):
                    row.append(k), at.append(p)
                    before.append(data[s:p][::-1]), after.append(data[p:e + length])
                if len(at) >= 50_000:
                    yield out()
                    row, at, hashes, before, after = [], [], [], [], []
            if at:
                yield out()
    return run


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width bytes padded with zero, lengths) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    if size.sum():
        out[np.arange(width) < size[:, None]] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return out, size.astype(np.int64)


def _common(m: np.ndarray, size: np.ndarray, order=None) -> np.ndarray:
    """Common-prefix lengths of neighbouring rows (in ``order``)."""
    if order is not None:
        m, size = m[order], size[order]
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the common-prefix intervals with value >= least,
    by a stack scan of the common-prefix lengths of neighbours."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > value:
            top, start = stack.pop()
            if top >= least:
                yield top, start, i
        if not stack or stack[-1][0] < value:
            stack.append((value, start))


def _scan(lcp: np.ndarray, left: np.ndarray, left_size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) extension around the anchor covered for each row of one
    gram's suffix array; left is -1 where no string repeats."""
    n = len(left)
    lefts = [left[i, :left_size[i]].tobytes() for i in range(n)]
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    left_lcp = _common(left, left_size, order)
    reach_left, reach_right = np.full(n, -1), np.zeros(n, np.int64)
    for value, first, last in intervals(lcp.tolist(), gram):
        ranks = np.sort(rank[first:last + 1])
        shared = np.minimum.reduceat(left_lcp[:ranks[-1]], ranks[:-1])
        best = np.maximum(np.append(shared, 0), np.insert(shared, 0, 0))
        ok = best + value >= length
        rows = order[ranks[ok]]
        reach_left[rows] = np.maximum(reach_left[rows], best[ok])
        reach_right[rows] = np.maximum(reach_right[rows], value)
    return reach_left, reach_right


def _solve(length: int, gram: int):
    def spans(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        column = lambda c: t[c].chunk(0) if t[c].num_chunks else t[c].combine_chunks()
        h = t["h"].to_numpy()
        left, left_size = _matrix(column("before"), length - gram)
        right, right_size = _matrix(column("after"), length)
        n = len(h)
        start = np.concatenate([[0], np.nonzero(np.diff(h))[0] + 1])
        size = np.diff(np.append(start, n))
        r, l = _common(right, right_size), _common(left, left_size)  # noqa: E741
        reach_left, reach_right = np.full(n, -1), np.zeros(n, np.int64)
        two = start[size == 2]
        ok = two[(l[two] + r[two] >= length) & (r[two] >= gram)]
        for k in (ok, ok + 1):
            reach_left[k], reach_right[k] = l[ok], r[ok]
        whole = (r == right_size[:-1]) & (r == right_size[1:]) & (l == left_size[:-1]) & (l == left_size[1:])
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            e = s + m
            if whole[s:e - 1].all():       # copies: every context is the same
                if left_size[s] + right_size[s] >= length:
                    reach_left[s:e], reach_right[s:e] = left_size[s], right_size[s]
            else:
                reach_left[s:e], reach_right[s:e] = _scan(r[s:e - 1], left[s:e], left_size[s:e], length, gram)
        at = np.nonzero(reach_left >= 0)[0]
        take, pos = pa.array(at), t["pos"].to_numpy()[at]
        return pa.RecordBatch.from_arrays(
            [t["id"].combine_chunks().take(take), t["th"].combine_chunks().take(take),
             pa.array((pos - reach_left[at]).astype(np.int32)), pa.array((pos + reach_right[at]).astype(np.int32))], ["id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []       # sorted by gram: the last run may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            h = b.column(0).to_numpy()
            if h[0] == h[-1]:
                continue
            cut = int(np.nonzero(h != h[-1])[0][-1]) + 1
            yield spans(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield spans(pa.Table.from_batches(held))
    return run


def _window_rows(length: int, gram: int):
    """(w1, w2, id, th, s) of every string around the listed anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (text, spots) in enumerate(zip(b.column(2), b.column(3))):
                data = np.frombuffer(_open(text), np.uint8)
                last = len(data) - length
                if last < 0:
                    continue
                near = np.zeros(last + 2, np.int64)
                for spot in spots.as_py():
                    lo, hi = max(0, spot - (length - gram)), min(last, spot)
                    if lo <= hi:
                        near[lo] += 1
                        near[hi + 1] -= 1
                at = np.nonzero(np.cumsum(near[:-1]))[0]
                w = [gram_hashes(data, length, seed)[at].view(np.int64) for seed in (0, 1)]
                row = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[0]), pa.array(w[1]), b.column(0).take(row), b.column(1).take(row), pa.array(at.astype(np.int32))],
                    ["w1", "w2", "id", "th", "s"])
    return run


def merge(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for s, e in sorted(spots):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        kept, runs, size = [], [], []
        for text, spots in zip(b.column(2), b.column(3)):
            data = _open(text)
            spans = merge([(x["s"], x["e"]) for x in spots.as_py()]) if spots.is_valid else []
            runs.append([{"start": s, "end": e} for s, e in spans])
            ends = [0, *(e for _, e in spans)]
            kept.append(b"".join(data[a:s] for a, (s, _) in zip(ends, spans)) + data[ends[-1]:])
            size.append(len(data))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs, start and
    end in bytes), kept (remaining bytes; a cut can split a character).

    Null text counts as empty; texts shorter than ``length`` bytes lose
    nothing.  Repeated rows are separate documents that share all their
    strings.  An empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(data).alias("th"), data.alias("data"))
    spots = base.mapInArrow(_anchor_rows(length, gram), f"id {kind}, th long, pos int, s int, e int, h long, c binary")
    counts = written(spots.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-grams")
    shared = join_unique(spots, counts, "h", "n", F.struct("th", "pos")).where(F.col("n").isNotNull())
    shared = written(shared.select(F.struct("id", "th").alias("rid"), "pos", "s", "e", F.struct("h", "c").alias("hc")), "repeat-shared")

    # classes of equal contexts: copies lose the whole context; each class
    # takes part once in the search for what the single contexts share
    classes = written(shared.groupBy("hc").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "pos")).alias("first"))
                      .select("hc", "m", "first.rid", "first.pos", F.col("hc.h").alias("h")), "repeat-classes")
    copies = join_unique(shared, classes.where("m > 1").select("hc", "m"), "hc", "m", F.struct("rid", "pos"))
    copies = copies.where(F.col("m").isNotNull()).select("rid.id", "rid.th", "s", "e")
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("m") == 1).alias("single"))
    groups = written(groups.where("k > 1 AND single > 0").select("h", "k"), "repeat-groups")
    firsts = join_unique(classes.select("rid", "pos", "h"), groups, "h", "k", F.struct("rid", "pos")).where(F.col("k").isNotNull())
    firsts = written(firsts.select("rid", "pos", "k"), "repeat-firsts")

    dealt = base.mapInArrow(_press, f"id {kind}, th long, data binary").select(F.struct("id", "th").alias("rid"), "data")

    def around(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("rid").agg(F.collect_set("pos").alias("spots"))
        return dealt.join(lists, "rid").select("rid.id", "rid.th", "data", "spots")

    context = around(firsts.where(F.col("k") <= max_group)).mapInArrow(
        _context_rows(length, gram), f"h long, id {kind}, th long, pos int, before binary, after binary")
    spans = context.repartition("h").sortWithinPartitions("h", "after").mapInArrow(_solve(length, gram), f"id {kind}, th long, s int, e int")
    spans = spans.unionByName(copies)
    hot = firsts.where(F.col("k") > max_group)
    if not hot.isEmpty():
        windows = written(around(hot).mapInArrow(_window_rows(length, gram), f"w1 long, w2 long, id {kind}, th long, s int")
                          .withColumn("w", F.struct("w1", "w2")).drop("w1", "w2"), "repeat-windows")
        twice = written(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-window-counts")
        again = join_unique(windows, twice, "w", "n", F.struct("th", "s")).where(F.col("n").isNotNull())
        spans = spans.unionByName(again.select("id", "th", "s", (F.col("s") + length).alias("e")))
    by_doc = spans.groupBy(F.struct("id", "th").alias("rid")).agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
    rows = dealt.join(by_doc, "rid", "left").select("rid.id", "rid.th", "data", "cuts")
    out = rows.mapInArrow(_cut_rows, f"id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.withColumnRenamed("id", "doc_id")
