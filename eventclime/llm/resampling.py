"""Target-distribution importance resampling over hashed word n-grams.

Documents are weighted by how much likelier their n-grams are in the target
texts than in the corpus; Gumbel noise from a hash of the id turns the weights
into a sample without replacement.  The n-grams' CRC-32 comes from a position
table: CRC is linear up to a constant of the length, so a span's value is the
XOR of one table entry per byte, chosen by the byte and its distance from the
span's end (``bitwise_xor.reduceat`` over all spans at once), and the constant.
Spans longer than the table are folded in blocks, each moved to its place by
tables for powers of two of zero bytes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ORDERS = 3                # words of the longest feature
BUCKETS = 10_000
MIN_WORDS = 20            # shorter documents are not drawn
SHARE = (5, 100)          # of the documents with enough words
SEED = 42
POLYNOMIAL = 0xEDB88320   # of CRC-32, reflected
BLOCK = 64                # bytes that the position table reaches back
CHUNK_BYTES = 1 << 18     # bytes of text, and of spans, worked on at a time


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position table (distance x byte, flat), constants of the lengths up to
    BLOCK, and tables (power x place x byte) that append 2^power zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    zero = lambda x: (x >> 8) ^ byte[x & 255]  # noqa: E731  append one zero byte
    position = [byte]
    while len(position) < BLOCK:
        position.append(zero(position[-1]))
    state, constants = np.uint32(0xFFFFFFFF), []
    for _ in range(BLOCK + 1):
        constants.append(state ^ np.uint32(0xFFFFFFFF))
        state = zero(state)
    power = [np.array([zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])]
    while len(power) < 40:
        power.append(_apply(power[-1], power[-1]))
    return np.array(position).ravel(), np.array(constants, np.uint32), np.array(power)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def _append_zeros(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states after ``n`` zero bytes each."""
    x, power = x.copy(), _tables()[2]
    for t in range(int(n.max(initial=0)).bit_length()):
        on = (n >> t & 1).astype(bool)
        x[on] = _apply(power[t], x[on])
    return x


def _block_values(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the table entries of each block's bytes (at most BLOCK each)."""
    end = np.cumsum(size, dtype=np.int32)
    first = end - size
    at = np.arange(end[-1], dtype=np.int32)
    entry = np.repeat((end - 1).astype(np.int32), size)
    entry -= at                                        # distance from the block's end
    entry <<= 8
    at += np.repeat((start - first).astype(np.int32), size)
    entry |= data[at]
    return np.bitwise_xor.reduceat(_tables()[0][entry], first)


def crc32_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans ``data[start:start + size]``; each size above 0."""
    if not len(size):
        return np.empty(0, np.uint32)
    blocks = (size + BLOCK - 1) // BLOCK
    long = blocks > 1
    if not long.any():
        return _block_values(data, start, size) ^ _tables()[1][size]
    # blocks from each span's end: all but its first are whole
    of = np.repeat(np.arange(len(size)), blocks)
    last = np.cumsum(blocks)
    behind = BLOCK * (np.repeat(last, blocks) - 1 - np.arange(last[-1]))      # bytes that follow the block
    stop = (start + size)[of] - behind
    head = np.maximum(stop - BLOCK, start[of])
    values = np.concatenate([_block_values(data, head[k:k + CHUNK_BYTES // BLOCK], (stop - head)[k:k + CHUNK_BYTES // BLOCK])
                             for k in range(0, len(of), CHUNK_BYTES // BLOCK)])
    out = np.bitwise_xor.reduceat(_append_zeros(values, behind), last - blocks)
    full = np.uint32(0xFFFFFFFF)
    constant = _tables()[1][np.minimum(size, BLOCK)]
    constant[long] = _append_zeros(np.full(int(long.sum()), full), size[long]) ^ full
    return out ^ constant


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True      # in UTF-8, all of a character above 0x7F


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Words of documents that lie one after the other in ``raw``: their bytes
    with one space between the words of a document, and each word's start
    there, length and document."""
    low = _LOWER[raw]
    inside = _IN_WORD[low]
    bound = np.zeros(len(raw) + 1, bool)
    bound[offsets] = True
    before = np.r_[False, inside[:-1]] & ~bound[:-1]
    after = np.r_[inside[1:], False] & ~bound[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    size = end - start
    space = np.zeros(len(raw) + 1, bool)
    space[end] = True
    space = space[:-1] & ~inside
    low[space] = 32
    spaced = end < len(raw)
    spaced[spaced] = space[end[spaced]]
    place = np.cumsum(size + spaced) - size - spaced
    return low[inside | space], place, size, np.searchsorted(offsets, start, "right") - 1


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents of about CHUNK_BYTES: the first's number, bytes, offsets."""
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, "right")) - 1)
        yield k, data[offsets[k]:offsets[stop]], offsets[k:stop + 1] - offsets[k]
        k = stop


def features(column: pa.Array, orders: int = ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each feature, its bucket, words of each document) of the
    texts, piecewise; the words are counted in the first piece of a run."""
    for k, raw, offsets in _texts(column):
        text, place, size, doc = _words(raw, offsets)
        n_words = np.zeros(len(column), np.int64)
        n_words[k:k + len(offsets) - 1] = np.bincount(doc, minlength=len(offsets) - 1)
        yield np.empty(0, np.int64), np.empty(0, np.int64), n_words
        none = np.zeros(0, np.int64)
        for n in range(1, orders + 1):
            head = np.arange(max(0, len(doc) - n + 1))
            head = head[doc[head] == doc[head + n - 1]]
            start, length = place[head], place[head + n - 1] + size[head + n - 1] - place[head]
            step = np.searchsorted(np.cumsum(length), np.arange(CHUNK_BYTES, int(length.sum()) + CHUNK_BYTES, CHUNK_BYTES))
            for a, b in zip(np.r_[0, step], np.r_[step, len(head)]):
                if a < b:
                    yield k + doc[head[a:b]], crc32_spans(text, start[a:b], length[a:b]) % np.uint32(buckets), none


def _count(orders: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in features(b.column(0), orders, buckets):
                n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket (null text: none).  A task sends
    one count a bucket; ``buckets`` numbers come to the driver."""
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(_count(orders, buckets), "bucket int, n long")
    out = [0] * buckets
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that
    in the corpus."""
    s, t, m = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log(float(b + 1) * float(s + m) / (float(a + 1) * float(t + m)))) for a, b in zip(corpus, target)]


def _weigh(gain: np.ndarray, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for doc, bucket, words in features(b.column(1), orders, len(gain)):
                if len(words):
                    n_words += words
                elif len(doc):
                    low, here = int(doc[0]), int(doc[-1]) + 1      # documents come in order
                    n_features[low:here] += np.bincount(doc - low, minlength=here - low)
                    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    weight[doc[edge]] += np.add.reduceat(gain[bucket], edge)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, orders: int = ORDERS, buckets: int = BUCKETS,
             seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document.

    ``rank`` counts the drawn ones from 1, by score, ties to the smaller id; it
    is null where a document is not drawn.  Words are runs of digits, a-z
    (after lower-casing A-Z) and characters above 0x7F; a feature is a run of
    up to ``orders`` words of one text.  Null and empty texts have no words,
    weight 0 and are not drawn.  A null id is hashed as empty text and comes
    first among equals.  Rows that repeat an id are separate documents, with
    the same noise.  Other columns are ignored; an empty table gives no rows.
    """
    gain = np.array(gains(bucket_counts(docs, text_col, orders, buckets), bucket_counts(target, target_col, orders, buckets)), np.int64)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _weigh(gain, orders), "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = written(rows.withColumn("score", F.col("weight") + noise), "resampling-scores")

    # the place in the global order: its partition's start and the place there
    enough = F.col("n_words") >= min_words
    order = written(rows.orderBy(enough.desc(), F.desc("score"), F.asc_nulls_first("doc_id"), F.xxhash64("doc_id", "n_features", "weight"))
                    .withColumn("at", F.monotonically_increasing_id()), "resampling-order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    held = order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(enough).alias("n_enough"))
    # one row a partition of the sort: as many as the shuffle setting
    before = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    drawn = (held.agg(F.sum("n_enough")).first()[0] or 0) * share[0] // share[1]
    rank = F.col("before") + place + 1
    return order.withColumn("part", part).join(F.broadcast(before), "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
