"""Best-fit packing with certified bounds.

``pieces`` tokenises documents and cuts the longer ones; ``pack`` deals the
pieces to partitions of bounded size, packs each by best-fit decreasing and
certifies its number of sequences with dual-feasible-function lower bounds.
Partitions with a gap put the documents of their unfilled sequences into a
pool (a certified one, those of its least filled sequence); the pool is dealt
anew, so partitions exchange documents, and best-fit decreasing runs again,
as long as that saves sequences.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

CAPACITY = 1024            # tokens of a sequence
END_ID = 2                 # appended to every document
PARTITION_PIECES = 50_000  # pieces packed by one task
MAX_ROUNDS = 4             # exchanges; each stops the loop if it saves nothing
RANKS = "byte_bpe_50k.tiktoken"
LONG_SPACE = 100_000       # white space from which on a run is too long for tiktoken's pattern

_long_space = re.compile(r"\s{%d}" % LONG_SPACE).search


def default_ranks() -> str:
    """The merge ranks of the vocabulary in ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def _contract(path: str) -> str:
    """The vocabulary as ``tokenizers`` reads it, beside its merge ranks."""
    return os.path.splitext(path)[0] + ".json"


@functools.cache
def encoder(path: str):
    """The vocabulary of ``byte_bpe_50k.json`` in its faster form: the same
    ids (tests compare them), at about a quarter of the CPU time.  The added
    tokens of the JSON file are matched inside texts, as ``tokenizers`` does."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {}
    if os.path.exists(_contract(path)):
        with open(_contract(path), encoding="utf-8") as f:
            for t in json.load(f)["added_tokens"]:
                if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                    raise ValueError(f"an added token that is not matched as it is: {t}")
                added[t["content"]] = t["id"]
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@functools.cache
def slow_encoder(path: str):
    """``tokenizers`` itself, for texts that ``tiktoken`` cannot split."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_contract(path))


def token_ids(path: str, text: str) -> list[int]:
    """The ids of ``tokenizers`` for the text, without an end id."""
    if len(text) < LONG_SPACE or not _long_space(text):
        try:
            return encoder(path).encode(text, allowed_special="all")
        except BaseException as e:     # a panic of the pattern is not an Exception
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
    return slow_encoder(path).encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _piece_rows(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*token_ids(path, text.as_py() or ""), end_id], "<u4")
                rows += [(doc_id, k, s, n, ids[s:s + n].tobytes()) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids"])
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of
    every piece.  Null text counts as empty: one piece, the end id alone.
    Repeated rows each give their pieces; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_piece_rows(ranks or default_ranks(), capacity, end_id),
                           "doc_id long, piece int, start long, length long, ids binary")


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; ``sizes`` descending, each at most ``capacity``."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                       # bit r: some bin has r tokens of room
    count = 0
    for i, size in enumerate(sizes.tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            open_by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible
    functions (thresholds U(p), and u(k) for k up to 100) on the sizes."""
    if not len(sizes):
        return 0
    many = np.bincount(sizes, minlength=capacity + 1)[:capacity + 1]
    size = np.arange(capacity + 1)
    tokens, number = np.cumsum(many * size), np.cumsum(many)
    p = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - p]
    middle = tokens[capacity - p] - tokens[p - 1]
    best = max(-(-int(tokens[-1]) // capacity), int((large + -(-middle // capacity)).max()))
    for k in range(1, 101):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((many * value).sum()) // (k * capacity)))
    return best


def _pack_group(capacity: int, round_no: int):
    def run(t: pa.Table) -> pa.Table:
        size, rid = t["length"].to_numpy(), t["rid"].to_numpy()
        order = np.lexsort((rid, -size))
        bins, offsets = best_fit_decreasing(size[order], capacity)
        n_bins = int(bins.max()) + 1
        bound = lower_bound(size, capacity)
        fill = np.bincount(bins, size[order], n_bins)
        again = fill < capacity if n_bins > bound else (np.arange(n_bins) == fill.argmin()) & (fill < capacity)
        base = (round_no << 56) | (t["part"][0].as_py() << 32)
        n = len(order)
        put = {"sequence_id": base + bins, "offset": offsets, "bound": np.full(n, bound), "bins": np.full(n, n_bins), "pool": again[bins]}
        t = t.take(pa.array(order)).select([c for c in t.column_names if c not in put])
        for name, values in put.items():
            t = t.append_column(name, pa.array(values))
        return t
    return run


def _round(rows: DataFrame, n: int, capacity: int, round_no: int, part: Column | None = None) -> DataFrame:
    parts = -(-n // PARTITION_PIECES)
    by_hash = F.pmod(F.xxhash64("rid", F.lit(round_no)), F.lit(parts))
    dealt = rows.withColumn("part", (by_hash if part is None else part).cast("long"))
    plain = [f for f in dealt.schema.fields if f.name not in ("sequence_id", "offset", "bound", "bins", "pool")]
    schema = T.StructType([*plain, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "bound", "bins")],
                           T.StructField("pool", T.BooleanType())])
    return written(dealt.select(*[f.name for f in plain]).groupBy("part").applyInArrow(_pack_group(capacity, round_no), schema).drop("part"), "packed")


def pack(rows: DataFrame, capacity: int = CAPACITY, run: Column | None = None) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``capacity``; other columns are
    carried along) plus sequence_id, offset, and of the partition that placed
    the row: ``bins`` (its sequences) and ``bound`` (the certified least).
    ``run``, a column of small whole numbers, says which rows are packed
    together at first, in place of a hash.

    The same rows always give the same packing; ties are broken by the row's
    place in the written table.  An empty table gives no rows.
    """
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    done = None
    if n := rows.count():
        now = _round(rows, n, capacity, 0, run)
        for k in range(1, MAX_ROUNDS + 1):
            pool = now.where("pool")
            n, before = pool.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
            if not n:
                break
            new = _round(pool, n, capacity, k)
            if new.select("sequence_id").distinct().count() >= before:
                break
            kept = now.where("not pool")
            done, now = kept if done is None else done.unionByName(kept), new
        done = now if done is None else done.unionByName(now)
    else:
        done = rows.withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset", "bound", "bins")}).withColumn("pool", F.lit(False))
    return done.drop("rid", "pool")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, its token ids (from ``ids``), and
    the documents in order.  At most ``capacity`` rows meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
