"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints
that differ in at most three bits, one segment differs in at most one bit, so
the two share a *variant* of that segment: the segment with one bit position
left out.  Every distinct fingerprint is indexed under its 64 variants; equal
variants meet by an equality shuffle and are verified on all 64 bits.  Each
linked pair belongs to exactly one variant (its first), and a group of equal
variants returns a spanning forest of its links, never all its pairs; the
forests together connect exactly what the links connect.

A variant that more than ``ALL_PAIRS`` fingerprints share is not solved in one
place: its rows are passed on as they come and dealt again by the same method,
one level down.  Of the three bits that may differ outside the variant's
segment, one 16-bit half of the other segment has at most one, so the pair
shares one of that half's 16 variants too.  A group of the second level leaves
18 bits free: it never holds more than 2^18 fingerprints, however many the
first level's group holds.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, written
from .components import components

BITS, SEGMENTS, MAX_DISTANCE, SHINGLE, SEED = 64, 2, 3, 3, 42
WIDTH = BITS // SEGMENTS
HALF = WIDTH // 2
SUB_BITS = 21         # of a second level's key: 5 for the sub-variant, 16 for the half
ALL_PAIRS = 2048      # larger groups are dealt again; if they still are larger, they look neighbours up (same links)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, repeats included (no word: 0)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(flat, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    pairs = zip(start[:n].tolist(), end[shingle - 1:].tolist())
    for _ in range(0, n, 1 << 16):
        part = [digest(flat[a:b], seed) for a, b in itertools.islice(pairs, 1 << 16)]
        raw = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp as a signed long) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def _first_variant(x: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For XORs ``x`` of linked pairs: the one variant index that owns the pair."""
    low, high = x & np.uint64((1 << width) - 1), x >> np.uint64(width)
    def bit(v):
        return np.bitwise_count(v - np.uint64(1) * (v > 0)).astype(np.int64) * (v > 0)  # index of a single set bit; 0 for none
    return np.where(np.bitwise_count(low) <= 1, bit(low), width + bit(high))


def _owns(x: np.ndarray, variant, sub=None) -> np.ndarray:
    """Whether a variant (and its sub-variant, on the second level) owns the
    pairs with XORs ``x``."""
    own = _first_variant(x) == variant
    if sub is None:
        return own
    other = np.where(np.asarray(variant) < WIDTH, x >> np.uint64(WIDTH), x & np.uint64((1 << WIDTH) - 1))
    return own & (_first_variant(other, HALF) == sub)


def _free_bits(variant: int, sub: int | None) -> list[int]:
    """Bits outside the variant's segment that may differ within a group."""
    base = WIDTH if variant < WIDTH else 0
    if sub is None:
        return list(range(base, base + WIDTH))
    rest = base + (HALF if sub < HALF else 0)         # the half that the sub-variant does not fix
    return sorted([base + sub, *range(rest, rest + HALF)])


@functools.lru_cache(maxsize=4096)
def _masks(variant: int, sub: int | None, distance: int) -> np.ndarray:
    """XORs of the linked pairs that a variant (and sub-variant) owns."""
    own = 1 << variant                # the bit left out: the only one of its segment that may differ
    other = [1 << b for b in _free_bits(variant, sub)]
    masks = np.array([first + sum(bits) for first in (0, own) for k in range(distance + 1 - bool(first))
                      for bits in itertools.combinations(other, k)], np.uint64)
    return masks[(masks != 0) & _owns(masks, variant, sub)]


def _forest(fp: np.ndarray, variant: int, distance: int, sub: int | None = None, limit: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest (indices) of the links that a variant (and sub-variant) owns in a group."""
    n, root = len(fp), np.arange(len(fp))
    out = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(us, vs):
        for u, v in zip(us.tolist(), vs.tolist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((u, v))

    if n <= (ALL_PAIRS if limit is None else limit):
        for i in range(n - 1):
            x = fp[i + 1:] ^ fp[i]
            ok = (np.bitwise_count(x) <= distance) & _owns(x, variant, sub)
            js = np.nonzero(ok)[0] + i + 1
            unite(np.full(len(js), i), js)
        return out
    order = np.argsort(fp)
    ranked = fp[order]
    for mask in _masks(variant, sub, distance):
        want = ranked ^ mask
        at = np.minimum(np.searchsorted(ranked, want), n - 1)
        hit = np.nonzero((ranked[at] == want) & (want > ranked))[0]
        unite(order[hit], order[at[hit]])
    return out


def _links(distance: int, level: int, limit: int):
    """Over rows (key, fp) sorted by key: the groups' links (a, b, false).  On
    level 1 the rows of a group above ``limit`` come back as (key, fp,
    true), batch by batch; no more than that many are ever held of one."""
    def names(key: np.ndarray):
        return (key >> WIDTH, None) if level == 1 else (key >> (WIDTH + SUB_BITS), (key >> HALF) & (2 * HALF - 1))

    def rows(a: np.ndarray, b: np.ndarray, again: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), again))], ["a", "b", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key, fp):
            cut = np.nonzero(np.diff(key))[0] + 1
            start = np.concatenate([[0], cut])
            size = np.diff(np.concatenate([start, [len(key)]]))
            a, b = [], []
            two = start[size == 2]
            x = fp[two] ^ fp[two + 1]
            ok = two[(np.bitwise_count(x) <= distance) & _owns(x, *names(key[two]))]
            a.append(fp[ok]), b.append(fp[ok + 1])
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                group = fp[s:s + n]
                if level == 1 and n > limit:
                    yield rows(key[s:s + n], group, True)
                    continue
                variant, sub = names(key[s])
                if f := _forest(group, int(variant), distance, None if sub is None else int(sub), limit):
                    f = np.array(f)
                    a.append(group[f[:, 0]]), b.append(group[f[:, 1]])
            yield rows(np.concatenate(a), np.concatenate(b), False)

        keys, fps, passed = [], [], None      # passed: the key whose rows are passed on
        for batch in batches:                 # the last run may go on in the next batch
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if passed is not None:
                end = np.searchsorted(key, passed, "right")
                if end:
                    yield rows(key[:end], fp[:end], True)
                key, fp = key[end:], fp[end:]
            if not len(key):
                continue
            passed = None
            keys.append(key), fps.append(fp)
            if keys[0][0] != key[-1]:
                k, f = np.concatenate(keys), np.concatenate(fps)
                end = np.searchsorted(k, k[-1])
                yield from solved(k[:end], f[:end])
                keys, fps = [k[end:]], [f[end:]]
            if level == 1 and sum(map(len, keys)) > limit:      # one key
                passed = keys[0][0]
                yield rows(np.concatenate(keys), np.concatenate(fps), True)
                keys, fps = [], []
        if keys:
            yield from solved(np.concatenate(keys), np.concatenate(fps))
    return run


def _dealt(variants: DataFrame, distance: int, level: int) -> DataFrame:
    rows = variants.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_links(distance, level, ALL_PAIRS), "a long, b long, again boolean")


def links(nodes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints ``fp`` that differ
    in at most ``distance`` bits (up to 3, the most two segments can serve)."""
    if not 0 <= distance <= 2 * SEGMENTS - 1:
        raise ValueError("two segments with one wildcard serve a distance of at most 3")
    i = F.col("i")
    segment = F.when(i < WIDTH, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    variants = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    variants = variants.select(
        (i.cast("long") * F.lit(1 << 32)).bitwiseOR(
            segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i % 32)")))).alias("key"), "fp")
    first = written(_dealt(variants, distance, 1), "simhash-links")
    again = first.where("again").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    other = F.when(F.shiftright("key", WIDTH) < WIDTH, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    half = F.when(i < HALF, F.col("other").bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned("other", HALF))
    subs = again.select("key", "fp", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("i"))
    subs = subs.select(
        F.shiftleft("key", SUB_BITS).bitwiseOR(i.cast("long") * F.lit(1 << HALF)).bitwiseOR(
            half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i % 16)")))).alias("key"), "fp")
    return first.where("not again").select("a", "b").unionByName(_dealt(subs, distance, 2).select("a", "b"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, distance: int = MAX_DISTANCE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links, itself included).

    Null and word-less texts have fingerprint zero and link like any other.
    Rows that repeat an id are separate rows of the result; a null id is never
    the component's id unless all ids of the component are null.  An empty
    table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-docs")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    comp = written(components(links(nodes, distance)), "simhash-comp")
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "d", "n", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("d").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = join_unique(rooted, written(roots, "simhash-roots"), "root", "m", F.col("fp")).select("fp", "n", "component_id")
    out = join_unique(fps, written(named, "simhash-named"), "fp", "n", F.col("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
