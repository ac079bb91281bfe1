"""Language-model scoring with a weighted backoff automaton.

The automaton's states are the n-grams seen in training, its arcs read one
word and carry the log-probability of a seen (n+1)-gram, and every state has a
failure arc to its longest proper suffix that carries the mass the state gives
up.  Smoothing is linear discounting: a state seen c times gives up
``GIVE_UP / c ** FALL`` of its mass, so P(w|h) = (1 - g(c(h))) c(hw)/c(h) +
g(c(h)) P(w|h'); the root is the add-half unigram with one place for all
unknown words, so every state's probabilities sum to one.

Neither the automaton nor the counts ever meet in one place.  Texts are read
in blocks; a block asks the shuffle for the counts of its own distinct n-grams
(sorted 64-bit hashes, with its own training counts), each bucket of n-grams
sums what all blocks sent and answers every block in the order it was asked,
and the block, then holding the part of the automaton its texts can reach,
traverses them from left to right.  A frequent n-gram is one entry a block.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import written

ORDER = 2                # longest n-gram
GIVE_UP, FALL = 0.9, 0.15
BLOCK_BYTES = 8 << 20    # text of a block (a longer text is a block of its own)
BUCKET_KEYS = 2_000_000  # n-grams that blocks send to a bucket, about
_END = b""               # the end token, also the context of a text's first word
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; split at ASCII white space."""
    return (text or b"").lower().split()


class Block:
    """The tokens of some texts and their n-grams' keys."""

    def __init__(self, texts: list[bytes | None], training: np.ndarray, order: int):
        local: dict[bytes, int] = defaultdict(itertools.count().__next__)
        local[_END]
        parts, size = [], []
        for t in texts:
            w = words(t)
            parts.append(np.fromiter(map(local.__getitem__, w), np.int64, len(w)))
            parts.append(np.zeros(1, np.int64))
            size.append(len(w) + 1)
        self.size = np.array(size, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.token = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.hash = np.fromiter((xxh64_intdigest(w, 42) for w in local), np.uint64, len(local))
        train = np.repeat(training, self.size)
        self.keys: list[np.ndarray] = []       # by order: distinct, sorted
        self.own: list[np.ndarray] = []        # training counts of these
        self.at: list[np.ndarray] = []         # keys of every position (order 1: of every word)
        count = np.bincount(self.token[train], minlength=len(local))
        rank = np.argsort(self.hash)
        self.keys.append(self.hash[rank]), self.own.append(count[rank]), self.at.append(self.hash)
        gram = self.hash[self.token]
        full = np.ones(len(gram), bool)
        for n in range(2, order + 1):
            # the (n-1)-gram that ends before each position; a text's first word follows the end token
            before = np.concatenate([gram[:0], [self.hash[0]], gram[:-1]])[:len(gram)] if n == 2 else np.concatenate([[np.uint64(0)], gram[:-1]])[:len(gram)]
            first = np.zeros(len(gram), bool)
            first[self.start[self.size > 0]] = True
            if n == 2:
                before[first] = self.hash[0]
            else:
                full = np.concatenate([[False], full[:-1]])[:len(full)] & ~first
            gram = _mix(before, self.hash[self.token])
            seen, counts = np.unique(gram[train & full], return_counts=True)
            rest = np.setdiff1d(gram[~train & full], seen)
            k = np.concatenate([seen, rest])
            c = np.concatenate([counts, np.zeros(len(rest), np.int64)])
            rank = np.argsort(k, kind="stable")
            self.keys.append(k[rank]), self.own.append(c[rank]), self.at.append(np.where(full, gram, np.uint64(0)))
        self.full = full


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MIX[0] + b * _MIX[1]
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the key: a bucket is a slice of the sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block number, rows) of at most BLOCK_BYTES of text; the number depends
    on the task and the texts, so it is the same whenever the task runs."""
    task = TaskContext.get().partitionId()
    seq = 0
    for b in batches:
        size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in b.column(2)], np.int64)
        s = 0
        while s < b.num_rows:
            e = s + max(1, int(np.searchsorted(np.cumsum(size[s:]), BLOCK_BYTES, "right")))
            part = b.slice(s, e - s)
            name = b"%d %d %d %d" % (task, seq, e - s, size[s:e].sum())
            yield xxh64_intdigest(name) >> 1, part
            s, seq = e, seq + 1


def _texts(part: pa.RecordBatch) -> tuple[list[bytes | None], np.ndarray]:
    return [t.as_buffer().to_pybytes() if t.is_valid else None for t in part.column(2)], np.array(part.column(1).to_pylist(), bool)


def _ask(order: int, buckets: int):
    kinds = [("bucket", pa.int64()), ("block", pa.int64()), ("tokens", pa.int64()), ("texts", pa.int64()), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _cut(batches):
            texts, training = _texts(part)
            block = Block(texts, training, order)
            where = [_bucket(k, buckets) for k in block.keys]
            asked = np.unique(np.concatenate(where))         # only the buckets that hold n-grams of this block
            edge = [(np.searchsorted(w, asked), np.searchsorted(w, asked, "right")) for w in where]
            rows = []
            for r, i in enumerate(asked.tolist()):           # the first one also carries the block's numbers
                cut = [slice(a[r], b[r]) for a, b in edge]
                rows.append((i, name, 0 if r else int(block.size[training].sum()), 0 if r else int(training.sum()),
                             [k[c].tobytes() for k, c in zip(block.keys, cut)], [n[c].astype(np.uint32).tobytes() for n, c in zip(block.own, cut)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])
    return run


def _answer(t: pa.Table) -> pa.Table:
    """Sums one bucket: to every block the total counts, in the order asked."""
    end = xxh64_intdigest(_END, 42)
    totals, types = [], 0
    asked, counts = t["keys"].to_pylist(), t["counts"].to_pylist()
    for n in range(len(asked[0])):
        keys = np.concatenate([np.frombuffer(a[n], np.uint64) for a in asked])
        own = np.concatenate([np.frombuffer(c[n], np.uint32) for c in counts]).astype(np.int64)
        order = np.argsort(keys, kind="stable")          # merges the sorted runs
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[:len(ranked)]
        group = np.cumsum(new) - 1
        total = np.bincount(group, own[order]).astype(np.int64) if len(ranked) else np.empty(0, np.int64)
        if n == 0:
            types = int((total[ranked[new] != np.uint64(end)] > 0).sum())
        back = np.empty(len(keys), np.int64)
        back[order] = total[group]
        totals.append(np.split(back, np.cumsum([len(a[n]) // 8 for a in asked])[:-1]))
    rows = [[x[i].tobytes() for x in totals] for i in range(len(asked))]
    return pa.table({"bucket": t["bucket"], "block": t["block"], "tokens": t["tokens"], "texts": t["texts"],
                     "types": pa.array([types] + [0] * (len(rows) - 1), pa.int64()), "totals": pa.array(rows, pa.list_(pa.binary()))})


def _pack(id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for name, part in _cut(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([press.compress(sink.getvalue().to_pybytes())], pa.binary())], ["block", "rows"])
    return run


def traverse(block: Block, totals: list[np.ndarray], n_tokens: int, n_types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each token by the root alone and by the automaton,
    and whether it is known.  All positions of a block move together: at each
    order the state before a token either has an arc for it, or its failure
    arc is taken; a state never seen in training is skipped."""
    rank = np.searchsorted(block.keys[0], block.hash)
    word = totals[0][rank]
    count = word[block.token]
    root = (count + 0.5) / (n_tokens + 0.5 * (n_types + 1))
    p = root.copy()
    state = None
    for n in range(2, len(totals) + 1):
        if n == 2:   # the state is the word before, or the end token
            before = np.concatenate([[0], block.token[:-1]])[:len(block.token)]
            state = word[before]
        else:
            state = np.concatenate([[0], arc[:-1]])[:len(arc)]
        key = block.at[n - 1]
        at = np.minimum(np.searchsorted(block.keys[n - 1], key), max(0, len(block.keys[n - 1]) - 1))
        arc = totals[n - 1][at] if len(block.keys[n - 1]) else np.zeros(len(key), np.int64)
        if n > 2:
            inside = key != 0
            arc, state = np.where(inside, arc, 0), np.where(inside, state, 0)
        c = np.maximum(state, 1)
        give = GIVE_UP / c ** FALL
        p = np.where(state > 0, (1 - give) * arc / c + give * p, p)
    return np.log10(root), np.log10(p), count > 0


def _score(order: int, n_tokens: int, n_types: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        out = []
        answers = sorted(zip(right["bucket"].to_pylist(), right["totals"].to_pylist()))
        totals = [np.concatenate([np.frombuffer(a[n], np.int64) for _, a in answers]) for n in range(order)]
        for rows in left["rows"]:
            part = pa.ipc.open_stream(press.decompress(rows.as_py())).read_all().combine_chunks().to_batches()
            for b in part:
                texts, training = _texts(b)
                block = Block(texts, training, order)
                if any(len(t) != len(k) for t, k in zip(totals, block.keys)):
                    raise RuntimeError("a block's texts changed between two reads of the documents")
                root, p, known = traverse(block, totals, n_tokens, n_types)
                add = lambda x: np.add.reduceat(x, block.start)
                out.append(pa.table({"doc_id": b.column(0), "training": b.column(1), "n_tokens": pa.array(block.size),
                                     "n_known": pa.array(add(known.astype(np.int64))), "base_score": pa.array(add(root)), "score": pa.array(add(p))}))
        return pa.concat_tables(out)
    return run


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, training, n_tokens, n_known, train_tokens,
    base_score, score (log10).

    ``training`` marks the rows learned from (null: not).  Null text counts as
    empty: its only token is the end.  Repeated rows are learned from and
    scored as often as they occur.  Without any training row every token is
    unknown with probability 1.  An empty table gives no rows; other columns
    are ignored.  n-grams are told apart by 64-bit hashes.  ``docs`` has to
    give the same rows in the same order when read twice, as a table does.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-volume * order // (6 * BUCKET_KEYS)))
    asked = rows.mapInArrow(_ask(order, buckets), "bucket long, block long, tokens long, texts long, keys array<binary>, counts array<binary>")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "bucket long, block long, tokens long, texts long, types long, totals array<binary>")
    answers = written(answers, "lm-answers")
    n_tokens, n_texts, n_types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("texts"), F.sum("types")).first())
    packed = rows.mapInArrow(_pack(None), "block long, rows binary")
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, n_tokens, n_types + (n_texts > 0)),
        f"doc_id {kind}, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "training", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
