"""Line dedup with a log-template tree.

Lines are parsed to a fixed depth: number of tokens, then the leading tokens
(tokens with digits are variable fields from the start).  Inside such a leaf a
token is constant at its position if enough documents have it there (three;
where that leaves a line too few constant tokens, two); the other positions
become variable fields.  What remains is the line's template, and
lines of a template that recurs across documents are dropped, but for the
template's first line.

The parse is order-free, so it is a chain of equality groupings: lines are
counted before anything is split into tokens, only leaves that recur go on,
and only their distinct lines are split.  Every grouping combines in the map
tasks and the joins deal hot keys, so a line, leaf or token of any frequency
stays spread.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import join_unique, written

LEADING = 3           # tokens of a line that are levels of the tree
MIN_DOCS = 2          # documents from which on a template recurs
TOKEN_DOCS = (3, 2)   # documents from which on a token is constant (at most 3); the first level that makes a template counts
MIN_CONSTANT = 0.5    # share of a template's tokens that must be constant
LEAF_BYTES = 1 << 18    # distinct lines of a leaf that one task parses; larger leaves are dealt by token
BUCKET_BYTES = 1 << 19  # such leaves taken together, about
FIELD = b"<*>"
_LOW = (1 << 64) - 1

_DIGIT = re.compile(rb"[0-9]").search


def masked_tokens(line: bytes) -> list[bytes]:
    """The line's tokens; those with a digit are fields."""
    tokens = line.split()
    return [FIELD if _DIGIT(t) else t for t in tokens] if _DIGIT(line) else tokens


def _line_rows(leading: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, digests, texts = [], [], [], []

            def out():
                d = np.array(digests, "<u8").view(np.int64).reshape(-1, 4)
                extra = [pa.array(texts, pa.binary()).cast(pa.string())] if with_text else []
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                     *[pa.array(d[:, k]) for k in range(4)], *extra],
                    ["ord", "h", "line_no", "a", "b", "la", "lb", *["masked"] * with_text])

            for k, text in enumerate(b.column(2)):
                if not text.is_valid:
                    continue
                for i, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    if tokens := masked_tokens(line):
                        flat = b" ".join(tokens)
                        x, y = xxh3_128_intdigest(flat), xxh3_128_intdigest(b"%d %b" % (len(tokens), b" ".join(tokens[:leading])))
                        row.append(k), number.append(i)
                        digests += (x & _LOW, x >> 64, y & _LOW, y >> 64)
                        if with_text:
                            texts.append(flat)
                if len(row) >= 20_000:
                    yield out()
                    row, number, digests, texts = [], [], [], []
            if row:
                yield out()
    return run


def _documents(docs: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """(ord, h, text): a document is its id and a hash of its text."""
    return docs.select(F.col(order_col).alias("ord"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def _lines(docs: DataFrame, leading: int, with_text: bool = False) -> DataFrame:
    """(rid, line_no, line, leaf[, masked]) of the lines that have tokens:
    ``line`` and ``leaf`` are 128-bit digests of the masked tokens and of the
    path in the tree."""
    kind = dict(docs.dtypes)["ord"]
    rows = docs.mapInArrow(_line_rows(leading, with_text), f"ord {kind}, h long, line_no int, a long, b long, la long, lb long"
                           + ", masked string" * with_text)
    return rows.select(F.struct("ord", "h").alias("rid"), "line_no", F.struct("a", "b").alias("line"),
                       F.struct(F.col("la").alias("a"), F.col("lb").alias("b")).alias("leaf"), *["masked"] * with_text)


def _digest(*cols) -> Column:
    """128 bits of the columns (two 64-bit hashes)."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(*cols, F.lit(1)).alias("b"))


def _documents_up_to_three() -> tuple[list[Column], Column]:
    """Aggregates over rows (docs, lo, hi), and the number of different
    documents that they give: 1, 2, or 3 for three and more.

    A row is a line: its documents, and the least and greatest of their 64-bit
    hashes.  One of three or more documents settles it; the others' documents
    are just lo and hi.  Whether all are the overall least or greatest shows in
    the bits that any, and that every, further hash of them has set (128 bits;
    a third document leaves all of them as they are once in 10**16)."""
    far = lambda c, k: F.xxhash64(c, F.lit(k))
    aggs, two = [F.max("docs").alias("at_once"), F.min("lo").alias("lo"), F.max("hi").alias("hi")], F.lit(True)
    for k in range(2):
        aggs += [F.bit_or(far("lo", k).bitwiseOR(far("hi", k))).alias(f"any{k}"), F.bit_and(far("lo", k).bitwiseAND(far("hi", k))).alias(f"all{k}")]
        two = two & (F.col(f"any{k}") == far("lo", k).bitwiseOR(far("hi", k))) & (F.col(f"all{k}") == far("lo", k).bitwiseAND(far("hi", k)))
    return aggs, F.when(F.col("at_once") >= 3, 3).when(F.col("lo") == F.col("hi"), 1).when(two, 2).otherwise(3)


def _parse_tokens(large: DataFrame, aggs: list[Column], number: Column, min_constant: float, token_docs: tuple[int, ...]) -> DataFrame:
    """(line, template) of the lines in leaves of any size."""
    # constant tokens: (leaf, position, token) that enough documents share
    cells = large.select("line", "docs", "lo", "hi", "leaf", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    cells = written(cells.select("line", "docs", "lo", "hi", (F.col("token") == FIELD.decode()).alias("field"), _digest("leaf", "pos", "token").alias("cell")),
                    "lines-cells")
    support = cells.groupBy("cell").agg(*aggs, F.count(F.lit(1)).alias("cells")).select("cell", number.alias("support"), "cells")
    constant = written(support.where(F.col("support") >= min(token_docs)), "lines-constant")
    marked = join_unique(cells.select("line", "field", "cell"), constant, "cell", "cells", F.col("line"))
    # the template: its constant positions and tokens, summed to 128 bits, by the first level with enough of them
    shape, template = [], F.lit(None)
    for t in reversed(token_docs):
        varies = F.col("field") | F.col("support").isNull() | (F.col("support") < t)
        part = lambda seed: F.sum(F.when(varies, F.lit(0)).otherwise(F.xxhash64("cell", F.lit(seed))).cast("decimal(20,0)"))  # noqa: B023, E731
        shape += [F.avg(F.when(varies, 0.0).otherwise(1.0)).alias(f"constant{t}"), part(1).alias(f"a{t}"), part(2).alias(f"b{t}")]
        template = F.when(F.col(f"constant{t}") >= min_constant, _digest("leaf", F.lit(t), f"a{t}", f"b{t}")).otherwise(template)
    shaped = marked.groupBy("line").agg(*shape).join(large.select("line", "leaf"), "line")
    return shaped.select("line", template.alias("template")).where(F.col("template").isNotNull())


def _parse_leaves(min_constant: float, token_docs: tuple[int, ...]):
    """The same for a bucket of whole leaves, one after the other."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*[t[c].to_pylist() for c in ("la", "lb", "a", "b", "docs", "lo", "hi")], t["masked"].cast(pa.binary()).to_pylist()))
        out = []
        for leaf, group in itertools.groupby(rows, key=lambda r: r[:2]):
            members = list(group)
            ids = [frozenset((lo, hi, None)) if docs >= 3 else frozenset((lo, hi)) for _, _, _, _, docs, lo, hi, _ in members]
            tokens = [r[7].split(b" ") for r in members]
            support = np.empty((len(tokens[0]), len(members)), np.int8)
            for p, column in enumerate(zip(*tokens)):
                have: dict[bytes, frozenset] = {}
                for x, d in zip(column, ids):
                    have[x] = have[x] | d if x in have and len(have[x]) < 3 else have.get(x, d)
                have[FIELD] = frozenset()
                support[p] = [min(3, len(have[x])) for x in column]
            level = np.zeros(len(members), int)
            for k in reversed(token_docs):
                level[(support >= k).sum(axis=0) / len(support) >= min_constant] = k
            for i in np.nonzero(level)[0].tolist():
                form = b" ".join(x if s else FIELD for x, s in zip(tokens[i], (support[:, i] >= level[i]).tolist()))
                z = xxh3_128_intdigest(b"%d %d %d %b" % (*leaf, level[i], form))
                out.append((*members[i][2:4], z & _LOW, z >> 64))
        d = np.array([(x & _LOW) for r in out for x in r], "<u8").view(np.int64).reshape(-1, 4)
        return pa.table({c: pa.array(d[:, k]) for k, c in enumerate(("a", "b", "ta", "tb"))})
    return run


def recurring(docs: DataFrame, lines: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT,
              token_docs: tuple[int, ...] = TOKEN_DOCS) -> DataFrame:
    """One row per distinct line whose template recurs: line (the digest of
    its masked tokens), template, docs (different documents that have the
    template; 3 stands for more too, unless ``min_docs`` is larger), first (the
    smallest (rid, line_no) under it), n (the line's occurrences).

    A document counts once for a leaf, a token or a template, however many of
    its lines have it.  ``lines`` has (rid, line_no, line, leaf) of every line
    of ``docs``."""
    aggs, number = _documents_up_to_three()
    per_doc = lines.groupBy("rid", "line", "leaf").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("k"))
    per_doc = per_doc.withColumn("doc", F.xxhash64("rid"))
    distinct = written(per_doc.groupBy("line", "leaf").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("k").alias("n"),
        F.min(F.struct("rid", "line_no")).alias("first")), "lines-distinct")
    leaves = distinct.groupBy("leaf").agg(*aggs, F.count(F.lit(1)).alias("leaf_lines"))
    leaves = written(leaves.select("leaf", number.alias("leaf_docs"), "leaf_lines"), "lines-leaves")
    live = join_unique(distinct, leaves, "leaf", "leaf_lines", F.col("line")).where(F.col("leaf_docs") >= min(min_docs, 3))
    live = written(live.select("line", "leaf", "docs", "lo", "hi", "n", "first"), "lines-live")

    # the text of the live lines, once each
    asked = live.select("line", "leaf", "docs", "lo", "hi", "n")
    texts = join_unique(_lines(docs, leading, True).select("line", "masked"), asked, "line", "n", F.xxhash64("masked")) \
        .where(F.col("docs").isNotNull()).drop("n").dropDuplicates(["line"])
    texts = written(texts.select("line", "leaf", "docs", "lo", "hi", "masked"), "lines-texts")
    sizes = written(texts.groupBy("leaf").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("masked")).alias("bytes")), "lines-sizes")
    sized = join_unique(texts, sizes, "leaf", "members", F.col("line"))
    # leaves that one task can take are parsed there; of the others the tokens are dealt
    buckets = (sizes.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES + 1
    small = sized.where(F.col("bytes") <= LEAF_BYTES).withColumn("bucket", F.pmod(F.xxhash64("leaf"), F.lit(buckets)))
    formed = small.select("bucket", F.col("leaf.a").alias("la"), F.col("leaf.b").alias("lb"), F.col("line.a").alias("a"), F.col("line.b").alias("b"),
                          "docs", "lo", "hi", "masked").groupBy("bucket").applyInArrow(_parse_leaves(min_constant, token_docs), "a long, b long, ta long, tb long")
    formed = formed.select(F.struct("a", "b").alias("line"), F.struct(F.col("ta").alias("a"), F.col("tb").alias("b")).alias("template"))
    large = sized.where(F.col("bytes") > LEAF_BYTES)
    if not sizes.where(F.col("bytes") > LEAF_BYTES).isEmpty():
        formed = formed.unionByName(_parse_tokens(large, aggs, number, min_constant, token_docs))
    templates = written(formed.join(live, "line").select("line", "template", "docs", "lo", "hi", "n", "first"), "lines-templates")
    groups = templates.groupBy("template").agg(*aggs, F.min("first").alias("all_first"), F.count(F.lit(1)).alias("members"))
    groups = groups.select("template", number.cast("long").alias("all_docs"), "all_first", "members")
    if min_docs > 3:     # counted in full
        rows = join_unique(lines.select("rid", "line"), templates.select("line", "template", "n"), "line", "n", F.col("rid"))
        full = rows.where(F.col("template").isNotNull()).select("template", "rid").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("all_docs"))
        groups = groups.drop("all_docs").join(full, "template")
    out = join_unique(templates.select("line", "template", "n"), written(groups, "lines-groups"), "template", "members", F.col("line"))
    return out.where(F.col("all_docs") >= min_docs).select(
        "line", "template", F.col("all_docs").alias("docs"), F.col("all_first").alias("first"), "n")


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts less the lines numbered in ``gone`` (null where there are none)."""
    def cut(t: bytes | None, numbers) -> bytes | None:
        if t is None:
            return None
        lines = bytes(t).split(b"\n")
        keep = np.ones(len(lines), bool)
        keep[numbers] = False
        return b"\n".join(itertools.compress(lines, keep))
    return pd.Series(map(cut, text, gone), dtype=object)


def line_dedup(docs: DataFrame, text_col: str = "text", leading: int = LEADING, min_docs: int = MIN_DOCS,
               min_constant: float = MIN_CONSTANT, order_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` as struct ``row``, plus ``text`` without the
    dropped lines, ``n_lines`` and ``n_dropped``.

    A template's first line (smallest ``order_col``, then a hash of the text,
    then line number) stays, so that content copied as a whole is not lost
    from all its copies; its other lines go.  Lines without tokens, lines with
    too few constant tokens and lines whose template is in fewer than
    ``min_docs`` different documents are never dropped.  Rows are never removed: a text
    that loses all lines becomes empty.  Null text stays null with 0 lines.
    Rows with the same id and text are one document and are treated alike.
    An empty table gives no rows.
    """
    base = _documents(docs, text_col, order_col)
    lines = written(_lines(base, leading), "lines-all")
    drop = written(recurring(base, lines, leading, min_docs, min_constant), "lines-recurring")

    found = join_unique(lines.select("rid", "line_no", "line"), drop, "line", "n", F.struct("rid", "line_no"))
    is_first = F.struct("rid", "line_no").eqNullSafe(F.col("first"))
    gone = found.where(F.col("template").isNotNull() & ~is_first).groupBy("rid").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct("*").alias("row")).withColumn(
        "rid", F.struct(F.col("row")[order_col].alias("ord"), F.xxhash64(F.col("row")[text_col]).alias("h")))
    both = rows.join(gone.select(F.col("rid").alias("at"), "gone"), F.col("rid").eqNullSafe(F.col("at")), "left")
    old = F.col("row")[text_col]
    some = F.col("gone").isNotNull()
    left = F.pandas_udf(_without, "binary")(F.when(some, old.cast("binary")), "gone").cast("string")
    return both.select(
        "row", F.when(some, left).otherwise(old).alias("text"),
        F.when(old.isNull(), 0).otherwise(F.size(F.split(old, "\n"))).alias("n_lines"),
        F.when(some, F.size("gone")).otherwise(0).alias("n_dropped"))
