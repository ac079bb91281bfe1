"""Hard-negative mining, window packing and importance resampling against
brute force, with nulls, empty and long texts, ties, repeats and clashes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventclime.llm import negatives, resampling, window_packing

DOCS = "doc_id long, text string, lang string, rid long, part long, ids binary, length string, score string, at long, bucket int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, b"x", "y", "z", 3, 4) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (2, ""), (None, "a b c d"), (None, None), (3, " \t\n"), (4, "Word " * 9000), (5, "a  b c d"),
       (6, "12 34 !!"), (7, "é漢字 \U0001f600 x"), (8, "漢字" * 3000), (9, "one <|endoftext|> two")]


# ---------------------------------------------------------------- packing

def _sequences(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.sequence_id].append((r.offset, r.length))
    return [sorted(s) for s in out.values()]


@pytest.mark.parametrize("no_padding", [True, False])
def test_window_packing_round_trip(spark, no_padding):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    texts = ODD + [(100 + k, " ".join(rnd.choice(["stone", "water", "of", "the", "X9"]) for _ in range(rnd.randrange(900)))) for k in range(60)]
    rows = window_packing.pack(_docs(spark, texts), no_padding=no_padding).collect()
    got = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, t in texts:
        if i not in (None, 2):
            want = tok.encode(t or "", add_special_tokens=False).ids + [1]
            parts = sorted(got[i])
            assert np.frombuffer(b"".join(x for _, x, _ in parts), "<u4").tolist() == want
            assert [s for s, _, _ in parts] == np.cumsum([0, *(len(x) // 4 for _, x, _ in parts)])[:-1].tolist()
            assert {n for _, _, n in parts} == {len(want)}
    assert [len(x) for _, x, _ in got[2]] == [4, 4] and sum(len(x) // 4 for _, x, _ in got[None]) == 6
    for s in _sequences(rows):
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and total <= 2048
        assert not no_padding or total == 2048 or total & (total - 1) == 0
    if not no_padding:       # only what is longer than a window is cut
        assert max(collections.Counter(r.doc_id for r in rows if r.doc_tokens <= 2048 and r.doc_id not in (None, 2)).values()) == 1


def test_window_packing_of_an_empty_table(spark):
    assert window_packing.pack(_docs(spark, ODD).limit(0)).count() == 0


def test_best_fit_takes_the_tightest_open_window():
    rnd = random.Random(3)
    for capacity in (1, 7, 16, 100, 2048):
        sizes = sorted((rnd.randint(1, capacity) for _ in range(400)), reverse=True)
        windows = window_packing.best_fit_decreasing(sizes, capacity)
        room, want = [], []
        for item, size in enumerate(sizes):
            fits = [r for r in room if r >= size]
            if not fits:
                room.append(capacity)
            k = room.index(min(fits or [capacity]))
            want.append(room[k])
            room[k] -= size
        left, got = {}, [None] * len(sizes)
        for w in windows:
            free = capacity
            for item in w:
                got[item] = free
                free -= sizes[item]
            assert free >= 0
        assert got == want          # the room that each item found
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))


def test_fill_leaves_no_padding_and_loses_nothing():
    rnd = random.Random(4)
    for capacity in (16, 100, 2048):
        for _ in range(30):
            sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randrange(1, 60))), reverse=True)
            windows = window_packing.fill([[(i, 0, sizes[i]) for i in w] for w in window_packing.best_fit_decreasing(sizes, capacity)], capacity)
            held = collections.defaultdict(list)
            for w in windows:
                total = sum(n for _, _, n in w)
                assert window_packing.unpadded(total, capacity) and 0 < total <= capacity
                for i, s, n in w:
                    held[i].append((s, n))
            for i, size in enumerate(sizes):
                at = 0
                for s, n in sorted(held[i]):
                    assert s == at and n > 0
                    at += n
                assert at == size


# ------------------------------------------------------------- resampling

def test_crc_of_spans():
    rnd = np.random.default_rng(5)
    data = rnd.integers(0, 256, 100_000, dtype=np.uint8)
    start = rnd.integers(0, 90_000, 3000)
    size = np.where(rnd.random(3000) < 0.9, rnd.integers(1, 70, 3000), rnd.integers(1, 10_000, 3000))
    for k in (slice(0, 3000), slice(0, 0), np.flatnonzero(size <= resampling.BLOCK)):
        got = resampling.crc32_spans(data, start[k], size[k])
        assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(start[k], size[k])]
    whole = np.tile(data, 20)
    assert resampling.crc32_spans(whole, np.array([0, 5]), np.array([len(whole), 1])).tolist() == [zlib.crc32(whole.tobytes()), zlib.crc32(whole[5:6].tobytes())]


def _slow_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _slow_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(bucket, _slow_features(text)[1]))
    for text in target:
        t.update(map(bucket, _slow_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, text in docs:
        n, f = _slow_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(x)) for x in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r))
    drawn = ranked[:5 * len(ranked) // 100]
    return out, drawn


def test_resampling_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = ["stone", "Water", "über", "漢字漢字", "x1", "of", "THE", "house", "q" * 80, "ß" * 300]
    docs = [*ODD, (50, "a,b;" * 20_000), *[(200 + k, rnd.choice(["", " ", "--"]).join(["", ""]) + rnd.choice([" ", "  ", ", ", "\n"]).join(rnd.choices(vocab, k=rnd.randrange(60)))) for k in range(300)]]
    docs += [docs[-1]] * 3
    target = [None, "", "the house of stone", "über water " * 30]
    df = _docs(spark, docs).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, n long")).collect()
    rows, drawn = _slow_resample(docs, target)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) > 5
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(_docs(spark, ODD).limit(0), none).count() == 0
    out = resampling.resample(_docs(spark, ODD), none).collect()
    assert len(out) == len(ODD) and all(r["rank"] is None for r in out)


def test_features_of_a_batch_do_not_depend_on_the_runs(monkeypatch):
    texts = pa.array([t for _, t in ODD] * 3)
    count = lambda: sum((collections.Counter(zip(d.tolist(), b.tolist())) for d, b, _ in resampling.features(texts)), collections.Counter())
    want = count()
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 100)
    assert count() == want


# --------------------------------------------------------------- negatives

def _slow_negatives(rows, scale=256):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * x) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i % 50:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, w, _ in ok]
        order = sorted((k for k in range(len(ok)) if k != a), key=lambda k: (-score[k], ok[k][0]))
        for p in [k for k in order if ok[k][2] == label][:5]:
            neg = [k for k in order if ok[k][2] != label and 50 * score[p] <= 100 * score[k] <= 95 * score[p]][:3]
            out += [(i, ok[p][0], r, ok[k][0], score[p], score[k]) for r, k in enumerate(neg, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, rid long, slot int, v string, b int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x", 3) for i, v, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_brute_force(spark, monkeypatch, small):
    if small:       # many chunks, blocks and merges
        for name, value in (("CHUNK_ANCHORS", 2), ("BLOCK_ROWS", 20), ("SCORED", 1), ("MERGED_BLOCKS", 2), ("LABEL_BUCKETS", 2)):
            monkeypatch.setattr(negatives, name, value)
    rnd = random.Random(7)
    base = [rnd.gauss(0, 1) for _ in range(8)]
    rows = []
    for i in range(400):
        label = rnd.randrange(4) if i % 3 else 1
        rows.append((i, [round(x + rnd.gauss(0, 0.6), 1) for x in base], label))
    rows += [(50, rows[50][1], rows[50][2]), (401, rows[3][1], 2), (402, rows[3][1], 2)]               # repeats and ties
    rows += [(None, base, 1), (450, None, 1), (451, [1.0, None], 1), (500, [1.0, math.nan], 1), (501, base, None), (550, [], 1), (551, [0.5], 3), (600, [-x for x in base], 2)]
    got = negatives.mine(_vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == _slow_negatives(rows)


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rows = [(50 * k, [x, 1.0], k % 2) for k, x in enumerate([3e6, 3e6 + 1, 3e6 - 1, 2e6, 2.5e6, 1e6])]
    assert sorted(map(tuple, negatives.mine(_vectors(spark, rows), F.lit(True)).collect())) == _slow_negatives(rows) != []
    huge = [(k, [1e300 * (1 + k)], k % 2) for k in range(4)]
    assert {r.positive_score for r in negatives.mine(_vectors(spark, huge), F.lit(True)).collect()} <= {2 ** 63 - 1}
    assert negatives.mine(_vectors(spark, rows).limit(0), F.lit(True)).count() == 0
    assert negatives.mine(_vectors(spark, rows), F.lit(False)).count() == 0


# ---------------------------------------------------------------- pipeline

def test_sequences_follow_the_mix(spark, monkeypatch):
    import corpus_pipeline
    from eventclime.llm import mixing
    from eventclime.llm.common import in_order, written

    monkeypatch.setattr(corpus_pipeline, "RUN_DOCS", 60)
    rnd = random.Random(8)
    source = lambda i: "large" if i % 3 == 0 else f"s{i % 5}"
    rows = [(i, "the stone of the water house " * rnd.randrange(1, 120), "en", source(i), 5) for i in range(900)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = written(corpus_pipeline.mix_sources(spark, docs, "").repartitionByRange(3, "doc_id"), "t-shuffled")     # any files
    mixed = written(corpus_pipeline.mix_sources(spark, kept, ""), "t-mixed")
    want = [r.doc_id for r in mixing.mix(kept).where("slot IS NOT NULL").orderBy("slot", "place").collect()]
    ranked = in_order(mixed, "rank").orderBy("rank").collect()
    assert [r.doc_id for r in ranked] == want and [r["rank"] for r in ranked] == list(range(901))
    out = corpus_pipeline.pack(spark, mixed, "").collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    of = {r.doc_id: r.source for r in ranked}
    assert all(ranked[r["rank"]].doc_id == r.doc_id for r in out)
    assert all(r.position == min(x["rank"] for x in out if x.sequence_id == r.sequence_id) for r in out[:50])
    # the documents of the first sequences have the shares of the mix's first documents, to a run
    first, seen = [], set()
    for r in sorted(out, key=lambda r: (r.position, r.sequence_id, r.offset)):
        if r["rank"] not in seen:
            seen.add(r["rank"])
            first.append(of[r.doc_id])
    for n in (200, 400, 600):
        for s in ("large", "s1", "s2", "s4"):
            assert abs(first[:n].count(s) - [of[i] for i in want[:n]].count(s)) <= 30


def test_line_stage_with_a_clashing_column(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a line\nof text", "en", "s", 3, "mine")], "doc_id long, text string, lang string, source string, n_chars long, text__ string")
    out = corpus_pipeline.drop_lines(spark, docs, "").collect()
    assert [(r.doc_id, r.text__, r.n_chars) for r in out] == [(1, "mine", len(out[0].text))]
