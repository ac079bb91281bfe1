"""Operators of the subpackage against brute force on small inputs, and the
defined results for nulls, empty texts, repeated rows and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from eventclime.llm import common, exact_dedup, knn, langid, line_dedup, lm, mixing, packing, simhash, substring_dedup, url_filter
from eventclime.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, rid long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (2, ""), (None, "a b c d"), (None, None), (3, " \t\n"), (4, "Word " * 3000), (5, "a  b c d"), (6, "12 34 !!"), (7, "é漢字 \U0001f600 x")]


def test_exact_dedup_odd_rows_and_collisions(spark):
    want = collections.defaultdict(list)
    for i, t in ODD:
        want[" ".join(p for p in [(t or "").replace("\t", " ").replace("\n", " ")]).replace("  ", " ").replace("  ", " ")].append(i)
    for weak in (None, lambda t: F.length(t)):     # a hash that collides all the time
        out = exact_dedup.exact_dedup(_docs(spark, ODD), **({"hash_fn": weak} if weak else {})).collect()
        assert len(out) == len(ODD)
        sizes = collections.Counter(r.text_sha256 for r in out)
        assert all(sizes[r.text_sha256] == r.group_size for r in out)
        by = {r.doc_id: r for r in out if r.doc_id}
        assert by[5].keep_id == 5 and by[5].group_size == 2 and by[1].keep_id == 1 and by[1].group_size == 4
        assert by[3].text_sha256 == hashlib.sha256(b" ").hexdigest()


def _slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdeÉ") for _ in range(4)) for _ in range(60)]
    rows = list(ODD)
    for i in range(100, 140):
        w = [rnd.choice(vocab) for _ in range(200)]
        for k in range(3):
            rows.append((3 * i + k, " ".join(w)))
            w[rnd.randrange(200)] = rnd.choice(vocab)
    fps = [_slow_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                comp[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)
    got = sorted((tuple(r) for r in simhash.simhash_dedup(_docs(spark, rows)).collect()), key=repr)
    assert got == want


def test_forest_connects_what_links_connect():
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    fps = np.array(sorted({base ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(5))}) for _ in range(200)}), np.uint64)
    groups = collections.defaultdict(list)
    for k, x in enumerate(fps.tolist()):
        for i in range(64):
            seg = x & 0xFFFFFFFF if i < 32 else x >> 32
            groups[i, seg & ~(1 << i % 32)].append(k)
    few = set()
    for (i, _), m in groups.items():
        if len(m) > 1:
            few |= {(m[a], m[b]) for a, b in simhash._forest(fps[m], i, 3)}

    def parts(edges, n):
        p = list(range(n))
        for _ in range(n):
            for a, b in edges:
                p[a] = p[b] = min(p[a], p[b])
        return p

    brute = {(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert parts(few, len(fps)) == parts(brute, len(fps))
    # a large group looks neighbours up instead: the same links
    (i, _), m = max(groups.items(), key=lambda g: len(g[1]))
    simhash.ALL_PAIRS = 1
    looked_up = simhash._forest(fps[m], i, 3)
    simhash.ALL_PAIRS = 2048
    assert parts(looked_up, len(m)) == parts(simhash._forest(fps[m], i, 3), len(m))


@pytest.mark.parametrize("all_pairs", [12, 2048])
def test_simhash_links_of_large_groups(spark, monkeypatch, all_pairs):
    """Groups of equal variants above ALL_PAIRS are dealt again (by halves of
    the other segment): the links still connect what brute force connects."""
    monkeypatch.setattr(simhash, "ALL_PAIRS", all_pairs)
    rnd = random.Random(8)
    fps = set()
    for _ in range(2):      # fingerprints that share the low (or the high) segment but for a bit, the other one near or far
        low, high = rnd.getrandbits(32), rnd.getrandbits(32)
        for _ in range(40):
            near = high ^ sum({1 << rnd.randrange(32) for _ in range(rnd.randrange(5))})
            x = (rnd.choice([near, near, rnd.getrandbits(32)]) << 32) | (low ^ rnd.choice([0, 0, 1 << rnd.randrange(32)]))
            fps |= {x, (x >> 32) | (x & 0xFFFFFFFF) << 32}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    found = simhash.links(nodes).collect()
    at = {x: k for k, x in enumerate(signed)}

    def parts(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(k) for k in range(len(fps))]

    brute = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 3 for r in found)
    assert parts([(at[r.a], at[r.b]) for r in found]) == parts(brute)
    groups = collections.Counter((i, (x & 0xFFFFFFFF if i < 32 else x >> 32) & ~(1 << i % 32)) for x in fps for i in range(64))
    assert max(groups.values()) > 24


def test_simhash_passes_a_large_group_on_in_parts():
    """A group over many batches is passed on as it comes, whole and once."""
    rnd = random.Random(9)
    sizes = [1, 2, 40, 3, 5, 6, 7, 30, 1]
    rows = [(k, rnd.getrandbits(60)) for k, n in enumerate(sizes) for _ in range(n)]
    for step in (1, 3, 4, 1000):
        parts = [rows[s:s + step] for s in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([f for _, f in p], pa.int64())], ["key", "fp"]) for p in parts]
        out = [r for b in simhash._links(3, 1, 5)(iter(batches)) for r in b.to_pylist()]
        again = sorted((r["a"], r["b"]) for r in out if r["again"])
        assert again == sorted((k, f) for k, f in rows if sizes[k] > 5), step


def test_packing_round_trip_and_bound(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pieces(_docs(spark, ODD))
    packed = packing.pack(rows)
    out = packed.collect()
    ids = collections.defaultdict(dict)
    for r in out:
        if r.doc_id is not None and r.doc_id != 2:
            ids[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
    for i, t in ODD:
        if i not in (None, 2):
            assert sum((ids[i][k] for k in sorted(ids[i])), []) == tok.encode(t or "", add_special_tokens=False).ids + [2]
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 1024
    assert len(bins) >= packing.lower_bound(np.array([r.length for r in out]))
    assert packing.sequences(packed).count() == len(bins)
    assert packing.pack(rows.limit(0)).count() == 0


def test_packing_ids_of_added_tokens_and_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "<|endoftext|><|endoftext|>  x\n", "<|endoftext", "a" + " " * 1_200_000 + "b <|endoftext|>",
             "\n" * 1_200_000]
    ids = collections.defaultdict(dict)
    for r in packing.pieces(_docs(spark, enumerate(texts))).collect():
        ids[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        assert sum((ids[i][k] for k in sorted(ids[i])), []) == tok.encode(t, add_special_tokens=False).ids + [2]


def test_lower_bound_never_exceeds_a_packing():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        sizes = np.sort(rnd.integers(1, 1025, rnd.integers(1, 200)))[::-1]
        bins, _ = packing.best_fit_decreasing(sizes)
        assert packing.lower_bound(sizes) <= bins.max() + 1
    assert packing.lower_bound(np.array([600, 600, 600])) == 3


def _windows_hold(weights, slots, lap):
    whole = mixing.integer_weights(weights)
    total, before, used = sum(whole), [0] * len(whole), [0] * len(whole)
    for t0 in range(0, slots, lap):
        after = mixing.lap_end(whole, before, t0, t0 + lap)
        for t, (s, j, release, due, slot) in enumerate(mixing.lap_slots(whole, before, after, t0, t0 + lap), t0):
            assert slot == t and release <= slot < due and j == used[s]
            assert release == j * total // whole[s] and due == -(-(j + 1) * total // whole[s])
            used[s] += 1
            assert all(abs(u * total - w * (t + 1)) < total for u, w in zip(used, whole))
        assert used == after
        before = after


@pytest.mark.parametrize("lap", [1, 7, 100, 1000])
def test_mixing_deviation_from_the_given_weights(lap):
    for weights in ([5.0, 3.0, 1.0], [1.0] * 7, [0.9, 0.05, 0.03, 0.02], [2.0], [0.3, 0.3] + [0.01] * 40,
                    [333_333.0 ** 0.7] + [(30_000.0 + 1111 * i) ** 0.7 for i in range(19)], [1e6] + [1.0] * 9):
        _windows_hold(weights, 2000, lap)


def test_mixing_integer_weights():
    assert mixing.integer_weights([3, 5.0]) == [3, 5] and mixing.integer_weights([0.7, 0.2, 0.09, 0.01]) == [70, 20, 9, 1]
    tiny = mixing.integer_weights([1.0, 1e-30])
    assert tiny[1] == 1 and abs(tiny[0] - mixing.UNIT) <= 1


def test_mixing_many_sources(spark):
    """A source for every document or two: 100,000 sources and one with a third of the rows."""
    df = spark.range(210_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 's' || (id % 100003) END AS source")
    out = mixing.mix(df).drop("row")
    n, places, slots = out.agg(F.count("slot"), F.count_distinct("source", "block", "place"), F.count_distinct("slot")).first()
    assert n == places == 210_000 and slots == out.select("source", "block").distinct().count()


def test_mixing_by_laps(spark):
    """The rows' slots are those of the schedule, whatever the laps, and no source is a block off in any prefix."""
    size = {"a": 1500, "b": 400, None: 90, "d": 9}
    rows = [(100 * i + k, "t", "en", s, 1, "x", 1) for k, (s, n) in enumerate(size.items()) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"a": 0.7, "b": 0.2, None: 0.09, "d": 0.01}
    for lap in (16, 100, None):
        out = mixing.mix(df, weights, block_docs=2, lap=lap).collect()
        assert len(out) == len(rows)
        blocks = sorted({(r.slot, r.source, r.block) for r in out if r.selected}, key=lambda b: b[0])
        assert [b[0] for b in blocks] == list(range(len(blocks))) and len(blocks) > 400
        used = collections.Counter()
        for slot, s, j in blocks:
            assert j == used[s]
            used[s] += 1
            assert all(abs(100 * used[x] - round(100 * w) * (slot + 1)) < 100 for x, w in weights.items())
        assert all(r.release <= r.slot < r.deadline for r in out if r.selected)
        assert min(r.slot for r in out if not r.selected) >= len(blocks)
        by = {}
        for r in out:
            by.setdefault(r.slot, set()).add((r.source, r.block))
        assert all(len(x) == 1 for x in by.values())
        # the source that runs out first ends the part in which the weights hold
        assert any(used[s] == -(-n // 2) for s, n in size.items())


def test_mixing_rows(spark):
    rows = [(i, "t", "en", "a" if i % 3 else None, 1, "x", 1) for i in range(90)] + [(None, None, None, "b", 1, None, 1)] * 4
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, block_docs=2).collect()
    assert len(out) == 94 and len({(r.source, r.block, r.place) for r in out}) == 94
    assert set(mixing.mixed(df).columns) == set(df.columns)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_every_document(spark):
    source = lambda i: None if i < 3 else "small" if i < 13 else f"s{i % 4}" if i % 3 else "large"
    rows = [(i, "t", "en", source(i), 1, "x", 1) for i in range(600)] + [(7, "t", "en", "small", 1, "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mixed(df)
    got = mixed.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mix(df).collect() if r.doc_id != 7}
    order = [place[r.doc_id] for r in got if r.doc_id != 7]
    assert order == sorted(order)
    # when a source has run out, the others go on in the ratio of their shares
    late = [r.source for r in got[300:500] if r.source != "large"]
    assert all(abs(late.count(f"s{k}") - len(late) / 4) <= 2 * mixing.BLOCK_DOCS for k in range(4))
    assert sorted(r.doc_id for r in mixing.mixed(df, weights={"large": 1.0, "small": 0.0}).collect()) == [i for i in range(600) if source(i) == "large"]
    kept = corpus_pipeline.mix_sources(spark, df, "")
    assert kept.count() == len(rows) and kept.columns == df.columns


def test_line_dedup(spark):
    note = "Build %d finished without any warning at host h%d today"
    rows = [(i, f"{'x' * (i + 2)} is a line of its own\n{note % (i, i)}\nshared by all of them\n") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "12 34\n12 34"), (13, "12 35")]
    out = {r.row.doc_id: r for r in line_dedup.line_dedup(_docs(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_dropped == 0
    for i in range(1, 6):
        assert out[i].text == f"{'x' * (i + 2)} is a line of its own\n" and out[i].n_dropped == 2
    assert out[10].text is None and out[10].n_lines == 0 and out[11].text == "" and out[12].text == "12 34\n12 34"
    assert line_dedup.line_dedup(_docs(spark, rows).limit(0)).count() == 0


def test_line_dedup_counts_documents_not_lines(spark):
    fruit = "".join(f"The price of {x} is low\n" for x in ("apples", "pears", "grapes", "plums"))
    rows = [(1, fruit), (1, fruit), (2, "another text\nof two lines")]
    assert [r.n_dropped for r in line_dedup.line_dedup(_docs(spark, rows)).collect()] == [0, 0, 0]
    rows += [(k, f"The price of {x} is low\nonly {x * 2} here") for k, x in ((3, "figs"), (4, "dates"))]
    out = {r.row.doc_id: r for r in line_dedup.line_dedup(_docs(spark, rows)).collect()}
    assert {i: out[i].n_dropped for i in out} == {1: 3, 2: 0, 3: 1, 4: 1} and out[3].text == "only figsfigs here"
    assert {r.n_dropped for r in line_dedup.line_dedup(_docs(spark, rows), min_docs=4).collect()} == {0}


def test_line_dedup_of_two_documents(spark):
    busy = [(10 + i, f"we all said {w} of it to them on the {w[::-1]} day and {w[1:]} then") for i, w in enumerate(["abcd", "bcda", "cdab", "dabc"])]
    twice = "we all said nothing whatever about any other thing that others may know"
    rows = [(1, f"alone here\n{twice}\nmy own"), (2, f"{twice}\nThe cost of pears is low"), (3, "The cost of plums is low"), *busy]
    out = {r.row.doc_id: r for r in line_dedup.line_dedup(_docs(spark, rows)).collect()}
    assert out[1].n_dropped == 0 and out[2].text == "The cost of pears is low" and out[3].n_dropped == 1


@pytest.mark.parametrize("min_docs, leaf_bytes", [(line_dedup.MIN_DOCS, line_dedup.LEAF_BYTES), (line_dedup.MIN_DOCS, 50), (5, 0)])
def test_line_dedup_against_brute_force(spark, monkeypatch, min_docs, leaf_bytes):
    monkeypatch.setattr(line_dedup, "LEAF_BYTES", leaf_bytes)
    rnd = random.Random(4)
    line = lambda: " ".join([rnd.choice("ab")] + ["x y z".split()[min(2, int(rnd.expovariate(2)))] + rnd.choice(["", "", "", "q", "s7"]) for _ in range(rnd.choice((3, 5)))])
    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 6)))) for i in range(80)]
    leaves, mask = collections.defaultdict(set), {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if w := tuple("<*>" if any(c.isdigit() for c in y) else y for y in x.split()):
                mask[i, k] = w
                leaves[len(w), w[:3]].add((i, k))
    gone = collections.Counter()
    for members in leaves.values():
        groups = collections.defaultdict(list)
        for at in members:
            for level in line_dedup.TOKEN_DOCS:
                form = tuple(y if y != "<*>" and len({i for i, k in members if mask[i, k][p] == y}) >= level else None for p, y in enumerate(mask[at]))
                if sum(y is not None for y in form) / len(form) >= 0.5:
                    groups[level, form].append(at)
                    break
        for g in groups.values():
            if len({i for i, _ in g}) >= min_docs:
                gone.update(i for i, _ in sorted(g)[1:])
    out = line_dedup.line_dedup(_docs(spark, rows), min_docs=min_docs).collect()
    assert {r.row.doc_id: r.n_dropped for r in out} == {i: gone[i] for i, _ in rows} and sum(gone.values()) > 5


def test_line_dedup_of_a_text_with_very_many_lines(spark):
    word = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    often = [f"{word(i)} is said again by all of the three" for i in range(40_000)]
    rows = [(k, "\n".join([*often, f"{word(k)} alone"] + [""] * k)) for k in range(3)]
    out = {r.row.doc_id: r for r in line_dedup.line_dedup(_docs(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_lines == 40_001
    for k in (1, 2):
        assert out[k].text == f"{word(k)} alone" + "\n" * k and out[k].n_dropped == 40_000


def test_language_id(spark):
    rnd = random.Random(2)
    words = {"en": "the of and house water stone", "de": "der und nicht straße wasser schön"}
    rows = [(i, " ".join(rnd.choice(words[x].split()) for _ in range(30)), x, "s", 1, "x", 1) for i in range(200) for x in [("en", "de")[i % 2]]]
    rows += [(900, None, "en", "s", 1, "x", 1), (901, "123 !!", None, "s", 1, "x", 1), (902, "", "de", "s", 1, "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in langid.identify(df, fold(F.col("doc_id")) != 0).collect()}
    assert all(out[i].lang_pred == ("en", "de")[i % 2] for i in range(200))
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def test_language_sample_of_a_very_small_rate(spark):
    train = spark.range(4_000_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    assert 0 < langid.sample(train, per_lang=3).count() < 20       # less than one in a million
    assert 900 < langid.sample(train, per_lang=1000).count() < 1100
    assert langid.sample(train.limit(50), per_lang=50).count() == 50


@pytest.mark.parametrize("bucket_keys", [lm.BUCKET_KEYS, 3])
def test_lm_scores(spark, monkeypatch, bucket_keys):
    monkeypatch.setattr(lm, "BUCKET_KEYS", bucket_keys)       # one bucket, and hundreds
    rows = [*ODD, *[(100 + i, "the cat sat on the mat " * (i % 3) + f"word{i} The") for i in range(40)]]
    out = lm.score(_docs(spark, rows), fold(F.col("doc_id")) != 1).collect()
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    one, two, n = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if train(i):
            w = tok(t)
            one.update(w), two.update(zip([b""] + w[:-1], w))
            n += len(w)
    want = []
    for i, t in rows:
        w, base, score = tok(t), 0.0, 0.0
        for a, x in zip([b""] + w[:-1], w):
            p = (one[x] + 0.5) / (n + 0.5 * (len(one) + 1))
            base += math.log10(p)
            if c := one[a]:
                g = lm.GIVE_UP / c ** lm.FALL
                p = (1 - g) * two[a, x] / c + g * p
            score += math.log10(p)
        want.append((str(i), len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_scores_of_other_orders(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BUCKET_KEYS", 20)
    rnd = random.Random(6)
    rows = [*ODD, *[(100 + i, " ".join(rnd.choice("the cat sat on a Mat".split()) for _ in range(rnd.randint(0, 9)))) for i in range(40)]]
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    seen, n = collections.Counter(), 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            w = [b"", *tok(t)]
            seen.update(tuple(w[k - m + 1:k + 1]) for k in range(1, len(w)) for m in range(1, order + 1) if k - m + 1 >= 0)
            n += len(w) - 1
    types = sum(len(g) == 1 for g in seen)
    want = []
    for i, t in rows:
        w, score = [b"", *tok(t)], 0.0
        for k in range(1, len(w)):
            p = (seen[w[k],] + 0.5) / (n + 0.5 * (types + 1))
            for m in range(2, min(order, k + 1) + 1):
                if c := seen[tuple(w[k - m + 1:k])]:
                    g = lm.GIVE_UP / c ** lm.FALL
                    p = (1 - g) * seen[tuple(w[k - m + 1:k + 1])] / c + g * p
            score += math.log10(p)
        want.append((str(i), len(w) - 1, round(score, 6)))
    got = lm.score(_docs(spark, rows), fold(F.col("doc_id")) != 1, order=order).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("max_group", [50_000, 5])
def test_repeats_against_brute_force(spark, max_group):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [text(n) for n in (40, 60, 120)]
    rows = [*ODD, (300, "a" * 900), (301, "ab" * 300), (302, "\0" * 300)]
    for i in range(20, 60):
        p = rnd.choice(shared)
        a = rnd.randint(0, len(p) // 2)
        rows.append((i, text(rnd.randint(0, 60)) + p[a:a + rnd.randint(100, 500)] + text(rnd.randint(0, 30))))
    rows += [(70, rows[-1][1]), (70, rows[-1][1]), (None, rows[-2][1])]
    count = collections.Counter(b[i:i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        want.append((str(i), len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    out = substring_dedup.remove_repeats(_docs(spark, rows), max_group=max_group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in out) == sorted(want)


def test_top_k_against_brute_force(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(400, 8)).round(3)
    x[::3] = x[0]                                        # a third of the rows are the same vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(500, None, 1), (520, [1.0, None] + [0.0] * 6, 1), (540, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (560, [1e18] * 8, 1), (580, [], 1), (40, x[40].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d long")
    got = collections.defaultdict(list)
    for r in knn.top_k(df, F.pmod("vec_id", F.lit(20)) == 0).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    live = [(i, [math.floor(64 * c) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    for q, (i, v) in enumerate(live):
        if i % 20 == 0 and i != 40:
            best = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), j) for k, (j, w) in enumerate(live) if k != q)[:20]
            assert sorted(got[i]) == [(r + 1, -s, j) for r, (s, j) in enumerate(best)], i
    assert len(got[40]) == 40
    assert knn.top_k(df.limit(0), F.lit(True)).count() == 0


def test_url_rules_and_trees(spark):
    rows = []
    for i in range(120):
        rows.append((i, ["http://a.example.org/es/%d", "https://x.example.org/%d", "http://shop.COM/de/%d?a=1&b=2", "http://shop.com/fr/%d"][i % 4] % i, "h"))
    rows += [(200, None, "h"), (201, "no scheme", "h"), (202, "http://EXAMPLE.org?x://y", "h"), (203, "http://notorg/x", "h"), (204, "http://q.net/de/1#f", "h"), (204, "http://q.net/de/1#f", "h"), (205, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_filter.judge_urls(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert (by[0].rule, by[0].verdict) == ("example.org/es/", "block") and (by[1].rule, by[1].verdict) == ("org/", "allow")
    assert (by[2].rule, by[2].verdict, by[2].host) == ("com/de/", "block", "shop.com") and by[3].rule == "com/fr/"
    assert (by[200].host, by[200].path, by[200].rule) == ("", "", None) and by[201].host == ""
    assert (by[202].host, by[202].path, by[202].rule) == ("example.org", "", None)
    assert by[203].rule is None and (by[204].host, by[204].path) == ("q.net", "/de/1")
    assert all(r.verdict in ("allow", "block") for r in out)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    rows = [(i, f"the house number {i} and the water of the stone " * (1 + i % 5), "en", f"s{i % 3}", 10) for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None, None, None, None), (98, "", "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, kept, "")
        assert nxt.columns == docs.columns, name
        kept = nxt
    out = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert out and {r.doc_id for r in out} <= set(range(60))


def test_sampled_rates(spark):
    rows = spark.range(200_000)
    for rate in (0.0, 1e-9, 1e-4, 0.3, 1.0):
        got = rows.where(common.sampled(rate, "id")).count()
        assert abs(got - rate * 200_000) <= 6 * math.sqrt(200_000 * rate * (1 - rate)) + (rate == 1e-9)
