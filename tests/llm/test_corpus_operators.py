"""Near duplicates, suffix dedup, decontamination, LM scores, toxicity and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tarn.llm import components, decontamination, lm_paths, lm_scoring, simhash, suffix_dedup, toxicity, windows
from tests.llm.conftest import EDGES, WORDS, prose


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, threshold):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def test_fingerprints_and_components(spark, make_docs):
    rng = random.Random(1)
    base = prose(50, 1500).split()
    near = []
    for k in range(25):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        near.append((300 + k, " ".join(words)))
    rows = EDGES + near
    got = simhash.near_duplicates(make_docs(rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    assert sorted(((r["doc_id"], r["fp"] % 2**64) for r in got), key=str) == sorted(((i, f) for (i, _), f in zip(rows, fps)), key=str)
    roots = brute_components(fps, 4)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, least.get(r)) for (i, _), r in zip(rows, roots)), key=str)
    assert sorted(((r["doc_id"], r["component"]) for r in got), key=str) == want
    assert len(set(roots[len(EDGES) :])) < len(near)
    kept = simhash.keep_one(make_docs(rows)).collect()
    assert len(kept) == len(set(roots)) and kept[0]["odd name"] == 2
    assert simhash.near_duplicates(make_docs([])).count() == 0 and simhash.keep_one(make_docs([])).count() == 0


@pytest.mark.parametrize("cap", [4, 10_000])
def test_links_lose_no_component(spark, cap):
    """Random fingerprints, chains and a crowded ball; small caps deal crowded anchors out in pairs of blocks."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for start in list(fps)[:20]:
        for _ in range(4):
            for _ in range(rng.randint(1, 4)):
                start ^= 1 << rng.randrange(64)
            fps.add(start)
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = components.connected_components(simhash.linked_fingerprints(df, cap=cap)).collect()
    root = {r["u"]: r["root"] for r in found}
    mine = [root.get(f, f) for f in signed]
    want = brute_components(fps, 4)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_anchors_of_close_fingerprints_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    y = x.copy()
    for _ in range(4):
        y ^= np.int64(1) << rng.integers(0, 63, 400)
    sets = []
    for v in (x, y):
        i, a = simhash.anchors(v)
        sets.append([set(a[i == k].tolist()) for k in range(400)])
    assert all(a & b for a, b in zip(*sets))


def test_components_of_long_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    got = components.connected_components(spark.createDataFrame(path, "u bigint, v bigint")).collect()
    root = {r["u"]: r["root"] for r in got}
    assert all(root[k] == 0 for k in range(1, 61)) and all(root[1000 + k] == 1000 for k in range(1, 50)) and root[2001] == 2000


def brute_removed(rows):
    """Removed byte masks by the definition; ``rows`` as (id, text)."""
    first = {}
    out = []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            key = math.inf if i is None else i
            first[w] = min(first.get(w, key), key)
    for i, t in rows:
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (math.inf if i is None else i):
                gone[k : k + 50] = True
        out.append((b, gone))
    return out


@pytest.mark.parametrize("limits", [suffix_dedup.Limits(), suffix_dedup.Limits(3000, 700, 50, 50, 1000, 7000, 500), suffix_dedup.Limits(9000, 700, 50, 50, 2)])
def test_suffix_dedup_equals_brute_force(spark, make_docs, limits):
    rng = random.Random(11)
    shared = [prose(70 + k, 25) for k in range(3)]
    rows = EDGES + [(400 + k, prose(100 + k, 20) + " " + rng.choice(shared)[rng.randint(0, 40) :] + " " + prose(200 + k, 12)) for k in range(25)]
    rows += [(500, "ab" * 300), (501, "ba" * 200), (502, "a" * 49), (503, "a" * 50), (504, "a" * 51), (505, "é" * 60), (506, "xé" * 60)]
    rng.shuffle(rows)
    got = suffix_dedup.remove_repeats(make_docs(rows).repartition(3), limits=limits).collect()
    want = Counter()
    for (i, _), (b, gone) in zip(rows, brute_removed(rows)):
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        want[i, len(b), tuple(zip(edges[::2].tolist(), edges[1::2].tolist())), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == want
    assert got[0]["odd name"] == 2
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_suffix_dedup_with_negative_ids(spark, make_docs):
    text = prose(77, 60)
    got = suffix_dedup.remove_repeats(make_docs([(-5, text), (-2, text), (3, text), (None, text)])).collect()
    assert {r["doc_id"]: len(r["kept"]) for r in got} == {-5: len(text.encode()), -2: 0, 3: 0, None: 0}


def test_suffix_dedup_uses_no_more_buckets_than_the_text_needs(spark, make_docs, monkeypatch):
    used, steps = [], suffix_dedup._steps

    def noted(texts, n, n_buckets, limits, seed):
        used.append(n_buckets)
        return steps(texts, n, n_buckets, limits, seed)

    monkeypatch.setattr(suffix_dedup, "_steps", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        suffix_dedup.remove_repeats(make_docs([(1, prose(1, 9000)), (2, prose(2, 10))]))
        suffix_dedup.remove_repeats(make_docs([(1, prose(1, 9000)), (2, prose(2, 10))]), limits=suffix_dedup.Limits(bucket=500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert used[0] == suffix_dedup.BUCKETS and used[1] == -(-len((prose(1, 9000) + prose(2, 10)).encode()) // 500)


def group_rows(text):
    one = pa.array([1], pa.int64())
    cells = [suffix_dedup.pack(np.array([len(text)], "<i8")), suffix_dedup.zstandard.compress(text), suffix_dedup.pack(np.array([3], "<i8"))]
    return pa.table([one, one, *(pa.array([c], pa.binary()) for c in cells), pa.array([[{"doc_id": 3}]])], names=["group", "block", "ends", "data", "keys", "carry"])


def test_cutting_takes_no_pass_over_the_text_for_each_bucket(monkeypatch):
    text, kinds = prose(5, 3000).encode(), np.arange(0, 400, 2)
    places = kinds * 40
    cover = suffix_dedup.pack(np.zeros(0, "<i8"), kinds, places)
    calls = []
    monkeypatch.setattr(suffix_dedup.np, "searchsorted", lambda *a, f=np.searchsorted, **b: calls.append(1) or f(*a, **b))

    def cut(n):
        notes = [suffix_dedup.pack(k, np.full(len(k), 5, "<u8")) for k in np.array_split(kinds, n)]
        found = pa.table([pa.array([suffix_dedup.COVER] + [0] * n, pa.int32()), pa.array([cover, *notes], pa.binary())], names=["bucket", "packed"])
        calls.clear()
        out = suffix_dedup._cut(group_rows(text), found, False)
        return out, len(calls)

    (few, a), (many, b) = cut(1), cut(100)
    assert few == many and a == b
    gone = np.zeros(len(text), bool)
    for at in places.tolist():
        gone[at : at + 50] = gone[at + 2 : at + 52] = True
    assert few["kept"][0].as_py() == bytes(np.frombuffer(text, np.uint8)[~gone])


def test_bits_of_one_class_from_several_buckets_are_united():
    kind, bits = suffix_dedup._united(np.array([7, 3, 7, 9]), np.array([1, 2, 4, 8], np.uint64))
    assert kind.tolist() == [3, 7, 9] and bits.tolist() == [2, 5, 8]
    assert [len(x) for x in suffix_dedup._united(np.zeros(0, np.int64), np.zeros(0, np.uint64))] == [0, 0]


def test_packed_columns_come_back():
    columns = [np.arange(5, dtype="<u4") * 70_000, np.zeros(0, "<i8"), np.frombuffer(b"abc", np.uint8), np.array([-1, 1 << 40], "<i8")]
    for got, want in zip(suffix_dedup.unpack(suffix_dedup.pack(*columns)), columns, strict=True):
        assert got.dtype == want.dtype and got.tolist() == want.tolist()


@pytest.mark.parametrize("wrong", [None, 0, 4, 9])
@pytest.mark.parametrize("chunk", [1, 1 << 18])
def test_a_wrong_claim_among_many_is_found(wrong, chunk):
    text = prose(6, 400).encode()
    first = np.arange(10) * 60
    home = suffix_dedup.pack(np.arange(10, dtype="<i8")[::-1].copy(), np.full(10, 5 * 64 + 11, "<i4"), first.astype("<i8")[::-1].copy())
    claims = []
    for k in range(10):
        spelled = np.frombuffer(text[first[k] : first[k] + 60], np.uint8).copy()
        spelled[-1] ^= k == wrong
        claims.append(suffix_dedup.pack(np.array([k], "<i8"), np.array([5 * 64 + 11], "<i4"), spelled))
    found = pa.table([pa.array([suffix_dedup.CLAIM] * 10 + [suffix_dedup.HOME], pa.int32()), pa.array([*claims, home], pa.binary())], names=["bucket", "packed"])
    assert len(suffix_dedup._verify(group_rows(text), found, suffix_dedup.Limits(chunk=chunk))) == (wrong is not None)


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    prefix = windows.prefix_hashes(data)
    start, segment = rng.integers(0, 2900, 500), np.sort(rng.integers(0, 5, 500))
    order = suffix_dedup.suffix_order(segment, start, prefix, data)
    got = [(segment[k], bytes(data[start[k] : start[k] + 50])) for k in order]
    assert got == sorted(got)
    a, b = rng.integers(0, 2900, 300), rng.integers(0, 2900, 300)
    for x, y, n in zip(a, b, suffix_dedup.extension(a, b, prefix, 50)):
        u, v = data[x : x + 50], data[y : y + 50]
        assert n == (50 if (u == v).all() else int(np.argmax(u != v)))


def test_verification_undoes_hash_collisions(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "extension", lambda a, b, prefix, length: np.full(len(a), length))
    data = np.frombuffer((prose(1, 40) + prose(2, 40)).encode(), np.uint8)[:220]
    mask = suffix_dedup.repeated_windows(np.array([1, 1], np.uint32), np.array([1, 2]), np.array([5, 5]), np.array([60, 60]), np.concatenate([data[:109], data[109:218]]))
    assert not mask.any()


def brute_alignment(item, text):
    """Plain Smith-Waterman over words."""
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            same = item[i - 1] == text[j - 1]
            stem = len(item[i - 1]) >= 5 and len(text[j - 1]) >= 5 and item[i - 1][:5] == text[j - 1][:5]
            pair = 2 if same else 1 if stem else -1
            h[i][j] = max(0, h[i - 1][j - 1] + pair, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_matrix():
    rng = random.Random(4)
    for _ in range(40):
        a, b = [rng.choice(WORDS[:9] + ["epsilons", "omicronx"]) for _ in range(rng.randint(3, 12))], [rng.choice(WORDS[:9] + ["epsilons"]) for _ in range(rng.randint(1, 25))]
        items = decontamination.Items([(1, " ".join(a))])
        numbers = items.numbers(b)
        stems = np.array([items.stems.get(w[:5], -1) if len(w) >= 5 else -1 for w in b], np.int64)
        assert decontamination.smith_waterman(items.words[0], items.stem[items.words[0]], numbers, stems)[0] == brute_alignment(a, b)


def test_decontamination_finds_copies_and_edits(spark, make_docs, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(30)) for k in range(12)] + [(50, None), (51, ""), (52, "short"), (53, text(30)), (54, "Too short")]
    docs = [(k, text(80)) for k in range(60)]
    planted = set()
    for d, (k, item) in zip(range(0, 48, 4), items):
        words = item.split()
        if d % 8 == 0:
            for at in range(3, 30, 7):
                words[at] = rng.choice(vocabulary)
        docs[d] = (d, text(30) + " " + " ".join(words).upper() + ", " + text(40))
        planted.add((d, k))
    docs[59] = (59, text(20) + " too short " + text(9) + " short")
    planted.add((59, 54))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for bits in (decontamination.MAX_BITS, 64):
        monkeypatch.setattr(decontamination, "MAX_BITS", bits)
        got = decontamination.contaminated(make_docs(docs + EDGES), benchmark).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == planted and all(0.5 <= r["score"] <= 1 for r in got)
    kept = decontamination.drop_contaminated(make_docs(docs + EDGES), benchmark)
    assert kept.count() == len(docs) + len(EDGES) - len(planted) and kept.columns == make_docs([]).columns
    assert decontamination.contaminated(make_docs([]), benchmark).count() == 0
    assert decontamination.contaminated(make_docs(docs), benchmark.where("false")).count() == 0


def edited(rng, words, vocabulary, how):
    """A copy with every third, fourth or fifth word replaced, words put in between, left out, or inflected."""
    if isinstance(how, int):
        return [rng.choice(vocabulary) if k % how == how - 1 else w for k, w in enumerate(words)]
    if how == "between":
        return [x for w in words for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.9 else [w])]
    if how == "left out":
        return [w for w in words if rng.random() < 0.8]
    return [w + "ness" if len(w) >= 5 and rng.random() < 0.7 else w for w in words]


def test_decontamination_equals_exhaustive_alignment(spark, make_docs):
    """Every pair of text and item at the threshold or above, and no other, with the score of the whole matrix."""
    rng = random.Random(21)
    common, rare = WORDS[:6], [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)]
    items = [(k, text(rng.choice([2, 3, 4, 5, 9, 14, 20, 31]))) for k in range(40)]
    rows, kinds = [], Counter()
    for d in range(160):
        how = [3, 4, 5, "between", "left out", "inflected"][d % 6]
        rows.append((d, " ".join(text(rng.randint(0, 25)) + edited(rng, items[d % 40][1], rare, how) + text(rng.randint(0, 25)))))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(make_docs(rows), benchmark).collect()}
    want = {}
    for d, t in rows:
        for k, w in items:
            score = brute_alignment(w, t.split()) / (2 * len(w))
            if score >= 0.5 and len(w) > 2:
                want[d, k] = score
                kinds[d % 6] += 1
    assert {pair: score for pair, score in got.items() if len(items[pair[1]][1]) > 2} == want
    assert all(n > 5 for n in kinds.values()) and len(kinds) == 6


def test_every_third_word_replaced_is_found(spark, make_docs):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(60)]
    docs = make_docs([(k, " ".join(edited(rng, w, ["zzz", "qqq"], 3))) for k, w in enumerate(items)])
    got = decontamination.contaminated(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(k, k) for k in range(60)}


def test_a_passage_that_many_documents_hold_is_found(spark, make_docs):
    item = prose(500, 30)
    docs = make_docs([(k, prose(600 + k, 20) + " " + item + " " + prose(700 + k, 20)) for k in range(30)])
    assert decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 30


def test_an_edit_with_only_a_frequent_seed_left_is_found(spark, make_docs):
    words = [f"{w}q" for w in WORDS[:15]]
    edited = [w if k not in (3, 6, 9, 12) else f"other{k}" for k, w in enumerate(words)]
    frequent = [(1000 + k, " ".join(words[:3]) + f" filler{k}") for k in range(150)]
    got = decontamination.contaminated(make_docs([(1, " ".join(edited)), *frequent]), spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in got] == [(1, 7, 0.6)]


def test_lm_base_scores_and_codes(spark, make_docs):
    # Two languages: for the rarer one the kind of a document tells more than the frequencies over all documents.
    rows = [(k, prose(k, 60) if k % 2 else prose(k, 60)[::-1]) for k in range(80)] + EDGES
    got = lm_scoring.lm_scores(make_docs(rows), block_bytes=4000).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, (t or "").encode().lower().split() + ["end"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in tokens), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 and r["bits_per_byte"] == (None if not t else pytest.approx(-r["score"] * math.log2(10) / len(t.encode()))) for r, t in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"])), [t for _, t in sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").split())))]))
    tested = [r for r in got if r["doc_id"] is not None and held(r["doc_id"]) and r["n_tokens"] > 30 and r["doc_id"] < 80 and r["doc_id"] % 2 == 0]
    assert tested and sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
    assert lm_scoring.lm_scores(make_docs([])).count() == 0
    alone = lm_scoring.lm_scores(make_docs([(2, "only held out")]), training=__import__("pyspark.sql.functions", fromlist=["lit"]).lit(False)).collect()
    assert alone[0]["n_known"] == 0 and alone[0]["score"] < 0


def test_spelling_is_a_probability():
    """Over all one-byte continuations of a prefix the mixed probabilities sum to less than one, as longer words remain."""
    n0, n1 = (np.random.default_rng(k).integers(0, 50, (lm_scoring.ORDERS, lm_scoring.SLOTS)).astype(np.float32) for k in (0, 1))
    kinds = np.zeros(lm_scoring.CLASSES, np.int64)
    both = lm_scoring.side_by_side(n0, n1)
    mixer = lm_scoring.train_mixer([b"0abc", b"0abd", b"0xyz"] * 50, np.ones(150), both, kinds)
    table = lm_scoring.states_of(both)
    every = [b"0a" + bytes([b]) for b in range(256)]
    assert lm_scoring.spelling_log10([b"0" + lm_scoring.END], table, mixer, kinds)[0] < 0
    hashes, data, _ = lm_scoring.contexts(every, kinds)
    assert hashes.shape == (lm_scoring.ORDERS, len(data))
    leaves = lm_scoring.spelling_log10(every, table, mixer, kinds)
    assert (10**leaves).sum() < 1


def test_states_keep_the_odds_of_large_counts():
    n1 = np.array([1e3, 1e5, 1e7, 1e9, 3e11])
    for odds in (0.25, 2.0, 9.0):
        states = lm_scoring.quantize(n1 / odds, n1)
        assert np.allclose(lm_scoring.STRETCH[states], math.log(odds), atol=0.02)
    packed = lm_scoring._slice(0, 0, np.array([[3e9, 0.5], [1e12, 7.0]]))
    assert lm_scoring._unpack_table(packed.column(2)[0].as_py()).tolist() == [[3e9, 0.5], [1e12, 7.0]]
    assert np.allclose(lm_scoring.plain_counts(lm_scoring.log_counts(n1)), n1, rtol=1e-3)
    assert lm_scoring.table_slots(10) == lm_scoring.SLOTS and lm_scoring.table_slots(5_000_000) == 1 << 23 and lm_scoring.table_slots(10**9) == lm_scoring.MAX_SLOTS


def buckets_of(texts):
    """All types of training texts as one bucket, its model, and a trained mixer."""
    known, keys, counts = lm_scoring.Words(), [], []
    for t in texts:
        kind, own, times, _ = lm_scoring.analyse(t.encode(), known)
        keys.append(own // lm_scoring.PREVIOUS * lm_scoring.CODES + kind * lm_scoring.PREVIOUS + own % lm_scoring.PREVIOUS)
        counts.append(times)
    bucket = lm_scoring.Bucket.gathered([(known.every, np.concatenate(keys), np.concatenate(counts))])
    kinds = np.arange(lm_scoring.CLASSES) % (lm_scoring.KINDS - 1)
    first = np.zeros((lm_scoring.CLASSES, lm_scoring.PREVIOUS, 1 << lm_paths.TOP))
    np.add.at(first, (bucket.classes, bucket.previous, (bucket.codes >> np.uint64(64 - lm_paths.TOP)).astype(int)[bucket.word]), bucket.n)
    tokens = np.bincount(kinds[bucket.classes], weights=bucket.n, minlength=lm_scoring.KINDS)
    once = np.bincount(kinds[bucket.classes], weights=bucket.n * (bucket.c[bucket.word] == 1), minlength=lm_scoring.KINDS)
    model = lm_scoring.Model(kinds, lm_paths.top_tables(first, kinds), lm_scoring.chance_of_new(tokens, once))
    paths = lm_paths.PathMixer()
    codes, n, ids, ends = bucket.entries(kinds)
    lm_paths.train(paths, codes, n, bucket.c[bucket.word], ids, ends, model.tops)
    return bucket, model, paths


def test_known_words_have_probabilities_that_sum_to_one():
    """In any class and after any word: over all known words, beside the chance of a new one."""
    bucket, model, paths = buckets_of([prose(k, 80) for k in range(60)])
    for code in (int(bucket.keys[5] % lm_scoring.CODES), int(bucket.keys[5] % lm_scoring.CODES) ^ 3, 77):
        every = np.arange(len(bucket.words)) * lm_scoring.CODES + code
        keys = np.union1d(bucket.keys, every)
        n = np.zeros(len(keys), np.int64)
        n[np.searchsorted(keys, bucket.keys)] = bucket.n
        both = lm_scoring.Bucket(bucket.words, keys, n)
        p = lm_scoring.token_log10(both, model, paths, np.zeros((lm_scoring.ORDERS, lm_scoring.SLOTS), np.uint16), lm_scoring.Mixer())
        kind = model.kinds[code // lm_scoring.PREVIOUS]
        assert abs((10 ** p[np.searchsorted(keys, every)]).sum() + model.new[kind] - 1) < 1e-9


def test_types_of_texts():
    """Each word with the class of the word before and the text's class, whatever the order of its commonest words."""
    known = lm_scoring.Words()
    text = "B a b  A\tc a b"
    kind, keys, counts, tokens = lm_scoring.analyse(text.encode(), known)
    words = text.lower().split()
    mark = lambda w: zlib.crc32(w.encode()) % lm_scoring.PREVIOUS
    want = Counter([(words[0], 0), *((w, mark(v)) for v, w in zip(words, words[1:])), ("end", mark("b"))])
    name = lambda k: "end" if k == 0 else known.every[k].decode()
    assert {(name(k // lm_scoring.PREVIOUS), k % lm_scoring.PREVIOUS): n for k, n in zip(keys.tolist(), counts.tolist())} == want
    assert kind == zlib.crc32(b"a") % lm_scoring.CLASSES and tokens == 8
    assert lm_scoring.analyse(b"a b", known)[0] == lm_scoring.analyse(b"b a", known)[0] == zlib.crc32(b"a") % lm_scoring.CLASSES
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in lm_scoring.analyse(b" ", known)] == [0, [0], [1], 1]


def test_nodes_have_the_counts_of_all_their_words():
    bucket, model, _ = buckets_of([prose(k, 40) for k in range(20)])
    codes, n, ids, ends = bucket.entries(model.kinds)
    k = int(np.argmax(bucket.n))
    got = {}
    for d, some, bit, same, other in lm_paths.nodes(codes, n, ids, ends, model.tops):
        for at in np.flatnonzero(some == k):
            got[d] = (int(bit[at]), same[:, at].tolist(), other[:, at].tolist())
    for d in range(64):
        shared = [j for j in range(len(codes)) if int(codes[j]) >> (64 - d) == int(codes[k]) >> (64 - d)]
        side = [j for j in shared if int(codes[j]) >> (63 - d) == int(codes[k]) >> (63 - d)]
        count = lambda js: [float(sum(n[j] for j in js if i[j] == i[k])) for i in ids]
        far = [j for j in shared if j not in set(side)]
        assert (d in got) == bool(far)
        if far:
            assert got[d] == (int(codes[k]) >> (63 - d) & 1, count(side), count(far))


def test_the_order_of_words_matters(spark, make_docs):
    text = lambda k: " ".join(f"{a} {a}after" for a in random.Random(k).sample(WORDS, 12))
    rows = [(k, text(k)) for k in range(300)]
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 7 == 2]
    mixed = [(k, " ".join(reversed(t.split())) if k in held else t) for k, t in rows]
    plain = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(make_docs(rows)).collect()}
    other = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(make_docs(mixed)).collect()}
    assert sum(plain[k] for k in held) > sum(other[k] for k in held) + len(held)


def test_mixers_learn_from_every_training_word(spark, make_docs, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 300}x" for j in range(60))) for k in range(80)]
    seen, averaged = {}, lm_scoring.Mixer.averaged
    monkeypatch.setattr(lm_scoring.Mixer, "averaged", classmethod(lambda cls, sums, use: seen.update(use=use) or averaged(sums, use)))
    lm_scoring.lm_scores(make_docs(rows), block_bytes=4000).collect()
    words = {w for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in text.split()}
    bits = 8 + sum(8 * (len(w) + 1) for w in words)
    assert seen["use"][: 32 * lm_scoring.ORDERS].sum() == bits * lm_scoring.ORDERS

    for kind in (lm_scoring.Mixer, lm_paths.PathMixer):
        a, b = kind(), kind()
        start = a.weights[1].copy()
        a.weights[0], a.used[0], b.weights[0], b.used[0] = 1.0, 1, 4.0, 2
        mean = kind.averaged(*(x + y for x, y in zip(a.sums(), b.sums(), strict=True)))
        assert np.allclose(mean.weights[0], 3.0) and np.allclose(mean.weights[1], start) and np.allclose(mean.map, a.map)


def test_adaptation_is_a_sequential_code():
    """Equal to adding one word after another, each with the document's own counts after words of its class."""
    rng = random.Random(4)
    p = {(m, w): rng.random() for m in range(2) for w in range(5)}
    used, log = Counter(), 0.0
    for _ in range(200):
        m, w = rng.randrange(2), rng.randrange(5)
        log += math.log10((lm_scoring.ALPHA * p[m, w] + used[m, w]) / (lm_scoring.ALPHA + sum(v for (k, _), v in used.items() if k == m)))
        used[m, w] += 1
    pairs = sorted(used)
    got = lm_scoring.adapted_log10(np.log10([p[k] for k in pairs]), np.array([used[k] for k in pairs], float), np.array([m for m, _ in pairs]))
    assert abs(got.sum() - log) < 1e-6


def test_log_gamma():
    x = np.array([1e-8, 0.1, 1.0, 2.5, 40.0, 1e6])
    assert np.allclose(lm_scoring.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_toxicity_learns_and_never_reads_held_out_labels(spark, make_docs):
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(500):
        words, bad = prose(k, 60).split(), k % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["zonkish", "zonkel", "zonkuma", "blarg"])
        rows.append((k, " ".join(words)))
        marks.append((k, None if k == 77 else int(bad)))
    labels = spark.createDataFrame(marks + [(None, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(make_docs(rows + EDGES), labels).where("doc_id IS NOT NULL").collect()}
    tested = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k] == (k % 6 == 0) for k in tested if k > 20]) > 0.95
    train = toxicity.training_rows(make_docs(rows), labels)
    assert not {r["_id"] for r in train.collect()} & set(tested)
    bare = toxicity.toxicity(make_docs([(1, "you idiot"), (2, None), (3, "fine")]), labels.where("false")).collect()
    assert [r["predicted"] for r in sorted(bare, key=lambda r: r["doc_id"])] == [1, 0, 0]
    assert toxicity.toxicity(make_docs([]), labels).count() == 0


def planted_votes(rng, y, toxic, clean, abstain):
    """Votes of voters with the given shares of TOXIC in either class, abstaining at random."""
    fired = rng.random((len(y), len(toxic))) < np.where(y[:, None], toxic, clean)
    votes = np.where(fired, toxicity.TOXIC, toxicity.CLEAN)
    return np.where(rng.random(votes.shape) < abstain, toxicity.ABSTAIN, votes)


@pytest.mark.parametrize("known", [0.0, 0.05, 1.0])
def test_label_model_finds_planted_accuracies(known):
    """With no, few and all labels (of which one in ten is wrong), beside many rows without."""
    rng = np.random.default_rng(0)
    y = rng.random(8000) < 0.3
    toxic, clean = np.array([0.9, 0.85, 0.75, 0.7, 0.6]), np.array([0.05, 0.1, 0.05, 0.15, 0.1])
    votes = planted_votes(rng, y, toxic, clean, 0.1)
    labels = np.where(rng.random(8000) < known, (y ^ (rng.random(8000) < 0.1)).astype(int), -1)
    posterior, model = toxicity.label_model(votes, labels)
    says = model.theta[:, :, toxicity.TOXIC] / model.theta[:, :, [toxicity.CLEAN, toxicity.TOXIC]].sum(axis=2)
    assert np.abs(says[1] - toxic).max() < 0.06 and np.abs(says[0] - clean).max() < 0.04
    assert abs(model.prior - 0.3) < 0.03 and ((posterior > 0.5) == y).mean() > 0.93
    assert not known or abs(model.accuracy - 0.9) < 0.04


def test_label_model_does_not_count_copies_of_a_voter_twice():
    rng = np.random.default_rng(1)
    y = rng.random(8000) < 0.3
    votes = planted_votes(rng, y, np.array([0.8, 0.8, 0.8, 0.7]), np.array([0.1, 0.1, 0.1, 0.2]), 0.0)
    echo = np.where(rng.random((8000, 6)) < 0.97, votes[:, 3:4], 3 - votes[:, 3:4])
    labels = np.where(rng.random(8000) < 0.1, y.astype(int), -1)
    plain, _ = toxicity.label_model(votes, labels)
    posterior, model = toxicity.label_model(np.c_[votes, echo], labels)
    assert ((posterior > 0.5) == y).mean() > ((plain > 0.5) == y).mean() - 0.01
    linked = [j for j in range(10) if model.parent[j] >= 0]
    assert set(linked) <= set(range(3, 10)) and len(linked) == 6


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input: junk goes, one of each group stays, repeats and leaks go, the rest is packed."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, passage = text(30), text(40)
    rows = [(k, text(90)) for k in range(60)]
    rows[10] = (10, rows[3][1])
    rows[20], rows[21] = (20, text(50) + " " + passage + " " + text(20)), (21, text(50) + " " + passage + " " + text(20))
    rows[30] = (30, text(40) + " " + item + " " + text(30))
    rows += [(60, "few words"), (61, "same again and more " * 30), (62, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(now)
    ids = [{r["doc_id"] for r in df.collect()} for df in kept]
    assert ids[0] == set(range(60)) and ids[1] == ids[0] - {10} and ids[2] == ids[1] and ids[3] == ids[2] - {30} and ids[4] == ids[3]
    assert all(df.columns == docs.columns for df in kept[:-1])
    cut = {r["doc_id"]: r for r in kept[2].collect()}
    assert passage in cut[20]["text"] and passage[5:-5] not in cut[21]["text"] and cut[21]["n_chars"] == len(cut[21]["text"])
    assert all(cut[k]["text"] == t for k, t in rows[:60] if k in cut and k != 21)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1].count()
