"""The pipeline against brute force, and cases at the edges: clashing names, no rows, odd ids, very long texts."""

import random

import pytest

import corpus_pipeline
from tarn.llm import decontamination, lm_scoring, packing, quality_rules, sharding, simhash, suffix_dedup, token_counts, toxicity
from tests.llm.conftest import EDGES, WORDS, prose
from tests.llm.test_corpus_operators import brute_alignment, brute_components, brute_fingerprint, brute_removed
from tests.llm.test_text_operators import brute_quality

P = pytest.importorskip("public_tokenizers")
#: Columns named like those that stages add.
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row int, fp string, n_words int, `odd name` int, spans int"


def corpus():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items, passages = [text(24) for _ in range(3)], [text(30) for _ in range(3)]
    rows = list(EDGES)
    for k in range(40):
        words = text(70).split()
        if k % 5 == 0:
            words[20:20] = rng.choice(passages).split()
        if k % 7 == 0:
            item = rng.choice(items).split()
            for at in range(k % 4, len(item), 5):
                item[at] = rng.choice(vocabulary)
            words[10:10] = item
        rows.append((100 + k, " ".join(words)))
    rows += [(200, rows[-1][1]), (201, rows[-2][1] + " more"), (202, "é" * 30 + " " + passages[0] + " è�" + text(20))]
    return rows, items


def write(spark, path, rows, items):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 3, "f", 9, 2, 5) for i, t in rows], CLASHING)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (None, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def brute_pipeline(rows, items):
    """(id, text) that each of the first four stages keeps."""
    out = []
    rows = [r for r in rows if not brute_quality(r[1])[-1]]
    out.append(rows)
    roots = brute_components([brute_fingerprint(t) for _, t in rows], 4)
    order = lambda r: (r[0] is None, r[0] or 0)
    best = {}
    for r, root in zip(rows, roots):
        if root not in best or order(r) < order(best[root]):
            best[root] = r
    rows = list(best.values())
    out.append(rows)
    cut = []
    for (i, _), (data, gone) in zip(rows, brute_removed(rows)):
        pieces, k = [], 0
        while k < len(data):
            end = k
            while end < len(data) and gone[end] == gone[k]:
                end += 1
            if not gone[k]:
                pieces.append(bytes(data[k:end]))
            k = end
        text = "".join(p.decode("utf-8", "ignore") for p in pieces) if gone.any() else bytes(data).decode()
        if text or not len(data):
            cut.append((i, text))
    out.append(cut)
    words = [decontamination.words_of(t) for t in items]
    out.append([(i, t) for i, t in cut if all(brute_alignment(w, decontamination.words_of(t)) < len(w) for w in words)])
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus()
    docs = write(spark, tmp_path, rows, items)
    want = brute_pipeline(rows, items)
    assert len({len(w) for w in want}) > 2
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        got = now.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want[k], key=str)
        assert all((r["kept"], r["row"], r["fp"], r["n_words"], r["odd name"], r["spans"]) == ("k", 3, "f", 9, 2, 5) for r in got)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths = sorted(((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in want[3]), key=str)
    packed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert sorted(packed.items(), key=str) == lengths


def test_a_second_run_leaves_the_first_one_alone(spark, tmp_path):
    rows, items = corpus()
    write(spark, tmp_path, rows[:30], items)
    first = corpus_pipeline.run(spark, str(tmp_path))
    n = first.count()
    second = corpus_pipeline.run(spark, str(tmp_path))
    assert first.count() == n == second.count() > 0


def test_pipeline_of_no_rows(spark, tmp_path):
    write(spark, tmp_path, [], [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_ids_of_suffix_dedup_are_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_shards_of_repeated_and_null_keys_hold_every_row_once(spark, tmp_path):
    rows = [(k % 3 if k % 4 else None, f"text {k} " * 40, k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    sharding.write_shards(df, f"{tmp_path}/s", limit=3000)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(str, ((r["doc_id"], r["text"], r["shard"]) for r in back.collect()))) == sorted(map(str, rows))


def test_training_rows_do_not_depend_on_the_order_of_ties(spark):
    rows = [(k % 20, prose(k, 30 + k % 5)) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(20)], "doc_id bigint, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic AS int) AS toxic")
    seen = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)
        x, bad = quality_rules.training_rows(docs, labels, 30)
        model = toxicity.learn(docs, labels, 12)
        seen.append((x.tolist(), bad.tolist(), model.features, model.weights.tolist()))
    assert seen[0] == seen[1]


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of megabytes: many words, one word, one line repeated, no ASCII."""
    shared = prose(900, 80)
    texts = [prose(1, 250_000), "x" * 3_000_000, "same line of text\n" * 120_000, "漢字かな交じり文。" * 120_000, prose(2, 150) + " " + shared, shared + " " + prose(3, 200)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), texts


def test_very_long_texts(spark, long_docs):
    from tokenizers import Tokenizer

    docs, texts = long_docs
    assert max(map(len, texts)) > 2_000_000
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("word_bpe_49k.json")).collect()}
    assert counted == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), carry={}).collect()
    ids = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        own = sorted((r["piece"], r["start"], r["length"]) for r in pieces if r["doc_id"] == k)
        total = len(ids.encode(t, add_special_tokens=False).ids) + 1
        assert sum(n for _, _, n in own) == total and all(n == packing.CAPACITY for _, _, n in own[1:]) and len(own) == -(-total // packing.CAPACITY)
    used = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= packing.CAPACITY and sorted(p)[0][0] == 0 for p in used.values())
    assert len(used) <= -(-sum(r["length"] for r in pieces) // packing.CAPACITY) + 1

    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[0]["n_bytes"] == len(texts[0].encode()) and [len(cut[k]["spans"]) for k in range(4)] == [0] * 4 and len(cut[5]["spans"]) == 1
    assert {r["doc_id"]: r["fp"] % 2**64 for r in simhash.near_duplicates(docs).collect()} == {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    items = spark.createDataFrame([(1, " ".join(texts[0].split()[200_000:200_030])), (2, prose(77, 30))], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(0, 1)]
    scored = lm_scoring.lm_scores(docs).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in scored} == {k: len(t.encode().split()) + 1 for k, t in enumerate(texts)} and all(r["score"] < 0 for r in scored)
    assert sharding.extendible_shards(docs).count() == len(texts)


def test_very_long_texts_of_labelled_operators(spark, long_docs):
    docs, texts = long_docs
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert [kept[k]["n_words"] for k in range(6)] == [len(t.split()) for t in texts] and kept[2]["base_failed"] and not kept[0]["base_failed"]
    assert toxicity.toxicity(docs, labels).count() == 6
