"""Token counts, packing, quality rules, sharding and extraction against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import html_extraction, packing, quality_rules, sharding, token_counts, vocabulary
from tests.llm.conftest import EDGES, prose

P = pytest.importorskip("public_tokenizers")
WILD = ["don't I'VE  x y　z", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "é İI ß ﬁ", "½²³ 123 x1y2 ___ --", "😀👍🏽 \x00\x1c\x85 tab\there", "İstanbul ΑΣ", "   lead  and trail   ", "\r\n\r\n a"]


def test_token_counts_equal_the_library(spark, make_docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = EDGES + [(100 + k, t) for k, t in enumerate(WILD)]
    tok = Tokenizer.from_file(path)
    got = token_counts.token_counts(make_docs(rows), path, block_bytes=2000).collect()
    want = sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert token_counts.token_counts(make_docs([]), path).count() == 0


def test_fast_pre_tokens_equal_the_library_on_every_fast_character():
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok, find = Tokenizer.from_file(path), token_counts.pre_tokens(path)
    letters = token_counts.byte_letters()
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(token_counts._LATIN + ["\t", "\n", "’", "—", "'s", " "]) for _ in range(80))
        norm = tok.normalizer.normalize_str(text)
        want = sorted(p for p, _ in tok.pre_tokenizer.pre_tokenize_str(norm))
        assert sorted("".join(letters[b] for b in k) for k, n in find(text.encode()).items() for _ in range(n)) == want


def test_packing_is_exact_and_tight(spark, make_docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = EDGES + [(100 + k, t) for k, t in enumerate(WILD)] + [(200 + k, prose(k, 10 + 7 * k)) for k in range(40)]
    tok = Tokenizer.from_file(path)
    got = packing.pack(make_docs(rows), path, capacity=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    for i, texts in wanted.items():
        total = sorted(sum(r["length"] for r in by_doc[i]) for _ in [0])
        assert total == [sum(map(len, texts))]
        if len(texts) == 1:
            pieces = sorted(by_doc[i], key=lambda r: r["piece"])
            assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
            assert list(np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4")) == texts[0]
            assert all(r["length"] == 256 for r in pieces[1:]) and len(pieces) == -(-len(texts[0]) // 256)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 256
    bound = -(-sum(r["length"] for r in got) // 256)
    assert len(by_sequence) <= bound + 2
    assert packing.pack(make_docs([]), path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 60))}
    used = {}
    for pattern, times in packing.plan(counts, 100):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 100
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    rows = packing.slots(packing.plan(counts, 100))
    assert rows[:, 2].sum() == sum(counts.values())


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_statistics(spark, make_docs):
    rows = [r for r in EDGES if r[0] != 7] + [(20, "a b c d e x a b c d e y\nsame\nsame\n \nsame"), (21, "#* $%& |<> é\x0b\x0cü"), (22, "a a a a a a a"), (23, "  nbsp word")]
    stats = quality_rules.text_statistics(make_docs(rows).select("doc_id", "text")).withColumn("failed", quality_rules.base_failed())
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["failed"]) for r in stats.collect()}
    assert got == {i: brute_quality(t) for i, t in rows}


def test_quality_rules_learn_and_apply(spark, make_docs):
    clean = [(k, prose(k, 40)) for k in range(150)]
    bad = [(1000 + k, " ".join(w + "***" for w in prose(k, 40).split())) for k in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in bad] + [(None, 0, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    scored = quality_rules.quality_rules(make_docs(clean + bad + EDGES), labels)
    kept = {r["doc_id"] for r in scored.where("kept").collect()}
    assert {i for i, _ in clean} <= kept and not kept & {i for i, _ in bad}
    none = quality_rules.quality_rules(make_docs(EDGES), labels.where("false"))
    assert none.where("NOT base_failed AND NOT kept").count() == 0 and none.count() == len(EDGES)
    assert quality_rules.quality_rules(make_docs([]), labels).count() == 0


def test_decision_list_expression_equals_arrays(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 5] < 0.6) | (x[:, 8] > 0.95)
    rules = quality_rules.learn_rules(x, bad)
    assert rules.rejects(x)[bad].mean() > 0.8 and rules.rejects(x)[~bad].mean() < 0.02
    assert quality_rules.learn_rules(x, np.zeros(600, bool)).rules == [] and str(quality_rules.DecisionList()) == "keep all"


def brute_shards(rows, limit):
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    out = {}

    def place(prefix, members):
        if sum(n for _, n in members) <= limit or len(members) == 1:
            out.update({k: prefix for k, _ in members})
            return
        for b in "01":
            inside = [m for m in members if bits[m[0]].startswith(prefix + b)]
            if inside:
                place(prefix + b, inside)

    place("", rows)
    return out


def test_shards_equal_brute_force(spark, make_docs):
    rng = random.Random(3)
    docs = [(k, "z" * rng.randint(0, 400)) for k in range(300)] + [(999, "y" * 5000)]
    got = sharding.extendible_shards(make_docs(docs), limit=2000).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == brute_shards([(k, len(t)) for k, t in docs], 2000)
    assert all(r["shard_bytes"] <= 2000 or r["shard_rows"] == 1 for r in got)


def test_shards_split_one_key(spark, make_docs):
    """A key with most rows, nulls and repeated rows still fits."""
    docs = [(5, "q" * 100)] * 64 + [(None, "n" * 100)] * 3 + [(6, None), (7, "")]
    got = sharding.extendible_shards(make_docs(docs), limit=1000, step=30).collect()
    assert len(got) == len(docs) and all(r["shard_bytes"] <= 1000 for r in got)
    assert sharding.extendible_shards(make_docs([])).count() == 0


def test_shard_files(spark, make_docs, tmp_path):
    docs = make_docs([(k, "t" * 100) for k in range(50)]).select("doc_id", "text")
    sharding.write_shards(docs, f"{tmp_path}/out", limit=1500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 50 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 1500


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href="/">Home of the site and of the world</a></header>
<nav><ul><li><a href=a>the one</a><li><a href=b>and the other</a></ul></nav><div class="cookie-notice">We use the cookies that you have to accept for the site to be good for you and for us all.</div>
<article><h1>Title &amp; more</h1><p>The first   paragraph of the page, with <b>bold</b> text&nbsp;and a <a href=x>link</a>, is long enough to be decided in the first pass of the rules.<p>Short.
<script>var t = "</p>";</script><div class="ad">Buy the best of the best now and for ever, it is a thing for you and your friends!</div><p>x &lt; y<br>z</p></article>
<aside>The most read of the week is on the list that you see here with all that is in it.</aside><section id="comments"><p>I was there and it was not like that at all, said the reader of the page.</p></section>
<form><p>Send us the mail that you have for us and we will be there for you.</p></form><footer>&copy; the site</footer></body></html>"""


def test_extraction_of_an_article():
    want = "Title & more\n\nThe first paragraph of the page, with bold text and a link, is long enough to be decided in the first pass of the rules.\n\nShort.\n\nx < y z"
    assert html_extraction.main_text(PAGE) == want


PROSE = "The text of the page is that of the article and it is what we want to see on this page for all of us that are here to read it, as it was for you and me in the past."


def test_a_teaser_in_a_container_does_not_take_the_article():
    page = f'<body><p>{PROSE} One.</p><p>{PROSE} Two.</p><div class="story-card"><p>A teaser of the story that is on the other page of the site for you.</p></div></body>'
    assert f"{PROSE} One.\n\n{PROSE} Two." in html_extraction.main_text(page)
    page = f"<p>{PROSE} Outside.</p><p>Menu of the site</p><article><p>{PROSE} In.</p><p>{PROSE} In.</p></article>"
    assert html_extraction.main_text(page) == f"{PROSE} Outside.\n\n{PROSE} In.\n\n{PROSE} In."


def test_unclosed_elements_do_not_take_the_page():
    for start in ("<head><title>T</title><meta charset=x><body>", "<head><title>T</title>", "<svg/>", '<iframe src="x" />', "<svg>", "<video src=x>", "<button>", "<canvas><object>"):
        assert html_extraction.main_text(f"<html>{start}<p>{PROSE}</p>") == PROSE, start
    assert html_extraction.main_text(f"<head><title>T</title>x</head><p>{PROSE}</p>") == PROSE
    assert html_extraction.main_text(f"<p>{PROSE}</p><style>p <p>{PROSE}") == PROSE
    html_extraction.main_text("<svg>" * 50_000 + "<head>" * 50_000)


def test_class_words_do_not_take_the_article():
    for name in ("legal content", "post share", "widget", "discussion-body", "related main-content"):
        assert html_extraction.main_text(f'<body><div><a href="/">Home</a></div><div class="{name}"><p>{PROSE} A.</p><p>{PROSE} B.</p></div></body>') == f"{PROSE} A.\n\n{PROSE} B.", name
    page = f'<div class="comments"><p>{PROSE} Reader.</p></div><article><p>{PROSE} Writer.</p></article>'
    assert html_extraction.main_text(page) == f"{PROSE} Writer."


def test_pages_of_other_languages_keep_their_text():
    polish = "Wczoraj wieczorem na rynku zebrało się kilkaset osób, które przyszły posłuchać koncertu. Orkiestra zagrała utwory znanych kompozytorów, a publiczność długo biła brawo. Na koniec wystąpił chór dziecięcy."
    italian = "Ieri sera nella piazza principale centinaia di persone hanno ascoltato il concerto dell'orchestra cittadina. Il pubblico ha applaudito a lungo, chiedendo ancora musica. Alla fine cantarono i bambini."
    japanese = "昨日の夕方、町の広場に何百人もの人々が集まり、市の楽団による演奏を楽しんだ。観客は長い間拍手を送り、最後に子どもたちの合唱団が歌を披露した。来年もまた同じ場所で開かれる予定だという。"
    for text in (polish, italian, japanese):
        page = f'<div><a href="/a">Menu</a> <a href="/b">Start</a></div><div><p>{text}</p><p>{text}</p></div><div><a href="/c">Link</a></div>'
        assert html_extraction.main_text(page) == f"{text}\n\n{text}"


def built_page(rng, marked):
    """(page, main text): paragraphs and short lines of an article between menus, teasers and a footer.

    ``marked``: with article elements and class words; else nothing but div and p tells them apart.
    """
    stops = "the of and to in a is that it for on was be with as by this from at are or an not have but they you he we which".split()
    words = [f"{a}{b}" for a in ("tor", "mel", "gan", "rid", "sul", "ven") for b in ("dex", "lum", "par", "nik", "fos", "bra")]
    prose = lambda n: " ".join(rng.choice(stops if rng.random() < 0.45 else words) for _ in range(n)).capitalize() + "."
    link = lambda n: "".join(f'<a href="/{k}">{" ".join(rng.choice(words) for _ in range(3))}</a> ' for k in range(n))
    tag = (lambda name, body: f"<{name}>{body}</{name}>") if marked else lambda name, body: f"<div>{body}</div>"
    kept = [prose(rng.randint(35, 90)) if k % 4 else prose(rng.randint(3, 8)) for k in range(1, rng.randint(5, 14))]
    kept.append(prose(40))
    kept.insert(0, prose(40))
    article = "".join(f"<p>{t}</p>" for t in kept)
    ad = f'<div class="ad">{prose(12)}</div>' if marked else f"<div>{link(3)}</div>"
    page = tag("nav", f"<ul>{''.join(f'<li>{link(1)}</li>' for _ in range(6))}</ul>") + tag("article", article) + ad
    page += tag("aside", f"<p>{link(4)}</p>") + tag("footer", f"&copy; {' '.join(rng.choice(words) for _ in range(5))}")
    return f"<html><body>{page}</body></html>", "\n\n".join(kept)


@pytest.mark.parametrize("marked", [True, False])
def test_built_pages_with_and_without_marks(marked):
    rng = random.Random(5)
    for _ in range(60):
        page, want = built_page(rng, marked)
        assert html_extraction.main_text(page) == want


@pytest.mark.parametrize("rule, value", [("_stop_density", lambda text: 1.0), ("MAX_LINKS", 2.0), ("LONG", 10), ("MIDDLE", 10**6)])
def test_each_density_rule_decides(monkeypatch, rule, value):
    """Without any one of stop words, link density and length, pages come out otherwise."""
    rng = random.Random(6)
    pages = [built_page(rng, False) for _ in range(20)]
    menu = '<div><a href="/">Menu of the site</a></div>'
    # Long, but no prose; prose, but short and thin, between menus.
    odd = f"{menu}<div>{' '.join(['mel tor ven'] * 30)}</div>{menu}<div>{'mel tor ven sul gan rid the ' * 3}dex lum</div>{menu}"
    assert all(html_extraction.main_text(p + odd) == want for p, want in pages)
    monkeypatch.setattr(html_extraction, rule, value)
    assert any(html_extraction.main_text(p + odd) != want for p, want in pages)


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (4, "u", "<p>The text of the page is that of the article and it is what we want to see."), (5, "u", "<script>never closed <p>The text"), (6, "u", "<<>><a <b"), (None, "u", "<!-- open"), (6, "u", "<p>" * 2000 + "The end of the line is here and it is the one that was there for all of us to see.")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id bigint, url string, html string, text int")
    got = html_extraction.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[5] == text[None] == "" and text[3] == "plain text" and text[4].startswith("The text")
    assert html_extraction.extract(df.where("false")).count() == 0


def test_extraction_time_is_linear():
    import time

    start = time.time()
    html_extraction.main_text('<a "' * 50_000 + "<p>x" * 20_000)
    html_extraction.main_text("<script>" * 20_000)
    assert time.time() - start < 20


def test_integer_packing():
    values = np.array([0, 1, 300, 2**32 - 1])
    assert list(vocabulary.unpack_ints(vocabulary.pack_ints(values))) == list(values)
    assert list(vocabulary.unpack_ints(vocabulary.pack_ints(values[:0]))) == [] and zlib.crc32(b"") == 0
