"""The numbered operators against brute force or the libraries, on small and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from classledger.llm import (decontamination, extraction, jaccard, packing, quality, scoring, substrings, token_counts,
                             url_filter, warc)
from classledger.llm.subwords import piece_ids, split_parts, word_ids
from classledger.llm.tables import tokenizer_path
from classledger.llm.words import pieces, split_words

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi"
TEXTS = [None, "", " \n\t", "one", "one two", "One TWO", BASE, BASE + " psi", "x " + BASE, BASE, BASE.upper(), "a " * 60,
         BASE + " " + BASE, "<|endoftext|> it's café 日本\n" * 3, "w" * 3000, "\x00\x0b ok"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", "key") for i, t in enumerate(TEXTS)] + [(6, BASE, "kept", "key")]  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n string").repartition(3)


def test_repeated_windows(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    seen = set()
    for i, t in enumerate(TEXTS):
        w, gone = WORD.findall(t or ""), set()
        for s in range(len(w) - 19):
            if tuple(w[s:s + 20]) in seen:
                gone.update(range(s, s + 20))
            seen.add(tuple(w[s:s + 20]))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def test_heavy_seeds_give_the_same(docs):
    key = lambda df: sorted(map(tuple, df.drop("text").collect()), key=str)
    assert key(substrings.remove_repeats(docs)) == key(substrings.remove_repeats(docs, heavy=1))


def test_similar_documents(docs):
    sets, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(TEXTS):
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
    part = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    part[i] = part[j] = min(part[i], part[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == {i: (len(sets[i]), part[i]) for i in sets}


def test_near_copies_around_the_threshold_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            words[rng.randrange(70)] = f"x{rng.randrange(40)}"
        texts.append(words)
    sets = [{tuple(w[i:i + 5]) for i in range(66)} for w in texts]
    root = list(range(len(texts)))
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                linked += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert 0 < linked and len(set(root)) > 20
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs, 5, 80).collect()}
    assert got == dict(enumerate(root))


def test_items_are_found_and_nothing_else(spark, docs):
    bench = spark.createDataFrame([(1, BASE), (2, None), (3, "one two"), (4, "not in any document of all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_items(docs, bench).collect()}
    assert got == {(i, 1) for i in (6, 7, 8, 9, 10, 12)} | {(4, 3), (5, 3)}
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns


def test_a_long_text_of_repeated_items(spark):
    words, other = [f"w{i}" for i in range(25)], [f"x{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join((words + other) * 1700)), (2, " ".join(["x"] * 9 + words))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {tuple(r) for r in decontamination.find_items(docs, bench).drop("key").collect()}
    assert got == {(1, 1, 1.0, 0, 25), (2, 1, 1.0, 9, 25)}


def test_token_counts_and_packing(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got == {i: len(piece.encode(t or "")) for i, t in enumerate(TEXTS)}
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    encode, found = word_ids("word_bpe_49k.json", 2), []
    for _, _, data, offsets in pieces(pa.array(TEXTS, pa.string())):
        flat, first, _, _ = encode(split_parts(data, offsets))
        found += [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    want = [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    assert found == want
    rows = packing.pack_documents(docs, window=64).collect()
    tokens = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert tokens == {i: len(w) * (2 if i == 6 else 1) for i, w in enumerate(want)}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end & (end - 1) == 0 and end <= 64


def test_word_ids_of_awkward_texts_equal_the_library():
    from tokenizers import Tokenizer

    texts = ["Don't I've <|STARTOFTEXT|> <|startoftext|>x a<|endoftext|>", "\u00c0\u00c9\u00df\u00ff\u00d7\u00f7\u00e9 E\u0301 \u00c9\u0301 x123y45 a,b.c-d;3,14",
             "", " \t\n ", "\u65e5\u672c\u8a9e \u041f\u0440\u0438 \u0130stanbul \u200b x\u3000y \x1c z\x85q", "it's. 'tis \"so\" \\b `t` ~ <a>", "x" * 5000,
             "ab" * 3000 + "\u00e9" * 1000, "\U0001f600hi \ufb01 A\u030a \u00ad"]
    whole, encode, found = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), word_ids("word_bpe_49k.json", 2), []
    for _, _, data, offsets in pieces(pa.array(texts)):
        flat, first, _, _ = encode(split_parts(data, offsets))
        found += [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert found == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_fill_is_the_best_subset():
    assert packing.fill([7, 5, 3], [1, 2, 1], 10) == (10, [(2, 1), (0, 1)]) or packing.fill([7, 5, 3], [1, 2, 1], 10)[0] == 10
    assert packing.fill([9, 6], [1, 1], 8) == (6, [(1, 1)])


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, none).collect()}
    assert not got[0].kept and not got[11].kept and got[6].kept and got[12].n_repeat_words == 44


def test_pages(spark, tmp_path):
    html = "<nav>Menu</nav><article><h1>A &amp; B</h1><p>Some  text<br>here.</article><footer>x</footer>"
    pages = spark.createDataFrame([(1, "https://A.org/x?y", html), (2, None, None), (3, "http://a.example.org/es/1", html)],
                                  "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    assert texts == {1: "A & B\nSome text here.", 2: "", 3: "A & B\nSome text here."}
    urls = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert urls[1] == ("a.org", "/x", "org/", "allow") and urls[3][2:] == ("example.org/es/", "block") and urls[2][:3] == ("", "", None)
    warc.write_archive(pages, f"{tmp_path}/a")
    back = {r.page_id: r for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    assert (back[1].record_type, back[3].record_type, back[3].refers_to, back[2].payload_bytes) == ("response", "revisit", 1, 0)
    assert {r.page_id: bytes(r.record) for r in warc.original_records(spark, f"{tmp_path}/a").collect()}[1].endswith(html.encode() + b"\r\n\r\n")


def test_a_page_id_of_many_rows_is_learnt_from_once(spark, monkeypatch):
    page = lambda i: f"<article><p>Text {i}, of some length.</article><nav>Menu {i}</nav>"
    rows = [(1, page(i)) for i in range(50)] + [(1, page(0))] * 50 + [(i, page(i)) for i in range(2, 6)]
    seen = []
    monkeypatch.setattr(extraction, "train", lambda x, y: seen.append((sorted(map(tuple, x)), len(y))))
    extraction.learn(spark.createDataFrame(rows, "page_id long, html string"))
    best = min((page(i) for i in range(50)), key=lambda p: hashlib.sha256(p.encode()).hexdigest())
    extraction.learn(spark.createDataFrame([(1, best)] + rows[100:], "page_id long, html string"))
    assert seen[0] == seen[1] and seen[0][1] == 2 * 5


@pytest.mark.parametrize("page, want", [
    ('<main class="main-content with-sidebar"><p>Text.</p></main>', "Text."),
    ('<article class="post tag-privacy"><p>Text.</p></article>', "Text."),
    ('<div class="content with-sidebar"><p>Text.</p></div>', "Text."),
    ('<article class="comment"><p>Text.</p></article>', ""),
    ('<div class="content sidebar"><p>Text.</p></div>', ""),
    ('<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>', "Let x=1 be."),
    ('<article><object><p>Shown.</p></object><canvas><p>Drawn.</p></canvas></article>', "Shown.\nDrawn."),
    ('<article><p>A<svg><path d="m"></p><p>B</p></article>', "A\nB"),
    ('<article><div>A<svg><text>no</text></div><p>B</p><p>C<svg><text>no</text></svg>D</p></article>', "A\nB\nCD"),
    ('<article><template><p>B</p></article>', "B"),
    ('<article><p>A</p><template><p>no</p></template><p>B</p></article>', "A\nB"),
    ('<article><p>A</p><script>no<p>no</p></article>', "A"),
])
def test_text_of_the_article_is_kept(page, want):
    assert extraction.main_text(page, extraction.PRIOR) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (substrings.remove_repeats(none), jaccard.similar_documents(none), token_counts.token_counts(none),
               packing.pack_documents(none), scoring.score_documents(none), decontamination.find_items(none, items)):
        assert df.count() == 0


PROSE = "A paragraph of some length, with commas, and a full stop at its end. Then another sentence follows it."


@pytest.mark.parametrize("page, want", [
    (f'<article><section id="social-history"><p>{PROSE}</p></section></article>', PROSE),
    (f'<article><h2 id="search-methods">Methods</h2><p>{PROSE}</p></article>', "Methods\n" + PROSE),
    (f'<article><p>One.</p><p class="promo-code-history">{PROSE}</p></article>', "One.\n" + PROSE),
    (f"<article><p class=it's>{PROSE}</p><p>it's</p></article>", PROSE + "\nit's"),
    (f'<article><p>{PROSE}</p><div class="reader-comments"><p>{PROSE} No.</p></div><div class="share-buttons">Share</div></article>', PROSE),
    (f'<body><div class="cookie-notice">We use cookies.</div><main><p>{PROSE}</p></main><div id="related-posts"><p>{PROSE} x</p></div>', PROSE),
    (f'<article><p title="a > b">{PROSE}</p><p data-x=\'">\'>Two.</p></article>', PROSE + "\nTwo."),
    (f'<article><p title="never closed>{PROSE}</p><p>Two.</p></article>', PROSE + "\nTwo."),
])
def test_names_and_broken_attributes(page, want):
    assert extraction.main_text(page, extraction.PRIOR) == want


def test_the_cut_outweighs_a_blocks_own_cost():
    """A short paragraph between long ones, in containers that say nothing: alone it would go."""
    page = f"<div><p>{PROSE}</p><p>So it is</p><p>{PROSE} Again.</p></div>"
    blocks = extraction.blocks_of(page)
    own = extraction.signals(extraction.figures(blocks), extraction.PRIOR)
    assert own[0] > 0 and own[2] > 0
    short = extraction.blocks_of(f"<div><div>{PROSE}</div><div>x y</div><div>{PROSE} Again.</div></div>")
    own = extraction.signals(extraction.figures(short), extraction.PRIOR)
    assert own[0] > 0 > own[1] and own[2] > 0 and all(b.hint == 0 for b in short)
    costs = [(max(s, 0.0), max(-s, 0.0)) for s in own.tolist()]
    assert extraction.cut(costs, []) == [True, False, True]
    assert extraction.cut(costs, extraction.ties(short)) == [True, True, True]


@pytest.mark.parametrize("unit", ["<a ", "<a x=\"", "<!", "</script ", "<svg ", "<svg>", "<b hidden>", "<a x='>", "<p class=\"'>", "<!-- ", "<div", "&", "<table><tr><td>"])
def test_broken_pages_take_linear_time(unit):
    import time

    page = unit * (200_000 // len(unit)) + ">"
    started = time.process_time()
    extraction.main_text(page[:-1], extraction.PRIOR)
    extraction.main_text(page, extraction.PRIOR)
    assert time.process_time() - started < 6
