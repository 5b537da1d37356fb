"""Very long texts and hot ids for the operators whose work is a text's or a sample's."""

import collections
import random
import re
import time

import pytest

from classledger.llm import quality, token_counts
from classledger.llm.tables import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "letters", "".join(rng.choice(letters) for _ in range(1_000_000))
    yield "base64", "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(300_000))
    yield "one letter", "a" * 300_000
    yield "words run together", "".join(rng.choice(["the", "function", "return", "var", "=", ";", "{}", "of"]) for _ in range(60_000))
    yield "script without spaces", "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(100_000))
    yield "unknown", "".join(rng.choice("\U0001f600\U0001f601ab") for _ in range(50_000))
    yield "spaces", " " * 100_000 + "x"


@pytest.mark.parametrize("name, text", list(long_texts()))
def test_a_text_without_spaces_equals_the_library(name, text):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    count = token_counts.piece_counter(path)
    started = time.process_time()
    got = count([text.encode()])
    assert time.process_time() - started < 30
    assert got == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))]


def test_pre_tokens_around_the_long_bound_equal_the_library():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, count, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path), random.Random(8)
    for n in [*range(250, 262), 400, 1000]:
        for alphabet in ("abcdefghij", "ab", "théé日本 ", "(){};=+-x1"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert count([text.encode()]) == [len(library.encode(text))], text


def brute_figures(text):
    words = WORD.findall(text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    repeated = {j for starts in windows.values() if len(starts) > 1 for i in starts for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(repeated), failed)


def labelled(spark):
    """Good documents of plain words; bad ones full of symbols, with two odd labels."""
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice("alpha beta gamma delta words of a plain text here".split()) + str(rng.randrange(500)) for _ in range(60)]
        if i % 3 == 0:
            words = [w + "$" * rng.randrange(1, 4) for w in words]
        texts.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, 0 if i % 3 == 0 else 1))
    labels += [(3, 1), (4, 0), (None, 0), (5, None)]
    return (spark.createDataFrame(texts, "doc_id long, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int"), texts)


def test_a_learned_list_rejects_held_out_rows(spark):
    docs, labels, texts = labelled(spark)
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    held_out = [i for i, _ in texts if i >= 450]
    assert all(got[i].kept == (i % 3 != 0) for i in held_out)
    for i, text in texts:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_figures(text)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_an_id_of_many_rows_is_fitted_once(spark, monkeypatch):
    docs, labels, texts = labelled(spark)
    more = docs.unionByName(spark.createDataFrame([(7, f"{texts[7][1]} {k}") for k in range(500)], "doc_id long, text string"))
    seen = []
    cells = quality._cells
    monkeypatch.setattr(quality, "_cells", lambda stats: seen.append(stats.count()) or cells(stats))
    quality.learn(more, labels, train_rows=21)
    assert seen == [21] or seen == [20]


def test_the_fit_reads_the_chosen_rows_only(spark, monkeypatch):
    docs, labels, _ = labelled(spark)
    plans = []
    cells = quality._cells
    monkeypatch.setattr(quality, "_cells", lambda stats: plans.append(stats._jdf.queryExecution().optimizedPlan().toString()) or cells(stats))
    quality.learn(docs, labels)
    assert "LogicalRDD" not in plans[0] and "parquet" in plans[0]   # the written texts, not the whole table


def test_awkward_tables(spark):
    docs, labels, _ = labelled(spark)
    none = docs.limit(0)
    assert quality.judge(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0, "k"), (1, "", 2.0, "k"), (None, "a " * 500_000, 3.0, "k")],
                                "doc_id long, text string, n_words double, row string")
    got = quality.judge(odd, labels.limit(0)).collect()
    assert len(got) == 3 and all(r.base_failed for r in got) and max(r.n_words for r in got) == 500_000
