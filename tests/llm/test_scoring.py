"""Operator 7: base columns by formula, the model against its base on held-out rows, layouts, copies, gradients."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from classledger.llm import catalog, scoring

from ..conftest import SF_ORACLE
from .test_operators import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(UPPER)) + [None]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    counts = collections.Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    n, smooth = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    return sorted(((i, is_held_out(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n,
                    round(sum(math.log10(counts[t] + 0.5) - smooth for t in tokens(x)), 6)) for i, x in rows), key=str)


def columns(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


@pytest.fixture()
def few_steps(monkeypatch):
    monkeypatch.setattr(scoring.train, "__defaults__", (scoring.EVERY, 30))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, copies long, key string, block long")


def test_base_columns_equal_the_formula(spark, few_steps):
    rows = list(enumerate(TEXTS)) + [(6, TEXTS[6]), (None, "a null id"), (None, None)] + [(40, "copies of one row")] * 50
    got = scoring.score_documents(frame(spark, rows).repartition(4)).collect()
    assert columns(got) == base(rows) and all(r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 40}) == 1


def test_the_layout_changes_nothing(spark, few_steps, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 4000)      # some blocks, so that weights are averaged
    monkeypatch.setattr(scoring, "FAN_IN", 2)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + rng.choice("xyz") for _ in range(rng.randrange(1, 90)))) for i in range(80)]
    rows += [rows[3]] * 30
    results = [sorted(map(tuple, scoring.score_documents(frame(spark, rows).repartition(k)).collect())) for k in (2, 7)]
    assert results[0] == results[1]


def test_the_model_beats_its_base_on_held_out_rows(spark):
    got = catalog.op7_scoring(spark, SF_ORACLE).where("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n


def test_every_id_is_scored_once_with_nine_ids_before_it():
    rng = np.random.default_rng(1)
    alphabet = scoring.Alphabet(np.append(np.arange(5000, 0, -1), 5).astype(float))
    weights = scoring.first_weights(alphabet)
    flat = rng.integers(0, 4000, 150)
    first = np.asarray([0, 0, len(flat), len(flat)])
    plain = scoring.log_probabilities(weights, alphabet, flat, first)
    assert (plain < 0).all()
    for p in range(9, len(flat)):
        other = flat.copy()
        other[p - 9] = (flat[p - 9] + 1) % 4000
        assert scoring.log_probabilities(weights, alphabet, other, first)[p] != plain[p], p
        if p < 31:
            continue
        after = flat.copy()
        after[p:] = (flat[p:] + 1) % 4000
        assert np.array_equal(scoring.log_probabilities(weights, alphabet, after, first)[:p], plain[:p])   # causal


def test_probabilities_of_all_ids_sum_to_one():
    alphabet = scoring.Alphabet(np.append(np.arange(2500, 0, -1), 5).astype(float))
    weights = scoring.first_weights(alphabet)
    start = np.asarray([7, 2300, 11])
    texts = np.asarray([np.append(start, k) for k in range(alphabet.size)])
    found = scoring.log_probabilities(weights, alphabet, texts.ravel(), np.arange(0, texts.size + 1, 4))
    assert abs(np.exp(found.reshape(-1, 4)[:, 3]).sum() - 1) < 1e-4


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    alphabet = scoring.Alphabet(np.append(np.arange(3000, 0, -1), 5).astype(float))
    w = {k: v.astype(np.float64) for k, v in scoring.first_weights(alphabet).items()}
    x, y = rng.integers(0, 2100, (2, scoring.WINDOW)), rng.integers(0, 2048, (2, scoring.WINDOW))
    counts = rng.integers(0, 3, (2, scoring.WINDOW)).astype(np.float32)

    def loss(w):
        h = scoring.forward(w, x)["h2"]
        group, member = np.divmod(y.ravel(), scoring.GROUP)
        first = h @ w["group_out"] + w["group_bias"]
        second = np.einsum("nd,ndk->nk", h, w["out"][group]) + w["bias"][group]
        log_share = lambda logits, at: logits[np.arange(len(at)), at] - np.log(np.exp(logits).sum(1))
        return -((log_share(first, group) + log_share(second, member)) * counts.ravel()).sum() / counts.sum()

    g = scoring.gradients(w, x, y, counts)
    for name in w:
        biggest = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][biggest] += 1e-4
        slope = (loss(moved) - loss(w)) / 1e-4
        assert abs(slope - g[name][biggest]) < 2e-3 * max(1, abs(slope)), name


def small_lesson(seed=5):
    rng = np.random.default_rng(seed)
    alphabet = scoring.Alphabet(np.append(np.arange(3000, 0, -1), 5).astype(float))
    x, y = rng.integers(0, 2100, (6, scoring.WINDOW)), rng.integers(0, 2048, (6, scoring.WINDOW))
    counts = np.ones(x.shape, np.float32)
    counts[1:, :scoring.WINDOW - scoring.STRIDE] = 0      # places that the window before has scored
    return scoring.first_weights(alphabet), x, y, counts


def test_only_places_that_count_go_above_the_attention(monkeypatch):
    w, x, y, counts = small_lesson()
    rows, plain = [], scoring.feed_forward
    monkeypatch.setattr(scoring, "feed_forward", lambda w, h: rows.append(len(h)) or plain(w, h))
    got = scoring.gradients(w, x, y, counts)
    assert rows == [np.count_nonzero(counts)] and rows[0] < counts.size
    idle = counts == 0
    other = np.where(idle, (y + 777) % 2048, y)      # what an idle place predicts is of no weight
    again = scoring.gradients(w, x, other, counts)
    assert all(np.array_equal(got[k], again[k]) for k in w)


def test_gradients_stay_finite_where_logits_are_large():
    w, x, y, counts = small_lesson()
    for k in ("out", "group_out"):
        w[k] = w[k] * np.float32(1000)
    g = scoring.gradients(w, x, y, counts)
    assert all(np.isfinite(v).all() for v in g.values())
    assert abs(g["group_bias"].sum()) < 1e-4 and abs(g["bias"].sum()) < 1e-4      # shares less one each


def test_a_step_moves_each_weight_by_its_own_moments():
    w, x, y, counts = small_lesson()
    model, plain = scoring.Adam(w), {k: v.astype(float) for k, v in w.items()}
    m, v = ({k: np.zeros(a.shape) for k, a in w.items()} for _ in range(2))
    for t in (1, 2, 3):
        g = scoring.gradients(model.w, x, y, counts)
        model.step(g, 0.01)
        for k in w:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k].astype(float) ** 2 - v[k])
            plain[k] -= 0.01 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)
    assert all(np.abs(model.w[k] - plain[k]).max() < 1e-4 and model.w[k].shape == w[k].shape for k in w)


def test_every_training_text_moves_the_weights(spark):
    rows = [(1, k, i, f"alpha beta gamma delta w{i} " * (1 + 40 * (i == 3)), 1) for k, i in enumerate(range(20))]
    import pyarrow as pa
    table = pa.table({"block": [r[0] for r in rows], "key": [r[1] * 977 for r in rows], "doc_id": [r[2] for r in rows],
                      "text": [r[3] for r in rows], "copies": [1] * 19 + [5]})
    alphabet = scoring.Alphabet(np.append(np.ones(32000), 5.0))
    every = scoring.Lessons(table, alphabet, "piece_bpe_32k.model", 1)
    some = scoring.Lessons(table, alphabet, "piece_bpe_32k.model", 8)
    assert 20 <= len(some.x) < len(every.x)
    one = [len(scoring.Lessons(table.slice(k, 1), alphabet, "piece_bpe_32k.model", 8).x) for k in range(20)]
    assert min(one) == 1 and sum(one) == len(some.x)
    assert scoring.Lessons(table.slice(19, 1), alphabet, "piece_bpe_32k.model", 8).counts.max() == 5


def test_every_position_of_every_training_text_is_learnt_from():
    import pyarrow as pa
    alphabet = scoring.Alphabet(np.append(np.ones(32000), 5.0))
    texts = ["a short text", "", "many words of a long text " * 300, "ab " * 25]
    table = pa.table({"block": [1] * 4, "key": [5, 977, 3, 12345], "doc_id": [1, 2, 3, 4], "text": texts, "copies": [1, 1, 1, 3]})
    model = scoring.piece_ids("piece_bpe_32k.model").model
    ids = [sum(map(len, model.encode(x.split()))) + 1 for x in texts]      # and the end mark
    lessons = scoring.Lessons(table, alphabet, "piece_bpe_32k.model", scoring.train.__defaults__[0])
    assert lessons.counts.sum() == ids[0] + ids[1] + ids[2] + 3 * ids[3]
    assert lessons.once() * scoring.BATCH >= len(lessons.x)      # the second round's steps take every window


def test_the_texts_travel_to_their_blocks_once(spark, few_steps):
    rows = [(i, f"text {i} " * 20) for i in range(40)]
    got = scoring.score_documents(frame(spark, rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(block" in x]
    assert len(moved) == 1, plan      # the words' counts; the texts lie in buckets
    assert "Bucketed: true" in plan


def library_ids(text):
    encode = scoring.piece_ids("piece_bpe_32k.model")
    words = WORD.findall((text or "").translate(UPPER))
    return [i for w in words for i in encode.model.encode(w)] + [encode.end]


def test_texts_are_encoded_where_they_are_dealt_and_not_again(spark, few_steps):
    texts = [*TEXTS, "", "UPPER and lower", "été 日本 \U0001f600", "many words of a long text " * 400]
    rows = [(i % 3, 977 * i, i, i % 4 == 1, t or "", 1 + 2 * (i % 5 == 0)) for i, t in enumerate(texts)]
    dealt = scoring.deal(spark.createDataFrame(rows, "block long, key long, doc_id long, held_out boolean, text string, copies long"), 3, "piece_bpe_32k.model")
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in dealt.collect()}
    assert got == {i: library_ids(t) for _, _, i, _, t, _ in rows}
    blind = dealt.drop("text")      # what counts and learns has no need of the texts
    counts = collections.Counter()
    for *_, i, _, t, copies in rows:
        counts.update({k: n * copies for k, n in collections.Counter(got[i]).items()})
    assert dict(enumerate(scoring.id_counts(blind, "piece_bpe_32k.model"))) == {k: counts[k] for k in range(scoring.piece_ids("piece_bpe_32k.model").end + 1)}
    weights, alphabet = scoring.train(blind, "piece_bpe_32k.model", 3)
    start = scoring.first_weights(alphabet)
    assert all(np.isfinite(v).all() for v in weights.values()) and (weights["embed"] != start["embed"]).any()


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_runs_of_ids_cover_all_texts(kind):
    import pyarrow as pa
    ids = [list(range(k, k + n)) for k, n in enumerate([3, 1, 40, 1, 7, 2, 2])]
    column = pa.array([np.asarray(x, kind).tobytes() for x in [[9], *ids]], pa.binary()).slice(1)
    size = np.asarray([9, 0, 90, 0, 12, 3, 3])      # of the texts
    for limit in (1, 12, 1000):
        runs = [*scoring.id_pieces(column, size, np.dtype(kind), limit)]
        assert [flat[a:b].tolist() for _, _, flat, first in runs for a, b in zip(first, first[1:])] == ids
        assert all(size[at:to].sum() <= limit or to == at + 1 for at, to, _, _ in runs)
    assert [*scoring.id_pieces(column[:0], size[:0], np.dtype(kind))] == []


def test_ids_do_not_depend_on_what_the_word_cache_holds(monkeypatch):
    from classledger.llm import subwords
    from classledger.llm.tables import tokenizer_path
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    monkeypatch.setattr(subwords, "CACHED_WORDS", 70)
    encode = subwords.PieceIds(tokenizer_path("piece_bpe_32k.model"))
    for text in texts + texts[:3]:
        raw = np.frombuffer(text.encode(), np.uint8)
        flat, _, _, _ = encode(scoring.split_words(raw, np.asarray([0, len(raw)]), lower=True), lower=True)
        assert flat.tolist() == library_ids(text)
        assert len(encode.keys) <= 70 and (encode.keys[1:] > encode.keys[:-1]).all()


def test_tables_without_rows_or_training_rows(spark, few_steps):
    assert scoring.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if is_held_out(i))
    got = scoring.score_documents(frame(spark, [(held, "only held out rows")])).collect()
    assert columns(got) == base([(held, "only held out rows")]) and got[0].score < 0
