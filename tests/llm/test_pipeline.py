"""corpus_pipeline.run, stage by stage against brute force, each stage on what its predecessor kept."""

import collections
import random

import pytest

import corpus_pipeline
from classledger.llm import quality
from classledger.llm.tables import tokenizer_path

from .test_long_texts import WORD, brute_figures

DOCS = "doc_id long, text string, lang string, source string, n_chars int, _text_key string, _key int, row string, extra long, h long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text, size=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, exact and near copies, a passage that several hold, benchmark items, junk; labels of both kinds."""
    rng, path = random.Random(4), tmp_path_factory.mktemp("corpus")
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts, passage = [], words(60)
    items = [(k, " ".join(words(30))) for k in range(5)] + [(7, None), (8, "")]
    for i in range(240):
        own = words(120)
        if i % 6 == 0 and i:
            own = texts[i - 1][1].split()                        # a copy of the one before
            if i % 12 == 0:
                own[50] = "changed"                               # a near copy
        elif i % 6 == 1:
            own[40:40] = passage
        elif i % 6 == 2:
            own[30:30] = items[i % 5][1].split()
            if i % 12 == 2:
                own[40] = "other"                                 # one word of the item changed
        elif i % 6 == 4:
            own = [w + "$#" for w in own]                         # bad by its symbols
        texts.append((i, " ".join(own)))
    texts += [(300, None), (301, ""), (302, "too short"), (303, "again " * 80), (1, "another text of an id, " + " ".join(words(40))), texts[3], texts[3]]
    rows = [(i, t, "en", "s", len(t or ""), "k", 1, "r", 5, 6) for i, t in texts]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 6 == 4 else 1, 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def key(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_every_stage_equals_brute_force(spark, corpus):
    path, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "packing"]

    rules = quality.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = stages["quality_rules"](spark, docs, path)
    assert good.columns == docs.columns
    before, kept = docs.collect(), good.collect()
    passing = [r for r in before if not brute_figures(r.text)[5]]
    assert rules and key(kept) == key([r for r in passing if "$#" not in r.text])       # the labels' rule, on unlabelled rows too

    one = stages["near_duplicates"](spark, good, path)
    assert one.columns == docs.columns
    sets, root = [shingles(r.text) for r in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    groups = collections.defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(kept[k])
    left = one.collect()
    assert len(groups) < len(kept) and len(left) == len(groups)
    assert sorted(r.doc_id for r in left) == sorted(min(r.doc_id for r in g) for g in groups.values())

    cut = stages["repeated_passages"](spark, one, path)
    assert cut.columns == docs.columns
    seen, want, n_cut = set(), [], 0
    for r in sorted(left, key=lambda r: r.doc_id):
        w = WORD.findall(r.text)
        gone = {j for i in range(len(w) - 19) if tuple(w[i:i + 20]) in seen for j in range(i, i + 20)}
        for i in range(len(w) - 19):
            if tuple(w[i:i + 20]) in seen:
                gone.update(range(i, i + 20))
            seen.add(tuple(w[i:i + 20]))
        n_cut += bool(gone)
        want.append((r.doc_id, [x for k, x in enumerate(w) if k not in gone]))
    rest = cut.collect()
    assert n_cut >= 5 and all(r.n_chars == len(r.text) for r in rest)
    by_words = lambda rows: sorted(rows, key=str)
    assert by_words([(r.doc_id, WORD.findall(r.text)) for r in rest]) == by_words(want)

    clean = stages["decontamination"](spark, cut, path)
    assert clean.columns == docs.columns

    def similarity(text, item):
        """The best window of the item's size, shingles weighted by how often they occur."""
        bag = lambda w: collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        w, m = WORD.findall(lower(text)), WORD.findall(lower(item))
        best, wanted = 0.0, bag(m)
        for at in range(max(1, len(w) - len(m) + 1)):
            have = bag(w[at:at + len(m)])
            best = max(best, sum((have & wanted).values()) / max(1, sum((have | wanted).values())))
        return best

    dirty = {r.doc_id for r in rest for _, t in items if t and similarity(r.text, t) >= 0.8}
    near = [similarity(r.text, t) for r in rest for _, t in items if t]
    assert dirty and any(0.5 < s < 0.8 for s in near)               # items on both sides of the threshold
    assert key(clean.collect()) == key([r for r in rest if r.doc_id not in dirty])

    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in clean.collect())
    assert packed(corpus_pipeline.run(spark, path).collect()) == want


def packed(rows):
    """(doc_id, tokens) of each document, after checking that sequences have no gap and pieces cover their documents."""
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    for (_, total), parts in pieces.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == total
    return sorted(pieces)


def test_an_empty_corpus_stays_empty(spark, corpus, tmp_path):
    path, _ = corpus
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
