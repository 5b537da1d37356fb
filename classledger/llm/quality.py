"""Operator 6: quality rules; statistics, base rules and learned decision lists, all native.

``statistics`` computes the texts' figures with DataFrame functions, one row at
a time and without a shuffle. ``learn`` grows and prunes a decision list by
sequential covering from the labelled rows' binned statistics; the list is
ordered Spark conditional expressions (``verdict``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRAIN_ROWS = 20_000
CUTS = 16
MIN_PRECISION = 0.9
MIN_COVER = 10
MAX_RULES = 12
MAX_CONDITIONS = 3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column, size: int = 5) -> Column:
    """Words covered by runs of ``size`` words that the text has twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size),
                         lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))

    def covered(ordered: Column) -> Column:
        twice = F.filter(F.transform(ordered, lambda x, j: F.when(
            F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)), x["at"])), lambda at: at.isNotNull())
        return F.aggregate(
            F.sort_array(twice), F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(size), x - a["last"])).alias("n")),
            lambda a: a["n"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ordered, covered))

    return F.when(F.size(words) > size, _let(hashes, count)).otherwise(0)


def _removed(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, the ``BASE`` figures, n_capitals, n_bangs); row: the whole row; a null text counts as empty."""
    source = docs.select(F.struct("*").alias("row"), docs[id_column].alias("doc_id"),
                         F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    bare = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SEPARATORS)) != "")
    figures = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                             _repeat_words(w).cast("long").alias("n_repeat_words")))
    return source.select(
        "row", "doc_id", figures.alias("_figures"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _removed(text, CAPITALS).cast("long").alias("n_capitals"),
        _removed(text, "!").cast("long").alias("n_bangs"),
    ).select("row", "doc_id", "_figures.*", "word_chars", "n_symbols", "n_dup_lines", "n_capitals", "n_bangs")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that do not grow with a text's length, and its length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words, "bangs_per_word": F.col("n_bangs") / words,
            "capitals": F.col("n_capitals") / chars, "dup_lines_per_word": F.col("n_dup_lines") / words,
            "repeated": F.col("n_repeat_words") / words}


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut


class Rule(NamedTuple):
    """A conjunction whose rows are rejected, with its counts on the pruning part."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts lie below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))


def _cells(stats: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """Cut points of each feature, and the training rows' counts by (bins, grows, bad)."""
    found = materialise(stats, "quality-train")
    names = list(features())
    values = found.select("bad", "grows", *[c.alias(n) for n, c in features().items()])
    cuts_row = values.agg(*[F.percentile_approx(n, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 2000).alias(n)
                            for n in names],
                          *[F.percentile_approx(F.when(F.col("bad"), F.col(n)),
                                                [(i + 1) / (CUTS + 1) for i in range(CUTS)], 2000).alias(f"_{n}")
                            for n in names]).first()
    cuts = {n: sorted(set((cuts_row[n] or []) + (cuts_row[f"_{n}"] or []))) for n in names}
    bins = {n: _bin(F.col(n), cuts[n]) for n in names}
    cells = values.groupBy(*[b.alias(n) for n, b in bins.items()], "grows", "bad").count().collect()
    return cuts, [tuple(r) for r in cells]


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, min_precision: float = MIN_PRECISION,
          text_column: str = "text") -> list[Rule]:
    """Decision list that rejects labelled quality 0, from at most ``train_rows`` labelled rows.

    The training rows are those with the smallest hash of doc_id (the bound of
    the fit; every row is judged). Two thirds grow rules by information gain,
    one third prunes them and decides whether a rule is precise enough to be
    kept. Without labels of both kinds the list is empty.
    """
    chosen = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 0).alias("bad"))
              .where("doc_id is not null and bad is not null")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(train_rows))
    picked = materialise(chosen, "quality-labels")  # train_rows rows at most
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    texts = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    # One row for each chosen id (the text of the least hash), so that the bound holds for rows too. The texts are
    # written before their figures are taken: the figures' filter would else be pushed below the join, to all rows.
    hashed = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = materialise(hashed, "quality-texts")
    stats = statistics(texts).drop("row").join(F.broadcast(picked), "doc_id").where(~base_failed()) \
        .withColumn("grows", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2)
    cuts, cells = _cells(stats)
    names, rules = list(features()), []
    bad_at, grows_at, n_at = len(names) + 1, len(names), len(names) + 2

    def fits(cell: tuple, conditions: Sequence[Condition]) -> bool:
        return all((cell[names.index(c.feature)] > cuts[c.feature].index(c.cut)) == c.above for c in conditions)

    def counts(rows: Sequence[tuple], conditions: Sequence[Condition]) -> tuple[int, int]:
        bad = good = 0
        for cell in rows:
            if fits(cell, conditions):
                bad, good = (bad + cell[n_at], good) if cell[bad_at] else (bad, good + cell[n_at])
        return bad, good

    def grow(rows: list[tuple]) -> tuple[Condition, ...]:
        conditions: tuple[Condition, ...] = ()
        for _ in range(MAX_CONDITIONS):
            bad, good = counts(rows, ())
            if not bad or not good:
                break
            before, best, gain = math.log2(bad / (bad + good)), None, 0.0
            for at, name in enumerate(names):
                tally = [[0, 0] for _ in range(len(cuts[name]) + 1)]
                for cell in rows:
                    tally[cell[at]][0 if cell[bad_at] else 1] += cell[n_at]
                below = [0, 0]
                for k, cut in enumerate(cuts[name]):
                    below = [below[0] + tally[k][0], below[1] + tally[k][1]]
                    for above, (b, g) in ((False, below), (True, (bad - below[0], good - below[1]))):
                        if b >= MIN_COVER and (value := b * (math.log2(b / (b + g)) - before)) > gain:
                            best, gain = Condition(name, above, cut), value
            if best is None:
                break
            conditions += (best,)
            rows = [r for r in rows if fits(r, (best,))]
        return conditions

    def worth(conditions: Sequence[Condition], rows: list[tuple]) -> float:
        bad, good = counts(rows, conditions)
        return (bad - good) / (bad + good) if bad + good else -1.0

    while len(rules) < MAX_RULES:
        growing, pruning = [c for c in cells if c[grows_at]], [c for c in cells if not c[grows_at]]
        conditions = grow(growing)
        while len(conditions) > 1:
            shorter = max((conditions[:k] + conditions[k + 1:] for k in range(len(conditions))),
                          key=lambda c: worth(c, pruning))
            if worth(shorter, pruning) < worth(conditions, pruning):
                break
            conditions = shorter
        bad, good = counts(pruning, conditions) if conditions else (0, 0)
        if not bad or bad / (bad + good) < min_precision:
            break
        rules.append(Rule(conditions, bad, good))
        cells = [c for c in cells if not fits(c, conditions)]
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that rejects the row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, the ``BASE`` figures, base_failed, kept, rejected_by) of each document row.

    A null or empty text has no words and fails the base rules; a very long one
    is judged whole, by expressions over its array of words. Repeated rows
    are judged each, alike. Other columns of either table are not read. An
    empty table gives no rows; without usable labels only the base rules
    reject.
    """
    return _judged(docs, labels, train_rows).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows that ``judge`` keeps, all columns as they are."""
    return _judged(docs, labels, train_rows).where("kept").select("row.*")


def _judged(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    rules = learn(docs, labels, train_rows)
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict(rules))
    return judged.select("row", "doc_id", *BASE, "base_failed",
                         (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
