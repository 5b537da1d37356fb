"""Operator 1: benchmark items found in documents by SimHash of item-sized windows, all native.

A window has as many word shingles as the item. Windows without one of the
item's shingles have similarity 0, and a window needs a certain number of
them to reach the threshold; both are used to leave out windows that cannot
match. The others get a 64-bit SimHash each, from running sums of the
shingles' bits (16 longs of four 16-bit counters, or 32 longs of two 32-bit
counters where an item has more than ``NARROW`` words), so a window costs one
subtraction however long it is. The sums restart in every slice of max(``STEP``,
window) starts, which also holds the rest of its last window: no counter passes
32,767 (2^31 - 1), however long a text repeats an item. ``RADIUS + 1`` blocks of the fingerprint index
the items: two fingerprints within the radius agree in one block at least.
Candidates are verified by the exact weighted Jaccard similarity of their
shingles, a shingle's weight being how often it occurs.

At similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average with a
standard deviation of 2.9; the radius of 19 lies 3.4 deviations above that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import SEPARATORS, _let
from .tables import materialise

WORDS = 5
THRESHOLD = 0.8
RADIUS = 19
BROADCAST_SHINGLES = 500_000
NARROW, STEP = 16_000, 8192
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` lower-cased words, in order; none for a shorter text."""
    bare = F.btrim(F.translate(text, CAPITALS, SMALL), F.lit(SEPARATORS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))

    def hashes(w: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), run)) \
            .otherwise(F.array().cast("array<long>"))

    return _let(words, hashes)


def _n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")))


def _lanes(h: Column, each: int) -> list[Column]:
    """The 64 bits of a hash as longs with so many counters each (four or two)."""
    width = 64 // each
    spread = sum(1 << (width - 1) * i for i in range(each))
    ones = sum(1 << width * i for i in range(each))
    return [(F.shiftrightunsigned(h, each * j).bitwiseAND((1 << each) - 1) * F.lit(spread)).bitwiseAND(F.lit(ones))
            for j in range(width)]


def _fingerprint(lanes: list[Column], n: Column) -> Column:
    """Bit ``each * j + i`` is set where more than half of the n shingles set it."""
    out = F.lit(0).cast("long")
    width, each = len(lanes), 64 // len(lanes)
    for j, lane in enumerate(lanes):
        for i in range(each):
            bit = each * j + i
            ones = F.shiftrightunsigned(lane, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = out.bitwiseOR(F.when(2 * ones > n, F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long"))
                                .otherwise(F.lit(0).cast("long")))
    return out


def _blocks(fingerprint: Column, radius: int) -> Column:
    """(number, bits) of each of ``radius + 1`` blocks."""
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    return F.array(*[F.struct(F.lit(b).alias("block"),
                              F.shiftrightunsigned(fingerprint, edges[b]).bitwiseAND((1 << (edges[b + 1] - edges[b])) - 1)
                              .alias("bits")) for b in range(radius + 1)])


def _needed(n: Column, m: Column, threshold: float) -> Column:
    """Shared shingles that a window of n and an item of m need at least."""
    return F.ceil(F.lit(threshold) / (1 + threshold) * (n + m) - 1e-9)


def _find(docs: DataFrame, items: DataFrame, size: int, threshold: float, radius: int) -> DataFrame:
    """Windows (doc_id, key, item_id, similarity, start, length) for items whose shingles have ``size`` words."""
    each = 4 if (items.agg(F.max(_n_words(F.col("text")))).first()[0] or 0) <= NARROW else 2
    count = 64 // each
    listed = items.select("item", "item_id", F.posexplode(_shingles(F.col("text"), size)).alias("at", "h"))
    weights = listed.groupBy("item", "h").agg(F.count(F.lit(1)).alias("weight"))
    sizes = listed.groupBy("item", "item_id").agg(
        F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(f"l{j}") for j, c in enumerate(_lanes(F.col("h"), each))])
    prints = sizes.select("item", "item_id", "m",
                          _fingerprint([F.col(f"l{j}") for j in range(count)], F.col("m")).alias("mark"))
    weights = materialise(weights.join(prints, "item"), f"benchmark-shingles-{size}")
    small = weights.count() <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda df: df)

    # Hits: places of documents that have a shingle of an item.
    placed = docs.select("doc_id", "key", F.posexplode(_shingles(F.col("text"), size)).alias("pos", "h"))
    hits = placed.join(hint(weights.select("h", "item", "m")), "h").select("doc_id", "key", "item", "m", "pos")
    # Runs of hits of one item that a window may span, with what lies around them.
    by_item = Window.partitionBy("doc_id", "key", "item").orderBy("pos")
    far = F.col("pos") - F.lag("pos").over(by_item) > 2 * F.col("m")
    numbered = hits.distinct().withColumn("far", F.coalesce(far, F.lit(False)).cast("int")) \
        .withColumn("run", F.sum("far").over(by_item))
    regions = numbered.groupBy("doc_id", "key", "item", "m", "run").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("hits")) \
        .where(F.col("hits") >= F.ceil(F.lit(threshold) * F.col("m") - 1e-9))
    regions = regions.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "m", "run", "lo", "hi")).alias("regions"))
    # All shingles of those regions, with running sums of their bits.
    around = docs.join(regions.withColumnsRenamed({"doc_id": "_id", "key": "_key"}),
                       F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))) \
        .select("doc_id", "key", "regions", _shingles(F.col("text"), size).alias("shingles")) \
        .select("doc_id", "key", "shingles", F.explode("regions").alias("r")) \
        .withColumn("n", F.least(F.size("shingles"), F.col("r.m")).cast("long")) \
        .select("doc_id", "key", F.col("r.item").alias("item"), F.col("r.run").alias("run"), F.col("r.m").alias("m"), "n",
                "shingles", F.explode(F.sequence(
                    F.greatest(F.lit(0), F.col("r.lo") - F.col("n") + 1).cast("int"),
                    F.least(F.size("shingles") - 1, F.col("r.hi") + F.col("n") - 1).cast("int"))).alias("pos")) \
        .withColumn("h", F.get("shingles", "pos")).drop("shingles")
    # Slice k has the windows that start in [k * step, (k + 1) * step), whole.
    step = F.greatest(F.lit(STEP), "n")
    around = around.withColumn("slice", F.explode(F.sequence(
        F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("n") + 2) / step) - 1).cast("int"), F.floor(F.col("pos") / step).cast("int"))))
    region = ["doc_id", "key", "item", "run", "slice"]
    flagged = around.distinct().join(hint(weights.select("item", "h", F.lit(1).alias("hit"))), ["item", "h"], "left")
    own = [c.alias(f"l{j}") for j, c in enumerate(_lanes(F.col("h"), each))] + [F.coalesce("hit", F.lit(0)).alias(f"l{count}")]
    running = Window.partitionBy(*region).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = flagged.select(*region, "m", "n", "pos", "h", *own) \
        .withColumns({f"s{j}": F.sum(f"l{j}").over(running) for j in range(count + 1)})
    sums = materialise(sums, f"benchmark-sums-{size}")
    begin = sums.where(F.floor(F.col("pos") / step) == F.col("slice")).select(*region, "m", "n", F.col("pos").alias("start"), (F.col("pos") + F.col("n") - 1).alias("pos"),
                        *[(F.col(f"s{j}") - F.col(f"l{j}")).alias(f"b{j}") for j in range(count + 1)])
    end = sums.select(*region, F.col("pos").cast("long").alias("pos"), *[f"s{j}" for j in range(count + 1)])
    same = [begin[c].eqNullSafe(end[c]) for c in [*region, "pos"]]
    keep_all = same[0]
    for c in same[1:]:
        keep_all = keep_all & c
    windows = begin.join(end, keep_all).select(
        *[begin[c] for c in [*region, "m", "n", "start"]],
        *[(F.col(f"s{j}") - F.col(f"b{j}")).alias(f"l{j}") for j in range(count + 1)]) \
        .where(F.col(f"l{count}") >= _needed(F.col("n"), F.col("m"), threshold))
    marked = windows.select(*region, "m", "n", "start",
                            _fingerprint([F.col(f"l{j}") for j in range(count)], F.col("n")).alias("mark"))
    # The index: one agreeing block at least within the radius.
    index = prints.select("item", "item_id", F.col("mark").alias("item_mark"), F.inline(_blocks(F.col("mark"), radius)))
    candidates = marked.select("*", F.inline(_blocks(F.col("mark"), radius))) \
        .join(hint(index), ["item", "block", "bits"]) \
        .where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius) \
        .select(*region, "item_id", "m", "n", "start").distinct()
    # Exact similarity of the candidates.
    inside = sums.select(*[F.col(c).alias(f"_{c}") for c in region], F.col("pos").alias("at"), "h")
    same = F.lit(True)
    for c in region:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    counted = candidates.join(inside, same & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n"))) \
        .groupBy(*region, "item_id", "m", "n", "start", "h").agg(F.count(F.lit(1)).alias("times"))
    shared = counted.join(hint(weights.select("item", "h", "weight")), ["item", "h"]) \
        .groupBy(*region, "item_id", "m", "n", "start").agg(F.sum(F.least("times", "weight")).alias("shared"))
    similarity = F.col("shared") / (F.col("m") + F.col("n") - F.col("shared"))
    return shared.withColumn("similarity", similarity).where(F.col("similarity") >= threshold - 1e-12) \
        .select("doc_id", "key", "item_id", "similarity", "start", (F.col("n") + size - 1).alias("length"))


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = THRESHOLD,
               radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, item_id, similarity, start, n_words): the best window of each document row and item.

    ``start`` is the window's first word, from 0; of equal windows the first.
    ``key`` is the text's hash. Words are split at white space and lower-cased
    (A-Z). An item with fewer than ``size`` words has its whole sequence as its
    one shingle; null texts and texts without words match nothing; a document
    shorter than the item is compared whole. Rows equal in doc_id and text give
    one row; rows with one doc_id and other texts are documents of their own; a
    null doc_id is kept. Items that repeat an id are compared each, the best
    counts. Empty tables give no rows; other columns are not read.
    """
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(docs[text_column]).alias("key"),
                       F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").where("text is not null") \
        .distinct().withColumn("width", F.least(F.lit(size), _n_words(F.col("text"))))
    widths = sorted(r.width for r in items.select("width").distinct().collect() if r.width)
    found = None
    for width in widths or [size]:  # size values at most
        part = _find(docs, items.where(F.col("width") == width), width, threshold, radius)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"), "length")).alias("best")
    return found.groupBy("doc_id", "key", "item_id").agg(best).select(
        "doc_id", "key", "item_id", F.col("best.similarity").alias("similarity"),
        (-F.col("best.first")).cast("long").alias("start"), F.col("best.length").cast("long").alias("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any item, all columns as they are."""
    found = find_items(docs, benchmark, **how).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"]), "left_anti")
