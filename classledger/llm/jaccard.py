"""Operator 10: n-gram Jaccard join by prefix filters under several global orders.

Two sets with Jaccard similarity t or more share a token among the first
``n - ceil(t n) + 1`` of each, under *any* order of all tokens that both are
sorted by. The join sorts by several orders and keeps a pair only if the prefixes meet
under every one:

- order 0 counts a fixed share of all tokens (by their hash, a bit more than a
  prefix needs) over the whole corpus and puts them first, rare ones before
  frequent ones; the others follow by hash. Most sets' prefixes then hold only
  tokens that no other set has, and such sets are done.
- order 1 counts all tokens of the sets that are left, rare ones first. Pairs
  are made from its prefixes: a pair is kept at a token only if what follows
  the token's place in either set is still enough for the overlap it needs.
- order 2 is a hash order.

What is left is verified on the full sets. Equal sets are one node from the
start, so copies meet no one. Within a token's bucket, two hub sets are
compared with all others first; pairs that a component already joins need no
comparison, and only the pairs across components are compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import map_arrow, materialise
from .words import Words, mix, pieces, split_words, windows

SEPARATORS_TEXT = " \t\n\x0b\x0c\r"
SIZE = 3
PERCENT = 90
ORDER_SEED = 0x51ED270B9F652295
_BITS = np.uint64(12)  # a token is a hash of 52 bits; the upper 12 number the texts of a chunk
_PER_CHUNK = 4000
_SLOTS = 1024


def prefix_length(n, percent: int):
    """How many tokens of a set of n must be looked at under an order."""
    return n - (n * percent + 99) // 100 + 1


def counted_slots(percent: int) -> int:
    """Of 1024 hash slots, those whose tokens are counted: half as many again as a prefix needs."""
    return min(_SLOTS, (_SLOTS * (100 - percent) * 3 // 2 + 99) // 100)


class Sets:
    """Distinct tokens of the texts of a chunk: ``token[first[d]:first[d+1]]``, ascending."""

    def __init__(self, words: Words, size: int):
        counts = words.counts()
        h, whole = windows(words, size)
        owner = np.repeat(np.arange(words.texts), counts)
        for d in np.flatnonzero((counts > 0) & (counts < size)):  # the whole sequence is the one shingle
            at = words.first[d]
            value = np.uint64(counts[d])
            for x in words.hash[at:words.first[d + 1]]:
                value = mix(np.asarray([value ^ x], np.uint64))[0]
            h[at], whole[at] = value, True
        key = np.sort(owner[whole].astype(np.uint64) << np.uint64(52) | h[whole] >> _BITS)
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        self.owner = (key >> np.uint64(52)).astype(np.int64)
        self.token = key & np.uint64((1 << 52) - 1)
        self.first = np.searchsorted(self.owner, np.arange(words.texts + 1))
        self.n = np.diff(self.first)
        sums = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(mix(self.token + np.uint64(1)), out=sums[1:])
        self.id = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)

    def smallest(self, seed: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, first) of each set's first ``length`` tokens in the hash order of ``seed``."""
        shuffled = mix(self.token ^ np.uint64(seed)) >> _BITS
        key = np.sort(self.owner.astype(np.uint64) << np.uint64(52) | shuffled)
        keep = np.arange(len(key)) - self.first[self.owner] < length[self.owner]
        first = np.zeros(len(self.n) + 1, np.int64)
        np.cumsum(np.minimum(length, self.n), out=first[1:])
        return (key[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), first


def _chunks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, Sets]]:
    for begin in range(0, batch.num_rows, _PER_CHUNK):
        part = batch.column(column).slice(begin, _PER_CHUNK)
        for at, _, data, offsets in pieces(part):
            yield begin + at, Sets(split_words(data, offsets, lower=True), size)


def describe(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, set_id, n, counted) of each row; counted: how many tokens are counted."""
    slots = counted_slots(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _chunks(batch, 2, size):
                k = len(sets.n)
                counted = np.bincount(sets.owner[(sets.token & np.uint64(_SLOTS - 1)) < slots], minlength=k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), batch.column(1).slice(at, k), pa.array(sets.id),
                     pa.array(sets.n, pa.int64()), pa.array(counted, pa.int64())],
                    ["doc_id", "text_key", "set_id", "n", "counted"])

    return map_arrow(docs, rows, "doc_id long, text_key long, set_id long, n long, counted long")


def postings(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, set_id): each set's counted tokens, and the first others where they are too few for a prefix.

    A task gives each set once, so the copies of a text add a row for each
    task at most.
    """
    slots = counted_slots(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _chunks(batch, 2, size):
                new = np.zeros(len(sets.n), bool)
                for d, key in enumerate(sets.id.tolist()):
                    if key not in seen:
                        seen.add(key)
                        new[d] = True
                counted = (sets.token & np.uint64(_SLOTS - 1)) < slots
                have = np.bincount(sets.owner[counted], minlength=len(sets.n))
                lack = np.maximum(prefix_length(sets.n, percent) - have, 0)
                others = np.cumsum(~counted) - 1
                before = np.append(0, np.cumsum(~counted))[sets.first[:-1]]
                tail = ~counted & (others - before[sets.owner] < lack[sets.owner])
                keep = (counted | tail) & new[sets.owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.token[keep].view(np.int64)), pa.array(sets.id[sets.owner[keep]])], ["token", "set_id"])

    return map_arrow(docs, rows, "token long, set_id long")


def candidates(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, order0): sets whose order-0 prefix has tokens of other sets, and those tokens.

    A token that one set has alone takes its place in that set's prefix and
    is dropped; so is a set with as many of them as its prefix is long.
    """
    slots = counted_slots(percent)
    counted = (F.col("token").bitwiseAND(_SLOTS - 1)) < slots
    rows = postings(docs, size, percent)
    shared = (rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("set_id").alias("least"),
                                        F.max("set_id").alias("most"))
              .where("least <> most").select("token", "df"))
    order = F.struct((~counted).alias("late"), F.when(counted, F.col("df")).otherwise(0).alias("df"), "token")
    per_set = (rows.join(shared, "token").groupBy("set_id").agg(F.sort_array(F.collect_set(order)).alias("shared"))
               .join(sets.select("set_id", "n", "counted"), "set_id"))
    alone = F.col("counted") - F.size(F.filter("shared", lambda s: ~s["late"]))
    room = prefix_length_column(F.col("n"), percent) - alone
    return per_set.where(room > 0).select("set_id", F.slice("shared.token", F.lit(1), room.cast("int")).alias("order0"))


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """(token, set_id, n, pos): places in order-1 prefixes of tokens that more than one of the sets has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(1)]
                ids = np.repeat(part.column(0).to_numpy(), list(map(len, lists)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(ids)], ["token", "set_id"])

    all_tokens = map_arrow(tokens.select("set_id", "tokens"), rows, "token long, set_id long")
    shared = all_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_set = (all_tokens.join(shared, "token").groupBy("set_id")
               .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
               .join(tokens.select("set_id", "n"), "set_id").withColumn("alone", F.col("n") - F.size("shared")))
    room = prefix_length_column(F.col("n"), percent) - F.col("alone")
    return (per_set.where(room > 0)
            .select("set_id", "n", "alone", F.posexplode(F.slice("shared.token", F.lit(1), room.cast("int"))).alias("i", "token"))
            .select("token", "set_id", "n", (F.col("alone") + F.col("i")).alias("pos")))


def prefix_length_column(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100) + 1


def _may_match(n: Column, pos: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can still be similar if their first common token has these places."""
    needed = F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    return F.least(n - pos, m - other) >= needed


def hub_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """(a, b): the sets of each token's bucket with its two hubs: the token's earliest place, and the least id."""
    hubs = prefix.groupBy("token").agg(F.min(F.struct("pos", "n", "set_id")).alias("near"),
                                       F.min(F.struct("set_id", "n", "pos")).alias("low"),
                                       F.max("set_id").alias("high")).where("low.set_id <> high") \
        .select("token", "near", F.struct("low.pos", "low.n", "low.set_id").alias("low"))
    each = prefix.join(hubs, "token").select("set_id", "n", "pos", F.explode(F.array("near", "low")).alias("hub"))
    each = each.where((F.col("hub.set_id") != F.col("set_id"))
                      & _may_match(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    return each.select(F.least("set_id", "hub.set_id").alias("a"), F.greatest("set_id", "hub.set_id").alias("b")).distinct()


def rest_pairs(prefix: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one bucket that no component joins yet."""
    labelled = prefix.join(components.withColumnRenamed("node", "set_id"), "set_id", "left") \
        .withColumn("component", F.coalesce("component", "set_id"))
    open_tokens = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x <> y").select("token")
    labelled = labelled.join(open_tokens, "token", "left_semi")
    other = labelled.toDF(*[c + "_" if c != "token" else c for c in labelled.columns])
    return (labelled.join(other, "token")
            .where((F.col("component") < F.col("component_"))
                   & _may_match(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_"), percent))
            .select(F.least("set_id", "set_id_").alias("a"), F.greatest("set_id", "set_id_").alias("b")).distinct())


def meet_in_all_orders(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The pairs whose prefixes share a token under orders 0 and 2 too; keys: (set_id, order0, order2)."""
    return (pairs.join(keys.toDF("a", "a0", "a2"), "a").join(keys.toDF("b", "b0", "b2"), "b")
            .where(F.arrays_overlap("a0", "b0") & F.arrays_overlap("a2", "b2")).select("a", "b"))


def full_sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, n, tokens, order2) of each wanted set, read again from one of its texts.

    tokens is sorted; order2 holds the first of them in the hash order, shortened to 32 bits.
    """
    which = (described.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id")
             .agg(F.min(F.struct("doc_id", "text_key")).alias("text")).select("text.*"))
    first = which.toDF("first_id", "first_key")
    texts = docs.join(first, docs["doc_id"].eqNullSafe(first["first_id"]) & (docs["text_key"] == first["first_key"]),
                      "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _chunks(batch, 2, size):
                tokens = [sets.token[a:b].tobytes() for a, b in zip(sets.first[:-1], sets.first[1:])]
                values, ends = sets.smallest(ORDER_SEED, prefix_length(sets.n, percent))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.id), pa.array(sets.n, pa.int64()), pa.array(tokens, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))],
                    ["set_id", "n", "tokens", "order2"])

    return map_arrow(texts, rows, "set_id long, n long, tokens binary, order2 array<int>").dropDuplicates(["set_id"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y"))
    return map_arrow(joined, rows, "a long, b long")


def similar_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; links are pairs with Jaccard of at least percent / 100.

    Words are lower-cased (A-Z); a text of fewer than ``size`` words has its
    whole sequence as the one shingle; a null text or one without words has an
    empty set and is linked with nothing: its component is its own doc_id.
    component_id is the smallest doc_id reachable by links, its own included; a
    null doc_id is never the smallest. Repeated rows are equal sets and so one
    component. A very long text is a set of as many tokens, built and verified
    whole by a task. An empty table gives no rows; other columns are not read.
    """
    rows = _rows_with_root(docs, size, percent, id_column, text_column)
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _rows_with_root(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n_shingles, text_key, root) of each row; rows linked to each other have one root."""
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(docs[text_column]).alias("text_key"),
                       docs[text_column].cast("string").alias("text"))
    described = materialise(describe(docs, size, percent), "jaccard-described")
    sets = described.where("n > 0").select("set_id", "n", "counted").distinct()
    chosen = materialise(candidates(docs, sets, size, percent), "jaccard-candidates")
    tokens = materialise(full_sets(docs, described, chosen, size, percent), "jaccard-sets")
    prefix = materialise(prefixes(tokens, percent), "jaccard-prefixes")
    keys = chosen.join(tokens.select("set_id", "order2"), "set_id")
    full = tokens.select("set_id", "tokens")
    links = materialise(verify(meet_in_all_orders(hub_pairs(prefix, percent), keys), full, percent), "jaccard-links")
    components = connected_components(links)
    rest = materialise(rest_pairs(prefix, components, percent), "jaccard-rest")
    if not rest.isEmpty():
        more = materialise(verify(meet_in_all_orders(rest, keys), full, percent), "jaccard-links")
        if not more.isEmpty():
            components = connected_components(links.union(more))
    return described.select("doc_id", F.col("n").alias("n_shingles"), "text_key", "set_id") \
        .join(components.withColumnRenamed("node", "set_id"), "set_id", "left") \
        .withColumn("root", F.coalesce("component", "set_id"))


def one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One document of each component, all columns as they are: the smallest doc_id (null before all), then text hash.

    Rows without words are linked with nothing and all stay.
    """
    rows = _rows_with_root(docs, size, percent, "doc_id", "text")
    best = rows.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("best")) \
        .select(F.col("best.doc_id").alias("_id"), F.col("best.text_key").alias("_key"))
    without_words = F.coalesce(F.btrim("text", F.lit(SEPARATORS_TEXT)) == "", F.lit(True))
    mark = "_text_key"
    while mark in docs.columns:
        mark += "_"
    keyed = docs.where(~without_words).withColumn(mark, F.xxhash64("text"))
    kept = keyed.join(best, keyed["doc_id"].eqNullSafe(best["_id"]) & (keyed[mark] == best["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).drop(mark).unionByName(docs.where(without_words))
