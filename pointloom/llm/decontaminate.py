"""Benchmark decontamination: a broadcast hash set of the test items' word windows, and a scan of every text's windows.

Only DataFrame functions. A text is lower-cased (A-Z) and cut into words; a window is WINDOW consecutive words of a
test item, or the whole item if it has fewer. The windows of each size are a hash set: bits that say whether a key is
taken, and buckets of the windows with that key; both are constant arrays that Spark broadcasts with the tasks. A text's word hashes are worked out once; the key of a window is that of its first and its last
word, so that nearly all positions end at the bits, and only others compare the window's words with its bucket. Hits are
found in place and joined to the items that have them. Where the test items have more than MOST_WINDOWS windows, which is
counted first, texts' windows are joined by a shuffle instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
#: Windows of test items that may be sent to every task.
MOST_WINDOWS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each different window: w (its words), size, h (their hash) and items (the ids that have it, as text)."""
    n = F.size("words")
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), C.words_of(F.col(text_col)).alias("words")).where(n > 0)
    size = F.least(n, F.lit(window))
    at = cut.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), n - size + 1)).alias("i"))
    w = at.select("item", "size", F.expr("slice(words, i, size)").alias("w"))
    return w.groupBy("w", "size").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("w"))


def _key(first: Column, last: Column) -> Column:
    """Of a window, by the hashes of its first and its last word."""
    return F.shiftleft(first, 1).bitwiseXOR(last)


@dataclass(frozen=True)
class HashSet:
    """The windows of one size. bits: a bit for each of 64 * cells keys; buckets: the windows' texts, by key modulo cells."""

    size: int
    cells: int
    bits: Column
    buckets: Column

    @staticmethod
    def of(bench: DataFrame, size: int, n: int) -> HashSet:
        """Of the n windows of a size. Both arrays are constants, which Spark broadcasts with the tasks; an element is
        read by its index, whatever n is."""
        cells = 1 << max(6, n.bit_length())
        own = bench.where(F.col("size") == size).select(F.array_join("w", " ").alias("text"), _key(F.xxhash64(F.element_at("w", 1)), F.xxhash64(F.element_at("w", -1))).alias("key"))
        bits, buckets = [0] * cells, [[] for _ in range(cells)]
        for r in own.collect():  # MOST_WINDOWS at most
            cell = r["key"] & cells - 1
            bits[cell] |= 1 << (r["key"] >> 32 & 63)
            buckets[cell].append(r["text"])
        signed = [x - (1 << 64) if x >> 63 else x for x in bits]
        constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded when the plan is made
        return HashSet(size, cells, constant(signed, "array<long>"), constant(buckets, "array<array<string>>"))

    def found(self, words: Column, hashes: Column) -> Column:
        """The positions, from 1, of the text's windows that are in the set."""
        last = F.size(words) - self.size + 1
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        key = lambda i: _key(F.get(hashes, i - 1), F.get(hashes, i + (self.size - 2)))
        cell = lambda i: key(i).bitwiseAND(self.cells - 1).cast("int")
        taken = F.filter(at, lambda i: F.getbit(F.get(self.bits, cell(i)), F.shiftright(key(i), 32).bitwiseAND(63).cast("int")) == 1)
        return F.filter(taken, lambda i: F.array_contains(F.get(self.buckets, cell(i)), F.array_join(F.slice(words, i, self.size), " ")))


def _found(words: Column, hashes: Column, sets: list[HashSet]) -> Column:
    """All windows of the sets in a text's words, as structs of position, from 0, and size."""
    sized = lambda x: F.transform(x.found(words, hashes), lambda i: F.struct((i - 1).alias("pos"), F.lit(x.size).alias("size")))
    each = [sized(x) for x in sets]
    return F.flatten(F.array(*each)) if each else F.array().cast("array<struct<pos:int,size:int>>")


def _covered(found: Column) -> Column:
    """The positions of the words in windows, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1)))))


def _all_starts(words: Column, size: int) -> Column:
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.lit(size).alias("size"), F.xxhash64(F.slice(words, i, size)).alias("h")))


def _bench(items: DataFrame, window: int) -> tuple[DataFrame, dict[int, int]]:
    """item_windows(), and how many there are of each size, of which there are `window` at most."""
    bench = C.checkpoint(item_windows(items, window=window))
    return bench, {r["size"]: r["n"] for r in bench.groupBy("size").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = MOST_WINDOWS, pass_on: tuple[str, ...] = ()) -> DataFrame:
    """The hits of each text: id_col, pass_on, n_words, hits (positions of hit words, ascending), items (ids, as sorted text).

    A null text has no words, like an empty one; an item without words has no window. Rows keep their number, whether
    ids repeat or are null; docs may have any other columns, also of the names used here. Without items nothing is hit.
    """
    docs = C.spread(docs)
    bench, sizes = _bench(items, window)
    kept = [docs[c].alias(f"k{k}") for k, c in enumerate((id_col, *pass_on))]
    names = [f"k{k}" for k in range(len(kept))]
    base = docs.select(*kept, C.words_of(docs[text_col].cast("string")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    n_words = F.size("words").alias("n_words")
    if sum(sizes.values()) <= most:
        sets = [HashSet.of(bench, size, n) for size, n in sorted(sizes.items())]
        hashed = base.select("row", *names, "words", n_words, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
        found = hashed.select("row", *names, "words", "n_words", _found(F.col("words"), F.col("hashes"), sets).alias("found"))
        hits = F.transform("found", lambda x: F.struct(x["pos"].alias("pos"), F.slice(F.col("words"), x["pos"] + 1, x["size"]).alias("w")))
        each = found.select("row", *names, "n_words", F.explode_outer(hits).alias("hit"))
        verified = each.join(F.broadcast(bench.select("w", "items")), F.col("hit.w") == F.col("w"), "left")
    else:
        base = C.checkpoint(base)
        windows = [_all_starts(F.col("words"), n) for n in sizes]
        each = base.select("row", F.explode(F.flatten(F.array(*windows))).alias("x")).select("row", "x.*")
        near = each.join(bench.select("h", "size"), ["h", "size"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "size")).alias("near"))
        hits = F.transform("near", lambda x: F.struct(x["pos"].alias("pos"), F.slice(F.col("words"), x["pos"] + 1, x["size"]).alias("w")))
        each = base.join(near, "row", "left").select("row", *names, n_words, F.explode_outer(hits).alias("hit"))
        verified = each.join(bench.select("w", "items"), F.col("hit.w") == F.col("w"), "left")
    covered = F.when(F.col("items").isNotNull(), F.sequence(F.col("hit.pos"), F.col("hit.pos") + F.size("hit.w") - 1))
    out = verified.groupBy("row", *names, "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, (id_col, *pass_on), strict=True)), "n_words", "hits", "items")


def without_words(text: Column, hits: Column) -> Column:
    """The text less the words at the given positions, with each one's leading separators; unchanged without hits."""
    pairs = F.arrays_zip(F.split(text, WORD).alias("gap"), F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("word"))
    kept = F.filter(pairs, lambda p, i: p["word"].isNull() | ~F.array_contains(hits, i))  # the last gap has no word
    return F.when(F.size(hits) > 0, F.array_join(F.transform(kept, lambda p: F.concat(p["gap"], F.coalesce(p["word"], F.lit("")))), "")).otherwise(text)


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: float = 0.5, window: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """docs without what the test items share: hit words go, and documents of which hits are more than `whole` go whole.

    All columns of docs stay as they are but for the text. A clean document is returned as it came. Texts stay where they
    are: nothing is shuffled, unless the test items have more than `most` windows.
    """
    bench, sizes = _bench(items, window)
    columns = [c for c in docs.columns if c != text_col]
    docs = C.spread(docs)
    own = docs.select(*(docs[c].alias(f"k{k}") for k, c in enumerate(columns)), docs[text_col].alias("t"))  # no clashing names
    names = own.columns
    if sum(sizes.values()) <= most:
        sets = [HashSet.of(bench, size, n) for size, n in sorted(sizes.items())]
        words = own.withColumn("words", C.words_of(F.col("t").cast("string"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        # a condition on the row number cannot move below it: else the scan would run in the condition once more
        found = words.select(*names, F.monotonically_increasing_id().alias("row"), F.size("words").alias("n_words"), _found(F.col("words"), F.col("hashes"), sets).alias("found"))
        marked = found.select(*names, "row", "n_words", F.when(F.size("found") > 0, _covered(F.col("found"))).otherwise(F.array().cast("array<int>")).alias("hits"))
    else:
        marked = scan(own, items, names[0], "t", window, most, pass_on=tuple(names[1:])).withColumn("row", F.lit(0))
    kept = marked.where((F.size("hits") <= F.col("n_words") * whole) & (F.col("row") >= 0)) if whole < 1 else marked
    back = dict(zip(columns, names, strict=False))
    return kept.select(*(without_words(F.col("t"), F.col("hits")).alias(c) if c == text_col else F.col(back[c]).alias(c) for c in docs.columns))
