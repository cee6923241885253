"""Trees and records of a project as tables: folders, revisions, registrations, operations, metadata common to scans.

The versioned state of one project is a value on the driver (plans.state); these are the same answers over tables of many
projects' items, as joins and aggregations.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.errors import InvalidState
from pointloom.session import checkpoint


def _links(items: DataFrame) -> DataFrame:
    """id and far: the parent, of those whose parent is an item."""
    known = items.select(F.col("id").alias("_known")).distinct()
    return items.where("parent IS NOT NULL").select("id", F.col("parent").alias("far")).join(known, F.col("far") == F.col("_known"), "left_semi")


def ancestors(items: DataFrame) -> DataFrame:
    """id, above and depth of each item (id, parent) and what holds it at any depth, itself at depth 0. A parent that is
    no item ends the chain; a circle is an error.

    By doubling: a round joins what is known up to 2^k above with the ancestors at exactly 2^k, so that a tree of n levels
    takes about log2(n) rounds. A round's rows are written, so that its plan reads tables and holds no earlier round's.
    """
    links = checkpoint(_links(items))
    parts = [checkpoint(items.select("id", F.col("id").alias("above"), F.lit(0).alias("depth")))]
    for k in range(items.count().bit_length() + 1):  # a longer chain than there are items is a circle
        closure = reduce(DataFrame.unionByName, parts)
        if links.isEmpty():
            return closure
        further = links.join(closure.withColumnRenamed("id", "far"), "far").select("id", "above", (F.col("depth") + F.lit(1 << k)).alias("depth"))
        parts.append(checkpoint(further))
        links = checkpoint(links.join(links.select(F.col("id").alias("far"), F.col("far").alias("_next")), "far").select("id", F.col("_next").alias("far")))
    raise InvalidState("items hold each other")


def depths(items: DataFrame) -> DataFrame:
    """id and depth: how many items (id, parent) stand above each. A circle is an error.

    Each item points at what stands above it, and a round lets it point where that one does: a row for each item, in about
    log2(n) rounds for n levels."""
    up = items.select("id").distinct().join(_links(items).groupBy("id").agg(F.min("far").alias("far")), "id", "left")
    up = checkpoint(up.select("id", "far", F.when(F.col("far").isNull(), 0).otherwise(1).alias("depth")))
    for _ in range(up.count().bit_length() + 1):
        if up.where("far IS NOT NULL").isEmpty():
            return up.select("id", "depth")
        there = up.select(F.col("id").alias("far"), F.col("far").alias("_next"), F.col("depth").alias("_more"))
        done, open_ = up.where("far IS NULL"), up.where("far IS NOT NULL").join(there, "far")
        up = checkpoint(done.unionByName(open_.select("id", F.col("_next").alias("far"), (F.col("depth") + F.col("_more")).alias("depth"))))
    raise InvalidState("items hold each other")


def totals(up: DataFrame, own: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """folder and the sums over it and all below. up: ancestors(); own: folder and the columns to add up."""
    return up.join(own, F.col("folder") == F.col("id")).groupBy(F.col("above").alias("folder")).agg(*(F.sum(c).alias(c) for c in sums))


def inside(rows: DataFrame, up: DataFrame, folder, item: str) -> DataFrame:
    """The rows whose item is the folder or in it at any depth."""
    below = up.where(F.col("above") == F.lit(folder)).select(F.col("id").alias(item))
    return rows.join(below, item, "left_semi")


def nearest_registered(up: DataFrame, valid: DataFrame) -> DataFrame:
    """id and registered: the item itself or the nearest folder above it that has a valid registration (valid: id)."""
    return up.join(valid.select(F.col("id").alias("above")), "above").groupBy("id").agg(F.min_by("above", "depth").alias("registered"))


def registration_valid(placed: tuple[Column, ...], now: tuple[Column, ...], tolerance: float = 1e-6) -> Column:
    """Whether an item still stands where its registration put it: no entry of the two poses differs by more."""
    off = [F.abs(a - b) for a, b in zip(placed, now, strict=True)]
    return (F.greatest(*off) if len(off) > 1 else off[0]) <= tolerance


def registration_status(registered: Column, valid: Column, stopped: Column) -> Column:
    """none without a registration; check where the item has moved since or the fit stopped early; else done."""
    return F.when(~F.coalesce(registered, F.lit(False)), "none").when(~F.coalesce(valid, F.lit(False)) | F.coalesce(stopped, F.lit(False)), "check").otherwise("done")


def worst_first(pairs: DataFrame, rms: str, *ties: str) -> DataFrame:
    """pairs, those without a fit first, then by falling rms."""
    return pairs.orderBy(F.col(rms).desc_nulls_first(), *ties)


def operation_counts(operations: DataFrame) -> DataFrame:
    """revision, kind, n and place: the kinds of operations (revision, kind, seq) of each, in the order of their first."""
    n = operations.groupBy("revision", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return n.select("revision", "kind", "n", F.row_number().over(Window.partitionBy("revision").orderBy("first")).cast("long").alias("place"))


def scan_record_forms(scans: DataFrame) -> DataFrame:
    """operation, form and scans: the shortest way to say which scans (operation, scan, taken) each took: all, except
    (those left out) where these are fewer, else only (those taken)."""
    lists = scans.groupBy("operation").agg(F.array_sort(F.collect_list(F.when(F.col("taken"), F.col("scan")))).alias("yes"), F.array_sort(F.collect_list(F.when(~F.col("taken"), F.col("scan")))).alias("no"))
    form = F.when(F.size("no") == 0, "all").when(F.size("no") < F.size("yes"), "except").otherwise("only")
    return lists.select("operation", form.alias("form"), F.when(form == "all", F.array().cast(lists.schema["no"].dataType)).when(form == "except", F.col("no")).otherwise(F.col("yes")).alias("scans"))


def common_records(records: DataFrame, scan: str, *key: str) -> DataFrame:
    """The keys of metadata records that all scans have; a scan's repeats count once."""
    own = records.select(scan, *key).distinct()
    scans = own.agg(F.countDistinct(scan).alias("_all"))
    held = own.groupBy(*key).agg(F.countDistinct(scan).alias("_n"))
    return held.join(F.broadcast(scans), F.col("_n") == F.col("_all")).select(*key)  # one row


def unreferenced(items: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Items that no state refers to."""
    return items.join(used.select(key), key, "left_anti")


def bare_stem(name: str | None) -> str:
    """A name without what file systems refuse: signs and control characters become _, outer space and dots at the end go;
    scan if nothing is left."""
    kept = "".join("_" if c in '<>:"/\\|?*' or unicodedata.category(c) == "Cc" else c for c in name or "")
    return kept.strip().rstrip(".") or "scan"


def numbered_stems(stems: list[str]) -> list[str]:
    """Stems made different, letters A-Z counting as a-z: the second of equal ones gets _2, or the next number that gives
    one that none before has."""
    used, nth, out = set(), {}, []
    for stem in stems:
        new, low = stem, ascii_lower(stem)
        k = nth.get(low, 2)
        while ascii_lower(new) in used:
            new, k = f"{stem}_{k}", k + 1
        nth[low] = k
        used.add(ascii_lower(new))
        out.append(new)
    return out


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def unique_stems(names: DataFrame) -> DataFrame:
    """id and stem of each file name (id, name), by id: bare_stem(), made different by numbered_stems(). A null or empty
    name is scan.

    A number only ever adds to a name, so names that differ but for numbers at their end are the only ones that can meet.
    Where all of these differ they stay; where all are equal their place among them is their number; the others, equal
    names beside numbered ones, are numbered together."""

    def bare(batches):
        for b in batches:
            stems = [bare_stem(n) for n in b.column(1).to_pylist()]
            low = [ascii_lower(s) for s in stems]
            roots = [re.sub(r"(_[0-9]+)+$", "", s) for s in low]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in (stems, low, roots))], names=["id", "stem", "low", "root"])

    def number(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        return pa.table({"id": t.column("id"), "stem": pa.array(numbered_stems(t.column("stem").to_pylist()), pa.string())})

    kind = names.schema["id"].dataType.simpleString()
    own = checkpoint(names.select("id", F.col("name").cast("string").alias("name")).mapInArrow(bare, f"id {kind}, stem string, low string, root string"))
    met = own.groupBy("root", "low").agg(F.count("*").alias("n")).groupBy("root").agg(F.max("n").alias("most"), F.count("*").alias("different"))
    own = own.join(met, "root")
    stay = own.where("most = 1").select("id", "stem")
    place = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    alike = own.where("most > 1 AND different = 1").withColumn("k", place)
    alike = alike.select("id", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", "k")).alias("stem"))
    mixed = own.where("most > 1 AND different > 1").select("id", "stem", "root").groupBy("root").applyInArrow(number, f"id {kind}, stem string")
    return stay.unionByName(alike).unionByName(mixed)
