"""Registries against one another: new, orphan, renamed and stale records, keyed merges, snapshots, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import first_of


def reconcile(disk: DataFrame, index: DataFrame, key: str, value: str) -> DataFrame:
    """One full outer join on the key: new, orphan, stale (the value differs) or same."""
    d, i = disk.select(key, F.col(value).alias("disk_value")), index.select(key, F.col(value).alias("index_value"))
    both = d.withColumn("_d", F.lit(True)).join(i.withColumn("_i", F.lit(True)), key, "full")
    state = F.when(F.col("_i").isNull(), "new").when(F.col("_d").isNull(), "orphan").when(~F.col("disk_value").eqNullSafe(F.col("index_value")), "stale").otherwise("same")
    return both.select(key, "disk_value", "index_value", state.alias("state"))


def renames(reconciled: DataFrame, key: str) -> DataFrame:
    """Orphans and new records that share a value: the record has moved. One to one only."""
    new = reconciled.where("state = 'new' and disk_value is not null").groupBy(F.col("disk_value").alias("value")).agg(F.min(key).alias("new_key"), F.count("*").alias("_n"))
    old = reconciled.where("state = 'orphan' and index_value is not null").groupBy(F.col("index_value").alias("value")).agg(F.min(key).alias("old_key"), F.count("*").alias("_o"))
    return new.join(old, "value").where("_n = 1 and _o = 1").select("value", "old_key", "new_key")


def duplicate_groups(docs: DataFrame, key, id_: str) -> DataFrame:
    """Groups of equal keys: count and first id; only keys and ids are shuffled."""
    return docs.select(F.col(id_).alias("id"), key.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def duplicate_lists(docs: DataFrame, key, id_: str, k: int = 50) -> DataFrame:
    """Groups of equal keys as one record each: the first id, how many copies there are, and the first k of these in order."""
    d = docs.select(F.col(id_).alias("id"), key.alias("key")).where("key is not null")
    groups = duplicate_groups(docs, key, id_).select("key", "n", "first_id")
    copies = d.join(groups.select("key", "first_id"), "key").where("id <> first_id")
    return groups.join(first_of(copies, ["key"], ["id"], k, F.col("id"), "duplicates"), "key", "left")


def latest(rows: DataFrame, keys: list[str], order: list, keep: int = 1) -> DataFrame:
    """The newest `keep` rows of each key; the row number's limit is pushed below the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= keep)


def upsert(target: DataFrame, source: DataFrame, key: str, fields: list[str], manual: tuple[str, ...] = ()) -> DataFrame:
    """Merge by key: the source's values first, null never overwrites, manual fields keep the target's;
    a flag tells rows where a source value replaced another."""
    t = target.select(key, *[F.col(c).alias(f"_t_{c}") for c in fields]).withColumn("_t", F.lit(True))
    s = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in fields]).withColumn("_s", F.lit(True))
    j = t.join(s, key, "full")
    value = lambda c: F.coalesce(f"_t_{c}", f"_s_{c}") if c in manual else F.coalesce(f"_s_{c}", f"_t_{c}")
    clash = F.lit(False)
    for c in fields:
        if c not in manual:
            clash = clash | F.coalesce(F.col(f"_s_{c}") != F.col(f"_t_{c}"), F.lit(False))
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "keep").otherwise("update")
    return j.select(key, *[value(c).alias(c) for c in fields], action.alias("action"), clash.alias("conflict"))


def second_chance(left: DataFrame, right: DataFrame, first: str, second: list[str], id_: str) -> DataFrame:
    """Left join by one key, then by others for what is left; `via` tells which matched, a second match of
    more than one record is none."""
    r1 = right.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(id_).alias("_id1"))
    r2 = right.groupBy(*second).agg(F.min(id_).alias("_id2"), F.count("*").alias("_n2")).where("_n2 = 1").drop("_n2")
    j = left.join(r1, first, "left").join(r2, second, "left")
    via = F.when(F.col("_id1").isNotNull(), "key").when(F.col("_id2").isNotNull(), "fields")
    return j.withColumn("match_id", F.coalesce("_id1", "_id2")).withColumn("via", via).drop("_id1", "_id2")


def _two_digits(number: str) -> Column:
    s = F.col(number).cast("string")
    return F.when(F.length(s) < 2, F.concat(F.lit("0"), s)).otherwise(s)


def catalog_order(docs: DataFrame, group: str, bundle: str, order: list[str]) -> DataFrame:
    """Package numbers NN by bundle within group, NN.kk within a bundle; numbers above 99 have all their digits."""
    # bundles are ranked among themselves, not over their members
    ranked = docs.select(group, bundle).distinct().withColumn("nn", F.row_number().over(Window.partitionBy(group).orderBy(bundle)))
    d = docs.join(ranked, [group, bundle]).withColumn("kk", F.row_number().over(Window.partitionBy(group, bundle).orderBy(*order)))
    return d.withColumn("label", F.concat_ws(".", _two_digits("nn"), _two_digits("kk")))


def retracted(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return rows.join(ledger.select(key), key, "left_anti")


def delta(docs: DataFrame, snapshot: DataFrame, key: str, hash_: str) -> DataFrame:
    """Documents that are new or whose hash changed since a snapshot."""
    s = snapshot.select(key, F.col(hash_).alias("_h"))
    return docs.join(s, key, "left").where(~F.col(hash_).eqNullSafe(F.col("_h"))).drop("_h")


def event_counters(events: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """Distinct marks by key, from an append-only log that may repeat; distinct first, then a plain count."""
    return events.select(*keys, *marks).distinct().groupBy(*keys).agg(F.count("*").alias("n"))


def keyed_upsert(target: DataFrame, source: DataFrame, id_: str = "id") -> DataFrame:
    """Each source row (source_id, number, dispute, folder) with the target row it goes to: by number and dispute, else by
    folder; a number that is there under neither is a collision and goes nowhere; else a new row. Matches of more than
    one target row are collisions too."""
    def one(keys, name):
        return target.dropna(subset=keys).groupBy(*keys).agg(F.min(id_).alias(f"{name}_id"), F.count("*").alias(f"{name}_n"))

    j = source.join(one(["number", "dispute"], "key"), ["number", "dispute"], "left").join(one(["folder"], "folder"), "folder", "left")
    j = j.join(target.select("number").where("number is not null").distinct().withColumn("known", F.lit(True)), "number", "left")
    via = F.when(F.col("key_n") == 1, "key").when(F.col("key_n") > 1, "collision").when(F.col("folder_n") == 1, "folder").when((F.col("folder_n") > 1) | F.col("known"), "collision").otherwise("insert")
    out = j.withColumn("via", via)
    return out.select("source_id", F.when(F.col("via") == "key", F.col("key_id")).when(F.col("via") == "folder", F.col("folder_id")).alias("target_id"), "via")


def shadow_duplicates(parties: DataFrame) -> DataFrame:
    """(slug, by_tax_id, by_slug): parties kept twice, once under a tax id and once under their slug alone.
    parties: (party_id, tax_id, slug)."""
    with_id = parties.where("tax_id is not null").groupBy("slug").agg(F.min("party_id").alias("by_tax_id"))
    bare = parties.where("tax_id is null").groupBy("slug").agg(F.min("party_id").alias("by_slug"))
    return with_id.join(bare, "slug")


def completeness(units: DataFrame, stated: DataFrame, key: str) -> DataFrame:
    """Per package: how many units there are and what they sum up to, against what is stated; units of no package are
    orphans, packages without units are empty. units: (key, amount); stated: (key, n, total)."""
    u = units.groupBy(key).agg(F.count("*").alias("n_units"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("sum_units"))
    j = u.join(stated.select(key, F.col("n").alias("stated_n"), F.col("total").cast("decimal(18,2)").alias("stated_total")), key, "full")
    state = F.when(F.col("stated_n").isNull(), "orphan").when(F.col("n_units").isNull(), "empty").when(F.col("n_units") != F.col("stated_n"), "count").when(F.col("sum_units") != F.col("stated_total"), "total").otherwise("complete")
    return j.select(key, F.coalesce("n_units", F.lit(0)).alias("n_units"), F.col("sum_units").cast("double").alias("sum_units"), state.alias("state"))


def catalog_summary(docs: DataFrame, group: str) -> DataFrame:
    return docs.groupBy(group).agg(F.count("*").alias("n"))


def appended_once(have: Column, more: Column) -> Column:
    """A list with what is new at its end."""
    return F.array_union(F.coalesce(have, F.array()), F.coalesce(more, F.array()))
