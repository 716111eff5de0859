"""Differences between two states of keyed records: added, removed, moved, and what depends on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codelode.plans.scratch import cut  # noqa: F401

#: Roles of a contract that declare it; only others consume it.
DECLARING_ROLES = ("parse", "declare", "write", "write_assign", "occurrence")


def under_label(snapshots: DataFrame, label: str) -> DataFrame:
    return snapshots.where(F.col("label") == label).drop("label", "ts").distinct()


def key_diff(base: DataFrame, head: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, change): `added` keys of head only, `removed` ones of base only; nulls are equal.

    Both sides go through one aggregation by key, so each row is moved once, partly combined.
    """
    sided = base.select(*key, F.lit(1).alias("b"), F.lit(0).alias("h")).unionByName(head.select(*key, F.lit(0).alias("b"), F.lit(1).alias("h")))
    sides = sided.groupBy(*key).agg(F.max("b").alias("b"), F.max("h").alias("h")).where("b <> h")
    return sides.select(*key, F.when(F.col("h") == 1, "added").otherwise("removed").alias("change"))


def shape(before: Column, after: Column) -> Column:
    """How sites moved, by their numbers."""
    return F.when((before == 1) & (after == 1), "1to1").when(before == 1, "split").when(after == 1, "merge").otherwise("many-to-many")


def moved_keys(base: DataFrame, head: DataFrame, identity: Sequence[str], place: str) -> DataFrame:
    """(identity, shape, from_places, to_places): records of both states that left some places and came to others."""
    changes = key_diff(base.where(F.col(place).isNotNull()), head.where(F.col(place).isNotNull()), [*identity, place])
    counts = changes.groupBy(*identity).agg(F.count_if(F.col("change") == "removed").alias("left"), F.count_if(F.col("change") == "added").alias("came"))
    counts = counts.where("left > 0 and came > 0")
    return counts.select(*identity, shape(F.col("left"), F.col("came")).alias("shape"), F.col("left").alias("from_places"), F.col("came").alias("to_places"))


def site_diff(base: DataFrame, head: DataFrame, key: Sequence[str], place: str) -> DataFrame:
    """(key, status, added_places, removed_places, kept_places) per key: added, removed, moved (its set of places differs) or unchanged."""
    sided = base.select(*key, place, F.lit(1).alias("b"), F.lit(0).alias("h")).unionByName(head.select(*key, place, F.lit(0).alias("b"), F.lit(1).alias("h")))
    sites = sided.groupBy(*key, place).agg(F.max("b").alias("b"), F.max("h").alias("h"))
    came, left, kept = (F.col("h") == 1) & (F.col("b") == 0), (F.col("b") == 1) & (F.col("h") == 0), (F.col("b") == 1) & (F.col("h") == 1)
    sums = sites.groupBy(*key).agg(F.sum("b").alias("nb"), F.sum("h").alias("nh"), F.count_if(came).alias("added_places"), F.count_if(left).alias("removed_places"), F.count_if(kept).alias("kept_places"))
    status = F.when(F.col("nb") == 0, "added").when(F.col("nh") == 0, "removed").when((F.col("added_places") > 0) | (F.col("removed_places") > 0), "moved").otherwise("unchanged")
    return sums.select(*key, status.alias("status"), "added_places", "removed_places", "kept_places")


def churn(base: DataFrame, head: DataFrame, key: Sequence[str], file: str = "file") -> DataFrame:
    """(file, added, removed): records that came and went per file."""
    return key_diff(base, head, key).groupBy(file).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


def removed_names(base: DataFrame, head: DataFrame, name: str = "name") -> DataFrame:
    return base.where(F.col(name).isNotNull()).select(name).distinct().join(head.where(F.col(name).isNotNull()).select(name).distinct(), name, "left_anti")


def describe_delta(base: DataFrame, head: DataFrame, file: str = "file", name: str = "name", most: int = 5) -> DataFrame:
    """(file, text): `+a, b; -c` of each file whose names changed, the first `most` names of each side and how many more."""
    changes = key_diff(base.select(file, name).where(F.col(name).isNotNull()), head.select(file, name).where(F.col(name).isNotNull()), [file, name])
    names = changes.groupBy(file).agg(F.array_sort(F.collect_list(F.when(F.col("change") == "added", F.col(name)))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("change") == "removed", F.col(name)))).alias("r"))  # names of one file

    def side(sign: str, c: str) -> Column:
        more = F.when(F.size(c) > most, F.concat(F.lit(" (+"), (F.size(c) - most).cast("string"), F.lit(" more)"))).otherwise("")
        return F.when(F.size(c) > 0, F.concat(F.lit(sign), F.array_join(F.slice(c, 1, most), ", "), more))

    return names.select(file, F.concat_ws("; ", side("+", "a"), side("-", "r")).alias("text"))


def listing_diff(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): `added`, `deleted` or `modified` paths of a listing (path, hash) against an index (path, hash)."""
    old, new = indexed.select("path", F.col("hash").alias("old")).withColumn("i", F.lit(1)), found.select("path", F.col("hash").alias("new")).withColumn("f", F.lit(1))
    both = old.join(new, "path", "full")
    change = F.when(F.col("i").isNull(), "added").when(F.col("f").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def name_variants(name: Column) -> Column:
    """A flag's name as it is, with underscores, and in camel case."""
    under = F.replace(name, F.lit("-"), F.lit("_"))
    parts = F.split(under, "_")
    camel = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), ""))
    return F.array_distinct(F.array(name, under, F.when(F.size(parts) > 1, camel).otherwise(under)))


def consumers(declared: DataFrame, contracts: DataFrame | None, refs: DataFrame, declaring: bool = True) -> DataFrame:
    """(kind, name, uses, orphan) for declared (kind, name): references under any variant of the name, and contract rows that don't declare it.

    declaring=False counts all contract rows: what still hangs on a removed name.
    """
    variants = declared.select("kind", "name").distinct().select("kind", "name", F.explode(name_variants(F.col("name"))).alias("variant"))
    counts = refs.where("name is not null").groupBy(F.col("name").alias("variant")).agg(F.count("*").alias("n"))
    uses = variants.join(counts, "variant", "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))
    if contracts is not None:
        rows = contracts.where(~F.col("role").isin(*DECLARING_ROLES)) if declaring else contracts
        uses = uses.unionByName(rows.join(declared.select("kind", "name").distinct(), ["kind", "name"], "left_semi").groupBy("kind", "name").agg(F.count("*").alias("n")))
    return uses.groupBy("kind", "name").agg(F.sum("n").alias("uses")).withColumn("orphan", F.col("uses") == 0)


def obligations(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(obligation, kind, name): added names without a use must get one, uses of removed names must go."""
    open_ = added.where("orphan").select(F.concat(F.lit("consume_"), F.col("kind")).alias("obligation"), "kind", "name")
    return open_.unionByName(removed.where("not orphan").select(F.lit("dangling_ref").alias("obligation"), "kind", "name"))


def default_base(labels: DataFrame, preferred: str = "pre-index") -> DataFrame:
    """(label): the preferred label if it is registered, else the newest one."""
    ranked = labels.select("label", "pos", (F.col("label") == preferred).cast("int").alias("own"))
    return ranked.agg(F.max(F.struct("own", "pos", "label"))["label"].alias("label"))
