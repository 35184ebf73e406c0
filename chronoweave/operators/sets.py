"""Set algebra with a stated winner among equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """The first row of each key by order (the last if asked), chosen by a partial aggregate, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    best = (F.max_by if last else F.min_by)(row, order)
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def ordered_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the parts; of equal keys the row of the earliest part, and there the one with the smallest ``ord``."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p)
    return one_per_key(rows, keys, F.struct("_part", "ord")).drop("_part")


def manifest_union(files: DataFrame) -> DataFrame:
    """One row per id, the smallest ``ord`` first; of those with a stem, the first owns it. A further file with the stem is left out if its
    size is the owner's and known (not null or 0), and else named ``stem~`` and six characters of its id.

    files: ord, id, stem, bytes. Renamed stems are not looked up again: an id's part makes them its own.
    """
    rows = one_per_key(files, ["id"], F.col("ord"))
    w = Window.partitionBy("stem").orderBy("ord")
    rows = rows.withColumn("_owner", F.first("bytes").over(w)).withColumn("_at", F.row_number().over(w))
    kept = rows.where((F.col("_at") == 1) | ~F.coalesce((F.col("bytes") == F.col("_owner")) & (F.col("bytes") != 0), F.lit(False)))
    return kept.withColumn("name", F.when(F.col("_at") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("~"), F.substring("id", 1, 6)))).select("ord", "id", "stem", "bytes", "name")


def layered(maps: list[Column]) -> Column:
    """Union of maps in which later ones win."""
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)))
