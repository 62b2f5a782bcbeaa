"""Connected components as joins, for links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import cut

MOST_ROUNDS = 50


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches; edges has columns u and v of one orderable type.

    Alternates large-star and small-star rounds until the links are stars. Each round is cut to the shared folder. Ids without a
    link have no row; self links and null ends are left out; repeated links count once. No group is gathered: a hot id is only
    aggregated (min) and joined, which adaptive execution splits."""
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"links are not stars after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
