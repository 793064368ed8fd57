"""Connected components of a link table, on DataFrames, by hooking and contraction.

Each round every vertex hooks onto its smallest smaller neighbour, the hooks
are followed to their roots, and the links are contracted to links between
roots. Nothing is collected: each round's tables are written and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise


def _oriented(links: DataFrame) -> DataFrame:
    return links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct()


def components(links: DataFrame) -> DataFrame:
    """u long, v long -> vertex, root (the least vertex); vertices without links are absent.

    Loops and repeated links do no harm; an empty table gives an empty one.
    """
    links = materialise(_oriented(links), "links")
    parts: list[DataFrame] = []
    while not links.isEmpty():
        hooks = materialise(links.groupBy("v").agg(F.min("u").alias("root")), "hooks")
        while True:  # follow hooks to hooks, halving the way to the root
            over = hooks.select(F.col("v").alias("_v"), F.col("root").alias("_root"))
            hooks = materialise(hooks.join(over, F.col("root") == F.col("_v"), "left").select("v", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        parts.append(hooks.select("v", "root"))
        a = hooks.select(F.col("v").alias("_a"), F.col("root").alias("_ra"))
        b = hooks.select(F.col("v").alias("_b"), F.col("root").alias("_rb"))
        links = links.join(a, F.col("u") == F.col("_a"), "left").join(b, F.col("v") == F.col("_b"), "left")
        links = links.select(F.coalesce("_ra", "u").alias("u"), F.coalesce("_rb", "v").alias("v"))
        links = materialise(_oriented(links), "links")
    if not parts:
        return links.select(F.col("v").alias("vertex"), F.col("u").alias("root"))
    # a root of one round may be hooked in a later one
    done = parts[-1]
    for p in reversed(parts[:-1]):
        later = done.select(F.col("v").alias("_v"), F.col("root").alias("_root"))
        p = p.join(later, F.col("root") == F.col("_v"), "left").select("v", F.coalesce("_root", "root").alias("root"))
        done = materialise(p.unionByName(done), "roots")
    # every non-root vertex is now mapped; roots map to themselves
    own = done.select(F.col("root").alias("vertex"), "root").distinct()
    return done.select(F.col("v").alias("vertex"), "root").unionByName(own)
