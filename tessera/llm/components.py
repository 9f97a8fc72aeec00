"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written


def components(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a long, b long), either way round, to (id, root): root is the smallest id that can be reached. The second
    table holds the links, each both ways. Both are written tables, the caller's to drop.

    Every round gives each id the smallest root among its own and its neighbours', then follows the root's own root,
    so a chain shortens by half and a star needs two rounds. A round is written to the shared folder; a hub is
    pre-aggregated before the shuffle. Null ids are left out, repeated links and loops do no harm.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = written(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        best = roots.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = written(best.join(up, "root").select("id", "was", F.least("root", "up").alias("root")), "roots")
        dropped(roots)
        roots = step.drop("was")
        roots.stored_at = step.stored_at
        if step.where(F.col("was") != F.col("root")).isEmpty():
            return roots, both
