"""Connected components of a table of links, by alternating large and small stars.

In a round each node links its larger neighbours, then its smaller ones, to the smallest node it
knows, until every node links to the root of its component. Links stay in tables: each round is
written to the shared folder, and only a count and a checksum reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(`node`, `root`) for every node of a link (`u`, `v`) to another node, roots included.

    `root` is the smallest node that can be reached. Null ends and links of a node to itself are
    ignored; links may repeat and go either way; no links give no rows.
    """
    ends = links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    ends = written(ends, "links")
    before = None
    for _ in range(ROUNDS):
        state = ends.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = ends.union(ends.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ends = written(least.select("a", F.col("m").alias("b")).union(small).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return ends.toDF("node", "root").union(ends.select("b", "b").distinct())
