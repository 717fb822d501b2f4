"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (id, label): label is the smallest id reachable, for ids that have links.

    Each round takes the least label among neighbours (a grouped minimum, combined before the
    shuffle, so an id with many links is no hot key) and then the label of that label, so that long
    chains halve. Rounds are jobs that run when this is called, each written to the checkpoint
    folder; only a flag comes back to the driver. No links give no rows; self links and repeated
    links change nothing; nulls are left out.
    """
    clean = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = saved(clean.unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")))
    while True:
        of = labels.select(F.col("id").alias("at"), F.col("label").alias("seen"))
        told = both.join(of, both["b"] == of["at"]).select(F.col("a").alias("id"), "seen", F.lit(None).cast("long").alias("was"))
        told = told.unionByName(labels.select("id", F.col("label").alias("seen"), F.col("label").alias("was")))
        near = told.groupBy("id").agg(F.min("seen").alias("near"), F.max("was").alias("was"))
        jump = near.join(of.withColumnRenamed("seen", "further"), near["near"] == of["at"])
        new = saved(jump.select("id", "was", F.least("near", "further").alias("label")))
        done = new.where("label != was").isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels, a result of components(), after more links; only what the new links join is worked on again."""
    known = labels.withColumnRenamed("id", "of")

    def named(df: DataFrame, end: str) -> DataFrame:
        joined = df.join(known, df[end] == known["of"], "left")
        return joined.withColumn(end, F.coalesce("label", end)).drop("of", "label")

    joined = components(named(named(links.select("a", "b"), "a"), "b"))
    renamed = joined.select(F.col("id").alias("label"), F.col("label").alias("now"))
    old = labels.join(renamed, "label", "left").select("id", F.coalesce("now", "label").alias("label"))
    return saved(old.unionByName(joined).groupBy("id").agg(F.min("label").alias("label")))
