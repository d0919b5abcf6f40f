"""Connected components of links between keys, without gathering them on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any orderable type -> key, label: for every key that stands in a link, the
    smallest key that can be reached from it. It is a written table, for release() when it's no longer read.

    Each round takes the least label among a key's neighbours, then the label of that label, so
    paths shorten at least by half. Every round is written to the shared folder. Sums and minima are
    combined before the shuffle, and joins are plain equi-joins that Spark can split where a hub has
    very many links.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["key"]).groupBy("b").agg(F.min("label").alias("m"))
        hop = labels.join(near, labels["key"] == near["b"]).select("key", F.col("label").alias("old"), F.least("label", "m").alias("hop"))
        ahead = labels.select(F.col("key").alias("at"), F.col("label").alias("ahead"))
        new = materialize(hop.join(ahead, hop["hop"] == ahead["at"]).select("key", F.least("hop", "ahead").alias("label"), (F.least("hop", "ahead") != F.col("old")).alias("moved")), "labels")
        release(labels)
        labels = new.select("key", "label")
        labels.written_to = new.written_to
        if new.filter("moved").isEmpty():
            release(both)
            return labels
