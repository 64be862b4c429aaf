"""Tables that streams keep: the events of the last weeks, and the graph of companies.

Both are versioned tables (sources.publish), one version a batch, named by the batch: a batch that is run again after a
failure finds its own version current and changes nothing, and one that died before it was published starts again from
the version before it. Each function is made for ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import attribution
from marketlens.sources import publish
from marketlens.sources.files import EDGE

EVENT = "id string, title string, day date, type string, phrase string, certainty string, direction string, domains array<string>, actors array<string>"
RETAINED_DAYS = 45
Batch = Callable[[DataFrame, int], None]


def _version(stream: str, batch: int) -> str:
    return f"{stream}-{batch:09d}"


def corpus_keeper(folder: str, terms: Callable[[], DataFrame], companies: Callable[[], DataFrame], days: int = RETAINED_DAYS, stream: str = "corpus") -> Batch:
    """Keeps the market events of the last days: a batch of headlines (id, title, day) joins the events that are held.

    terms and companies give the vocabulary and the list as they are now, read again for every batch. All events are
    attributed anew by them, those of earlier batches too, and an event that touches nothing any more goes. The newest day
    ever seen is the day that ages are measured from, so late headlines join if they are not too old, and replaying files
    gives the same table. An id that is held is not taken again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = publish.read(spark, folder, "rows", EVENT)
        seen = publish.read(spark, folder, "newest", "day date")
        newest = seen.unionByName(batch.select("day")).agg(F.max("day").alias("day"))
        fresh = batch.dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti")
        found = attribution.market_events(fresh.select(F.col("id").cast("string").alias("id"), "title", "day"), terms(), companies())
        both = held.unionByName(found.select(*held.columns))
        kept = attribution.refreshed(both, companies(), newest.scalar(), days)
        publish.publish({"rows": kept, "newest": newest.coalesce(1)}, folder, _version(stream, number), orders={"rows": ["day", "id"]})

    return keep


def edge_key() -> Column:
    """What two edges have in common that are the same: the type and the ends in lower case, of partners in either order."""
    a, b = F.lower("src"), F.lower("dst")
    partner = F.col("type") == "partner"
    return F.struct(F.col("type"), F.when(partner, F.least(a, b)).otherwise(a).alias("a"), F.when(partner, F.greatest(a, b)).otherwise(b).alias("b"))


def grown(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """graph with the edges that it lacks; an edge that is there stays as it is. Of equal new ones the first evidence counts."""
    new = edges.withColumn("key", edge_key()).groupBy("key").agg(F.min_by(F.struct(*edges.columns), F.struct("evidence", "src", "dst")).alias("e"))
    missing = new.join(graph.select(edge_key().alias("key")).distinct(), "key", "left_anti")
    return graph.unionByName(missing.select("e.*"), allowMissingColumns=True)


def in_graph_order(graph: DataFrame) -> DataFrame:
    return graph.orderBy("type", F.lower("src"), F.lower("dst"))


def partner_edges(titles: DataFrame, companies: DataFrame) -> DataFrame:
    """titles (id, title, day) -> an edge for each two companies that a tie-up headline names, with it as evidence."""
    found = attribution.partner_edges(titles, attribution.named(titles, companies)).withColumnRenamed("evidence", "id").join(titles, "id")
    return found.select("src", "dst", F.lit("partner").alias("type"), F.lit(None).cast("string").alias("note"), F.substring("title", 1, 160).alias("evidence"), F.col("day").cast("string").alias("added"))


def graph_grower(folder: str, companies: Callable[[], DataFrame], stream: str = "graph") -> Batch:
    """Adds to the graph what a batch of headlines (id, title, day) tells of partners; nothing is ever overwritten or added twice."""

    def grow(batch: DataFrame, number: int) -> None:
        graph = publish.read(batch.sparkSession, folder, "edges", EDGE)
        both = grown(graph, partner_edges(batch, companies()))
        keyed = both.select("*", F.lower("src").alias("_a"), F.lower("dst").alias("_b"))
        publish.publish({"edges": keyed}, folder, _version(stream, number), orders={"edges": ["type", "_a", "_b"]})

    return grow
