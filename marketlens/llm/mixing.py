"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations alone.

* Slot i of the schedule goes to the source in whose share of [0, 1) the i-th golden-ratio point falls, so any run of
  slots is close to the target weights. A source's slots are ranked by their place in the schedule.
* Each source's documents are laid in shuffled order (by a digest of the doc_id) on a line of tokens that repeats up to
  ``MAX_REPEATS`` times. The target's length of it is cut into as many blocks of equal tokens as the source has slots,
  and the k-th block joins the k-th slot.

Running totals and ranks are made in two levels (a sum per bucket or chunk, then inside it), so that no source is
gathered in one task. Sources are ordered by code point, null last, and weigh 1, 2, 3, 1, ...; a null text has no
words. Documents without words are returned with nothing taken. Repeated rows are laid one after another. An empty
table gives an empty result. If all sources are empty, so is the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlens.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
SLOT_WORDS = 256
BUCKET_ROWS = 2000
CHUNK_SLOTS = 8192
#: Tables with a row per source are broadcast up to so many sources.
BROADCAST_SOURCES = 20_000
_UNIT = 1 << 31
#: The golden ratio's fraction in units of 2**-31.
_GOLDEN = 1327217885
_CELL = 1 << 19


def words_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, docs, source_size) -> with weight, target (double) and the source's range [low, high) of 2**31 points.

    A target is the source's weight times a common level, or its size times MAX_REPEATS if that is less. Sources in the
    order of the level at which they are full: the level is the first that fits those not yet full.
    """
    one = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", 1 + (F.col("place") - 1) % 3)
    most = ranked.withColumns({"most": (MAX_REPEATS * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(one).cast("double")}).withColumn("full_at", F.col("most") / F.col("weight"))
    by = one.orderBy("full_at", "place")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    most = most.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)).withColumn("order", F.row_number().over(by))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("order", "level"))).over(one)["level"]
    aimed = most.withColumn("at", F.coalesce(level, F.lit(0.0))).withColumn("target", F.when(F.col("full_at") <= F.col("at"), F.col("most")).otherwise(F.col("weight") * F.col("at")))
    upto = F.sum("target").over(one.orderBy("place"))
    aimed = aimed.withColumns({"upto": upto, "all": F.sum("target").over(one)})
    point = lambda x: F.when(F.col("all") > 0, F.floor(x / F.col("all") * _UNIT)).otherwise(F.lit(0)).cast("long")
    return aimed.select("source", "docs", "source_size", "weight", "target", F.round("target").cast("long").alias("aim"), "place", point(F.col("upto") - F.col("target")).alias("low"), point(F.col("upto")).alias("high"))


def schedule(aims: DataFrame, slots: int, small: bool) -> DataFrame:
    """(slot, place, rank): the source of each slot by its place, and the slot's rank among the source's, from 0."""
    spark = aims.sparkSession
    cells = aims.where("high > low").select("place", "low", "high", F.explode(F.expr(f"sequence(low div {_CELL}, (high - 1) div {_CELL})")).alias("cell"))
    points = spark.range(slots).withColumn("u", F.expr(f"pmod(pmod(id, {_UNIT}L) * {_GOLDEN}L, {_UNIT}L)")).withColumn("cell", F.expr(f"u div {_CELL}"))
    dealt = points.join(F.broadcast(cells) if small else cells, "cell").where("u >= low and u < high").select(F.col("id").alias("slot"), "place")
    size = max(CHUNK_SLOTS, int(slots**0.5))
    dealt = dealt.withColumn("chunk", F.expr(f"slot div {size}"))
    counts = dealt.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("place", "chunk", ahead.alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot"))
    return dealt.withColumn("inside", inside).join(counts, ["place", "chunk"]).select("slot", "place", (F.col("ahead") + F.col("inside") - 1).alias("rank"))


def mix_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, source, text) -> the placed documents and the mix.

    Placed: doc_id, content, source, place, bucket, pos (these three name a row), size, source_size, target. The mix: slot,
    place, bucket, pos, pass, first, last: the words [first, last) of that pass over the document, in slot order.
    """
    # rows without a doc_id are dealt by their texts, so that they do not gather in one bucket
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))), 1, 15), 16, 10).cast("long")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest.alias("digest"), F.xxhash64("text").alias("content"), words_of("text").alias("size")))
    sizes = written(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")))
    small = sizes.count() <= BROADCAST_SOURCES
    aims = written(targets(sizes))
    total = aims.agg(F.sum("source_size")).first()[0] or 0
    slots = max(1, -(-total // SLOT_WORDS))
    order = written(schedule(aims, slots, small))
    ranks = order.groupBy("place").agg(F.count("*").alias("slots"))
    aims = written(aims.join(ranks, "place", "left").withColumn("slots", F.coalesce("slots", F.lit(0).cast("long"))))
    # a source too small for a slot of its own gets one at the end
    order = order.unionByName(aims.where("slots = 0 and aim > 0").select((F.lit(slots) + F.col("place")).cast("long").alias("slot"), "place", F.lit(0).cast("long").alias("rank")))
    block = F.expr("case when aim > 0 then (aim + greatest(slots, 1) - 1) div greatest(slots, 1) else 1 end")
    about = aims.select(F.col("source").alias("of"), "place", "docs", "source_size", "target", "aim", block.alias("block"))
    about = F.broadcast(about) if small else about

    buckets = F.expr(f"1 + docs div greatest({BUCKET_ROWS}, cast(sqrt(docs) as long))")
    laid = sized.join(about, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.pmod(F.col("digest"), buckets))
    within = Window.partitionBy("place", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_first(), "size", "content")
    laid = laid.withColumns({"pos": F.row_number().over(within), "upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    laid = written(laid.select("doc_id", "content", "source", "place", "bucket", "pos", "upto", "size", "source_size", "target", "aim", "block"))
    sums = laid.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("place", "bucket", ahead.alias("ahead"))
    put = laid.where("size > 0 and aim > 0").join(starts, ["place", "bucket"])
    put = put.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))).withColumn("a", F.expr("ahead + upto - size + pass * source_size")).withColumn("b", F.expr("least(a + size, aim)")).where("a < b")
    put = put.withColumn("rank", F.explode(F.expr("sequence(a div block, (b - 1) div block)")))
    put = put.select("place", "bucket", "pos", "pass", "rank", F.expr("greatest(a, rank * block) - a").alias("first"), F.expr("least(b, (rank + 1) * block) - a").alias("last"))
    return laid.select("doc_id", "content", "source", "place", "bucket", "pos", "size", "source_size", "target"), put.join(order, ["place", "rank"]).drop("rank")


def taken(placed: DataFrame, mix: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    none = placed.select("place", "bucket", "pos", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("words"))
    some = mix.select("place", "bucket", "pos", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("size", "long"), ("source_size", "long"), ("target", "double"))], (F.col("last") - F.col("first")).alias("words"))
    return none.unionByName(some).groupBy("place", "bucket", "pos").agg(*[F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("words").alias("taken")).drop("place", "bucket", "pos")


def _row_hash(schema: StructType) -> Column:
    """A hash of all fields of ``row``; types that have no order or hash, as maps, count by their JSON."""
    plain = lambda kind: not any(x in kind.simpleString() for x in ("map<", "variant"))
    fields = [F.col(f"row.`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"row.`{f.name}`").alias("x"))) for f in schema.fields]
    return F.xxhash64(*fields)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each pass over a document, whole or cut at the end of
    its source's target. n_chars follows the text."""
    placed, mix = mix_sources(docs)
    # the pieces of a pass are neighbours: together they are its first words
    passes = mix.groupBy("place", "bucket", "pos", "pass").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
    passes = passes.groupBy("place", "bucket", "pos").agg(F.collect_list("words").alias("takes"))
    # rows with equal doc_id, text and source are told apart by their number, in the order of their other columns
    copy = F.row_number().over(Window.partitionBy("doc_id", "content", "source").orderBy("bucket", "pos"))
    takes = placed.withColumn("copy", copy).join(passes, ["place", "bucket", "pos"]).select(F.col("doc_id").alias("id"), "content", F.col("source").alias("from"), "copy", "size", "takes")
    read = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"), F.col("source").alias("of"))
    read = read.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "hash", "of").orderBy(_row_hash(docs.schema))))
    joined = read.join(takes, (F.col("hash") == F.col("content")) & F.col("doc").eqNullSafe(F.col("id")) & F.col("of").eqNullSafe(F.col("from")) & (F.col("nth") == F.col("copy")))
    pieces = joined.withColumn("take", F.explode("takes"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")), " ")
    pieces = pieces.withColumn("row", F.col("row").withField("text", F.when(F.col("take") >= F.col("size"), F.col("row.text")).otherwise(cut)))
    if "n_chars" in docs.columns:
        pieces = pieces.withColumn("row", F.col("row").withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType)))
    return pieces.select("row.*")
