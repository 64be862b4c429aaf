"""Quality rules whose cutoffs follow the data.

Each document gets a few integer rates. Their distribution per language and source is held in a mergeable quantile
sketch: counts in bins of bounded relative width, so sketches of partitions, sources and languages merge by addition
and the quantiles do not depend on how rows were dealt. A document is rejected if a fixed base rule fails or if a rate
lies over its group's 90 % quantile by more than ``REACH`` times the distance from the median to that quantile (for
word length also under the 10 % quantile likewise); the distance counts as one unit at least. A group's quantiles are
drawn towards those of its language, and these towards the whole table's, with the weight of ``PRIOR`` documents, so
small groups follow the merged sketches without a switch.

A single event is no rate: before the division the last figure of ``RATES`` is taken off the count, so that one repeated
line of a short text, or one repeated run of three words, never rejects it.

Nulls: a null text has no words (rejected); null languages and sources are groups of their own. An empty table gives
an empty result. Repeated rows are judged each by itself, and ties fall in one bin. Texts of any length are read whole.
Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marketlens.llm.store import written
from marketlens.llm.words import Words, slices, windows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PRIOR = 30
#: How many distances from the median to the outer quantile a rate may lie beyond that quantile.
REACH = 6
OUTER = 90
#: Of each rate: the count, what it is counted in, per how many of these, and how much of the count goes first.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, 6),
    "upper_rate": ("n_upper", "word_chars", 1000, 0),
    "mark_rate": ("n_marks", "word_chars", 1000, 6),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, 1),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, 6),
    "word_length": ("word_chars", "n_words", 100, 0),
}
#: Rates that can also be too low.
TWO_SIDED = ("word_length",)
#: Values under 2**BIN_BITS have a bin of their own; above, a bin is 2**-(BIN_BITS - 1) of its value wide at most.
BIN_BITS = 7
#: Thresholds of so many groups are broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 20_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = np.arange(256) == ord("!")


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the rules use, one entry for each text."""
    words = Words.of(texts)
    n = len(texts)
    out = {"n_words": words.counts, "word_chars": words.word_chars(), "n_symbols": words.sums(_SYMBOL)}
    # lines with a word: those in which a word starts
    breaks = np.flatnonzero(words.data == 10)
    starts = np.unique(np.concatenate([words.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(words.data)]
    ends = np.minimum(np.append(starts[1:], len(words.data)), np.append(breaks, len(words.data))[np.searchsorted(breaks, starts)])
    full = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(words.offsets, starts, "right") - 1
    out["n_lines"] = np.bincount(owner, minlength=n)
    order = np.lexsort((hashes := words.spans(starts, ends), owner))
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][again], minlength=n)
    runs, at = windows(words.hashes(), words.first, 3)
    owner = words.owner
    runs = runs ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(runs)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = runs[order][1:] == runs[order][:-1]
    twice = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(owner), bool)
    for j in range(3):
        covered[twice + j] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    out["n_upper"], out["n_marks"] = words.sums(_UPPER), words.sums(_MARK)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "_text"):
            got = text_counts(piece.column("_text"))
            rest = [c for c in piece.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), *(pa.array(got[c], pa.int64()) for c in _COUNTS)], [*rest, *_COUNTS])


def _rates(frame: DataFrame) -> DataFrame:
    per = lambda a, b, k, off: F.when(F.col(b) > 0, F.expr(f"({k} * greatest({a} - {off}, 0L)) div {b}")).otherwise(F.lit(0).cast("long"))
    return frame.withColumns({name: per(*made) for name, made in RATES.items()})


def _bin(value: str):
    """Lower end of the value's bin, by integer arithmetic alone."""
    shift = f"greatest(0, length(bin({value})) - {BIN_BITS})"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(scored: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the quantile sketch of each group. Sketches merge by adding n."""
    return (
        scored.select("_lang", "_source", F.explode(F.create_map(*[x for c in RATES for x in (F.lit(c), F.col(c))])).alias("rate", "value"))
        .groupBy("_lang", "_source", "rate", _bin("value").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The outer quantiles and the median per key and rate, the first bin that reaches the share; and the size."""
    by = Window.partitionBy(*keys, "rate")
    ranked = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    ranked = ranked.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    at = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("all") * share, F.col("bin")))
    cuts = F.struct(at(100 - OUTER).alias("low"), at(50).alias("mid"), at(OUTER).alias("high"), F.max("all").alias("size"))
    return ranked.groupBy(*keys, "rate").agg(cuts.alias(name))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits): for each rate the least and the largest value that passes."""
    own = _quantiles(sketch, ["_lang", "_source"], "own")
    lang = _quantiles(sketch, ["_lang"], "lang").withColumnsRenamed({"_lang": "l_", "rate": "lr"})
    whole = _quantiles(sketch.withColumn("one", F.lit(1)), ["one"], "whole").withColumnRenamed("rate", "ar").drop("one")
    both = own.join(lang, F.col("_lang").eqNullSafe(F.col("l_")) & (F.col("rate") == F.col("lr"))).join(whole, F.col("rate") == F.col("ar"))

    def drawn(cut: str, of: str, to: Column) -> Column:
        size = F.col(f"{of}.size")
        return (F.col(f"{of}.{cut}") * size + PRIOR * to) / (size + PRIOR)

    at = {cut: drawn(cut, "own", drawn(cut, "lang", F.col(f"whole.{cut}"))) for cut in ("low", "mid", "high")}
    most = F.floor(at["high"] + REACH * F.greatest(at["high"] - at["mid"], F.lit(1.0)))
    least = F.ceil(at["low"] - REACH * F.greatest(at["mid"] - at["low"], F.lit(1.0)))
    both = both.select("_lang", "_source", "rate", most.alias("most"), least.alias("least"))
    return both.groupBy("_lang", "_source").agg(
        *[F.max(F.when(F.col("rate") == c, F.col("most"))).alias(f"{c}_most") for c in RATES],
        *[F.max(F.when(F.col("rate") == c, F.col("least"))).alias(f"{c}_least") for c in TWO_SIDED],
    )


def quality_rules(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Judges each document.

    Returns ``row`` (a struct of the columns named in ``carry``; all of them by default), the counts, the rates,
    ``base_failed`` and ``kept``.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct("*")
    read = docs.select(carried.alias("row"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    counts = [StructField(c, LongType()) for c in _COUNTS]
    scored = _rates(read.mapInArrow(_counted, StructType([*read.schema.fields[:3], *counts])))
    if carry:
        # small rows, so that texts are read once
        slim = scored = written(scored)
    else:
        slim = docs.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("text").alias("_text"))
        slim = _rates(slim.mapInArrow(_counted, StructType([*slim.schema.fields[:2], *counts])))
    # the sketch is small: written once, so that the limits are not worked out anew for each use
    limits = written(thresholds(written(sketches(slim))))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    limits = limits.withColumnsRenamed({"_lang": "g_lang", "_source": "g_source"})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inside = F.lit(True)
    for c in RATES:
        inside &= F.col(c) <= F.col(f"{c}_most")
    for c in TWO_SIDED:
        inside &= F.col(c) >= F.col(f"{c}_least")
    return (
        scored.join(limits, F.col("_lang").eqNullSafe(F.col("g_lang")) & F.col("_source").eqNullSafe(F.col("g_source")), "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .select("row", *_COUNTS, *RATES, "base_failed", "kept")
    )
