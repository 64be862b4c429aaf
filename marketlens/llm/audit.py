"""Audit of how filters act together, over every order, by packed bitmaps.

Each document's failures, labels and part become bits. A task packs the rows of a batch into NumPy bitsets, one for each
filter and label, with the rows of a part side by side from a word's start on. For each set of filters that may have run
before and each filter that comes next, AND-NOT gives what that filter removes, and a popcount by part counts it. Tasks
emit their sums, 80 rows a part, which add up to the table's; every order of the filters is then read off these sums.

Filters: A under 50 words; B fewer than 65 distinct words in 100; C over 5 capitals A-Z in 100 code points; D holds one of
``#$%&*|``; E is identical to the text of a lesser doc_id anywhere (texts are told apart by 128 bits of hash).

A null text is empty and a null source the part "". A null doc_id is no lesser id, has none, and carries no label. Rows of
equal doc_id are documents of their own, and do not make each other fail E; a doc_id with several labels has a label if
any of them says so. Texts of any length are read whole. An empty table gives no rows, and a table without labels counts
none lost. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import written
from marketlens.llm.words import slices

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Parts whose sums a task holds before it emits them.
HELD_PARTS = 4096
#: Which filters may have run, as a bit mask, and which comes next.
STEPS = [(before, k) for before in range(1 << len(FILTERS)) for k in range(len(FILTERS)) if not before >> k & 1]
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1


def own_failures(text: str | None) -> int:
    """The filters A to D that a text fails, as a bit mask."""
    data = (text or "").encode()
    words = data.split()  # of bytes: at 0x20 and 0x09-0x0D alone
    a = len(words) < MIN_WORDS
    b = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    c = 100 * (len(data) - len(data.translate(None, CAPITALS))) > MAX_CAPITAL_PERCENT * len(text or "")
    d = len(data.translate(None, MARKS)) < len(data)
    return a | b << 1 | c << 2 | d << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            flags = pa.array([own_failures(t.as_py()) for t in piece.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("doc_id", "part", "h1", "h2")] + [flags], ["doc_id", "part", "h1", "h2", "flags"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags): a row for each document; bits 0 to 4 are the filters that it fails, 5 quality = 1, 6 toxic = 1."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), "text")
    judged = written(read.mapInArrow(_judged, "doc_id long, part string, h1 long, h2 long, flags int"))
    first = judged.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr(f"if(quality = 1, {1 << GOOD}, 0)")).alias("good"), F.max(F.expr(f"if(toxic = 1, {1 << TOXIC}, 0)")).alias("toxic"))
    both = judged.join(told, "doc_id", "left").join(first, ["h1", "h2"], "left")
    return both.select("part", F.expr(f"flags + if(coalesce(doc_id > least, false), {1 << FILTERS.index('E')}, 0) + coalesce(good, 0) + coalesce(toxic, 0)").alias("flags"))


def counted(part: pa.Array, flags: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The parts of some rows, and for each of them and each step the COUNTS."""
    coded = pc.dictionary_encode(part)
    code = coded.indices.to_numpy()
    sizes = np.bincount(code, minlength=len(coded.dictionary))
    # a part's rows are side by side and begin at a new word of 64 bits
    words = -(-sizes // 64)
    starts = np.cumsum(words) - words
    order = np.argsort(code, kind="stable")
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 64 * np.repeat(starts, sizes)

    def packed(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros(64 * int(words.sum()), bool)
        wide[place] = bits[order]
        return np.packbits(wide, bitorder="little").view(np.uint64)

    def count(bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits), starts, dtype=np.int64)

    fails = [packed(flags >> k & 1 == 1) for k in range(len(FILTERS))]
    good, toxic = packed(flags >> GOOD & 1 == 1), packed(flags >> TOXIC & 1 == 1)
    failing = [count(f) for f in fails]
    left = [packed(np.ones(len(code), bool))]
    for before in range(1, 1 << len(FILTERS)):
        k = before.bit_length() - 1
        left.append(left[before ^ 1 << k] & ~fails[k])
    there = [count(x) for x in left]
    out = np.zeros((len(sizes), len(STEPS), len(COUNTS)), np.int64)
    for i, (before, k) in enumerate(STEPS):
        gone = left[before] & fails[k]
        n = count(gone)
        out[:, i] = np.stack([there[before] - n, n, failing[k] - n, count(gone & good), count(gone & toxic)], 1)
    return coded.dictionary.to_pylist(), out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    before, step = (np.array(x, np.int32) for x in zip(*STEPS, strict=True))

    def rows() -> pa.RecordBatch:
        parts = pa.array([p for p in held for _ in STEPS], pa.string())
        sums = np.concatenate(list(held.values())).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([parts, pa.array(np.tile(before, len(held))), pa.array(np.tile(step, len(held))), *(pa.array(sums[:, i]) for i in range(len(COUNTS)))], ["part", "before", "filter", *COUNTS])

    for batch in batches:
        if not batch.num_rows:
            continue
        for name, sums in zip(*counted(batch.column("part"), batch.column("flags").to_numpy()), strict=True):
            held[name] = held[name] + sums if name in held else sums
        if len(held) > HELD_PARTS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source), labels (doc_id, quality, toxic) -> a row for each part, filter_order and step."""
    spark = docs.sparkSession
    counts = ", ".join(f"{c} long" for c in COUNTS)
    sums = flagged(docs, labels).mapInArrow(_summed, f"part string, before int, filter int, {counts}")
    sums = written(sums.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    all_, n = (1 << len(FILTERS)) - 1, len(FILTERS)
    orders = F.expr("case bit_count(before) " + " ".join(f"when {k} then {factorial(k) * factorial(n - 1 - k)}" for k in range(n)) + " end")
    of_filter = sums.groupBy("part", "filter").agg(F.sum(orders * F.col("removed")).alias("shapley"), F.sum(F.expr(f"if(before + shiftleft(1, filter) = {all_}, removed, 0)")).alias("unique_fails"))
    # 600 rows, whatever the table
    rows = [("".join(p), i + 1, sum(1 << FILTERS.index(x) for x in p[:i]), FILTERS.index(p[i])) for p in permutations(FILTERS) for i in range(n)]
    steps = spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")
    found = sums.join(of_filter, ["part", "filter"]).join(F.broadcast(steps), ["before", "filter"])
    return found.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


AUDIT_SQL = r"""
with letters(filter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.filter || b.filter || c.filter || d.filter || e.filter as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps as (
  select filter_order, cast(i as integer) as step, l.bit,
    coalesce((select sum(p.bit) from letters p where instr(filter_order, p.filter) < i), 0) as before
  from orders, range(1, 6) r(i), letters l where l.filter = filter_order[i]
),
texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
),
firsts as (select text, min(doc_id) as least from texts group by text),
told as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    if(len(words) < 50, 1, 0) + if(100 * len(list_distinct(words)) < 65 * len(words), 2, 0)
    + if(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 4, 0)
    + if(regexp_matches(text, '[#$%&*|]'), 8, 0) + if(coalesce(doc_id > least, false), 16, 0) as fails
  from texts join firsts using (text) left join told using (doc_id)
),
masks as (select part, fails, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from failed group by part, fails),
counted as (
  select part, filter_order, step, bit,
    sum(n) filter (fails & (before | bit) = 0) as kept,
    sum(n) filter (fails & before = 0 and fails & bit > 0) as removed,
    sum(n) filter (fails & before > 0 and fails & bit > 0) as redundant,
    sum(n) filter (fails = bit) as unique_fails,
    sum(n_good) filter (fails & before = 0 and fails & bit > 0) as good_lost,
    sum(n_toxic) filter (fails & before = 0 and fails & bit > 0) as toxic_lost
  from masks, steps group by all
)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, bit), 0) as bigint) as shapley
from counted
"""
