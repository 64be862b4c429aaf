"""Near-duplicate documents by an inverted join over MinHash coordinates.

Every document is a set of 5-word shingles, with a signature of ``COORDINATES`` minima. Documents are posted under
(coordinate, value) for the first ``PREFIX`` coordinates; the other lists are skipped. The prefix loses nothing: a pair
that agrees in ``MATCHES`` coordinates differs in ``COORDINATES - MATCHES`` at most, so it agrees in one of the first
``COORDINATES - MATCHES + 1``. A pair that met in a list has its collisions counted over both whole signatures, and stays
at ``MATCHES``, which a pair with a Jaccard similarity of 0.85 misses with a chance of about 5e-7; above 0.85 that
shrinks fast. Pairs that stay are confirmed on their full shingle sets.

Groups of copies do not make all pairs:

* documents with equal sets are one class, and only classes are posted;
* each list is first compared with one hub, its most frequent class; what links to it becomes one component;
* then only members of different components of a list are compared: directly in lists of up to ``SMALL_LIST``. Longer
  lists are compared in blocks. Signatures alone tell which rows of two blocks may link components that are apart and
  meet in no earlier list, so documents that agree in many coordinates are dealt with their texts in few of their lists;
  tasks then hold those texts, confirm pairs, and emit only links that join two components. No pair is left out.

Nulls and empty texts: no words, hence an empty set, linked with nothing; a null doc_id takes no part and has a null
component. Every row is a document of its own, also where rows repeat a doc_id, with the links of its own text; equal
ids tie and have equal components if their texts are linked. Texts of any length are read whole. An empty table gives
an empty result. Columns other than doc_id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.bitmaps import bitmaps, likely
from marketlens.llm.components import components
from marketlens.llm.store import written
from marketlens.llm.words import Words, mix, slices, windows

WIDTH = 5
PERCENT = 85
COORDINATES = 64
MATCHES = 38
PREFIX = COORDINATES - MATCHES + 1
SMALL_LIST = 40
#: Rows of a block of a long list without texts, and pairs of them that are compared at once.
SIGN_BLOCK = 1 << 14
PAIRS = 1 << 22
#: Rows and bytes of text of a block of a long list.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Bytes of text of one hub's members that go to one task together.
SALT_BYTES = 1 << 19

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and where each text's begin (with one more)."""
    words = Words.of(texts)
    hashes = words.hashes(lower=True)
    runs, at = windows(hashes, words.first, WIDTH)
    owner = words.owner[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < WIDTH))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(mix(hashes[words.first[i] : words.first[i + 1]] + np.arange(1, words.counts[i] + 1, dtype=np.uint64))) for i in short], np.uint64)
        runs, owner = np.concatenate([runs, mix(whole)]), np.concatenate([owner, short])
    order = np.argsort(runs)
    order = order[np.argsort(owner[order], kind="stable")]
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    return runs, np.searchsorted(owner, np.arange(len(texts) + 1))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            runs, first = shingle_sets(piece.column("text"))
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            sign = np.zeros((len(sizes), COORDINATES), np.uint32)
            total = np.zeros((len(sizes), 2), np.uint64)
            if len(some):
                starts = first[:-1][some]
                for k in range(COORDINATES):
                    sign[some, k] = np.minimum.reduceat((runs ^ _XOR[k]) * _ODD[k], starts) >> np.uint64(32)
                total[some, 0] = np.add.reduceat(mix(runs + _XOR[0]), starts)
                total[some, 1] = np.add.reduceat(mix(runs ^ _XOR[1]), starts)
            flat = pa.array(sign.reshape(-1).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("ref"), piece.column("bytes"), pa.array(sizes, pa.int64()), pa.array(total[:, 0].view(np.int64)), pa.array(total[:, 1].view(np.int64)), lists], ["doc_id", "ref", "bytes", "n_shingles", "high", "low", "sign"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, bytes, n_shingles, high, low, sign): the text's hash and bytes, and size, fingerprint and MinHash signature of its set."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ref"), F.octet_length("text").cast("long").alias("bytes"), "text")
    return read.mapInArrow(_signed, "doc_id long, ref long, bytes long, n_shingles long, high long, low long, sign array<int>")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that each hub's own row precedes its members; yields the pairs at or over the similarity."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for piece in slices(batch, "text"):
            runs, first = shingle_sets(piece.column("text"))
            a, b = [], []
            for i, (h, node, lead) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("hub", "node", "lead")), strict=True)):
                mine = runs[first[i] : first[i + 1]]
                if lead:
                    hub, own = h, mine
                elif h == hub and len(own) and len(mine):
                    at = np.searchsorted(own, mine)
                    both = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                    if 100 * both >= PERCENT * (len(own) + len(mine) - both):
                        a.append(h)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. texts: (node, text, bytes), one row for each node."""
    members = pairs.select(F.col("a").alias("hub"), F.col("b").alias("node")).join(texts, "node")
    members = written(members.select("hub", "node", "text", "bytes"))
    salts = members.groupBy("hub").agg(F.expr(f"1 + sum(bytes) div {SALT_BYTES}").alias("salts"))
    salts = written(salts)
    leads = salts.join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", F.col("hub").alias("node"), "text", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"), F.lit(True).alias("lead"))
    split = salts.where("salts > 1")
    rest = members.join(split, "hub", "left").select("hub", "node", "text", F.expr("coalesce(cast(pmod(xxhash64(node), salts) as int), 0)").alias("salt"), F.lit(False).alias("lead"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leads.unionByName(rest).repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.desc("lead"))
    return written(dealt.select("hub", "node", "lead", "text").mapInArrow(_compared, "a long, b long"))


def _agree(x: str, y: str):
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> if(p = q, 1, 0)), 0, (s, v) -> s + v)") >= MATCHES


_SIZES = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose sizes and signatures allow the similarity.

    Coordinates are compared by one byte each, a quarter of what would be shuffled: equal values have equal bytes, so no
    pair is lost, and what a byte lets through is told by the full sets.
    """
    code = F.transform("sign", lambda x: (x.bitwiseAND(255) - 128).cast("tinyint"))
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), code.alias(f"sign_{x}"))
    return pairs.where("a <> b").distinct().join(side("a"), "a").join(side("b"), "b").where(_SIZES).where(_agree("sign_a", "sign_b")).select("a", "b")


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (list, i, j), which are adjacent, as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("list", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if held and tuple(keys[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of both blocks' rows; a block with itself has one side, whose i and j are equal."""
    left = rows.column("left").to_numpy()
    one = np.flatnonzero(left)
    return one, one if rows.column("i")[0] == rows.column("j")[0] else np.flatnonzero(~left)


def _meeting(rows: pa.Table, size: np.ndarray, sign: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of both rows of each pair that may link components that are apart, and in how many coordinates they agree.

    A pair is left to the first list in which it meets.
    """
    comp = rows.column("component").to_numpy()
    k = int(rows.column("list")[0].as_py()) >> 32
    one, two = _sides(rows)
    step = max(1, PAIRS // max(1, len(two)))
    for s in range(0, len(one), step):
        # of a block with itself each pair once
        x, y = one[s : s + step], two[s:] if one is two else two
        a, b = size[x][:, None], size[y][None, :]
        open_ = (comp[x][:, None] != comp[y][None, :]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
        for c in range(k):
            open_ &= sign[x, c][:, None] != sign[y, c][None, :]
        i, j = np.nonzero(open_)
        for at in range(0, len(i), PAIRS // COORDINATES):
            p, q = x[i[at : at + PAIRS // COORDINATES]], y[j[at : at + PAIRS // COORDINATES]]
            same = (sign[p] == sign[q]).sum(1)
            near = same >= MATCHES
            yield p[near], q[near], same[near]


def _signs(rows: pa.Table) -> np.ndarray:
    return rows.column("sign").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows without texts: those of the pairs that _blocks() would confirm by their texts."""
    for rows in _adjacent(batches):
        kept = np.zeros(len(rows), bool)
        for p, q, _ in _meeting(rows, rows.column("size").to_numpy(), _signs(rows)):
            kept[p] = kept[q] = True
        if kept.any():
            yield from rows.drop_columns(["size", "i", "j", "left"]).take(pa.array(np.flatnonzero(kept))).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of a list are adjacent; yields confirmed pairs that join components that were apart."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        node, comp = (rows.column(c).to_numpy() for c in ("node", "component"))
        runs, first = shingle_sets(rows.column("text").combine_chunks())
        size = np.diff(first)
        met = [*_meeting(rows, size, _signs(rows))]
        i, j, same = (np.concatenate([np.zeros(0, np.int64), *[m[c] for m in met]]) for c in range(3))
        order = np.argsort(-same, kind="stable")
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        sets: dict[int, set[int]] = {}
        got = lambda x: sets.get(x) or sets.setdefault(x, set(runs[first[x] : first[x + 1]].tolist()))
        a, b = [], []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q:
                both = len(got(x) & got(y))
                if 100 * both >= PERCENT * (int(size[x]) + int(size[y]) - both):
                    parent[p] = q
                    a.append(int(node[x]))
                    b.append(int(node[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for rows in _adjacent(batches):
        yield found(rows)


def _dealt(rows: DataFrame, blocks: str, n: int, texts: DataFrame | None = None) -> DataFrame:
    """Rows of lists with i, j and left, once for each block of their list that they are compared with; rows of (list, i, j) are adjacent.

    blocks: an aggregate over a list, by how much it has more than one block.
    """
    of = written(rows.groupBy("list").agg(F.expr(f"1 + {blocks}").alias("of")))
    both = rows.join(of, "list").withColumn("own", F.expr("pmod(xxhash64(node), of)")).withColumn("with", F.explode(F.expr("sequence(0L, of - 1)")))
    key = [F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") <= F.col("with")).alias("left")]
    both = both.select(*rows.columns, *key)
    if texts is not None:
        both = both.join(texts, "node")
    return both.repartition(n, "list", "i", "j").sortWithinPartitions("list", "i", "j")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = written(signatures(docs))
    # a class of equal sets is named by the least hash of its texts, one of which stands for it
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("high", "low", "n_shingles")
    classes = written(classes.agg(F.min("ref").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.first("sign").alias("sign")))

    posted = classes.select("node", "copies", F.posexplode(F.slice("sign", 1, PREFIX)).alias("k", "value")).select("node", "copies", F.expr("shiftleft(cast(k as long), 32) | (value & 4294967295L)").alias("list"))
    lists = written(posted.groupBy("list").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("copies"), F.xxhash64("node"), F.col("node").alias("hub")))["hub"].alias("hub")).where("n > 1"))
    members = written(posted.drop("copies").join(lists, "list"))
    first = written(_candidates(members.select(F.col("hub").alias("a"), F.col("node").alias("b")), classes))

    texts = docs.where("text is not null").select(F.xxhash64("text").alias("node"), "text")
    needed = written(first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct())
    held = written(_texts(texts, needed))
    links = confirmed(first, held)
    parts = written(components(links))

    placed = members.join(parts, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
    mixed = written(placed.groupBy("list").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("list", "n"))
    open_ = written(placed.join(mixed, "list"))
    few = open_.where(F.col("n") <= SMALL_LIST)
    other = few.select("list", F.col("node").alias("b"), F.col("component").alias("other"))
    near = few.withColumnRenamed("node", "a").join(other, "list").where("a < b and component <> other").select("a", "b")
    near = _candidates(near, classes)
    long = open_.where(F.col("n") > SMALL_LIST)
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = written(near.join(tested, ["a", "b"], "left_anti"))

    # signatures alone tell which rows of two blocks may have a link; only their texts are read and dealt
    rows = written(long.join(classes, "node").select("list", "node", "component", "bytes", "sign", F.col("n_shingles").alias("size")))
    apart = _dealt(rows, f"count(*) div {SIGN_BLOCK}", n).mapInArrow(_apart, "list long, node long, component long, bytes long, sign array<int>")
    apart = written(apart.dropDuplicates(["list", "node"]))

    ends = [near.select(F.col(c).alias("node")) for c in ("a", "b")]
    more = written(ends[0].unionByName(ends[1]).unionByName(apart.select("node")).distinct().join(needed, "node", "left_anti"))
    held = held.unionByName(written(_texts(texts, more)))
    links = links.unionByName(confirmed(near, held))
    held = likely(held.select("node", "text"), "node", bitmaps(apart.select("node"), "node"))
    dealt = _dealt(apart, f"greatest(count(*) div {BLOCK}, sum(bytes) div {BLOCK_BYTES})", n, held)
    links = links.unionByName(written(dealt.mapInArrow(_blocks, "a long, b long")))
    parts = written(components(links))

    placed = written(classes.join(parts, "node", "left").select("high", "low", "n_shingles", "least", F.coalesce("component", "node").alias("component")))
    least = placed.groupBy("component").agg(F.min("least").alias("found"))
    found = placed.drop("least").join(least, "component").select("high", "low", "n_shingles", "found")
    # empty sets and null ids have no class
    out = signed.select("doc_id", "n_shingles", "high", "low").join(written(found), ["high", "low", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _texts(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The nodes' texts with their bytes, each once."""
    return likely(texts, "node", bitmaps(needed, "node")).join(needed, "node").groupBy("node").agg(F.min("text").alias("text")).withColumn("bytes", F.expr("octet_length(text)"))
