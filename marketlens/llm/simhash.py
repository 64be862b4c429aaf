"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of its 3-word
shingles, repeats included. Fingerprints link at ``RADIUS`` = 2 differing bits or fewer.

Search. A fingerprint is cut into two segments of 32 bits, each with a table of its own. Of two fingerprints that link,
either the low segments are equal, or the high ones differ in one bit at most. So the low table is probed with the
segment itself, and the high one with the Hamming ball of radius 1; as one side of a pair has the differing bit clear,
only clear bits are flipped, some 16 of 32. What a probe finds is verified by the complete distance.

A crowd, an entry of more than ``CROWD`` fingerprints, would give a probe all of them. It gets a second level that is exact as
well: its members are posted under the radius-1 ball of their other segment, and a probe that has used one bit under
its other segment as it is. All that meet there are within the radius, 66 fingerprints at most, whatever the crowd's
size, and each hangs on the least of them.

Only distinct fingerprints are searched, so copies make no pairs. A null text has no words, like an empty one; texts
without words have the fingerprint zero and are linked like any other. Every row is a document of its own; equal ids tie
and have the least id of their own fingerprint's component. A null doc_id gets the least id of its component, or null
where no other is in it. Texts of any length are read whole. An empty table gives an empty result. Other columns are
ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marketlens.llm.components import components
from marketlens.llm.store import dropped, written
from marketlens.llm.words import Words, slices

WIDTH = 3
SEED = 42
RADIUS = 2
SEGMENT = 32
CROWD = 16
_CHUNK = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, text by text, and the text of each; a text of fewer words is one shingle."""
    words = Words.of(texts)
    length = words.end - words.start
    # the words of all texts, lower-cased and one space apart
    joined = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    at = np.repeat(np.arange(len(length)), length)
    at += np.arange(len(at))
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    joined[at] = _LOWER[words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]]
    start = np.cumsum(length + 1) - (length + 1)
    first, last = words.first[:-1], words.first[1:]
    size = np.where(words.counts > 0, np.maximum(words.counts - (WIDTH - 1), 1), 0)
    owner = np.repeat(np.arange(len(size)), size)
    word = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    end = np.minimum(word + WIDTH, last[owner]) - 1
    text = joined.tobytes()
    spans = map(slice, start[word].tolist(), (start[end] + length[end]).tolist())
    return np.fromiter(map(xxh64_intdigest, map(text.__getitem__, spans), repeat(SEED)), np.uint64, len(owner)), owner


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    hashes, owner = shingle_hashes(texts)
    ones = np.zeros((len(texts), 64), np.int64)
    for k in range(0, len(hashes), _CHUNK):
        own = owner[k : k + _CHUNK]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    set_ = 2 * ones > np.bincount(owner, minlength=len(texts))[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fingerprints(piece.column("text")).view(np.int64))], ["doc_id", "print"])


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_printed, "doc_id long, print long")


def _segment(k: int) -> Column:
    """Segment 0 holds the high bits, 1 the low ones."""
    return F.shiftrightunsigned("print", SEGMENT) if k == 0 else F.col("print").bitwiseAND((1 << SEGMENT) - 1)


def _ball(value: Column, clear_only: bool = False) -> Column:
    """The segment with one bit flipped, in an array; with ``clear_only``, bits that were clear."""
    bits = F.array(*[F.lit(1 << i) for i in range(SEGMENT)])
    flipped = F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0) if clear_only else bits, lambda b: value.bitwiseXOR(b))
    return flipped


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(prints: DataFrame) -> DataFrame:
    """prints: distinct fingerprints (print) -> (a, b): links that join all fingerprints within the radius."""
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), _segment(k).alias("value"), _segment(1 - k).alias("rest")) for k in (0, 1)])).alias("e")
    posted = prints.select("print", entry).select("print", "e.*")
    crowds = written(posted.groupBy("table", "value").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select("table", "value"))
    flipped = prints.select("print", F.lit(0).alias("table"), F.explode(_ball(_segment(0), clear_only=True)).alias("value"), _segment(1).alias("rest"))

    sparse = posted.join(crowds, ["table", "value"], "left_anti").select("table", "value", F.col("print").alias("other"))
    probes = posted.select("print", "table", "value").unionByName(flipped.select("print", "table", "value"))
    found = probes.join(sparse, ["table", "value"]).where((F.col("print") != F.col("other")) & _near("print", "other"))
    found = found.select(F.greatest("print", "other").alias("a"), F.least("print", "other").alias("b"))

    inner = posted.join(crowds, ["table", "value"]).select("print", "table", "value", F.explode(F.concat(F.array("rest"), _ball(F.col("rest")))).alias("rest"))
    outer = flipped.join(crowds, ["table", "value"]).select("print", "table", "value", "rest")
    met = inner.unionByName(outer).groupBy("table", "value", "rest").agg(F.collect_set("print").alias("all")).where("size(all) > 1")
    hung = met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where((F.col("a") != F.col("b")) & _near("a", "b"))
    return found.unionByName(hung).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per document: doc_id, fingerprint (16 hex digits), component_id."""
    signed = written(printed(docs))
    classes = written(signed.groupBy("print").agg(F.min("doc_id").alias("least")))
    parts = written(components(links(classes.select("print"))))
    placed = written(classes.join(parts.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = written(placed.join(least, "component").select("print", "component_id"))
    dropped(classes, parts, placed)
    return signed.join(found, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
