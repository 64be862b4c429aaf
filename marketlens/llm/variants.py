"""Grouping of spelling variants by rolling-hash deletions.

Words are counted over all texts, and two are near if one code point is inserted, deleted or replaced between them. A
word is posted under the hash of the word itself, of each text with one code point deleted, and of each such text with its
place. Prefix and suffix hashes of the words, polynomials over 64-bit integers, give all of these at once in NumPy:
the hash of a text without code point i is the prefix before it plus the suffix behind it, moved up by one.

Keys are dealt by their leading bits and sorted within each partition. Of equal keys the texts themselves are compared,
so hashes that collide do no harm. A word meets those that delete to it (one place for a run of equal letters, which all give the same text),
and words of equal length that delete to the same text at the same place, at most as many as there are letters.
Neither needs pairs: a group gives each member the number of the others and the best of them.

Each task holds the counts of ``HELD_WORDS`` words before it emits them. A null text has no words; a null doc_id is spelled
as an empty string. Repeated rows count again. Ties between equally frequent words go to the least in code-point order.
Texts of any length are read whole. An empty table gives an empty result. Other columns are ignored, so their names
cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import dropped, written
from marketlens.llm.words import SLICE_BYTES, mix, slices

RUN = re.compile("[a-zÀ-ÿ]+")
NOISE = 97
MIN_CHARS = 5
MIN_COUNT = 3
FORM_TIMES = 2
HELD_WORDS = 1 << 17
RADIX_BITS = 16
_ITSELF, _DELETED, _REPLACED = 0, 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def spelled(doc_id: int | None, text: str) -> Counter:
    """The words of a text whose A-Z are lower-cased, with the noise that the document's id puts in."""
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        h = crc32(run.encode(), seed)
        if h % NOISE == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= MIN_CHARS:
            found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        for piece in slices(batch, "text"):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), pc.ascii_lower(piece.column("text")).to_pylist(), strict=True):
                held.update(spelled(doc_id, text or ""))
            if len(held) > HELD_WORDS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least MIN_CHARS code points that occur MIN_COUNT times or more."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return read.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {MIN_COUNT}")


def keys(words: pa.Array) -> dict[str, np.ndarray]:
    """Of each word and key: word (its number), key, kind, at (the place of the deletion, from 0)."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(code)) - first[word]
    power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(int(size.max(initial=1)), _BASE))])
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code + _PLACE) * power[at], out=total[1:])
    whole = total[first + size] - total[first]
    before = total[:-1] - total[first][word]
    behind = (total[first + size][word] - total[1:]) * _BACK
    short = before + behind
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (word[1:] != word[:-1])
    place = at.astype(np.uint64) + np.uint64(1)
    parts = [
        (np.arange(len(size)), mix(whole), _ITSELF, np.zeros(len(size), np.int64)),
        (word[new], mix(short[new]), _DELETED, at[new]),
        (word, mix(short ^ mix(place * _PLACE)), _REPLACED, at),
    ]
    return {
        "word": np.concatenate([p[0] for p in parts]),
        "key": np.concatenate([p[1] for p in parts]),
        "kind": np.concatenate([np.full(len(p[0]), p[2], np.int8) for p in parts]),
        "at": np.concatenate([p[3] for p in parts]).astype(np.int32),
    }


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "word", SLICE_BYTES >> 4):
            got = keys(piece.column("word"))
            who = pa.array(got["word"])
            yield pa.RecordBatch.from_arrays([piece.column("word").take(who), piece.column("n").take(who), pa.array(got["key"].view(np.int64)), pa.array(got["kind"]), pa.array(got["at"])], ["word", "n", "key", "kind", "at"])


def _met(rows: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """rows (word, n, kind, at) of one key -> (word, near, n, word): how many others each is near, and the best of them."""
    alike: dict[tuple[int, str], list[tuple[int, str]]] = {}
    target: dict[str, int] = {}
    for word, n, kind, at in rows:
        if kind == _ITSELF:
            target[word] = n
        else:
            alike.setdefault((at if kind == _REPLACED else -1, word[:at] + word[at + 1 :]), []).append((-n, word))
    for (at, text), some in alike.items():
        if at >= 0:
            if len(some) > 1:
                one, two = sorted(some)[:2]
                for x in some:
                    best = two if x == one else one
                    yield x[1], len(some) - 1, -best[0], best[1]
        elif text in target:
            best = min(some)
            yield text, len(some), -best[0], best[1]
            for x in some:
                yield x[1], 1, target[text], text


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys; a key's rows may go on in the next batch."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("key").to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        cuts = np.concatenate([[0], cuts, [len(key)]])
        several = np.flatnonzero(np.diff(cuts) > 1)
        out: list[tuple[str, int, int, str]] = []
        if len(several):
            inside = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in several])
            some = rows.take(pa.array(inside))
            flat = list(zip(*(some.column(c).to_pylist() for c in ("word", "n", "kind", "at")), strict=True))
            ends = np.cumsum(np.diff(cuts)[several]).tolist()
            for a, b in zip([0, *ends], ends, strict=False):
                out += _met(flat[a:b])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "near", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
            yield found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield found(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n) -> (word, n_near, best_n, best): for each word that has near ones, their number and the most frequent."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = words.select("word", "n").mapInArrow(_posted, "word string, n long, key long, kind byte, at int")
    dealt = posted.repartition(n, F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    met = dealt.mapInArrow(_grouped, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def _rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> (word, root): the end of each word's chain of forms.

    Each round makes the way twice as long; n doubles at least from form to form, so six rounds are the most.
    """
    far = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(far.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        dropped(far)
        far = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return far


def variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (word, form, root, n, n_near, form_n) for each word of the vocabulary."""
    words = written(vocabulary(docs))
    near = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= FORM_TIMES * F.col("n")
    found = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    roots = _rooted(found.where("form is not null"))
    dropped(words)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
