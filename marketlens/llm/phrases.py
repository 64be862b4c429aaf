"""Removal of passages that occur more than once, found by sharded Aho-Corasick automata.

A word goes if a window of ``WINDOW`` consecutive words that covers it starts anywhere else in the table too.

1. Anchors. Every window has an anchor, the least hash of the ``GRAM``-word runs inside it, so equal windows have equal
   anchors. Each text posts its anchors (about one for eleven words), and anchors that occur once are dropped.
2. Confirmation. Only windows with a recurring anchor are posted, by hash; those that occur twice recur. Each is
   assigned to the least text that holds it, where neighbouring windows join to passages.
3. Automata. An anchor belongs to the least text whose passages hold it, and a shard to many such texts; so each anchor
   lies in one shard, and a passage, cut where the shard of its anchors changes, mostly stays in one piece. A shard's
   automaton holds every ``CHUNK``-th run of CHUNK words of its pieces, so any window of a piece contains a whole
   pattern. Every text, cut in the same way, streams through the automata of its anchors in bounded pieces. Nothing is
   lost by the cut: a window can only recur where its anchor does, and each window with a recurring anchor goes whole
   to the one shard that holds all recurring windows of that anchor. The windows around a hit are confirmed against
   those of the shard's passages; all of these recur, so this marks exactly the words to remove.

Texts that are equal as a whole are posted once for all of them. Nulls and empty texts have no words and nothing is
removed; rows with a null or repeated doc_id each get their own result. Texts of any length are read whole. An empty
table gives an empty result. Columns other than doc_id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import dropped, written
from marketlens.llm.words import Words, long_windows, slices

WINDOW = 35
GRAM = 14
CHUNK = 18
_SPAN = WINDOW - GRAM + 1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of passages in a shard, and of texts that pass its automaton in one piece.
SHARD_BYTES = 1 << 20
PIECE_BYTES = 2 << 20


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i (shorter at the end)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


def _anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs' hashes by first word, the anchor of the window that starts at each word, and whether one does."""
    n = len(hashes)
    grams, at = long_windows(hashes, words.first, GRAM)
    gram = np.full(n, _TOP)
    gram[at] = grams
    least = _sliding(gram, _SPAN, np.minimum)
    room = np.repeat(words.first[1:], words.counts) - np.arange(n)
    return gram, least, room >= WINDOW


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words.of(piece.column("text"))
            gram, least, opens = _anchors(words, words.hashes())
            # a run is posted if it is the least of a window: the largest anchor of the windows around it is its own
            reach = _sliding(np.where(opens, least, np.uint64(0))[::-1], _SPAN, np.maximum)[::-1]
            picked = np.flatnonzero((reach == gram) & (gram != _TOP))
            first = np.searchsorted(picked, words.first).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(first), pa.array(gram[picked].view(np.int64)))
            shas = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() if t else _EMPTY for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "ref", "ref2")), pa.array(words.counts, pa.int64()), pa.array(shas), lists], ["doc_id", "ref", "ref2", "n_words", "sha", "anchors"])


_EMPTY = hashlib.sha256(b"").hexdigest()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the windows with a recurring anchor."""
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words.of(piece.column("text"))
            hashes = words.hashes()
            run, starts = _recurring(words, hashes, piece.column("hits"))
            owner = words.owner[starts]
            columns = [pa.array(run.view(np.int64)), *(pa.array(piece.column(c).to_numpy()[owner]) for c in ("ref", "n"))]
            yield pa.RecordBatch.from_arrays(columns, ["window", "ref", "n"])


def _recurring(words: Words, hashes: np.ndarray, hits: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the windows whose anchor is among their text's hits."""
    _, least, opens = _anchors(words, hashes)
    runs, at = long_windows(hashes, words.first, WINDOW)
    anchors, good = least[at], np.zeros(len(at), bool)
    first = np.searchsorted(at, words.first)
    for i, mine in enumerate(hits.to_pylist()):
        a, b = first[i], first[i + 1]
        if b > a and mine:
            good[a:b] = np.isin(anchors[a:b], np.array(mine, np.int64).view(np.uint64))
    return runs[good], at[good]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the windows assigned to them: one row for each run of such windows, with its anchors."""
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words.of(piece.column("text"))
            hashes = words.hashes()
            _, least, _ = _anchors(words, hashes)
            runs, at = long_windows(hashes, words.first, WINDOW)
            first = np.searchsorted(at, words.first)
            text, anchors, refs, starts = [], [], [], []
            for i, (ref, mine) in enumerate(zip(piece.column("ref").to_pylist(), piece.column("windows").to_pylist(), strict=True)):
                a, b = first[i], first[i + 1]
                mine = np.array(mine, np.int64).view(np.uint64)
                # the first place of each window in this text
                values, places = np.unique(runs[a:b], return_index=True)
                places = np.sort(places[np.isin(values, mine)])
                for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    if len(run):
                        text.append(words.text(i, at[a + run[0]] - words.first[i], at[a + run[-1]] - words.first[i] + WINDOW))
                        anchors.append(np.unique(least[at[a + run]]).view(np.int64))
                        refs.append(ref)
                        starts.append(int(at[a + run[0]] - words.first[i]))
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(starts, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(anchors, pa.list_(pa.int64()))], ["ref", "start", "text", "anchors"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with (anchor, shard) pairs: the runs of windows whose anchors are in one shard."""
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words.of(piece.column("text"))
            _, least, opens = _anchors(words, words.hashes())
            out: dict[str, list] = {c: [] for c in ("shard", "ref", "ref2", "start", "text")}
            pairs = piece.column("pairs")
            ends, flat = np.asarray(pairs.offsets) - pairs.offsets[0].as_py(), pairs.flatten()
            known, shards = (np.asarray(flat.field(c)) for c in ("anchor", "shard"))
            for i, (ref, ref2) in enumerate(zip(piece.column("ref").to_pylist(), piece.column("ref2").to_pylist(), strict=True)):
                first, mine = words.first[i], slice(ends[i], ends[i + 1])
                order = np.argsort(known[mine])
                sorted_, anchors = known[mine][order], least[first : words.first[i + 1]].view(np.int64)
                at = np.minimum(np.searchsorted(sorted_, anchors), len(sorted_) - 1)
                shard = np.where((sorted_[at] == anchors) & opens[first : words.first[i + 1]], shards[mine][order][at], -1)
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a and shard[a] >= 0:
                        row = (int(shard[a]), ref, ref2, a, words.text(i, a, b - 1 + WINDOW))
                        for column, value in zip(out.values(), row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), pa.array(out["ref"], pa.int64()), pa.array(out["ref2"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["text"], pa.binary()).cast(pa.string())], list(out))


class _Shard:
    """The automaton of a shard's passages, and the hashes of their windows."""

    def __init__(self, passages: list[str]) -> None:
        words = Words.of(pa.array(passages, pa.large_string()))
        hashes = words.hashes()
        self.known = np.unique(hashes)
        self.windows = np.unique(long_windows(hashes, words.first, WINDOW)[0])
        symbols = self._symbols(hashes)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            for p in range(a, b - CHUNK + 1, CHUNK):
                self.automaton.add_word(symbols[p : p + CHUNK])
        self.automaton.make_automaton()

    def _symbols(self, hashes: np.ndarray) -> str:
        """Each word as one character (hits are confirmed, so characters may be shared beyond a million words)."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        code = np.where(self.known[at] == hashes, at % 1_000_000 + 2, 1).astype(np.uint32) if len(self.known) else np.ones(len(hashes), np.uint32)
        code[code >= 0xD800] += 0x800
        return code.astype("<u4").tobytes().decode("utf-32-le")

    def runs(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """The word ranges of a text that are made of windows of the passages."""
        ends = np.fromiter((last + 1 for last, _ in self.automaton.iter(self._symbols(hashes))), np.int64)
        mine, _ = long_windows(hashes, np.array([0, len(hashes)]), WINDOW)
        if not len(ends) or not len(mine):
            return []
        # a window of a passage holds a pattern: it starts at most WINDOW words before the pattern's end
        step = np.zeros(len(mine) + 1, np.int64)
        np.add.at(step, np.clip(ends - WINDOW, 0, len(mine)), 1)
        np.add.at(step, np.clip(ends - CHUNK + 1, 0, len(mine)), -1)
        near = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        at = np.minimum(np.searchsorted(self.windows, mine[near]), len(self.windows) - 1)
        good = near[self.windows[at] == mine[near]]
        return [(int(run[0]), int(run[-1]) + WINDOW) for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(run)]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and piece, passages first; yields the matched word ranges of each text."""
    key, passages, shard = None, [], None
    for batch in batches:
        for piece in slices(batch, "text"):
            ref, ref2, begins, ends = [], [], [], []
            words = Words.of(piece.column("text"))
            hashes = words.hashes()
            columns = [piece.column(c).to_pylist() for c in ("shard", "salt", "ref", "ref2", "start", "text")]
            for i, (s, salt, r, r2, start, text) in enumerate(zip(*columns, strict=True)):
                if (s, salt) != key:
                    key, passages, shard = (s, salt), [], None
                if r is None:
                    passages.append(text)
                    continue
                shard = shard or _Shard(passages)
                for a, b in _merged(shard.runs(hashes[words.first[i] : words.first[i + 1]])):
                    ref.append(r)
                    ref2.append(r2)
                    begins.append(start + a)
                    ends.append(start + b)
            yield pa.RecordBatch.from_arrays([pa.array(ref, pa.int64()), pa.array(ref2, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["ref", "ref2", "a", "b"])


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, texts = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = text.encode().split()
            kept, last = [], 0
            for a, b in _merged([(r["a"], r["b"]) for r in runs]):
                kept += words[last:a]
                last = b
            kept += words[last:]
            removed.append(len(words) - len(kept))
            texts.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("ref"), batch.column("ref2"), pa.array(removed, pa.int64()), pa.array(texts)], ["ref", "ref2", "n_removed", "kept_sha256"])


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> the scanned documents, their distinct texts that may hold a repeated passage, and the
    word ranges to remove from these: (ref, ref2, a, b), b exclusive."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ref"), F.hash("text").alias("ref2"), "text")
    scanned = written(read.mapInArrow(_scanned, "doc_id long, ref long, ref2 int, n_words long, sha string, anchors array<long>"))
    posts = scanned.select("ref", "ref2", F.explode("anchors").alias("anchor"))
    again = written(posts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    hits = posts.join(again, "anchor").groupBy("ref", "ref2").agg(F.collect_set("anchor").alias("hits"))
    classes = scanned.where(f"n_words >= {WINDOW}").groupBy("ref", "ref2").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    wanted = hits.join(classes, ["ref", "ref2"]).withColumn("id", F.coalesce("doc_id", F.lit(-1))).drop("doc_id")
    held = written(read.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["ref", "ref2", "id"]).select("ref", "ref2", "n", "hits", "text", F.expr("octet_length(text)").alias("bytes")))

    counts = held.select("ref", "n", "hits", "text").mapInArrow(_posted, "window long, ref long, n long")
    assigned = counts.groupBy("window").agg(F.sum("n").alias("n"), F.min("ref").alias("ref")).where("n > 1").groupBy("ref").agg(F.collect_list("window").alias("windows"))
    passages = written(held.select("ref", "text").join(assigned, "ref").select("ref", "text", "windows").mapInArrow(_passages, "ref long, start long, text string, anchors array<long>"))

    size = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    owners = passages.select("ref", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("ref").alias("owner"))
    where = written(owners.select("anchor", F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard")))

    def dealt_out(rows: DataFrame, keys: list[str], anchors: str) -> DataFrame:
        pairs = rows.select(*keys, F.explode(anchors).alias("anchor")).join(where, "anchor").groupBy(*keys).agg(F.collect_set(F.struct("anchor", "shard")).alias("pairs"))
        return rows.join(pairs, keys)

    segments = dealt_out(held, ["ref", "ref2"], "hits").select("ref", "ref2", "text", "pairs").mapInArrow(_segments, "shard long, ref long, ref2 int, start long, text string")
    segments = written(segments)
    pieces = dealt_out(passages, ["ref", "start"], "anchors").select("ref", F.lit(0).alias("ref2"), "text", "pairs").mapInArrow(_segments, "shard long, ref long, ref2 int, start long, text string")
    pieces = written(pieces.select("shard", "text"))
    salts = written(segments.groupBy("shard").agg(F.expr(f"1 + sum(octet_length(text)) div {PIECE_BYTES}").alias("salts")))
    texts = segments.join(salts, "shard").select("shard", F.expr("pmod(xxhash64(ref, start), salts)").alias("salt"), "ref", "ref2", "start", "text")
    every = pieces.join(salts, "shard").select("shard", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "long"), ("ref2", "int"), ("start", "long"))], "text")
    dealt = every.unionByName(texts).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("ref").asc_nulls_first())
    runs = written(dealt.mapInArrow(_streamed, "ref long, ref2 int, a long, b long"))
    dropped(again, where, salts, segments, passages, pieces)
    return scanned, held, runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 for each row."""
    scanned, held, runs = repeated_runs(docs)
    gathered = runs.groupBy("ref", "ref2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    cut = held.select("ref", "ref2", "text").join(gathered, ["ref", "ref2"]).mapInArrow(_cut, "ref long, ref2 int, n_removed long, kept_sha256 string")
    cut = written(cut.dropDuplicates(["ref", "ref2"]))
    return scanned.select("doc_id", "ref", "ref2", "n_words", "sha").join(cut, ["ref", "ref2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
