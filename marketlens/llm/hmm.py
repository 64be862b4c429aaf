"""A hidden Markov language model over words.

Words are emitted by latent states. A state emits one of a bounded number of symbols: the ``SYMBOLS`` most frequent
training words and the end have their own, all other words share one symbol for each ending. A word with a shared
symbol has the symbol's probability times its own share: count + 1 for training words, and for all unknown words together
one more than the number of training words with that ending that were seen once.

* Word counts are summed by Spark over all training texts, and never gathered. Only the ``HELD`` most frequent words
  (16 bytes each) go to every task; counts of other words come by a join with the tokens that need them.
* Baum-Welch: every round, tasks run the forward and backward recursions over all training texts and emit the expected
  counts of symbols by state and of transitions; Spark adds them up. The sums, of fixed size, give the next model.
* Likelihood is exact: the scaled forward recursion over the whole text. Texts are cut into stretches of ``STRETCH``
  tokens, whose transfer matrices are worked out side by side and then multiplied in order.

A null text is empty: its only token is the end. Texts of any length are scored whole; repeated rows each by itself. A
null doc_id counts as an empty string when rows are held out. An empty table gives an empty result. Without training
rows all counts are zero and the model stays as it began. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.store import written
from marketlens.llm.words import Words, slices

STATES = 4
ROUNDS = 4
SYMBOLS = 1 << 16
ENDINGS = 1 << 12
#: Bytes of a word's ending.
ENDING = 3
HELD = 1 << 20
STRETCH = 64
#: Tokens that are worked on together.
TOKENS = 400_000
#: Distinct words that a task holds before it emits their counts.
MERGED = 3_000_000
#: Counts added to starts and moves, and the weight in tokens that a state's emissions give to all states' together.
SMOOTH = 0.02
PRIOR = 1000


def _endings(words: Words) -> np.ndarray:
    return (words.spans(np.maximum(words.start, words.end - ENDING), words.end, lower=True) % np.uint64(ENDINGS)).astype(np.int32)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, endings, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        hashes, endings, counts = hashes[order], endings[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        return hashes[first], endings[first], np.add.reduceat(counts, first) if len(first) else counts

    def batch_of(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["word", "ending", "n"])

    loose = 0
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words.of(piece.column("text"))
            hashes, first, counts = np.unique(words.hashes(lower=True), return_index=True, return_counts=True)
            held.append((hashes, _endings(words)[first], counts))
            loose += len(hashes)
            if loose > MERGED:
                held = [merged()]
                loose = 0
                if len(held[0][0]) > MERGED:
                    yield batch_of(held.pop())
    if held:
        yield batch_of(merged())


def word_counts(texts: DataFrame) -> DataFrame:
    """text -> (word, ending, c): each word's hash, its ending's class, and its count."""
    return texts.select("text").mapInArrow(_tallied, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words by hash, with count and symbol, and what the shared symbols hold."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    log_share: np.ndarray
    unseen: np.ndarray
    own: int
    ends: int

    @property
    def size(self) -> int:
        return self.own + 1 + ENDINGS


def _floor(counts: DataFrame, most: int) -> int:
    """The least count c such that at most ``most`` words have c or more."""
    bins = counts.groupBy(F.expr("least(c, 64L) + greatest(0L, floor((log2(greatest(c, 64L)) - 6) * 64))").alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c"))
    floor, total = None, 0
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # 4000 bins at most
        total += row["n"]
        if total > most:
            break
        floor = row["c"]
    return (1 << 62) if floor is None else floor


def lexicon(counts: DataFrame, ends: int) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the counts of the words that it does not hold."""
    least, own = _floor(counts, HELD), _floor(counts, SYMBOLS)
    own = max(least, own)
    top = counts.where(F.col("c") >= least).select("word", "c", "ending").toArrow()
    hashes, c, endings = (np.asarray(top.column(k)) for k in ("word", "c", "ending"))
    hashes = np.ascontiguousarray(hashes).view(np.uint64)
    order = np.argsort(hashes)
    hashes, c, endings = hashes[order], c[order], endings[order]
    frequent = c >= own
    n = int(frequent.sum())
    symbols = np.where(frequent, np.cumsum(frequent) - 1, n + 1 + endings).astype(np.int32)
    unseen = np.ones(ENDINGS)
    for row in counts.where("c = 1").groupBy("ending").agg(F.count("*").alias("n")).collect():  # ENDINGS rows at most
        unseen[row["ending"]] += row["n"]
    mass = unseen.copy()
    for row in counts.where(F.col("c") < own).groupBy("ending").agg(F.sum(F.col("c") + 1).alias("n")).collect():  # ENDINGS rows at most
        mass[row["ending"]] += row["n"]
    return Lexicon(hashes, c.astype(np.int32 if len(c) == 0 or c.max() < 1 << 31 else np.int64), symbols, np.log10(mass), unseen, n, ends), counts.where(F.col("c") < least).select("word", "ending", "c")


def _read(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """row, doc_id, held_out, text -> these without the text, n_tokens, n_known, symbols, rare, count_log, share_log.

    count_log: sum of log10(count + 1) of held words; share_log: sum of the log10 shares of tokens with a shared symbol,
    as if those that the lexicon does not hold were unknown; rare: the hashes of these.
    """
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        logs, unseen = np.log10(lex.counts + 1.0), np.log10(lex.unseen)
        end_log = math.log10(lex.ends + 1)
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words.of(piece.column("text"))
                n, hashes, owner = len(piece), words.hashes(lower=True), words.owner
                at = np.searchsorted(lex.hashes, hashes)
                known = np.zeros(len(hashes), bool)
                if len(lex.hashes):
                    at = np.minimum(at, len(lex.hashes) - 1)
                    known = lex.hashes[at] == hashes
                endings = _endings(words)
                symbol = lex.own + 1 + endings
                symbol[known] = lex.symbols[at[known]]
                shared = symbol > lex.own
                count_log = np.bincount(owner[known], logs[at[known]], n) + end_log
                share_log = np.bincount(owner[shared], lex.log_share[endings[shared]], n) - np.bincount(owner[~known], unseen[endings[~known]], n)
                # within the shared symbols a word's own count matters, for the frequent ones it does not
                own_log = np.bincount(owner[known & shared], logs[at[known & shared]], n)
                n_known = np.bincount(owner[known], minlength=n) + (lex.ends > 0)
                counts = words.counts
                ends = np.cumsum(counts + 1)
                tokens = np.full(int(ends[-1]) if n else 0, lex.own, np.int32)
                tokens[np.arange(len(hashes)) + owner] = symbol
                rare = hashes[~known].view(np.int64)
                rare_at = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=n))])
                lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                columns = [*(piece.column(k) for k in ("row", "doc_id", "held_out")), pa.array(counts + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(count_log.astype(float)), pa.array((own_log - share_log).astype(float)), lists(np.concatenate([[0], ends]), tokens), lists(rare_at, rare)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "count_log", "share_log", "symbols", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, count_log double, share_log double, symbols array<int>, rare array<long>")


@dataclass
class Model:
    """Distribution of the state before the first word, transitions, and emissions by symbol (rows) and state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def begun(cls, symbols: int, states: int = STATES) -> Model:
        rng = np.random.default_rng(3)
        emit = rng.uniform(0.5, 1.5, (symbols, states))
        return cls(np.full(states, 1 / states), 0.1 / states + 0.9 * np.eye(states), emit / emit.sum(0))


class Stretches:
    """Texts laid end to end and cut into stretches, the longest first."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray) -> None:
        lengths = np.diff(first)
        pieces = -(-lengths // STRETCH)
        self.docs = len(lengths)
        self.doc = np.repeat(np.arange(self.docs), pieces)
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[self.doc] + self.number * STRETCH
        length = np.minimum(STRETCH, first[self.doc + 1] - begin)
        order = np.argsort(-length, kind="stable")
        self.doc, self.number, self.begin, self.length = self.doc[order], self.number[order], begin[order], length[order]
        self.tokens = tokens
        self.active = np.searchsorted(-self.length, -np.arange(STRETCH), "left")
        by = np.lexsort((self.doc, self.number))
        cuts = np.searchsorted(self.number[by], np.arange(int(self.number.max(initial=-1)) + 2))
        #: for each number, the stretches with it
        self.rounds = [by[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def transfer(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each stretch's matrix from the state before it to the state at its end, scaled, and the log of the scale."""
        k = len(model.start)
        out = np.tile(np.eye(k), (len(self.doc), 1, 1))
        log = np.zeros(len(self.doc))
        for t in range(STRETCH):
            n = self.active[t]
            if not n:
                break
            step = (out[:n].reshape(-1, k) @ model.move).reshape(n, k, k)
            step *= model.emit[self.tokens[self.begin[:n] + t]][:, None, :]
            if t % 16 == 15:
                scale = step.sum((1, 2))
                step /= scale[:, None, None]
                log[:n] += np.log(scale)
            out[:n] = step
        scale = out.sum((1, 2))
        return out / scale[:, None, None], log + np.log(scale)

    def forward(self, model: Model, matrix: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state's distribution before each stretch, and the natural log of each text's likelihood."""
        before = np.zeros((len(self.doc), len(model.start)))
        now, total = np.tile(model.start, (self.docs, 1)), np.zeros(self.docs)
        for some in self.rounds:
            doc = self.doc[some]
            before[some] = now[doc]
            moved = np.einsum("ni,nij->nj", now[doc], matrix[some])
            scale = moved.sum(1)
            now[doc] = moved / scale[:, None]
            total[doc] += np.log(scale) + log[some]
        return before, total

    def expected(self, model: Model, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of the start state, of transitions, and of states by symbol."""
        k = len(model.start)
        matrix, log = self.transfer(model)
        before, _ = self.forward(model, matrix, log)
        after = np.ones((len(self.doc), k))
        ahead = np.ones((self.docs, k))
        start = np.zeros(k)
        for number in range(len(self.rounds) - 1, -1, -1):
            some = self.rounds[number]
            doc = self.doc[some]
            after[some] = ahead[doc]
            back = np.einsum("nij,nj->ni", matrix[some], ahead[doc])
            ahead[doc] = back / back.sum(1)[:, None]
        first = model.start * ahead
        start = (first / first.sum(1)[:, None]).sum(0) if self.docs else start
        now, alphas, emits = before, [before], []
        for t in range(STRETCH):
            n = self.active[t]
            if not n:
                break
            emits.append(model.emit[self.tokens[self.begin[:n] + t]])
            now = (now[:n] @ model.move) * emits[-1]
            now /= now.sum(1)[:, None]
            alphas.append(now)
        moves, gammas, symbols = np.zeros((k, k)), [], []
        beta = after
        for t in range(len(emits) - 1, -1, -1):
            n = self.active[t]
            alpha = alphas[t][:n]
            both = alphas[t + 1] * beta[:n]
            gammas.append(both / both.sum(1)[:, None])
            symbols.append(self.tokens[self.begin[:n] + t])
            seen = emits[t] * beta[:n]
            back = seen @ model.move.T
            moves += (alpha / (alpha * back).sum(1)[:, None]).T @ seen
            beta[:n] = back / back.sum(1)[:, None]
        gamma, symbol = np.concatenate(gammas), np.concatenate(symbols)
        used, place = np.unique(symbol, return_inverse=True)
        by = np.zeros((size, k))
        for s in range(k):
            by[used, s] = np.bincount(place, gamma[:, s], len(used))
        return start, moves * model.move, by


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Stretches]]:
    """Pieces of a batch of about ``TOKENS`` tokens."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets, np.int64)
    values = np.asarray(lists.values)
    at, n = 0, len(batch)
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS, "right")) - 1))
        yield batch.slice(at, stop - at), Stretches(values[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def trained(read: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``symbols``."""
    spark, model = read.sparkSession, Model.begun(lex.size)
    k = len(model.start)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model = held.value
            size = len(model.emit)
            total = np.zeros((size + 1 + k, k))  # symbols, the start, the transitions
            for batch in batches:
                for _, texts in _texts(batch, "symbols"):
                    start, moves, by = texts.expected(model, size)
                    total[:size] += by
                    total[size] += start
                    total[size + 1 :] += moves
            some = np.flatnonzero(total.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, s]) for s in range(k))], ["symbol", *(f"s{s}" for s in range(k))])

        counts = read.select("symbols").mapInArrow(run, "symbol int" + "".join(f", s{s} double" for s in range(k)))
        got = counts.groupBy("symbol").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toArrow()  # a row for each symbol at most
        held.unpersist()
        total = np.zeros((lex.size + 1 + k, k))
        total[np.asarray(got.column("symbol"))] = np.stack([np.asarray(got.column(f"s{s}")) for s in range(k)], 1)
        if not total.any():
            break
        start, moves, emit = total[lex.size] + SMOOTH, total[lex.size + 1 :] + SMOOTH, total[: lex.size]
        emit[lex.own + 1 :] += (lex.unseen / k)[:, None]
        whole = emit.sum(1) + 1
        emit = emit + (PRIOR / whole.sum()) * whole[:, None]
        model = Model(start / start.sum(), moves / moves.sum(1)[:, None], emit / emit.sum(0))
    return model


def _forward(read: DataFrame, model: Model) -> DataFrame:
    held = read.sparkSession.sparkContext.broadcast(model)
    carry = ["row", "doc_id", "held_out", "n_tokens", "n_known", "count_log", "share_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in _texts(batch, "symbols"):
                _, log = texts.forward(held.value, *texts.transfer(held.value))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carry), pa.array(log / math.log(10))], [*carry, "path_log"])

    kinds = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in carry)
    return read.select(*carry, "symbols").mapInArrow(run, f"{kinds}, path_log double")


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = docs.where("not held_out")
    ends = train.count()
    counts = written(word_counts(train))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    lex, rest = lexicon(counts, ends)
    read = written(_read(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), lex))
    model = trained(read.where("not held_out"), lex)
    paths = _forward(read, model)
    # tokens of words that were seen in training but are not held by the lexicon; unseen words add log10(1)
    rare = read.select("row", F.explode("rare").alias("word")).join(rest, "word")
    unseen = F.broadcast(spark.createDataFrame(list(enumerate(np.log10(lex.unseen).tolist())), "ending int, unseen double"))  # ENDINGS rows
    rare = rare.join(unseen, "ending").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1)).alias("log"), F.sum("unseen").alias("unseen")).withColumnRenamed("row", "of")
    extra = F.coalesce("log", F.lit(0.0))
    return paths.join(rare, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("count_log") + extra - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("path_log") + F.col("share_log") + extra - F.coalesce("unseen", F.lit(0.0))).alias("score"),
    )
