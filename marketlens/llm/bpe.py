"""BPE encoding by a depth-first walk over a trie of distinct words.

For a prefix of a word's symbols, the state is the last token of the prefix's encoding. It is the only token that ends
the prefix and is compatible with the state where it begins: encoding the two together gives the two. So the encodings
of all prefixes of a word follow from one state per symbol, and words with a common prefix share the states of that
prefix. A task keeps the trie with the state of every node across its batches, and a new word is inserted below
the longest prefix that is there, so each prefix is encoded once. Words of a batch are inserted in sorted order, the
trie's depth-first order. The encoding of a word is read off by walking the states back.

Only distinct words are encoded. A text is first cut at ASCII white space, which no word and no normalisation crosses.
Its pieces are found and hashed for a whole batch at once, distinct pieces are looked up by their 64-bit hash in a table
of encodings, and the ids of the texts are gathered from it (two of a million distinct pieces in a worker share a hash
with a chance of 3e-8).

Texts are split and normalised as the vocabulary file says (NFC, lower case, white space dropped); the strings of the
special tokens in a text give their ids. Letter classes and cases come from the regex and unicodedata modules: code
points that are not assigned in their version of Unicode (15.1 and before) may split otherwise than in the tokenizers
library. A null text is empty: no ids. Texts of any length are encoded whole, repeated rows each by itself. An empty
table gives an empty result. Columns to carry are held in a struct, so their names cannot clash.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from marketlens.llm.words import Words, released, slices

#: Words and pieces whose encodings a task keeps, and nodes of its trie, at most; beyond that it starts anew.
HELD_WORDS = 150_000
HELD_PIECES = 1_000_000
HELD_NODES = 400_000
#: Answers about pairs of tokens that a worker keeps at most.
HELD_PAIRS = 400_000
#: What a worker keeps from one task to the next, some 60 MB: the pieces, words and pairs that it met first, the most
#: frequent ones among them. The trie goes.
KEPT_PIECES = 200_000
KEPT_WORDS = 60_000
KEPT_PAIRS = 150_000
END = "</w>"
_CONTROL = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


class Encoder:
    """The encoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or spec.get("decoder") is not None:
            raise ValueError(f"{path}: a BPE vocabulary with word ends and no decoder is expected")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.symbols: dict[int, tuple[int, ...]] = {}
        made = {new: pair for pair, (_, new) in self.merges.items()}
        for i in sorted(self.ids.values()):
            self._spell(i, made)
        self.rank = {new: rank for rank, new in self.merges.values()}
        #: Of the tokens with a given ending of up to three letters: the length of the longest.
        self.longest: dict[str, int] = {}
        for t in self.ids:
            body = t.removesuffix(END)
            end = END if t != body else ""
            for k in range(1, min(3, len(body)) + 1):
                self.longest[body[-k:] + end] = max(self.longest.get(body[-k:] + end, 0), len(body))
        self.made = made
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.byte = _byte_alphabet()
        self.shown = {i: f"{t} ".encode() for i, t in self.names.items()}
        self.forget()

    def forget(self) -> None:
        """Starts anew with an empty trie and empty tables."""
        self.pairs: dict[tuple[int, int], bool] = {}
        self.root: list = [{}, -1, 0]
        self.nodes = 0
        self.held: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.special.items()}
        self.pieces = _Pieces()

    def rest(self) -> None:
        """Ends a task: an idle worker lives on beside later stages, so only a bounded part is kept."""
        first = lambda table, n: table if len(table) <= n else dict(islice(table.items(), n))
        self.pairs, self.held = first(self.pairs, KEPT_PAIRS), first(self.held, KEPT_WORDS)
        self.root, self.nodes = [{}, -1, 0], 0
        self.pieces.keep_first(KEPT_PIECES)

    def _spell(self, i: int, made: dict[int, tuple[int, int]]) -> tuple[int, ...]:
        if i not in self.symbols:
            self.symbols[i] = (*self._spell(made[i][0], made), *self._spell(made[i][1], made)) if i in made else (i,)
        return self.symbols[i]

    def merged(self, parts: list[int]) -> list[int]:
        """Plain BPE by merge ranks; used on two tokens at a time only."""
        while len(parts) > 1:
            best = min((self.merges.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k : k + 2] = [self.merges[parts[k], parts[k + 1]][1]]
        return parts

    def fits(self, state: int | None, token: int) -> bool:
        """Whether the token may follow the state (None: stand first)."""
        if state is None:
            if token not in self.whole:
                self.whole[token] = self.merged(list(self.symbols[token])) == [token]
            return self.whole[token]
        key = (state, token)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > HELD_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.fits(None, token) and self._apart(state, token)
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge joins symbols of a and b: the merges that made both are undone at their border, the latest
        first, and a merge over the border counts if it comes before the one undone last (in a tie, the left one)."""
        limit = 1 << 60
        while True:
            over = self.merges.get((a, b))
            if over and over[0] < limit:
                return False
            left, right = self.rank.get(a, -1), self.rank.get(b, -1)
            if left > right:
                limit, a = left, self.made[a][1]
            elif right >= 0:
                limit, b = right + 1, self.made[b][0]
            else:
                return True

    def last(self, word: str, n: int, path: list[list], end: str) -> tuple[int, int]:
        """The last token of the encoding of word[:n], and its length; path[i] is the node of word[:i]."""
        most = 1
        for k in (3, 2):
            if n >= k:
                # no token has this ending of k letters: those that fit are shorter
                most = self.longest.get(word[n - k : n] + end, 0)
                if most:
                    break
                most = k - 1
        for size in range(min(n, most), 0, -1):
            token = self.ids.get(word[n - size : n] + end)
            if token is not None and self.fits(path[n - size][1] if n > size else None, token):
                return token, size
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Inserts a word (in byte letters) into the trie: a node is its children, its last token and that one's length."""
        path = [self.root]
        for n in range(1, len(word)):
            children, letter = path[-1][0], word[n - 1]
            node = children.get(letter)
            if node is None:
                node = children[letter] = [{}, *self.last(word, n, path, "")]
                self.nodes += 1
            path.append(node)
        token, size = self.last(word, len(word), path, END)
        ids, at = [token], len(word) - size
        while at:
            _, token, size = path[at]
            ids.append(token)
            at -= size
        ids.reverse()
        return tuple(ids)

    def words(self, text: str) -> list[str]:
        """The words of a text in byte letters, and special tokens as they are."""
        out: list[str] = []
        for k, part in enumerate(self.split.split(text) if self.split and "<|" in text else [text]):
            if k % 2:
                out.append(part)
            elif part.isascii() and not _CONTROL.search(part):
                out += self.pattern.findall(part.lower())
            else:
                # lower case letter by letter: a final sigma is not special
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.byte) for w in self.pattern.findall(low)]
        return out

    def learn(self, pieces: list[str]) -> tuple[list[list[int]], list[bytes]]:
        """The ids of new pieces, and their tokens as bytes, each followed by a space."""
        split = [self.words(x) for x in pieces]
        new = set().union(*split) - self.held.keys()
        if len(self.held) + len(new) > HELD_WORDS or self.nodes > HELD_NODES:
            self.held = {t: (i,) for t, i in self.special.items()}
            self.root, self.nodes = [{}, -1, 0], 0
            new = set().union(*split) - self.held.keys()
        for word in sorted(new):
            self.held[word] = self.encode_word(word)
        ids = [[i for w in words for i in self.held[w]] for words in split]
        return ids, [b"".join([self.shown[i] for i in x]) for x in ids]

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """Ids of each text, and the text decoded from them."""
        found = Words.of(texts)
        values, first, which = np.unique(found.hashes(), return_index=True, return_inverse=True)
        if len(self.pieces.keys) + len(values) > HELD_PIECES:
            self.pieces = _Pieces()
        new = np.flatnonzero(self.pieces.places(values) < 0)
        if len(new):
            raw = found.data.tobytes()
            self.pieces.add(values[new], *self.learn([raw[a:b].decode() for a, b in zip(found.start[first[new]].tolist(), found.end[first[new]].tolist(), strict=True)]))
        places = self.pieces.places(values)[which]
        ids, ends = _gathered(self.pieces.ids, self.pieces.id_ends, places, found.first)
        shown, cuts = _gathered(self.pieces.shown, self.pieces.shown_ends, places, found.first)
        # the space after a text's last token goes
        keep = np.ones(len(shown), bool)
        keep[cuts[1:][np.diff(cuts) > 0] - 1] = False
        offsets = cuts - np.concatenate([[0], np.cumsum(np.diff(cuts) > 0)])
        decoded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(shown[keep]))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), decoded


class _Pieces:
    """Encodings by a piece's hash: sorted keys, their places, and flat arrays of ids and of token bytes."""

    def __init__(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.id_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.shown, self.shown_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def keep_first(self, n: int) -> None:
        if len(self.keys) > n:
            early = self.at < n
            self.keys, self.at = self.keys[early], self.at[early]
            self.ids, self.id_ends = self.ids[: self.id_ends[n]].copy(), self.id_ends[: n + 1].copy()
            self.shown, self.shown_ends = self.shown[: self.shown_ends[n]].copy(), self.shown_ends[: n + 1].copy()

    def places(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, self.at[k], -1)

    def add(self, keys: np.ndarray, ids: list[list[int]], shown: list[bytes]) -> None:
        at = np.concatenate([self.at, len(self.at) + np.arange(len(keys))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], np.int32)])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(x) for x in ids])])
        self.shown = np.concatenate([self.shown, np.frombuffer(b"".join(shown), np.uint8)])
        self.shown_ends = np.concatenate([self.shown_ends, self.shown_ends[-1] + np.cumsum([len(x) for x in shown])])


def _gathered(flat: np.ndarray, ends: np.ndarray, places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[ends[p] : ends[p + 1]] for all places one after another, and where those of each text begin."""
    starts, sizes = ends[places], ends[places + 1] - ends[places]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)
    return flat[at], upto[first]


def _byte_alphabet() -> dict[int, str]:
    """Each byte's letter: itself if printable, else the next free letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(other)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, built once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, name: str, carry: list[str]) -> DataFrame:
    """docs (text and the columns of ``carry``) -> row (a struct of these), ids, decoded.

    ``name`` is a file of the public_tokenizers package, opened where the tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = encoder(public_tokenizers.path(name))
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, decoded = coder.encode(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("row"), ids, decoded], ["row", "ids", "decoded"])
        coder.rest()
        released()

    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "text")
    return read.mapInArrow(run, StructType([read.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digests(rows: DataFrame) -> DataFrame:
    """encoded() -> the carried columns, n_tokens, ids_sha256 and decoded_sha256."""
    return rows.select("row.*", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.translate(F.col("ids").cast("string"), ",[]", ""), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
