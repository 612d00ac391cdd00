"""Byte-pair encoding and decoding by batched numpy merge rounds.

Words of many documents lie as symbols in one flat array. A round looks every neighbouring pair up by binary search in
the sorted keys of all merges, takes the lowest rank of each word and merges there; words without a pair left leave
the array. Equal chunks between white space are encoded once and remembered (a memory of bounded size that never
changes a result).

Nulls encode like empty texts (no ids) and decode to the empty text; extra columns pass through; repeated rows give
repeated results; a text of any length is one row.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from talentweave.llm.common import add_columns

WORD_END = "</w>"
#: Fixed value: the vocabulary's own rule for splitting normalised text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Remembered chunks in a worker; beyond it the memory starts anew.
REMEMBER = 200_000
NONE = np.iinfo(np.int32).max
_BREAKS = re.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a tokenizer file, as arrays."""

    tokens: list[str]
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at a word's end
    keys: np.ndarray  # sorted pair keys
    rank: np.ndarray  # rank of each key
    made: np.ndarray  # id that each rank's merge makes
    whole: np.ndarray  # ranks whose merge may run at all places of a word at once
    special: dict[str, int]

    @property
    def base(self) -> int:
        return len(self.tokens)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in [*vocab.items(), *special.items()]:
            tokens[i] = t
        merges = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * len(tokens) + right
        order = np.argsort(keys, kind="stable")
        # A merge is safe at all places at once unless a pair with the symbol that it makes ranks before it.
        lowest = np.full(len(tokens), NONE)
        np.minimum.at(lowest, left, np.arange(len(merges)))
        np.minimum.at(lowest, right, np.arange(len(merges)))
        letters = _byte_letters()
        return cls(
            tokens,
            np.array([vocab[c] for c in letters], np.int32),
            np.array([vocab[c + WORD_END] for c in letters], np.int32),
            keys[order],
            order.astype(np.int32),
            made,
            lowest[made] > np.arange(len(merges)),
            special,
        )


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the number of ids of each word. No word may be empty."""
    size = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym, word = v.first[raw], np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size) - 1
    sym[ends] = v.last[raw[ends]]
    done_sym, done_word = [], []
    while len(sym):
        same = word[1:] == word[:-1]
        key = sym[:-1].astype(np.int64) * v.base + sym[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where(same & (v.keys[at] == key), v.rank[at], NONE)
        rank = np.append(rank, NONE)
        starts = np.flatnonzero(np.append(True, ~same))
        least = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(sym)))
        of = np.repeat(least, lengths)
        open_ = of != NONE
        if not open_.all():
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            if not open_.any():
                break
        hit = open_ & (rank == of)
        # In a run of overlapping hits (equal symbols) every second one merges, from the left.
        where = np.flatnonzero(hit)
        fresh = np.append(True, np.diff(where) > 1)
        run = np.maximum.accumulate(np.where(fresh, where, 0))
        where = where[(where - run) % 2 == 0]
        careful = ~v.whole[rank[where]]
        if careful.any():  # only the leftmost place of such a word
            leading = np.append(True, word[where][1:] != word[where][:-1])
            where = where[~careful | leading]
        sym[where] = v.made[rank[where]]
        keep = open_
        keep[where + 1] = False
        sym, word = sym[keep], word[keep]
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(words))


class Store:
    """Ids of remembered pieces end to end, with the place and number of each piece's ids."""

    def __init__(self, ids: list[int]):
        self.flat = np.array(ids, np.int32)
        self.start, self.length = np.arange(len(ids)), np.ones(len(ids), np.int64)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.flat) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.flat = np.append(self.flat, ids)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and where each piece's ids end."""
        n = self.length[which]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Encodes texts; remembers the ids of words, and of chunks between white space."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) or r"(?!)")
        self.openers = {s[0] for s in v.special}
        self.forget()

    def forget(self) -> None:
        # A special token is a word under its id, which no text can spell.
        self.word_number: dict[str | int, int] = {i: n for n, i in enumerate(self.v.special.values())}
        self.words = Store(list(self.v.special.values()))
        self.known: dict[str, int] = {}
        self.store = Store([])

    def pieces(self, chunk: str) -> list[str | int]:
        """Words and special ids of a chunk without white space."""
        if not any(c in chunk for c in self.openers):
            return self.plain(chunk)
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(chunk):
            out += self.plain(chunk[at : m.start()])
            out.append(self.v.special[m[0]])
            at = m.end()
        return out + self.plain(chunk[at:])

    @staticmethod
    def plain(chunk: str) -> list[str]:
        low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [low] if low.isalpha() else WORD.findall(low)

    def learn(self, chunks: list[str]) -> None:
        number = self.word_number
        fresh: list[bytes] = []
        which, counts = [], []
        for c in chunks:
            own = self.pieces(c)
            for w in own:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(number)
                    fresh.append(w.encode())
                which.append(n)
            counts.append(len(own))
        if fresh:
            self.words.add(*merge_words(fresh, self.v))
        ids, ends = self.words.gather(np.array(which, np.int64))
        bounds = np.append(0, ends)[np.append(0, np.cumsum(np.array(counts, np.int64)))]
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.store.add(ids, np.diff(bounds))

    @staticmethod
    def chunks(text: str) -> list[str]:
        if _BREAKS.search(text):  # white space to str.split, but not to the vocabulary
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin, the end included."""
        if len(self.known) > REMEMBER:
            self.forget()
        of, chunks = [], []
        for t in texts:
            own = self.chunks(t or "")
            of.append(len(own))
            chunks += own
        if new := list(set(chunks).difference(self.known)):
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        ids, ends = self.store.gather(which)
        return ids, np.append(0, ends)[np.append(0, np.cumsum(np.array(of, np.int64)))]


def _joined(token, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The decoded texts: the file has no decoder, so token strings are joined by a space."""
    return pa.array([" ".join(map(token, flat[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the ids of each whole text by the tokenizer file at `path` (read on the driver and broadcast), and where
    `decoded` names a column with what these ids decode to.

    Special tokens' strings in a text become their ids; none are added. A null or empty text has no ids.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def work():
        encoder = Encoder(shared.value)

        def of(column: pa.Array) -> list[pa.Array]:
            flat, bounds = encoder.encode(column.to_pylist())
            own = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            return [own] if decoded is None else [own, _joined(encoder.v.tokens.__getitem__, flat, bounds)]

        return of

    new = T.StructType().add(ids, T.ArrayType(T.IntegerType()))
    return add_columns(df, text, new if decoded is None else new.add(decoded, T.StringType()), work, drop)


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the text that ids decode to by the tokenizer file. Null ids decode to the empty text."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(path).tokens)

    def work():
        token = shared.value.__getitem__

        def of(column: pa.Array) -> list[pa.Array]:
            column = column.fill_null([]) if column.null_count else column
            return [_joined(token, column.values.to_numpy(), column.offsets.to_numpy())]

        return of

    return add_columns(df, ids, T.StructType().add(text, T.StringType()), work, drop)
