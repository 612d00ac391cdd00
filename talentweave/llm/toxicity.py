"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-cased words of a text and the first four letters of longer words. All terms that occur in a bounded
sample of labelled documents count, whatever their labels, with document frequencies from all documents; a term weighs
(1 + ln count) * idf. The examples lie in an inverted index in blocks of BLOCK. Rare terms' postings are summed in full.
Of terms that are in many examples a block stores the largest weight and the largest norm: a query visits first the
blocks with the highest upper bounds that these give, then those whose bound reaches the k-th similarity found, so the
k nearest are exact. Every neighbour votes with its cosine, over the share that its class has of the examples; the log
ratio of the votes goes through a logistic curve fitted by leave-one-out on the examples. k is a thirtieth of the
examples, LEAST at least. The neighbours' ids are the evidence.

Terms that no example has count neither for a cosine nor for a text's length. A text without any term of an example is
as near to all examples without terms: its score is their share of toxic ones, without evidence. Null and empty texts
are such texts. Ties in similarity go to the example whose hashed id comes first. Equal texts have equal scores.
Repeated label rows count once, with the largest value; of rows that share a labelled id the least text is the example;
without labels of both classes every score is the share of toxic labels, or 0 where there is none. Texts of any length
are read whole. Extra columns pass through; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.llm.common import add_columns, labelled_sample, mixed

#: Labelled documents of each class in the index, at most.
BOUND = 2000
BLOCK = 64
#: Neighbours: one for so many examples, and the least number.
SHARE, LEAST = 30, 15
BEGIN = 4
#: A term that more than this share of the examples have is summed by blocks, others by their postings.
COMMON = 1 / 16
_WORD = re.compile(r"[^\W_]+")
#: The same words, and the beginnings of longer ones, in SQL.
_WORD_SQL, _BEGIN_SQL = r"[\\p{L}\\p{N}]+", rf"(?<![\\p{{L}}\\p{{N}}])[\\p{{L}}\\p{{N}}]{{{BEGIN}}}(?=[\\p{{L}}\\p{{N}}])"
#: Remembered texts in a worker; beyond it the memory starts anew.
REMEMBER = 50_000
#: Texts that are searched together, and code points that are cut into words together.
BATCH, PIECE = 64, 1_000_000
#: UTF-8 bytes of the examples' terms that may be broadcast; more are joined by a shuffle.
MOST_BYTES = 64_000_000

#: Numbers of texts, terms and their weights, sorted.
Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(words: list[str]) -> set[str]:
    """The words themselves and, marked by a star, the beginnings of longer ones."""
    return {*words, *(w[:BEGIN] + "*" for w in words if len(w) > BEGIN)}


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is in words, and 64 bits."""
    inside = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return inside, mixed(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (_BASE, _BASE_INVERSE))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of PIECE code points; words stay whole."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def hashed_words(pieces: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The words of lower-cased pieces: hashes and numbers of their pieces, of whole words and of longer ones' beginnings.

    A word's hash is the sum of its code points' bits times powers of a base, from one running sum over all pieces.
    """
    inside, bits = _characters()
    code = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[code], [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(20, len(code).bit_length()))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(bits[code] * up[: len(code)], out=total[1:])
    owner = np.searchsorted(first, start, "right") - 1
    long = end - start > BEGIN
    begin = start[long]
    return ((total[end] - total[start]) * down[start], owner), ((total[begin + BEGIN] - total[begin]) * down[begin], owner[long])


@dataclass
class Examples:
    """Labelled examples as an inverted index with block maxima. Examples are numbered in the order of their blocks."""

    # Hashes of words and of beginnings, ascending, and the terms' numbers.
    whole: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    begin: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list = field(default_factory=list)
    turn: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each example in the order of hashed ids, for ties
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each rare term's postings; common terms have none
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # example numbers
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and weights
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each common term in `common` and `best`, -1 for a rare one
    common: np.ndarray = field(default_factory=lambda: np.zeros((1, 0, BLOCK)))  # weights by block, common term, place
    best: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))  # largest weight of each common term in each block
    norm: np.ndarray = field(default_factory=lambda: np.zeros((1, BLOCK)))  # of each example's common terms
    k: int = LEAST
    slope: float = 0.0
    offset: float = 0.0
    bare: float = 0.0  # score of a text without terms

    def vectors(self, texts: list[str | None]) -> Vectors:
        """The examples' terms that each text has and their TF-IDF weights, of unit length."""
        size = len(self.idf)
        keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        waiting: list[tuple[int, str]] = []

        def read() -> None:
            owners = np.array([i for i, _ in waiting], np.int64)
            for (known, number), (h, piece) in zip((self.whole, self.begin), hashed_words([p for _, p in waiting]), strict=True):
                if len(known) and len(h):
                    some, back = np.unique(h, return_inverse=True)
                    place = np.minimum(np.searchsorted(known, some), len(known) - 1)
                    term = np.where(known[place] == some, number[place], -1)[back]
                    keys.append(owners[piece[term >= 0]] * size + term[term >= 0])
            waiting.clear()

        room = PIECE
        for i, t in enumerate(texts):
            for piece in _pieces((t or "").lower()):
                if waiting and len(piece) > room:
                    read()
                    room = PIECE
                waiting.append((i, piece))
                room -= len(piece) + 1
        if waiting:
            read()
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        text, term = np.divmod(key, max(1, size))
        w = (1 + np.log(n)) * self.idf[term]
        return text, term, w / np.sqrt(np.bincount(text, w * w, len(texts)))[text]

    def nearest(self, vectors: Vectors, many: int, leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each of `many` vectors the numbers and cosines of the k nearest examples with a cosine over 0, nearest
        first; leave: an example that each leaves out."""
        n_blocks, n = len(self.common), self.norm.size
        query, term, weight = vectors
        row = self.row[term]
        rare = row < 0
        lengths = self.start[term[rare] + 1] - self.start[term[rare]]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[term[rare]] - (ends - lengths), lengths)
        sums = np.bincount(self.of[at] + np.repeat(query[rare] * n, lengths), self.values[at] * np.repeat(weight[rare], lengths), many * n).reshape(many, n_blocks, BLOCK)
        heavy = np.zeros((many, len(self.best)))
        heavy[query[~rare], row[~rare]] = weight[~rare]
        # What common terms can add: by their largest weights in a block, and by the norms of an example's (Cauchy-Schwarz).
        bounds = np.minimum(sums.max(2) + heavy @ self.best, (sums + np.sqrt((heavy * heavy).sum(1))[:, None, None] * self.norm).max(2))
        exact = np.full((many, n_blocks, BLOCK), -1.0)
        flat = exact.reshape(many, n)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                rows = np.flatnonzero(wanted[:, b])
                exact[rows, b] = np.round(sums[rows, b] + heavy[rows] @ self.common[b], 12)
            if leave is not None:
                flat[np.arange(many), leave] = -1.0

        k = min(self.k, n)
        first = min(n_blocks, -(-k // BLOCK) + 2)
        wanted = np.zeros((many, n_blocks), bool)
        np.put_along_axis(wanted, np.argpartition(-bounds, first - 1, axis=1)[:, :first], True, axis=1)
        visit(wanted)
        least = np.partition(flat, n - k, axis=1)[:, n - k]
        more = ~wanted & (bounds + 1e-11 >= np.maximum(least, 1e-12)[:, None])
        visit(more)
        least = np.maximum(np.partition(flat, n - k, axis=1)[:, n - k], 1e-12)
        out = []
        for own, limit in zip(flat, least, strict=True):
            near = np.flatnonzero(own >= limit)
            near = near[np.lexsort((self.turn[near], -own[near]))[:k]]
            out.append((near, own[near]))
        return out

    def votes(self, near: np.ndarray, sims: np.ndarray, labels: np.ndarray, share: float) -> float:
        """Log ratio of the votes for and against; a twenty-fifth of all votes is dealt to both sides."""
        w = sims / np.where(labels[near] == 1, share, 1 - share)
        yes, total = (w * labels[near]).sum(), w.sum()
        return float(np.log((yes + 0.02 * total) / (total - yes + 0.02 * total)))

    def score_all(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """Score and nearest ids of each text."""
        share = float(self.labels.mean()) if len(self.labels) else 0.0
        out: list[tuple[float, list]] = [(self.bare, [])] * len(texts)
        if not 0 < share < 1:
            return out
        text, term, weight = self.vectors(texts)
        for i in range(0, len(texts), BATCH):
            own = slice(*np.searchsorted(text, (i, i + BATCH)))
            for j, (near, sims) in enumerate(self.nearest((text[own] - i, term[own], weight[own]), min(BATCH, len(texts) - i)), i):
                if len(near):
                    z = self.slope * self.votes(near, sims, self.labels, share) + self.offset
                    out[j] = round(float(1 / (1 + np.exp(-z))), 9), [self.ids[x] for x in near[:5]]
        return out


def document_frequencies(docs: DataFrame, terms: list[str], text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are, counted over all of them."""
    spark = docs.sparkSession
    small = sum(map(len, terms)) * 4 <= MOST_BYTES
    found = []
    for pattern, mark in ((_WORD_SQL, ""), (_BEGIN_SQL, "*")):
        own = [(i, t.removesuffix("*")) for i, t in enumerate(terms) if t.endswith("*") == bool(mark)]
        wanted = spark.createDataFrame(pa.table({"term": pa.array([t for _, t in own], pa.string()), "number": pa.array([i for i, _ in own], pa.int64())}))
        in_text = docs.select(F.explode(F.expr(f"array_distinct(regexp_extract_all(lower({text}), '{pattern}', 0))")).alias("term"))
        found.append(in_text.join(F.broadcast(wanted) if small else wanted, "term").groupBy("number").agg(F.count(F.lit(1)).alias("n")))
    found = found[0].union(found[1]).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found["number"].to_numpy()] = found["n"].to_numpy()
    return out, docs.count()


def build(rows: list[tuple[object, int, str]], df: dict[str, int], n_docs: int) -> Examples:
    """The index of the examples, with its curve. df: of each of their terms."""
    labels = np.array([y for _, y, _ in rows], float)
    made = Examples(idf=np.log((1 + n_docs) / (0.5 + np.fromiter(df.values(), float, len(df)))), k=max(LEAST, len(rows) // SHARE))
    for star in (False, True):
        own = [(t.removesuffix("*"), i) for i, t in enumerate(df) if t.endswith("*") == star]
        h = hashed_words([t for t, _ in own])[0][0] if own else np.zeros(0, np.uint64)
        order = np.argsort(h)
        known = h[order], np.array([i for _, i in own], np.int64)[order]
        made.begin, made.whole = (known, made.whole) if star else (made.begin, known)
    text, term, weight = made.vectors([t for _, _, t in rows])
    ends = np.searchsorted(text, np.arange(len(rows) + 1))
    vectors = [(term[a:b], weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    bare = [y for v, y in zip(vectors, labels, strict=True) if not len(v[0])]
    made.bare = round(float((sum(bare) + 0.5 * labels.mean()) / (len(bare) + 0.5)), 9) if len(labels) else 0.0
    spread = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]), minlength=len(df))
    made.row = np.full(len(df), -1, np.int32)
    often = np.flatnonzero(spread > COMMON * len(rows))
    made.row[often] = np.arange(len(often))
    # Examples that share their weightiest common term share blocks, which keeps the bounds tight.
    commons = [(made.row[t][made.row[t] >= 0], w[made.row[t] >= 0]) for t, w in vectors]
    some = sorted(range(len(rows)), key=lambda i: (int(commons[i][0][commons[i][1].argmax()]) if len(commons[i][0]) else -1, -float((commons[i][1] ** 2).sum()), i))
    n_blocks = max(1, -(-len(some) // BLOCK))
    made.ids, made.labels = [rows[i][0] for i in some], labels[some]
    made.turn = np.append(np.array(some, np.int64), np.arange(len(some), n_blocks * BLOCK))
    made.norm, made.common = np.zeros(n_blocks * BLOCK), np.zeros((n_blocks, len(often), BLOCK))
    for number, i in enumerate(some):
        made.common[number // BLOCK, commons[i][0], number % BLOCK] = commons[i][1]
        made.norm[number] = np.sqrt((commons[i][1] ** 2).sum())
    made.norm, made.best = made.norm.reshape(n_blocks, BLOCK), made.common.max(2).T.copy()
    of = np.repeat(np.arange(len(some), dtype=np.int32), [len(vectors[i][0]) for i in some])
    term, value = (np.concatenate([vectors[i][j] for i in some] or [np.zeros(0, kind)]) for j, kind in ((0, np.int64), (1, float)))
    of, term, value = (x[made.row[term] < 0] for x in (of, term, value))
    order = np.argsort(term, kind="stable")
    made.of, made.values = of[order], value[order]
    made.start = np.append(0, np.cumsum(np.bincount(term, minlength=len(df))))
    if not 0 < labels.sum() < len(labels):
        return made
    # Leave-one-out votes of the examples fit the curve.
    votes = []
    numbers = np.array([number for number, i in enumerate(some) if len(vectors[i][0])], np.int64)
    for part in np.split(numbers, range(BATCH, len(numbers), BATCH)):
        own = [vectors[some[j]] for j in part]
        query = np.repeat(np.arange(len(part)), [len(t) for t, _ in own])
        found = made.nearest((query, *(np.concatenate([v[k] for v in own] or [np.zeros(0, np.int64)]) for k in (0, 1))), len(part), part)
        for number, (near, sims) in zip(part, found, strict=True):
            if len(near):
                votes.append((made.votes(near, sims, made.labels, float(labels.mean())), made.labels[number]))
    x, y = np.array([[v, 1.0] for v, _ in votes]).reshape(-1, 2), np.array([t for _, t in votes])
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w += np.linalg.solve(curve, x.T @ (y - p) - 1e-2 * w)
    made.slope, made.offset = float(w[0]), float(w[1])
    return made


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND, key: str = "doc_id", text: str = "text") -> Examples:
    """The index over a bounded sample of labelled documents; pass only the labels that may be learnt from."""
    rows = labelled_sample(docs, labels, label, bound, key, text)
    terms = sorted({t for _, _, own in rows for t in terms_of(words_of(own))}) if len({y for _, y, _ in rows}) == 2 else []
    df, n = document_frequencies(docs, terms, text) if terms else (np.zeros(0, np.int64), 0)
    return build(rows, dict(zip(terms, df.tolist(), strict=True)), n)


def score(docs: DataFrame, examples: Examples, text: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with each whole text's score between 0 and 1 and `neighbours`, the ids of up to five nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(examples)

    def work():
        own: Examples = shared.value
        known: dict = {}

        def of(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            if len(known) > REMEMBER:
                known.clear()
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
            known.update(zip(new, own.score_all(list(new.values())), strict=True))
            got = [known[k] for k in keys]
            return [pa.array([s for s, _ in got], pa.float64()), pa.array([[str(i) for i in ids] for _, ids in got], pa.list_(pa.string()))]

        return of

    return add_columns(docs, text, T.StructType().add(out, T.DoubleType()).add("neighbours", T.ArrayType(T.StringType())), work, drop)
