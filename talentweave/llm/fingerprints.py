"""Document fingerprints by consistent weighted sampling, as SQL expressions inside the row.

A document is its shingles of `size` words, weighted by how often each occurs: a term of weight w has the units (term, 1)
to (term, w). For each of SLOTS slots every unit draws a number, by hashes of unit and slot alone, and the slot's sample
is the unit of the least. So a sample is uniform over all weighted terms and consistent: a weight that grows keeps it or
moves it to the grown term. Two documents' samples in a slot agree with a probability of their generalised Jaccard
similarity, so the share of agreeing slots estimates it without bias.

Few of the draws are looked at. A unit draws its own hash in the one slot that the hash's leading bits name, which it
favours, and more than any such draw in each other slot. In a slot that some unit favours the least of those is the
least of all; only in a slot that none favours all units are hashed with the slot. For n units and s slots that makes
n + n * s * exp(-n / s) draws on the average, under n + 0.4 * s * s, not n * s.

Words are those of Python's str.split() on the lower-cased text. Hashes are XXH64, so that equal texts have equal
fingerprints on machines of any kind. Time and memory grow with a text's length (but for the sorting of its hashes).

Null texts count as empty; a text of fewer words than a shingle is one shingle; texts without words have an empty
signature and are alike (1.0), and unlike all others (0.0). Equal texts have equal fingerprints whatever their ids.
Repeated rows give repeated results; extra columns pass through, and one named like the result is replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.common import cut

SHINGLE, SLOTS = 5, 64
#: Spark's seed of XXH64, and the white space that str.split() knows.
_SEED = 42
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _let(value: str, name: str, body: str) -> str:
    """body, in which `name` stands for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _slot(x: str, slots: int) -> str:
    """The slot that x favours: equal shares of the 64-bit numbers, in their order."""
    return f"shiftright((shiftright({x}, 32) + 2147483648L) * {slots}L, 32)"


def _low(x: str) -> str:
    return f"cast(shiftright(shiftleft({x}, 32), 32) as int)"


def _terms(size: int) -> str:
    """The hashes of all shingles of the words ws, ascending."""
    rest = ", ".join(f"ws[i + {k}]" for k in range(1, size))
    each = f"transform(slice(ws, 1, size(ws) - {size - 1}), (w, i) -> xxhash64(w{', ' if rest else ''}{rest}))"
    return f"sort_array(if(size(ws) >= {size}, {each}, if(size(ws) > 0, array(xxhash64(ws)), cast(array() as array<bigint>))))"


def _units() -> str:
    """The units of the terms hs, ascending: a term's first is its hash; further ones are hashed with their number."""
    runs = "filter(sequence(0, size(ds) - 1), i -> i = 0 or ds[i] <> ds[i - 1])"
    further = "flatten(transform(rs, (p, j) -> transform(sequence(2L, coalesce(get(rs, j + 1), size(ds)) - p + 1L), k -> xxhash64(ds[p], k))))"
    repeated = _let("filter(hs, (h, i) -> i > 0 and h = hs[i - 1])", "ds", _let(runs, "rs", further))
    return f"if(size(array_distinct(hs)) = size(hs), hs, sort_array(concat(array_distinct(hs), {repeated})))"


def _samples(slots: int) -> str:
    """32 bits of the unit sampled in each slot, of the units us; none without units."""
    least = f"filter(us, (u, i) -> i = 0 or {_slot('u', slots)} <> {_slot('us[i - 1]', slots)})"
    rest = "array_min(transform(us, u -> xxhash64(u, j)))"
    searched = _let("cast(array_position(ts, j) as int)", "p", _low(f"if(p > 0, ls[p - 1], {rest})"))
    some = _let(f"transform(ls, l -> {_slot('l', slots)})", "ts", f"transform(sequence(0L, {slots - 1}L), j -> {searched})")
    return _let(least, "ls", f"if(size(ls) in (0, {slots}), transform(ls, l -> {_low('l')}), {some})")


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE, slots: int = SLOTS, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the signature of each whole text: an int for each slot, none for a text without words."""
    kept = [(f"c{i}", c) for i, c in enumerate(df.columns) if c not in {*drop, out}]
    words = f"array_remove(split(lower(coalesce(c{df.columns.index(text)}, '')), r'{_SPACE}'), '')"
    signed = _let(words, "ws", _let(_terms(size), "hs", _let(_units(), "us", _samples(slots))))
    # Numbered names inside: expressions would not find those with dots and ticks.
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(c for c, _ in kept), F.expr(signed)).toDF(*(c for _, c in kept), out)


def _hashed(*parts: bytes | int) -> int:
    """xxhash64 of strings and longs: each hash is the seed of the next."""
    seed = _SEED
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else (p % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def terms_of(text: str | None, size: int, known: dict[tuple, int]) -> tuple[np.ndarray, np.ndarray]:
    """In plain Python: the hashes of a text's distinct shingles, ascending, and how often each occurs. known: hashes
    of shingles met before."""
    words = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    n = min(size, len(words))
    shingles = [tuple(words[i : i + n]) for i in range(len(words) - n + 1 if n else 0)]
    known |= {s: _hashed(*s) for s in {*shingles} - known.keys()}
    return np.unique(np.array([known[s] for s in shingles], np.int64), return_counts=True)


class Draws:
    """The samples in plain Python, draw by draw; the tests compare the expressions with it."""

    @classmethod
    def make(cls) -> Draws:
        return cls()

    def signature(self, terms: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
        """For each slot 32 bits of the sampled unit. Terms are distinct, weights whole numbers."""
        units = [_hashed(x, k) if k > 1 else x for x, w in zip(terms.astype(np.int64).tolist(), weights.tolist(), strict=True) for k in range(1, w + 1)]
        favoured: dict[int, int] = {}
        for u in sorted(units):
            favoured.setdefault(((u >> 32) + 2**31) * slots >> 32, u)
        return np.array([favoured[j] if j in favoured else min(_hashed(u, j) for u in units) for j in range(slots if units else 0)], np.int64).astype(np.int32)


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """The inverse of Gamma(2, 1)'s distribution function 1 - (1 + x) exp(-x), by bisection. Weights that are no whole
    numbers would need it; counts of shingles do not."""
    low, high = np.zeros(len(p)), np.full(len(p), 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def likeness(a: str, b: str):
    """Share of slots with equal samples; 1 for two empty signatures, 0 for an empty and another one."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1D, {same} / greatest(size({a}), size({b})))")


def as_text(c: str):
    return F.expr(f"lower(array_join(transform({c}, v -> lpad(hex(v & 4294967295L), 8, '0')), ''))")


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, next, n): each distinct key, the next larger one (after the last the first) and its text's code points.

    Keys are dealt to ranges; neighbours are found inside a range, and a row for each range bridges to the next.
    Keys are not null.
    """
    ids = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.length(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n"))
    ranged = cut(ids.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    # As few rows as there are ranges.
    firsts = ranged.groupBy("range").agg(F.min(key).alias("first"))
    order = Window.orderBy("range")
    bridge = firsts.select("range", F.coalesce(F.lead("first").over(order), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bridge"))
    inside = F.lead(key).over(Window.partitionBy("range").orderBy(key))
    return ranged.withColumn("next", inside).join(F.broadcast(bridge), "range").select(key, F.coalesce("next", "bridge").alias("next"), "n")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next, edited): the last floor(n / 2) code points of a text are replaced by the first as many (or
    all) of the next document's. Rows that share a key share its next one, whose text is the least of its rows; the
    number replaced is that of the key's longest text. A null key has no next document and an empty replacement."""
    after = cut(successors(docs, key, text))
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    wanted = after.select(F.col("next").alias(key), F.col(key).alias("_for"), F.expr("n div 2").cast("int").alias("_half"))
    # Texts move once, to their keys; from there the heads alone move on to the keys before.
    placed = body.join(wanted.hint("merge"), key, "left")
    least = placed.groupBy(key).agg(F.min(text).alias("_t"), F.first("_for").alias("_for"), F.first("_half").alias("_half")).where("_for is not null")
    heads = least.select(F.col("_for").alias(key), F.col(key).alias("next"), F.expr("left(_t, _half)").alias("head"))
    n = f"length({text})"
    paired = body.join(heads.hint("merge"), key, "left")
    return paired.withColumn("edited", F.expr(f"concat(left({text}, {n} - {n} div 2), left(coalesce(head, ''), {n} div 2))")).select(key, text, "next", "edited")
