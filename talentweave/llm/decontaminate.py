"""Benchmark decontamination with a generalised suffix automaton.

All benchmark items go into one automaton over word numbers. Document words stream through it while the longest match
that ends at each word is tracked, up to the window; a match as long as the window, or a whole item shorter than that,
is an occurrence. Runs of words that cannot hold one (a word pair of theirs is in no item) are passed over at once.

Words: `[0-9a-z]` and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive words of an item; an item
of fewer words is one window; items without words never occur. Null or empty texts have no words and no hits. Items
whose id is null count as hits but are not listed. Repeated items and rows are allowed; texts of any
length are read whole; extra columns pass through, and those named like the new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.llm.common import add_columns, unused

WINDOW = 13
#: Benchmark text that goes into one automaton (some 200 MB in a worker); more of it makes several, one after another.
BLOCK_BYTES = 1_000_000
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton of items, which tells where their windows occur in a stream of words."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        texts = [(item, [self.number.setdefault(w, len(self.number)) for w in words_of(text)]) for item, text in items]
        texts = [(item, seq) for item, seq in texts if seq]
        self.shortest = min([window, *(len(seq) for _, seq in texts)])
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs = set()
        for _, seq in texts:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            pairs.update(zip(seq, seq[1:], strict=False))
        self.base = len(self.number) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        # Whose windows a state stands for: full ones by state, short items by state and length.
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for item, seq in texts:
            state = n = 0
            for i, c in enumerate(seq):
                state, n = self._step(state, n, c)
                if i >= window - 1:
                    self.full.setdefault(state, set()).add(item)
            if len(seq) < window:
                self.short.setdefault(state, {}).setdefault(len(seq), set()).add(item)
        # The nearest state on the way to the root, itself included, at which a short item ends.
        self.near = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.near[state] = state if state in self.short else self.near[self.link[state]] if state else -1

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        state = self._new(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def _new(self, length: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """State and length (at most the window) of the longest match that ends with word c."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if c in self.next[state]:
            state, n = self.next[state][c], n + 1
        if n >= self.window:
            n = self.window
            while self.length[self.link[state]] >= n:
                state = self.link[state]
        return state, n

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that may hold an occurrence; -1 is a word of no item."""
        if self.shortest == 1:
            good, least = ids >= 0, 1
        else:
            good = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.flatnonzero(good)
            key = ids[at] * self.base + ids[at + 1]
            if len(self.pairs):
                place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                good[at] = self.pairs[place] == key
            least = self.shortest - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        ok = ends - starts >= least
        return list(zip(starts[ok].tolist(), (ends[ok] + (self.shortest > 1)).tolist(), strict=True))

    def scan(self, ids: list[int], at: int = 0) -> list[tuple[int, int, set]]:
        """(first word, end, items) of each occurrence; `at` is the number of the first word of ids."""
        found, state, n = [], 0, 0
        for i, c in enumerate(ids, at + 1):
            state, n = self._step(state, n, c)
            if n == self.window:
                found.append((i - n, i, self.full[state]))
            if self.short and (u := self.near[state]) >= 0:
                while u > 0:
                    found += [(i - k, i, items) for k, items in self.short[u].items() if k <= n]
                    u = self.near[self.link[u]]
        return found


def _spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items, in lists of about BLOCK_BYTES of text, one after another; a longer item makes a list of its own size."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size * 2 // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    block = F.pmod(F.xxhash64(F.col(item), F.col(text)), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in benchmark.where(block == i).select(item, text).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence), hit_items (ids, sorted) and hit_spans.

    hit_spans are the code points from the first to the end of the last word of each joined run of hit words.
    """
    kind = T.ArrayType(benchmark.schema[item].dataType)
    out, names = docs, []
    for i, items in enumerate(_blocks(benchmark, item, item_text)):
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window))

        def work(shared=shared):
            auto: Automaton = shared.value
            get = auto.number.get

            def of(column: pa.Array) -> list[pa.Array]:
                texts = column.to_pylist()
                ids, first = [], [0]
                for t in texts:
                    ids += [get(w, -1) for w in words_of(t)]
                    ids.append(-1)
                    first.append(len(ids))
                flat = np.array(ids, np.int64)
                hits: dict[int, tuple[list, set]] = {}
                for a, b in auto.runs(flat):
                    if got := auto.scan(ids[a:b], a):
                        d = int(np.searchsorted(first, a, "right")) - 1
                        where, whose = hits.setdefault(d, ([], set()))
                        for x, y, its in got:
                            where.append((x - first[d], y - first[d]))
                            whose |= its
                n_words = [b - a - 1 for a, b in zip(first, first[1:], strict=False)]
                found_words, found_chars, found_items = [], [], []
                for d, t in enumerate(texts):
                    if d not in hits:
                        found_words.append([])
                        found_chars.append([])
                        found_items.append([])
                        continue
                    where = _spans(hits[d][0])
                    ends = [m.span() for m in _WORD.finditer(t)]
                    found_words.append([{"start": x, "end": y} for x, y in where])
                    found_chars.append([{"start": ends[x][0], "end": ends[y - 1][1]} for x, y in where])
                    found_items.append(sorted(x for x in hits[d][1] if x is not None))
                arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                return [pa.array(n_words, pa.int64()), pa.array(found_words, arrow), pa.array(found_chars, arrow), pa.array(found_items, to_arrow)]

            from pyspark.sql.pandas.types import to_arrow_type

            to_arrow = to_arrow_type(kind)
            return of

        names.append(tuple(unused(docs, f"_{x}_{i}") for x in ("words", "chars", "items")))
        new = T.StructType().add("n_words", T.LongType()).add(names[-1][0], _SPAN).add(names[-1][1], _SPAN).add(names[-1][2], kind)
        out = add_columns(out, text, new, work)
    if len(names) == 1:
        (w, c, x), = names
        out = out.withColumns({"n_hit": F.expr(f"aggregate({w}, 0L, (a, s) -> a + s.end - s.start)"), "hit_items": F.col(x), "hit_spans": F.col(c)})
    else:
        words, chars, items = (F.flatten(F.array(*cols)) for cols in zip(*names, strict=True))
        inside = F.array_distinct(F.flatten(F.transform(words, lambda s: F.sequence(s["start"], s["end"] - 1))))
        out = out.withColumns({"n_hit": F.size(inside).cast("long"), "hit_items": F.array_sort(F.array_distinct(items)), "hit_spans": F.array_sort(chars)})
    return out.drop(*(c for cols in names for c in cols))


def contaminated(coverage: float = 0.05):
    """Of a scan's row: hit words make up at least this share of its words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(coverage) * F.col("n_words")) if coverage != 0.05 else (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_spans(scanned: DataFrame, text: str = "text", min_chars: int = 0, coverage: float = 0.05) -> DataFrame:
    """scanned with the hit spans cut out of texts beyond the coverage limit, and spans of min_chars or more elsewhere
    where min_chars is over 0. What stands before and after a cut stays as it is, joined by one line break."""
    beyond, n = unused(scanned, "_over"), int(min_chars)
    at = f"filter(hit_spans, s -> {beyond} or ({n} > 0 and s.end - s.start >= {n}))"
    piece = f"""aggregate({at}, struct(0 as at, cast(array() as array<string>) as parts),
        (a, s) -> struct(greatest(a.at, s.end) as at, case when s.start > a.at then array_append(a.parts, substring({text}, a.at + 1, s.start - a.at)) else a.parts end as parts),
        a -> array_join(array_append(a.parts, substring({text}, a.at + 1, length({text}))), '\\n'))"""
    over = scanned.withColumn(beyond, contaminated(coverage))
    return over.withColumn(text, F.when(F.expr(f"size({at}) > 0"), F.expr(piece)).otherwise(F.col(text))).drop(beyond)
