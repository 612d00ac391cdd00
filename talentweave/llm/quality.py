"""Document quality from a linear-chain conditional random field over lines.

Every line is a node with two labels, bad and good. A node's features are shapes of the line (shares of letters, case,
marks and digits, repetition, lengths) and the same shapes of the lines before and after; the chain adds a weight for
each pair of neighbouring labels. Forward-backward gives each line's probability of being good; their mean, weighted
by the lines' lengths, is the document's evidence, and a logistic curve fitted on the training documents turns it into
a score.

Only documents carry labels. Lines start with their document's label; after a first fit, lines of bad documents that
the field finds clearly good may keep that (one round), so that good lines inside bad documents do not blur it.

Training takes at most `bound` labelled documents of each class, those whose hashed ids come first. It and scoring take
whole texts. Labels, language, source and id are no features.

A null or empty text is one empty line and gets a score like any other. Texts of one very long line or of very many
lines are scored in full: lines are turned into shapes in chunks, and a text of more than LONG lines goes through the
recursions by itself, so that a line takes some 100 bytes. In training a line takes about 0.5 kB. Repeated label rows count once, with the largest value; null labels do not count. Without
labels of both classes every score is 0.5. Equal texts have equal scores; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.llm.common import add_columns, labelled_sample

#: Labelled documents of each class that the field is fitted on, at most.
BOUND = 1500
N_SHAPES = 16
N_FEATURES = 3 * N_SHAPES + 3
#: Lines whose shapes are in memory at a time when scoring, and lines of a text that goes through the recursions alone.
LINES, LONG = 8192, 2000


def _byte_classes() -> np.ndarray:
    """For each byte its class: upper, lower, digit, space, stop mark, other mark, pipe, non-ASCII lead, non-ASCII rest."""
    kind = np.full(256, 5, np.uint8)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A] = 0, 1, 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[list(b".,;:?'\"-()")] = 4
    kind[list(b"|")] = 6
    kind[0xC0:], kind[0x80:0xC0] = 7, 8
    return kind


_KIND = _byte_classes()


def line_shapes(lines: list[bytes]) -> np.ndarray:
    """N_SHAPES numbers of each line, each about between 0 and 1."""
    size = np.array([len(x) for x in lines], np.int64)
    out = np.zeros((len(lines), N_SHAPES))
    raw = np.frombuffer(b"".join(x + b"\n" for x in lines), np.uint8)
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    kinds = _KIND[raw]
    counts = np.stack([np.add.reduceat((kinds == k), starts, dtype=np.int64) for k in range(9)], axis=1).astype(float)
    counts[:, 3] -= 1  # the added line break
    chars = size - counts[:, 8]
    per = np.maximum(chars, 1)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 7]
    out[:, 0] = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    out[:, 1] = letters / per
    out[:, 2] = np.minimum(1, 4 * counts[:, 2] / per)
    out[:, 3] = np.minimum(1, 2 * counts[:, 3] / per)
    out[:, 4] = np.minimum(1, 8 * counts[:, 4] / per)
    out[:, 5] = np.minimum(1, 4 * counts[:, 5] / per)
    out[:, 6] = np.minimum(1, 8 * counts[:, 6] / per)
    # Marks that repeat at once, as in "!!" or "%%%".
    twice = np.append((raw[1:] == raw[:-1]) & ((kinds[1:] == 5) | (kinds[1:] == 4)), False)
    out[:, 7] = np.minimum(1, 8 * np.add.reduceat(twice, starts, dtype=np.int64) / per)
    for i, x in enumerate(lines):
        words = x.split()
        n = len(words)
        if n > 1:
            unique = len(set(words))
            out[i, 8] = 1 - unique / n
            out[i, 9] = sum(map(bytes.__eq__, words, words[1:])) / (n - 1)
        if n:
            out[i, 10] = min(1.0, (size[i] / n) / 20)
            out[i, 11] = min(1.0, n / 60)
    out[:, 12] = np.minimum(1, np.log1p(chars) / 8)
    last = np.where(size > 0, raw[np.maximum(ends - 2, 0)], 0)
    out[:, 13] = np.isin(last, np.frombuffer(b".!?\"')", np.uint8))
    first = np.where(size > 0, kinds[starts], 3)
    out[:, 14] = (first == 0) | (first == 7)
    out[:, 15] = size == 0
    return out


def lines_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of all texts, their weights (length, 1 at least) and where each text's lines begin."""
    lines: list[bytes] = []
    first = [0]
    for t in texts:
        lines += (t or "").encode("utf-8", "surrogatepass").split(b"\n")
        first.append(len(lines))
    return lines, np.fromiter((len(x) or 1 for x in lines), np.int64, len(lines)), np.array(first)


def features(lines: list[bytes], at: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Node features of the lines from start to stop: their shapes, those of the lines before and after in their text,
    a constant and whether they are a text's first or last."""
    stop = len(lines) if stop is None else stop
    low, high = max(0, start - 1), min(len(lines), stop + 1)
    shapes = line_shapes(lines[low:high])
    shapes = np.vstack([np.zeros((low - start + 1, N_SHAPES)), shapes, np.zeros((stop + 1 - high, N_SHAPES))])
    own, before, after = shapes[1:-1], shapes[:-2].copy(), shapes[2:].copy()
    edge = np.zeros((stop - start, 3))
    edge[:, 0] = 1
    heads, tails = at[:-1] - start, at[1:] - 1 - start
    heads, tails = heads[(heads >= 0) & (heads < stop - start)], tails[(tails >= 0) & (tails < stop - start)]
    before[heads], after[tails], edge[heads, 1], edge[tails, 2] = 0, 0, 1, 1
    return np.hstack([own, before, after, edge])


@dataclass
class Field:
    """Weights of a node being good, weights of neighbouring labels [before, after], and the score's curve."""

    node: np.ndarray
    pair: np.ndarray
    slope: float = 0.0
    offset: float = 0.0


def _padded(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line values as a row for each text, and which places are lines."""
    n = np.diff(at)
    place = np.arange(n.max(initial=0))[None, :]
    mask = place < n[:, None]
    grid = np.zeros(mask.shape)
    grid[mask] = values
    return grid, mask


def _forward_backward(score: np.ndarray, mask: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each place, and each text's expected counts of neighbouring labels."""
    n, m = score.shape
    weight = np.exp(pair - pair.max())
    emit = np.stack([1 / (1 + np.exp(np.clip(score, -30, 30))), 1 / (1 + np.exp(-np.clip(score, -30, 30)))], axis=2)
    forward, backward = np.empty((n, m, 2)), np.ones((n, m, 2))
    forward[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for j in range(1, m):
        now = (forward[:, j - 1] @ weight) * emit[:, j]
        forward[:, j] = np.where(mask[:, j, None], now / now.sum(1, keepdims=True), forward[:, j - 1])
    for j in range(m - 2, -1, -1):
        now = (backward[:, j + 1] * emit[:, j + 1]) @ weight.T
        backward[:, j] = np.where(mask[:, j + 1, None], now / now.sum(1, keepdims=True), 1.0)
    both = forward * backward
    good = both[:, :, 1] / both.sum(2)
    joint = forward[:, :-1, :, None] * weight * (emit[:, 1:] * backward[:, 1:])[:, :, None, :]
    joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
    return good, (joint * mask[:, 1:, None, None]).sum(1)


def _one_chain(score: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(good) of each line of one text: forward-backward with a number for each line, the odds of good."""
    (w00, w01), (w10, w11) = np.exp(pair - pair.max()).tolist()
    odds = np.exp(np.clip(score, -30, 30))
    forward = np.empty(len(odds))
    f = 0.0
    for i in range(0, len(odds), LINES):
        out = []
        for j, e in enumerate(odds[i : i + LINES].tolist(), i):
            f = e * (w01 + w11 * f) / (w00 + w10 * f) if j else e
            out.append(f)
        forward[i : i + LINES] = out
    b = 1.0
    for i in range((len(odds) - 1) // LINES * LINES, -1, -LINES):
        out = []
        for e in reversed(odds[i : i + LINES].tolist()):
            out.append(b)
            b = (w10 + w11 * e * b) / (w00 + w01 * e * b)
        forward[i : i + LINES] *= out[::-1]
    return forward / (1 + forward)


def _alike(at: np.ndarray, wanted: np.ndarray | None = None):
    """Wanted texts (all, if not said) of like length together: their line numbers, one after the other, and where each
    one's begin."""
    n = np.diff(at)
    order = np.argsort(n, kind="stable")
    order = order if wanted is None else order[wanted[order]]
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and n[order[stop]] <= 1.5 * n[order[start]] + 4 and (stop - start) * n[order[stop]] < 200_000:
            stop += 1
        rows = order[start:stop]
        yield np.concatenate([np.arange(at[r], at[r + 1]) for r in rows]), np.append(0, np.cumsum(n[rows]))
        start = stop


def marginals(field: Field, score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """P(good) of each line, from the node scores. Texts of like length go through the recursions together."""
    out = np.empty(len(score))
    n = np.diff(at)
    for i in np.flatnonzero(n > LONG):
        out[at[i] : at[i + 1]] = _one_chain(score[at[i] : at[i + 1]], field.pair)
    for lines, own in _alike(at, n <= LONG):
        grid, mask = _padded(score[lines], own)
        out[lines] = _forward_backward(grid, mask, field.pair)[0][mask]
    return out


def evidence(good: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's length-weighted mean of its lines' marginals."""
    return np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])


def _climb(x: np.ndarray, at: np.ndarray, y: np.ndarray, share: np.ndarray, field: Field, steps: int) -> None:
    """Gradient ascent (Adam) on the field's conditional likelihood of the texts' line labels y, each text weighing its
    share, with a small penalty."""
    seen = np.zeros((2, 2))
    groups = []
    number = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for lines, own in _alike(at):
        truth, mask = _padded(y[lines], own)
        labels, both = truth.astype(int), mask[:, 1:]
        weight = share[number[lines[own[:-1]]]]
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] += weight @ ((labels[:, :-1] == a) & (labels[:, 1:] == b) & both).sum(1)
        groups.append((lines, x[lines], own, weight))
    total = len(y)
    first, second = [np.zeros_like(field.node), np.zeros_like(field.pair)], [np.zeros_like(field.node), np.zeros_like(field.pair)]
    for step in range(1, steps + 1):
        ascent, expected = np.zeros_like(field.node), np.zeros((2, 2))
        for lines, own_x, own, weight in groups:
            grid, mask = _padded(own_x @ field.node, own)
            good, pairs = _forward_backward(grid, mask, field.pair)
            ascent += ((y[lines] - good[mask]) * share[number[lines]]) @ own_x
            expected += np.tensordot(weight, pairs, 1)
        slopes = [ascent / total - 1e-4 * field.node, (seen - expected) / total - 1e-3 * field.pair]
        for k, (target, slope) in enumerate(zip((field.node, field.pair), slopes, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            target += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def fit(texts: list[str | None], labels: list[int], steps: int = 60) -> Field:
    """The field of documents with labels 0 and 1; neutral if only one class is there."""
    field = Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return field
    own, weight, at = lines_of(texts)
    x = features(own, at)
    lines = np.repeat(y, np.diff(at))
    # The lines of either class of documents weigh the same together.
    share = np.where(y == 1, 0.5 / lines.mean(), 0.5 / (1 - lines.mean()))
    _climb(x, at, lines, share, field, steps)
    sure = marginals(field, x @ field.node, at)
    lines = np.where((lines == 0) & (sure > 0.9), 1.0, lines)
    for text in np.flatnonzero(y == 0):  # a bad document keeps a bad line
        own = slice(at[text], at[text + 1])
        if lines[own].all():
            lines[own] = 0.0
    _climb(x, at, lines, share, field, steps)
    # The curve from evidence to score, by Newton's steps, each class weighing the same.
    e = evidence(marginals(field, x @ field.node, at), weight, at)
    design = np.stack([e, np.ones(len(e))], axis=1)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (share * (y - p)) - 0.02 * len(y) * np.array([w[0] / 100, 0])
        curve = (design * (share * p * (1 - p))[:, None]).T @ design + 1e-3 * len(y) * np.eye(2)
        w += np.linalg.solve(curve, slope)
    field.slope, field.offset = float(w[0]), float(w[1])
    return field


def score_of(field: Field, texts: list[str | None]) -> np.ndarray:
    lines, weight, at = lines_of(texts)
    node = np.concatenate([features(lines, at, i, min(i + LINES, len(lines))) @ field.node for i in range(0, len(lines), LINES)])
    z = field.slope * evidence(marginals(field, node, at), weight, at) + field.offset
    return np.round(1 / (1 + np.exp(-z)), 9)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND, key: str = "doc_id", text: str = "text") -> Field:
    """The field fitted on a bounded sample of labelled documents; pass only the labels that may be learnt from."""
    rows = labelled_sample(docs, labels, label, bound, key, text)
    return fit([t for _, _, t in rows], [y for _, y, _ in rows])


def score(docs: DataFrame, field: Field, text: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with each whole text's score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return add_columns(docs, text, T.StructType().add(out, T.DoubleType()), lambda: lambda column: [pa.array(score_of(shared.value, column.to_pylist()))], drop)
