"""Personal data: base patterns, candidate generators and boosted trees, all as SQL expressions inside the row.

Four base kinds (email, ip, card, phone) follow fixed patterns and are always kept. Generators with high recall propose
further, overlapping spans: assignments of secrets, access keys, long random tokens, account numbers, digit groups,
spelt-out e-mail addresses, colon-separated addresses. Gradient-boosted trees over format and context features give
each candidate a margin, a logistic curve turns it into a probability, and a threshold for each kind, set on held-out
examples for a wanted precision, selects. Where selected candidates overlap, the surest stays; base spans win.

The trees are fitted on the driver on MADE sentences that a seeded generator writes, whose features the same
expressions compute; they run as nested IF expressions. Nothing in the main path is Python.

Null texts count as empty and have no spans; repeated rows give repeated results; extra columns pass through, whatever
their names, and one named like the result is replaced. Patterns are possessive and anchored; positions are running
sums in chunks, overlaps are found by sorting, and texts are cut in chunks, so that the time of a text grows in
proportion to its length and number of spans. Only a chain of candidates that overlap one another is compared in pairs.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds in their order, the base ones first.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "key", "token", "account", "digits", "spelt", "colons", "phone_in", "card_in")
#: Generators whose spans carry a base kind: they look inside longer runs that the base patterns read as one.
NAMED = {"phone_in": "phone", "card_in": "card"}
KINDS = BASE + EXTRA
_LOCAL = "[A-Za-z0-9._%+-]"
#: For each kind a pattern that finds the same matches as the plain form, and a cheap test that a match needs.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "{t} like '%@%'"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "_has_digit"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "_has_digit"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "{t} like '%+%'"),
    "secret": (r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth)["']?\s?[:=]\s?["']?[^\s"']{4,}+["']?""", "_has_sign"),
    "key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|sk_live_|xox[bap]-)[A-Za-z0-9_-]{16,}+", "_has_long"),
    "token": (r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])", "_has_long and _has_digit"),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "_has_digit"),
    "digits": (r"(?<![A-Za-z0-9.(])[(]?[0-9](?:[ ()./-]{0,2}[0-9]){5,14}+(?![A-Za-z0-9])", "_has_digit"),
    "spelt": (rf"(?i)(?<!{_LOCAL}){_LOCAL}{{2,}}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{{2,}}+ ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{{2,}}+(?![a-z0-9])", "_has_spelt"),
    "phone_in": (r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])", "{t} like '%+%'"),
    "card_in": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])", "_has_digit"),
    "colons": (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "{t} like '%:%:%:%'"),
}
#: Numbers of a candidate, from its text {b}, the lower-cased text before it {x} and its kind.
FEATURES = {
    "size": "length({b})",
    "digits": "length(regexp_replace({b}, '[^0-9]', ''))",
    "upper": "length(regexp_replace({b}, '[^A-Z]', ''))",
    "lower": "length(regexp_replace({b}, '[^a-z]', ''))",
    "marks": "length(regexp_replace({b}, '[A-Za-z0-9]', ''))",
    "turns": "regexp_count({b}, '[0-9][A-Za-z]') + regexp_count({b}, '[A-Za-z][0-9]')",
    "groups": "regexp_count({b}, '[0-9]+')",
    "hex": "if({b} rlike '^[0-9a-f]{16,}$', 1, 0)",
    "vowels": "length(regexp_replace({b}, '[^aeiouAEIOU]', ''))",
    "ssn": "if({b} rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$', 1, 0)",
    "local": "if({b} rlike '^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$', 1, 0)",
    "date": "if({b} rlike '^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}$', 1, 0)",
    "call": "if({x} rlike '(?:tel|phone|call|fax|mobile|cell|dial)[a-z.]{0,4}[ :]{0,3}$', 1, 0)",
    "owned": "if({x} rlike '(?:ssn|social|security|passport|account|iban|routing|card|patient|member)[a-z. ]{0,12}[ :#]{0,3}$', 1, 0)",
    "plain": "if({x} rlike '(?:version|page|isbn|order|invoice|price|total|build|chapter|issue|commit|date|part|item|room|line)[a-z. ]{0,8}[ :#]{0,3}$', 1, 0)",
    "sort": "s.rank",
}
NAMES = tuple(FEATURES)
MADE, TREES, DEPTH, RATE, PRECISION, SEED = 3000, 24, 3, 0.3, 0.98, 11
#: Characters before a candidate that are its context, numbers in a chunk of a running sum, code points in one of a text.
CONTEXT, CHUNK, PIECE = 24, 128, 4096


def _luhn(d: str) -> str:
    """d, a string of digits, passes Luhn's check: from the right every second digit counts double."""
    return f"""aggregate(sequence(1, length({d})), 0, (a, i) -> a + (case when i % 2 = 1 then cast(substring({d}, length({d}) + 1 - i, 1) as int)
        when substring({d}, length({d}) + 1 - i, 1) >= '5' then 2 * cast(substring({d}, length({d}) + 1 - i, 1) as int) - 9
        else 2 * cast(substring({d}, length({d}) + 1 - i, 1) as int) end)) % 10 = 0"""


def _valid(kind: str) -> str:
    digits = "regexp_replace(s.body, '[^0-9]', '')"
    if kind == "ip":
        return "not exists(split(s.body, '[.]'), p -> not p rlike '^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')"
    if kind in ("card", "card_in"):
        return f"length({digits}) between 12 and 19 and {_luhn(digits)}"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body, in which `name` stands for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, op: str) -> str:
    """The sums or maxima (op: "+" or "greatest") of what comes before each of an array's numbers, and of all at the end.

    An array grows by copying, so chunks are added up by themselves and then moved by the total of those before.
    """
    both = (lambda a, b: f"{a} + {b}") if op == "+" else (lambda a, b: f"{op}({a}, {b})")
    chunks = f"transform(sequence(0, cast((size(vs) - 1) / {CHUNK} as int)), g -> aggregate(slice(vs, g * {CHUNK} + 1, {CHUNK}), array(0), (a, x) -> array_append(a, {both('element_at(a, -1)', 'x')})))"
    totals = f"aggregate(cs, array(0), (a, g) -> array_append(a, {both('element_at(a, -1)', 'element_at(g, -1)')}))"
    moved = f"concat(flatten(transform(cs, (g, j) -> transform(slice(g, 1, size(g) - 1), x -> {both('ts[j]', 'x')}))), array(element_at(ts, -1)))"
    return _let(values, "vs", _let(chunks, "cs", _let(totals, "ts", moved)))


def _find(df: DataFrame, kinds: tuple[str, ...], text: str) -> DataFrame:
    """df with an array _<kind> of (start, end, body, before) for each kind: the gaps between matches give the positions
    and what stands before."""
    gates = {"_has_digit": f"{text} rlike '[0-9]'", "_has_sign": f"{text} rlike '[:=]'", "_has_long": f"{text} rlike '[A-Za-z0-9_+/=-]{{16}}'", "_has_spelt": f"lower({text}) rlike '[ (\\\\[]at[ )\\\\]]' and lower({text}) rlike '[ (\\\\[]dot[ )\\\\]]'"}
    df = df.withColumns({g: F.expr(e) for g, e in gates.items()})
    some = "cast(array() as array<string>)"
    hits = {f"_h_{k}": F.expr(f"if({PATTERNS[k][1].format(t=text)}, regexp_extract_all({text}, {_quoted(PATTERNS[k][0])}, 0), {some})") for k in kinds}
    df = df.withColumns(hits)
    gaps = {f"_g_{k}": F.expr(f"if(size(_h_{k}) > 0, split({text}, {_quoted(PATTERNS[k][0])}, -1), {some})") for k in kinds}
    df = df.withColumns(gaps)
    found = {}
    for k in kinds:
        empty = "cast(array() as array<struct<start:int,end:int,body:string,before:string>>)"
        ends = _running(f"transform(_h_{k}, (h, i) -> length(_g_{k}[i]) + length(h))", "+")
        before = "''" if k in BASE else f"lower(right(concat(coalesce(get(_g_{k}, i - 1), ''), coalesce(get(_h_{k}, i - 1), ''), _g_{k}[i]), {CONTEXT}))"
        places = _let(ends, "es", f"transform(_h_{k}, (h, i) -> struct(es[i + 1] - length(h) as start, es[i + 1] as end, h as body, {before} as before))")
        found[f"_{k}"] = F.expr(f"if(size(_h_{k}) = 0, {empty}, filter({places}, s -> {_valid(k)}))")
    return df.withColumns(found).drop(*gates, *hits, *gaps)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _base, sorted spans (start, rank, end, kind), and _candidates, spans with their features."""
    df = _find(df, KINDS, text)
    base = ", ".join(f"transform(_{k}, s -> struct(s.start as start, {i} as rank, s.end as end, '{k}' as kind))" for i, k in enumerate(BASE))
    extra = ", ".join(f"transform(_{k}, s -> struct(s.start as start, {i + len(BASE)} as rank, s.end as end, '{NAMED.get(k, k)}' as kind, s.body as body, s.before as before))" for i, k in enumerate(EXTRA))
    df = df.withColumns({"_base": F.expr(f"array_sort(concat({base}))"), "_open": F.expr(f"concat({extra})")})
    # A candidate is free if no base span that starts before its end reaches beyond its start: base spans by their
    # starts and candidates by their ends in one order, with the running maximum of the base spans' ends.
    events = "array_sort(concat(transform(_base, b -> struct(b.start as at, 1 as sort, -1 as i, b.end as reach)), transform(_open, (s, i) -> struct(s.end as at, 0 as sort, i as i, 0 as reach))))"
    reached = _let(events, "es", _let(_running("transform(es, e -> e.reach)", "greatest"), "ms", "transform(filter(transform(es, (e, j) -> struct(e.i as i, ms[j] as reach)), x -> x.i >= 0 and x.reach <= _open[x.i].start), x -> _open[x.i])"))
    df = df.withColumn("_free", F.expr(f"if(size(_base) = 0 or size(_open) = 0, _open, {reached})"))
    numbers = ", ".join(f"cast({e.replace('{b}', 's.body').replace('{x}', 's.before')} as double) as {n}" for n, e in FEATURES.items())
    return df.withColumn("_candidates", F.expr(f"transform(_free, s -> struct(s.start as start, s.rank as rank, s.end as end, s.kind as kind, {numbers}))")).drop("_open", "_free", *(f"_{k}" for k in KINDS))


@dataclass(frozen=True)
class Trees:
    """Trees as nested tuples (feature, bound, left, right) or leaf values, a curve, and each kind's threshold."""

    trees: tuple
    slope: float
    offset: float
    thresholds: tuple[tuple[str, float], ...]

    def margin(self, s: str = "s") -> str:
        def of(t) -> str:
            if isinstance(t, float):
                return f"{t!r}D"
            return f"if({s}.{NAMES[t[0]]} <= {t[1]!r}D, {of(t[2])}, {of(t[3])})"

        return " + ".join(map(of, self.trees)) or "0D"

    def chance(self, s: str = "s") -> str:
        return f"1D / (1D + exp(-({self.slope!r}D * ({self.margin(s)}) + {self.offset!r}D)))"


def _passes(d: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def _sentences(n: int, seed: int) -> list[tuple[int, str, int, int, int]]:
    """(number, sentence, start and end of the item in it, whether it is personal) from a seeded generator."""
    rng = random.Random(seed)
    pick = rng.choice
    syllables = ("an", "re", "th", "ion", "mo", "la", "vi", "ker", "sto", "el", "dun", "pa")
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    some = lambda a, k: "".join(pick(a) for _ in range(k))
    digits = lambda k: some("0123456789", k)
    checked = lambda d: d + next(c for c in "0123456789" if _passes(d + c))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    personal = (
        lambda: f"{pick(('password', 'pwd', 'passwd', 'secret', 'api_key', 'token'))}{pick(('=', ': ', ' = '))}{pick(('', chr(34)))}{some('0123456789abcdef', rng.randint(12, 40))}",
        lambda: f"{pick(('AKIA', 'ASIA'))}{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}",
        lambda: f"{pick(('AKIA', 'ASIA'))}{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 16)}",
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)} {digits(16)}",
        lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)} {digits(12)}",
        lambda: f"{digits(6)} {checked('4' + digits(14))}",
        lambda: f"{pick(('ghp_', 'sk-', 'xoxb-'))}{some(alnum, rng.randint(20, 40))}",
        lambda: some(alnum, rng.randint(24, 48)) + "9aZ",
        lambda: some("0123456789abcdef", pick((32, 40, 64))),
        lambda: f"{pick(('DE', 'FR', 'ES', 'GB'))}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
        lambda: f"{pick(('ssn', 'social security number', ''))} {digits(3)}-{digits(2)}-{digits(4)}".strip(),
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{pick(('phone', 'call', 'tel', 'mobile'))}: {digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{pick(('account', 'passport', 'card', 'member'))} {digits(rng.randint(8, 12))}",
        lambda: f"{word()} {pick(('(at)', '[at]', ' at ')).strip()} {word()} {pick(('(dot)', '[dot]', 'dot'))} com",
        lambda: ":".join(some("0123456789abcdef", 4) for _ in range(8)),
        lambda: ":".join(some("0123456789abcdef", 2) for _ in range(6)),
    )
    plain = (
        lambda: f"{pick(('version', 'build', ''))} {digits(1)}.{digits(2)}.{digits(4)}".strip(),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2030)}",
        lambda: f"{pick(('order', 'invoice', 'item', 'part', 'page', 'total'))} {digits(rng.randint(6, 14))}",
        lambda: digits(rng.randint(13, 19)),
        lambda: f"isbn {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: "-".join(word() for _ in range(rng.randint(4, 7))) + pick(("", "-2", "-10")),
        lambda: "/".join(word() for _ in range(rng.randint(4, 7))) + "/index2",
        lambda: "".join(word() for _ in range(rng.randint(5, 8))),
        lambda: "=" * rng.randint(16, 40) + pick(("", "1")),
        lambda: "-" * rng.randint(16, 40) + pick(("", "2")),
        lambda: f"{rng.randint(1000, 2000)} {rng.randint(1000, 2000)} {rng.randint(1000, 2000)}",
        lambda: f"token {word()}: {word()}",
        lambda: f"secret: {word()}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"look at {word()} dot",
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + "_" + word().upper() + "_1",
    )
    out = []
    for i in range(n):
        mine = i % 2
        item = pick(personal if mine else plain)()
        head = " ".join(word() for _ in range(rng.randint(0, 8)))
        head += " " if head else ""
        out.append((i, head + item + " " + " ".join(word() for _ in range(rng.randint(0, 5))), len(head), len(head) + len(item), mine))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree on gradients and curvatures that gains the most at each split; leaves shrink by RATE."""
    total = g.sum() ** 2 / (h.sum() + 1)
    best = (1e-3, None, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            bounds = (values[1:] + values[:-1]) / 2
            if len(bounds) > 24:
                bounds = bounds[np.linspace(0, len(bounds) - 1, 24).astype(int)]
            order = np.searchsorted(bounds, x[:, f], "left")
            gl = np.cumsum(np.bincount(order, g, len(bounds) + 1))[:-1]
            hl = np.cumsum(np.bincount(order, h, len(bounds) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, float(bounds[k]))
    if best[1] is None:
        return float(round(RATE * g.sum() / (h.sum() + 1), 9))
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _run(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _run(tree[2], x[low]), _run(tree[3], x[~low])
    return out


@lru_cache(maxsize=4)
def _fit(rows: tuple) -> Trees:
    x = np.array([r[1] for r in rows], float)
    y = np.array([r[2] for r in rows], float)
    held = np.array([r[0] % 3 == 2 for r in rows])
    margin, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin[~held]))
        trees.append(_grow(x[~held], y[~held] - p, p * (1 - p), DEPTH))
        margin += _run(trees[-1], x)
    m, t = np.stack([margin[held], np.ones(held.sum())], axis=1), y[held]
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w += np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 0.1 * np.eye(2), m.T @ (t - p) - 0.1 * (w - [1, 0]))
    chance = 1 / (1 + np.exp(-(m @ w)))
    thresholds = []
    for i, kind in enumerate(EXTRA):
        own = x[held][:, NAMES.index("sort")] == i + len(BASE)
        limit = 0.5
        for c in sorted(set(chance[own]), reverse=True):
            if t[own & (chance >= c)].mean() < PRECISION:
                limit = max(limit, float(np.nextafter(c, 1)))
                break
        thresholds.append((kind, limit))
    return Trees(tuple(trees), float(w[0]), float(w[1]), tuple(thresholds))


def train(spark: SparkSession, made: int = MADE, seed: int = SEED) -> Trees:
    """Trees fitted on `made` written sentences, whose candidates' features the engine computes."""
    rows = _sentences(made, seed)
    df = candidates(spark.createDataFrame(rows, "id long, text string, first int, last int, y int").repartition(1))
    flat = df.selectExpr("id", "first", "last", "y", "explode(_candidates) as s").select("id", "first", "last", "y", "s.*")
    got = []
    for r in flat.collect():
        common = min(r.last, r.end) - max(r.first, r.start)
        got.append((r.id, tuple(r[n] for n in NAMES), int(r.y == 1 and 2 * common > r.end - r.start)))
    return _fit(tuple(sorted(got)))


def find(df: DataFrame, trees: Trees, text: str = "text", out: str = "spans") -> DataFrame:
    """df with `out`: all spans (start, rank, end, kind) in code points, end exclusive, by start and kind. A base span
    has a rank under 4."""
    # The row is kept in one struct, so that no column of it can be taken for one of ours.
    own = candidates(df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    limit = "case s.rank " + " ".join(f"when {len(BASE) + EXTRA.index(k)} then {t!r}D" for k, t in trees.thresholds) + " else 2D end"
    scored = f"transform(_candidates, s -> struct(s.start as start, s.end as end, -({trees.chance()}) as p, s.rank as rank, s.kind as kind))"
    own = own.withColumn("_scored", F.expr(f"array_sort(filter({scored}, s -> -s.p >= {limit}))"))
    # Of candidates that overlap the surest stays. Those between two places that none reaches across are a chain.
    first = "filter(sequence(0, size(_scored) - 1), i -> _scored[i].start >= ms[i])"
    chains = "transform(fs, (f, j) -> slice(_scored, f + 1, coalesce(get(fs, j + 1), size(_scored)) - f))"
    empty = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"
    span = "struct(s.start as start, s.rank as rank, s.end as end, s.kind as kind)"
    best = f"""aggregate(array_sort(transform(c, s -> struct(s.p as p, s.start as start, s.end as end, s.rank as rank, s.kind as kind))), {empty},
        (a, s) -> if(exists(a, o -> o.start < s.end and s.start < o.end), a, array_append(a, {span})))"""
    chosen = _let(_running("transform(_scored, s -> s.end)", "greatest"), "ms", _let(first, "fs", f"flatten(transform({chains}, c -> {best}))"))
    own = own.withColumn("_spans", F.expr(f"array_sort(concat(_base, if(size(_scored) = 0, {empty}, {chosen})))"))
    return own.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != out.lower()), F.col("_spans").alias(out))


def as_text(spans: str = "spans", base_only: bool = False):
    """kind:start:end of the spans, comma-joined."""
    of = f"filter({spans}, s -> s.rank < {len(BASE)})" if base_only else spans
    return F.expr(f"array_join(transform({of}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with every span of `text` replaced by its kind in brackets; overlapping spans become one, by the first kind."""
    # The text from code point a to b, out of pieces of equal length.
    part = lambda a, b: f"""if({b} <= {a}, '', if({a} div {PIECE} = ({b} - 1) div {PIECE}, substring(ps[cast({a} div {PIECE} as int)], cast({a} % {PIECE} as int) + 1, {b} - {a}),
        concat(substring(ps[cast({a} div {PIECE} as int)], cast({a} % {PIECE} as int) + 1, {PIECE}),
            array_join(slice(ps, cast({a} div {PIECE} as int) + 2, cast(({b} - 1) div {PIECE} - {a} div {PIECE} as int) - 1), ''),
            substring(ps[cast(({b} - 1) div {PIECE} as int)], 1, cast(({b} - 1) % {PIECE} as int) + 1))))"""  # noqa: E731
    heads = f"transform(filter(sequence(0, size({spans}) - 1), i -> {spans}[i].start >= ms[i]), i -> concat({part('ms[i]', f'{spans}[i].start')}, '[', upper({spans}[i].kind), ']'))"
    whole = f"concat(array_join({heads}, ''), {part('element_at(ms, -1)', f'length({text})')})"
    hidden = _let(f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", "ps", _let(_running(f"transform({spans}, s -> s.end)", "greatest"), "ms", whole))
    return df.withColumn(text, F.expr(f"if(size({spans}) > 0, {hidden}, {text})"))
