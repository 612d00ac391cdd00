"""Fuzzy joins, entity hits and spelling against bounded word lists, and scope resolution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import fuzzy
from talentweave.functions import lexicon as L
from talentweave.functions import text as X
from talentweave.operators.gramjoin import partial_ratio_join
from talentweave.sources.scratch import written

#: Rows of a side that is broadcast for a fuzzy join; a larger one is joined in blocks of about as many.
MOST_ROWS = 20_000


def name_tokens(question: Column, least: int = 3) -> Column:
    """Words of a question that may be names: long enough and not on the stop list."""
    words = F.transform(F.split(F.lower(F.trim(question)), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(L.STOP_NAMES))


def in_blocks(df: DataFrame, join: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """The union of join(block) over blocks of df of about `most` rows, dealt by hash; each is broadcast."""
    n = -(-df.count() // (most or MOST_ROWS))
    if n <= 1:
        return join(F.broadcast(df))
    block = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return reduce(DataFrame.unionByName, [join(F.broadcast(df.where(block == i))) for i in range(n)])


def fuzzy_names(tokens: DataFrame, people: DataFrame, cutoff: float = L.NAME_CUTOFF) -> DataFrame:
    """(query_name, matched_name, email, score): for each address the first token that matches its name, by token order.

    tokens (pos, token) and people (full_name, email) may both be of any size: distinct tokens and names meet on common
    q-grams, and only what can reach the cutoff is scored. Empty names, addresses and tokens match nothing.
    """
    known = people.where((F.coalesce("full_name", F.lit("")) != "") & (F.coalesce("email", F.lit("")) != "")).withColumn("_b", F.lower("full_name"))
    asked = tokens.where("token is not null").withColumn("_a", F.lower("token"))
    # Read three times below: written once.
    known = written(known.select("full_name", "email", "_b"))
    found = partial_ratio_join(asked.select("_a"), known.select("_b"), cutoff)
    # Of each name and text the first token, before people join.
    first = found.join(asked, found["a"] == asked["_a"]).groupBy("b").agg(F.min(F.struct("pos", "token", "score")).alias("m"))
    best = known.join(first, known["_b"] == first["b"]).groupBy("email").agg(F.min(F.struct("m.pos", "full_name", "m")).alias("r"))
    return best.select(F.col("r.m.token").alias("query_name"), F.col("r.full_name").alias("matched_name"), "email", F.round("r.m.score", 4).alias("score"))


def enrich_scope(selected: DataFrame, matches: DataFrame) -> DataFrame:
    """The selected addresses (pos, email) in order, with the match of each or nulls."""
    return selected.join(matches, "email", "left").select("pos", "email", "query_name", "matched_name")


def vocabulary_hits(texts: DataFrame, words: list[str], cutoff: float, spare_below: int, top: int = 8, text: str = "text", key: str = "id") -> DataFrame:
    """(key, hits): entries that a text contains; where there are fewer than `spare_below`, the closest ones by
    token-set ratio of at least the cutoff are added, `top` at most."""
    low = F.lower(F.col(text))
    direct = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    df = texts.select(key, F.when(F.size(direct) < spare_below, low).alias("_t"), direct.alias("_d"))
    near = F.transform(fuzzy.closest(F.col("_t"), words, fuzzy.token_set_ratio_of, cutoff, top), lambda s: s["word"])
    return df.select(key, F.sort_array(F.array_union("_d", near)).alias("hits"))


def query_entities(questions: DataFrame, question: str = "question", extra_skills: tuple[str, ...] = (), extra_roles: tuple[str, ...] = (), extra_degrees: tuple[str, ...] = ()) -> DataFrame:
    """questions with the skills, roles, degrees, section hints and least years that each names."""
    text = X.plain_norm(F.col(question))
    lists = {
        "skills": ([*L.QUERY_SKILLS, *map(str.lower, extra_skills)], L.SKILL_CUTOFF, 3),
        "roles": ([*L.QUERY_ROLES, *map(str.lower, extra_roles)], L.ROLE_CUTOFF, 2),
        "degrees": ([*L.QUERY_DEGREES, *map(str.lower, extra_degrees)], L.DEGREE_CUTOFF, 1),
    }
    named = {k: fuzzy.near_terms(text, list(dict.fromkeys(words)), cutoff, below) for k, (words, cutoff, below) in lists.items()}
    hints = F.sort_array(F.array_compact(F.array(*[F.when(F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in words]), F.lit(name)) for name, words in L.SECTION_HINTS])))
    years = X.metric(text, r"(\d+)\s*(?:\+|plus)?\s*(?:years|yrs|yr)\b")
    return questions.withColumns({**named, "sections": hints, "min_years": years})


def _fewer(df: DataFrame, word: str, most: int) -> DataFrame:
    """df with `_v`, a row for each: 64-bit hashes of the word and of what is left of it without up to `most` of its letters.
    Of equal neighbouring letters the first ones go; other ways to the same rest may repeat a hash."""
    left = df.withColumns({"_w": F.col(word), "_i": F.lit(1)})
    for _ in range(most):
        # Position 0 keeps what is left; letters go from left to right.
        at = F.when(F.col("_i") == 0, F.array(F.lit(0))).otherwise(F.expr("concat(array(0), if(_i > length(_w), cast(array() as array<int>), sequence(_i, length(_w))))"))
        step = left.withColumn("_j", F.explode(at)).where("_j < 2 or _j = _i or substring(_w, _j, 1) <> substring(_w, _j - 1, 1)")
        left = step.withColumns({"_w": F.expr("if(_j = 0, _w, concat(left(_w, _j - 1), substring(_w, _j + 1)))"), "_i": F.col("_j")})
    return left.withColumn("_v", F.xxhash64("_w")).drop("_w", "_i", "_j")


def _letters(x: str) -> str:
    """SQL of 64 bits that tell which letters, by their codes' last six bits, a string holds an odd number of."""
    return f"aggregate(split({x}, ''), 0L, (m, c) -> m ^ shiftleft(1L, ascii(c) & 63))"


def spell(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, correction): the dictionary term (term, freq) within `most` edits that is nearest, then most frequent, then
    first by name; the word itself where none is. Edits are those of optimal string alignment, so that a swap of
    neighbouring letters counts once.

    Two words within `most` edits have something in common once up to `most` letters are left out of each. So words and
    terms meet by equality on hashes of what is left and are verified where they meet; neither side is broadcast. Pairs
    whose distance without swaps tells the one with swaps need no alignment, nor do those whose letters are too different
    for swaps to help.
    """
    w = words.select("word").where("word is not null").distinct()
    terms = dictionary.groupBy("term").agg(F.max("freq").alias("freq"))
    near = _fewer(w, "word", most).join(_fewer(terms, "term", most), "_v")
    # A generated column, so that filters on it stay out of the join and the distance is computed once.
    near = near.select("word", "term", "freq", F.explode(F.array(F.levenshtein("word", "term", 2 * most))).alias("_l"))
    # With k swaps and e other edits the plain distance is 2k + e at most; e edits turn over 2e bits of letters at most.
    swaps = F.greatest(F.lit(1), F.col("_l") - most)
    others = F.col("_l") - 2 * swaps
    bits = F.expr(f"bit_count({_letters('word')} ^ {_letters('term')})")
    unsure = (others >= 0) & (F.abs(F.length("word") - F.length("term")) <= others) & (bits <= 2 * others)
    near = near.where((F.col("_l") >= 0) & ((F.col("_l") <= most) | unsure))
    d = F.coalesce(fuzzy.alignment(F.when(unsure, F.col("word")), F.when(unsure, F.col("term"))), "_l")
    # No filter on the distance: that would align every pair once more below it.
    best = near.withColumn("d", d).groupBy("word").agg(F.min_by("term", F.when(F.col("d") <= most, F.struct("d", -F.col("freq"), "term"))).alias("correction"))
    return w.join(best, "word", "left").select("word", F.coalesce("correction", "word").alias("correction"))
