import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.llm import fingerprints, quality, toxicity
from talentweave.llm.common import labelled_sample

WORDS = [f"word{i}" for i in range(200)]


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(rng, n=40):
    return rng.choice([lambda: " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=n)), lambda: " | ".join(rng.choices(WORDS, k=n)), lambda: " ".join([rng.choice(WORDS)] * n)])()


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        out.append((i, "\n".join(prose(rng) if y or rng.random() < 0.3 else junk(rng) for _ in range(rng.randint(2, 6))), y))
    return out


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    score, pair = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.arange(5)[None] < np.array([5, 3, 1])[:, None]
    good, counts = quality._forward_backward(np.where(mask, score, 0), mask, pair)
    total = np.zeros((2, 2))
    for t, n in enumerate((5, 3, 1)):
        weights = {ys: np.exp(sum(score[t, i] * y for i, y in enumerate(ys)) + sum(pair[a, b] for a, b in zip(ys, ys[1:], strict=False))) for ys in product((0, 1), repeat=n)}
        z = sum(weights.values())
        for i in range(n):
            assert abs(sum(w for ys, w in weights.items() if ys[i]) / z - good[t, i]) < 1e-9
        for ys, w in weights.items():
            for a, b in zip(ys, ys[1:], strict=False):
                total[a, b] += w / z
    assert np.allclose(total, counts.sum(0))
    for t, n in enumerate((5, 3, 1)):
        assert np.allclose(quality._one_chain(score[t, :n], pair), good[t, :n])


def test_held_out_quality(spark):
    rows = corpus(2, 400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "long " * 30000, "x"), (1003, "\n" * 3000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(1, rows[1][2]), (2, None), (1000, None)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, field).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert sum(held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001]
    assert quality.train(docs, labels.where("quality = 1")).slope == 0.0
    assert quality.score(docs.limit(0), field).count() == 0


def test_marginals_do_not_depend_on_the_batch():
    rows = corpus(3, 60)
    field = quality.fit([t for _, t, _ in rows], [y for *_, y in rows])
    together = quality.score_of(field, [t for _, t, _ in rows])
    assert np.allclose(together, [quality.score_of(field, [t])[0] for _, t, _ in rows], atol=1e-9)


def test_long_texts_are_scored_in_chunks(monkeypatch):
    import tracemalloc

    rows = corpus(4, 60)
    field = quality.fit([t for _, t, _ in rows], [y for *_, y in rows])
    texts = [t for _, t, _ in rows] + ["\n" * 300, None, ""]
    together = quality.score_of(field, texts)
    tracemalloc.start()
    assert 0 <= quality.score_of(field, ["\n" * 300_000])[0] <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000 * 150
    monkeypatch.setattr(quality, "LINES", 7)
    monkeypatch.setattr(quality, "LONG", 5)
    assert np.allclose(quality.score_of(field, texts), together, atol=1e-8)


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        w = rng.choices(WORDS, k=80)
        if y:
            for _ in range(rng.randint(3, 6)):
                w[rng.randrange(80)] = rng.choice(["idiot", "moron"]) + rng.choice(["", "isch", "ous"])
        elif rng.random() < 0.1:
            w[3] = "idiotous"
        out.append((i, " ".join(w), y))
    return out


def index(rows):
    own = [toxicity.terms_of(toxicity.words_of(t)) for _, t, _ in rows]
    df = {t: sum(t in o for o in own) for t in sorted(set().union(*own))}
    return toxicity.build([(i, y, t) for i, t, y in rows], df, len(rows)), df


def plain_weights(text, df, n):
    """TF-IDF weights of unit length, by term."""
    counts = {}
    for w in toxicity.words_of(text):
        for t in toxicity.terms_of([w]) & df.keys():
            counts[t] = counts.get(t, 0) + 1
    own = {t: (1 + np.log(c)) * np.log((1 + n) / (0.5 + df[t])) for t, c in counts.items()}
    size = np.sqrt(sum(w * w for w in own.values()))
    return {t: w / size for t, w in own.items()}


def brute_scores(rows, texts):
    """Scores by comparing with every example, and the nearest ids."""
    made, df = index(rows)
    own = [plain_weights(t, df, len(rows)) for _, t, _ in rows]
    share, k = sum(y for *_, y in rows) / len(rows), max(toxicity.LEAST, len(rows) // toxicity.SHARE)
    out = []
    for text in texts:
        v = plain_weights(text, df, len(rows))
        sims = sorted(((-round(sum(w * o.get(t, 0) for t, w in v.items()), 12), i) for i, o in enumerate(own)))[:k]
        near = [(-s, rows[i]) for s, i in sims if s < 0]
        yes = sum(s for s, r in near if r[2]) / share
        no = sum(s for s, r in near if not r[2]) / (1 - share)
        z = np.log((yes + 0.02 * (yes + no)) / (no + 0.02 * (yes + no))) if near else None
        out.append((made.bare if z is None else 1 / (1 + np.exp(-(made.slope * z + made.offset))), [r[0] for _, r in near[:5]]))
    return made, out


@pytest.mark.parametrize("n", [20, 300, 900])
def test_nearest_examples_equal_brute_force(n):
    rows = toxic_corpus(5, n)
    texts = [t for _, t, _ in toxic_corpus(6, 80)] + ["", "qq", rows[3][1]]
    made, wanted = brute_scores(rows, texts)
    got = made.score_all(texts)
    assert np.allclose([s for s, _ in got], [s for s, _ in wanted], atol=1e-8) and [i for _, i in got] == [i for _, i in wanted]
    assert made.score_all(texts[40:41])[0] == got[40]


def test_held_out_toxicity(spark):
    rows = toxic_corpus(7, 500)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(1000, None, 1), (1001, "", 1), (1002, "idiot " * 20000, 1)], "doc_id long, text string, neighbours int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(1, rows[1][2]), (2, None)], "doc_id long, toxic int")
    examples = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, examples).collect()}
    held = [(got[i].score >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score < 0.5 < got[1002].score and got[1002].neighbours
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), examples).count() == 0


@pytest.fixture(scope="module")
def signed(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        a = rng.choices(WORDS, k=300)
        b = a[: rng.randint(0, 300)] + rng.choices(WORDS, k=rng.randint(0, 100)) + rng.choices([a[:40], []], k=1)[0]
        texts.append((" ".join(a), " ".join(b)))
    shared = " ".join(f"s{i}" for i in range(204))
    hot = " ".join(["u v w x y"] * 1000)
    texts += [(f"{shared} {hot}", f"{shared} u v w x y"), (f"{hot} {shared}", f"{hot} {' '.join(f'q{i}' for i in range(204))}")]  # weights of 1000 against 1 and against 1000
    texts += [(" ".join(rng.choices("abcdefgh", k=n)), " ".join(rng.choices("abcdefgh", k=n))) for n in range(1, 12)]  # short ones
    texts += [("a b c d e f g", "a b c d e f z"), ("a b c d e", "a b c d e f")]
    texts += [(None, ""), ("one two", "one  Two"), ("x y z " * 4000, "x y z " * 4000), ("a b c d e f", "")]
    df = spark.createDataFrame([(i, a, b, 7) for i, (a, b) in enumerate(texts)], "doc_id long, a string, b string, x int")
    both = fingerprints.fingerprint(fingerprints.fingerprint(df, "a", "x", slots=256), "b", "y", slots=256)
    return texts, {r.doc_id: r for r in both.withColumn("near", fingerprints.likeness("x", "y")).collect()}


def generalised_jaccard(a, b):
    from collections import Counter

    def bag(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_likeness_estimates_generalised_jaccard(signed):
    texts, got = signed
    truth = np.array([generalised_jaccard(a, b) for a, b in texts])
    miss = np.array([got[i].near for i in range(len(texts))]) - truth
    # Five standard errors of 256 slots.
    assert (np.abs(miss) <= 5 * np.sqrt(truth * (1 - truth) / 256) + 1e-9).all() and abs(miss.mean()) < 0.01
    assert [got[len(texts) - k].near for k in (4, 3, 2, 1)] == [1.0, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("weight", [1, 2, 3, 40])
def test_weights_count_in_proportion(weight):
    """Of two terms with weights 1 and w, the second is sampled with a probability of w / (1 + w); a weight that grows
    keeps the sample or moves it to the grown term."""
    draws, n = fingerprints.Draws.make(), 8000
    terms = np.array([12345, 987654321], np.uint64)
    grown = draws.signature(terms, np.array([1, weight]), n)
    seeds_share = (grown == draws.signature(terms[:1], np.array([1]), n)).mean()
    assert abs(seeds_share - 1 / (1 + weight)) < 0.02
    alike = (grown == draws.signature(terms, np.array([1, 1]), n)).mean()
    assert abs(alike - 2 / (1 + weight)) < 0.02


def test_gamma_quantiles():
    x = fingerprints.gamma_quantiles(np.array([0.001, 0.3, 0.5, 0.999]))
    assert np.allclose(1 - (1 + x) * np.exp(-x), [0.001, 0.3, 0.5, 0.999])


@pytest.mark.parametrize(("size", "slots"), [(5, 64), (1, 3), (2, 100)])
def test_expressions_sign_as_plain_python(spark, size, slots):
    rng = random.Random(4)
    texts = [None, "", " \n", "\u00a0One\u2003two\x1cTHREE\x85four\u3000", "É😀 ΣΑΣ straße", "a b c d", "a b c d e", "x " * 700, "u v w x y\n" * 90 + "s"]
    texts += [" ".join(rng.choices(WORDS, k=n)) for n in (6, 40, 300, 3000)]
    df = spark.createDataFrame([(t, i, t) for i, t in enumerate(texts)], "`te.xt` string, `a``b` int, out string")
    got = fingerprints.fingerprint(df, "te.xt", "out", size, slots)
    assert got.columns == ["te.xt", "a`b", "out"] and not any(w in got._jdf.queryExecution().executedPlan().toString() for w in ("Arrow", "Python", "Pandas"))
    draws = fingerprints.Draws.make()
    for text, _, out in got.collect():
        assert out == draws.signature(*fingerprints.terms_of(text, size, {}), slots).tolist()


@pytest.mark.parametrize("n", [1, 30, 400])
def test_samples_are_the_least_of_all_draws(n):
    """Every unit draws in every slot, its own hash where it favours the slot, before all others."""
    terms, slots = np.array([fingerprints._hashed(i) for i in range(n)]), 64
    weights = np.array([1 + i % 3 for i in range(n)])
    units = [int(x) if k == 1 else fingerprints._hashed(int(x), k) for x, w in zip(terms, weights, strict=True) for k in range(1, w + 1)]
    least = [min((0, u) if (u + 2**63) * slots >> 64 == j else (1, fingerprints._hashed(u, j)) for u in units)[1] for j in range(slots)]
    assert fingerprints.Draws.make().signature(terms, weights, slots).tolist() == np.array(least).astype(np.int32).tolist()


def test_edited_texts_and_successors(spark):
    rows = [(30, "abcdef😀"), (10, "123456789"), (20, "x"), (40, None), (20, "x"), (None, "null")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.next, r.edited) for r in fingerprints.edited(df).collect()}
    assert got == {(10, "123456789"): (20, "12345x"), (20, "x"): (30, "x"), (30, "abcdef😀"): (40, "abcd"), (40, ""): (10, ""), (None, "null"): (None, "nu")}
    assert fingerprints.edited(df.limit(0)).count() == 0
    one = fingerprints.edited(df.where("doc_id = 30")).first()
    assert one.next == 30 and one.edited == "abcdabc"


def test_many_keys_have_the_right_successor(spark):
    keys = random.Random(3).sample(range(10**6), 3000)
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next for r in fingerprints.successors(df).collect()}
    keys.sort()
    assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True))


def test_hashed_words_are_those_of_the_pattern(monkeypatch):
    text = "Éa_ÉA 7b-x  😀wörd ١٢ a²b longer\nlongest_one " * 40
    (whole, owner), (begin, of) = toxicity.hashed_words([text.lower(), "", "tail"])
    words = toxicity.words_of(text)
    assert owner.tolist() == [0] * len(words) + [2] and len({*whole.tolist()}) == len({*words, "tail"})
    assert [dict(zip(words, whole.tolist()))[w] for w in words] == whole[:-1].tolist()
    assert len(begin) == len(of) == sum(len(w) > 4 for w in words) and set(toxicity.hashed_words(["wörd long"])[0][0].tolist()) >= set(begin[:1].tolist()) - set(whole.tolist())
    made, _ = index(toxic_corpus(3, 40) + [(90, text, 1)])
    plain = made.vectors([text, "idiot"])
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert all(np.array_equal(a, b) for a, b in zip(plain, made.vectors([text, "idiot"]), strict=True))


def test_a_copy_of_an_example_is_nearest_whatever_its_words():
    rows = toxic_corpus(9, 120) + [(500, "quagga zebu", 1), (501, "okapi", 0)]
    made, _ = index(rows)
    for (near, sims), (i, *_) in zip(made.nearest(made.vectors([t for _, t, _ in rows]), len(rows)), rows, strict=True):
        assert sims[0] == 1.0 and made.ids[near[0]] == i
    assert made.score_all(["quagga"])[0][1] == [500]


def test_the_toxicity_query_equals_brute_force(spark):
    rows = toxic_corpus(13, 240)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "Éa ÉA éa_éa 7b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, toxic int")
    examples = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, examples).collect()}
    known = {i: (t, y) for i, t, y in rows[:200]}
    some = [(i, *known[i]) for i in sorted(known)]
    own = [toxicity.terms_of(toxicity.words_of(r.text)) for r in docs.collect()]
    used = set().union(*(toxicity.terms_of(toxicity.words_of(t)) for _, t, _ in some))
    df = {t: sum(t in o for o in own) for t in sorted(used)}
    turn = [r.doc_id for r in docs.where("doc_id < 200").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    made = toxicity.build([(i, known[i][1], known[i][0]) for i in turn], df, len(own))
    wanted = made.score_all([r.text for r in docs.collect()])
    assert [(got[r.doc_id].score, got[r.doc_id].neighbours) for r in docs.collect()] == [(s, [str(i) for i in ids]) for s, ids in wanted]


def test_training_reads_what_comes_after_many_lines(spark):
    rng = random.Random(12)
    head = [prose(rng) for _ in range(64)]
    rows = [(i, "\n".join(head + [(junk if i % 2 else prose)(rng) for _ in range(200)]), 1 - i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    assert sorted(labelled_sample(docs, labels, "quality", 100)) == sorted((i, y, t) for i, t, y in rows)
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, 'z')"))
    assert labelled_sample(twice, labels, "quality", 100) == labelled_sample(docs, labels, "quality", 100)
    field = quality.fit([t for _, t, _ in rows[20:]], [y for *_, y in rows[20:]])
    assert ((quality.score_of(field, [t for _, t, _ in rows[:20]]) >= 0.5) == [bool(y) for *_, y in rows[:20]]).all()
