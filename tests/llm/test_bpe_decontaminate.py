import random

import pytest
from pyspark.sql import functions as F

from talentweave.llm import bpe, decontaminate
from talentweave.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, token_ids string"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_library(library):
    rng = random.Random(5)
    letters = "aAbBéÉ ΣσςİIıßﬀ́  \x1c\x85\t\n'sS'T're1२½Ⅷ$%-…😀👍🏽<|endoftext|>​中ก가ǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 3000, "hahaha" * 300, "x<|startoftext|>Y<|endoftext|>", "", "<|END<|endoftext|>OF|>"]
    ids, at = bpe.Encoder(bpe.Vocabulary.read(tokenizer_path())).encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_a_merge_that_is_not_safe_runs_leftmost_first():
    v = bpe.Vocabulary.read(tokenizer_path())
    whole = bpe.merge_words([b"hahahaha", b"aaaaaaa"], v)
    v.whole[:] = False
    careful = bpe.merge_words([b"hahahaha", b"aaaaaaa"], v)
    assert [x.tolist() for x in whole] == [x.tolist() for x in careful]


def test_encode_decode_columns_nulls_and_clashing_names(spark, library):
    rows = [(1, "Hello  world", "old"), (2, None, "x"), (3, "", None), (None, "Hello  world", "y"), (1, "Hello  world", "old"), (4, "word " * 20000, "z")]
    df = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS), tokenizer_path()), tokenizer_path())
    got = df.collect()
    assert len(got) == len(rows) and df.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    both = bpe.encode(spark.createDataFrame(rows, DOCS), tokenizer_path(), decoded="decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, got))
    nothing = spark.createDataFrame([(None,), ([],), ([1],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(nothing, tokenizer_path()).collect()] == ["", "", '"']
    assert bpe.encode(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def brute(docs, items, window):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in docs:
        w, hit, whose = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(window, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    whose.add(item)
        out.append((len(w), len(hit), sorted(whose - {None})))
    return out


@pytest.mark.parametrize("window,short", [(4, True), (4, False), (1, True), (13, True)])
def test_scan_equals_brute_force(spark, window, short, monkeypatch):
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "B", "c", "dé", "9"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1 if short else window, 9)))) for i in range(12)] + [(50, None), (51, " - "), (None, "c c c c c")]
    docs = [" ,".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "!!"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = [(r.n_words, r.n_hit, r.hit_items) for r in decontaminate.scan(d, b, window).orderBy("doc_id").collect()]
        assert got == brute(docs, items, window)


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, f"Before it. {item.upper()}! After it."), (2, "word " * 400 + item), (3, None), (4, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    found = decontaminate.scan(d, spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    assert got == {1: "Before it. \n! After it.", 2: docs[1][1], 3: None, 4: ""}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found, min_chars=20).collect()}
    assert cut[2] == "word " * 400 + "\n"


def test_cutting_spans_keeps_columns_of_any_name(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"Before. {item}. After", "kept")], "doc_id long, text string, _over string")
    row = decontaminate.remove_spans(decontaminate.scan(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))).first()
    assert (row.text, row["_over"]) == ("Before. \n. After", "kept")
