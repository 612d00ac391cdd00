"""Whole queries against plain versions of them, on small tables."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from talentweave.llm import fingerprints, html_extract, quality, queries
from tests.llm.test_html import brute_repeated
from tests.llm.test_models import WORDS, junk, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(5, 80)) if i % 3 else "\n".join(junk(rng, 12) for _ in range(3)) for i in range(60)]
    texts += [texts[4], texts[4] + " more", None, "", "one two", "É😀 " * 50]
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(3 * i, int(bool(i % 3)), i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    own = lambda k, n=30: " ".join(f"{rng.choice(WORDS)}{k}" for _ in range(n))
    menu, note = own("m", 12), own("n", 12)
    pages = []
    for i in range(24):
        open_ = f"<div>{menu}</div><div>{menu if i % 4 else ''} {own(i)}</div>"
        pages.append((i, f"https://h{i % 2}.example/{i}", open_ if i % 3 == 0 else f"<nav>{menu}</nav><article><p>{own(i)}</p><p>{note}</p></article>{open_ if i % 3 == 1 else ''}"))
    pages += [(90, None, None), (91, "https://h0.example/x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def test_fingerprints(spark, folder):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    draws = fingerprints.Draws.make()

    def sign(text):
        found = fingerprints.terms_of(text, fingerprints.SHINGLE, {})
        return draws.signature(*found).tolist() if len(found[0]) else []

    def like(a, b):
        return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))

    got = {r.doc_id: r for r in queries.op7_fingerprints(spark, folder).collect()}
    assert len(got) == len(rows)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, r = sign(text), sign(edited), got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{v & 0xFFFFFFFF:08x}" for v in a) and r.edited_fingerprint == "".join(f"{v & 0xFFFFFFFF:08x}" for v in b)
        assert abs(r.near_edited - like(a, b)) < 1e-9 and abs(r.near_next - like(a, sign(after))) < 1e-9


def test_fingerprints_run_no_python(spark, folder, monkeypatch):
    for module in (queries, fingerprints):
        monkeypatch.setattr(module, "cut", lambda df: df)
    plan = queries.op7_fingerprints(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not any(w in plan for w in ("Arrow", "Python", "Pandas"))


def test_quality(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    learn = [(r.text, labels[r.doc_id]) for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r.doc_id in labels and crc32(str(r.doc_id).encode()) % 3 != 1]
    field = quality.fit([t for t, _ in learn], [y for _, y in learn])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op6_quality(spark, folder).collect()}
    for key, text in texts.items():
        want = quality.score_of(field, [text])[0]
        assert abs(got[key].score - want) < 1e-6 and got[key].predicted == (got[key].score >= 0.5) and got[key].held_out == (crc32(str(key).encode()) % 3 == 1)


def test_html(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = {}
    for host in {re.sub(r"^https://([^/]*).*", r"\1", r.url or "") for r in rows}:
        own = [r for r in rows if re.sub(r"^https://([^/]*).*", r"\1", r.url or "") == host]
        blocks = [(r.page_id, html_extract.blocks_of(r.html)) for r in own]
        words = [(k, w) for k, bs in blocks for _, t in bs for w in t.lower().split()]
        tokens, pages = [w for _, w in words], [k for k, _ in words]
        twice = brute_repeated(tokens, pages, html_extract.RUN, 2)
        often = brute_repeated(tokens, pages, html_extract.RUN, max(html_extract.MOST_PAGES, -(-len(set(pages)) // 2)))
        at = 0
        for key, bs in blocks:
            spans = []
            for role, t in bs:
                spans.append((role, t, twice[at : at + len(t.split())], often[at : at + len(t.split())]))
                at += len(t.split())
            main = [s for s in spans if s[0] == html_extract.CONTENT]
            site = sum(sum(s[3]) for s in main) * 2 < sum(len(s[3]) for s in main)
            out = []
            for role, t, two, most in spans:
                if role == html_extract.CONTENT and not (site and sum(most) >= 0.5 * len(most)):
                    out.append(t)
                elif role == html_extract.OPEN and len(two) < html_extract.RUN:
                    out += [t] if not main and sum(two) < 0.5 * len(two) else []
                elif role == html_extract.OPEN:
                    runs = re.finditer("1+", "".join("01"[x] for x in two))
                    gone = {i for m in runs if m.end() - m.start() >= html_extract.RUN for i in range(*m.span())}
                    left = [w for i, w in enumerate(t.split()) if i not in gone]
                    out += [" ".join(left)] if not gone or len(left) >= html_extract.RUN else []
            want[key] = "\n\n".join(out)
    got = {r.page_id: r.text for r in queries.op2_html(spark, folder).collect()}
    assert got == want and any(v and v.count("\n\n") == 0 for v in want.values()) and np.mean([bool(v) for v in want.values()]) > 0.8
