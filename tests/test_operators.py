"""Small hand-computed cases and plain-Python counterparts of operators that SQL does not express."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talentweave.functions import fuzzy
from talentweave.functions import text as X
from talentweave.operators import evaluation, folding, gramjoin, layout, matching, people, retrieval, schedule, sections
from talentweave.plans import sqlgate
from talentweave.sources import readers
from talentweave.streaming import events


def one(spark, expression, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize("raw,valid,normal", [
    ("98765 43210", True, "+91 9876543210"), ("+1 (319) 555-5132", True, "+13195555132"), ("12345678", False, "12345678"), ("+12345678", True, "+12345678"),
    ("2018-2022", False, "20182022"), ("1234567", False, "1234567"), (None, False, None), ("", False, ""), ("+91 9876543210", True, "+919876543210"),
])
def test_phones(spark, raw, valid, normal):
    assert one(spark, X.valid_phone(F.col("a"), True), a=raw) is valid
    if raw is not None:
        assert one(spark, X.normal_phone(F.col("a")), a=raw) == normal


@pytest.mark.parametrize("text,want", [
    ("Aug 2023 - Present", ("2023-08", None, True)), ("2019–2021", ("2019-01", "2021-01", False)), ("March, '22 to Sept 2023", ("2022-03", "2023-09", False)),
    ("joined June 2020", ("2020-06", "2020-06", False)), ("nothing", (None, None, False)),
])
def test_date_ranges(spark, text, want):
    assert tuple(one(spark, X.date_range(F.col("a")), a=text)) == want


def test_text_rules(spark):
    assert one(spark, X.season_to_month(F.col("a")), a="Spring ’20") == "2020-03"
    assert one(spark, X.collapse(F.col("a")), a=" a\xa0\t b\n") == "a b"
    assert one(spark, X.join_spaced_caps(F.col("a")), a="A M A N and S INGH") == "AMAN and SINGH"
    assert one(spark, X.join_spaced_caps(F.col("a")), a="A B test, X Y Z") == "A B test, XYZ"
    assert one(spark, X.unwrap_hyphens(F.col("a")), a="data-\nbase well-known") == "database wellknown"
    assert one(spark, X.skills(F.col("a")), a="JavaScript, digital c") == ["git", "java", "javascript"]
    assert one(spark, X.header_label(F.col("a")), a="TECHNICAL SKILLS:") == "skills" and one(spark, X.header_label(F.col("a")), a="plain") is None
    assert one(spark, X.bullets(F.col("a")), a="• one\ntwo\nthree\n- four\n\nfive") == ["one", "two three", "four", "five"]
    assert one(spark, X.metrics(F.col("a")), a="cut 30% at 500 QPS, p99: 20 ms, 95% accuracy") == {"percent": 30, "throughput_qps": 500, "latency_p99_ms": 20, "accuracy_pct": 95}
    assert one(spark, X.iso_date(F.col("a")), a="2020-05") == "2020-05-01" and one(spark, X.iso_date(F.col("a")), a="2020") is None
    assert one(spark, X.gpa(F.col("a")), a="CGPA 8.5/10") == "8.5/10" and one(spark, X.company(F.col("a")), a="Engineer at Acme Corp") == "Acme Corp"
    assert one(spark, X.awards(F.col("a")), a="Best award\nsecond") and not one(spark, X.date_only(F.col("a")), a="2019 - 2021\nx")
    assert one(spark, X.confidence(0.5, (F.col("a") == "x", 0.2), (F.col("a") == "x", 0.4)), a="x") == 1.0
    assert one(spark, X.json_or_raw(F.col("a")), a='["p","q"]') == ["p", "q"] and one(spark, X.json_or_raw(F.col("a")), a="p, q|r") == ["p", "q", "r"]
    assert one(spark, X.glued_header(F.col("a")), a="SKILLSPython and") == ["SKILLS", "Python and"]
    assert one(spark, X.merge_skills(F.col("a")), a=["SQL ", "c", "R", None, ""]) == ["r", "sql"]


def test_fuzzy_scores(spark):
    assert fuzzy.ratio_of("abcd", "abxd") == 75.0 and fuzzy.ratio_of("", "") == 100.0
    assert fuzzy.partial_ratio_of("john", "john smith") == 100.0 and fuzzy.token_set_ratio_of("senior data analyst", "data analyst") == 100.0

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy._common(a, b) == lcs(a, b)
    assert one(spark, fuzzy.normal_form(F.col("a")), a="ﬁ") == "fi"


def test_jaccard_rules(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(evaluation.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, 0.3333, 1.0]


def test_fusion_ties_and_fallback(spark):
    hits = spark.createDataFrame([(0, 1.0, "b", 0.1, 1), (0, 1.0, "a", 0.2, 2), (1, 1.0, "a", 0.3, 1), (1, 1.0, "b", 0.4, 2), (1, 1.0, "c", 0.5, 3)], "qid int, weight double, id string, dist double, rank int")
    assert [(r.id, r.first_rank, r.dist) for r in retrieval.fuse(hits).collect()] == [("a", 1, 0.2), ("b", 1, 0.1), ("c", 3, 0.5)]
    pool = spark.createDataFrame([("a", 0.3), ("b", 0.1)], "id string, dist double")
    assert [r.id for r in retrieval.with_fallback(pool.where("dist > 9"), pool, 1).collect()] == ["b"]
    assert {r.id for r in retrieval.with_fallback(pool.where("dist > 0.2"), pool, 1).collect()} == {"a"}


def test_diversity(spark):
    rows = [(0, "a", 1.0, [1.0, 0.0]), (0, "b", 0.99, [1.0, 0.0]), (0, "c", 0.5, [0.0, 1.0]), (0, "z", 0.1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "qid int, id string, score double, embedding array<double>")
    pick = lambda **more: [r.id for r in retrieval.mmr(df, **more).orderBy("pick").collect()]
    assert pick(top=2, weight=0.5) == ["a", "c"] and pick(top=3, weight=1.0) == ["a", "b", "c"] and pick(top=9) == ["a", "b", "c", "z"]


def test_chunks_cover_texts(spark):
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(0, 80))) for _ in range(20)] + ["x" * 250, None, "  "]
    got = retrieval.chunk_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), size=60, overlap=15).collect()
    for i, t in enumerate(texts):
        own = [r.chunk for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk_no)]
        assert all(len(c) <= 60 for c in own)
        words = (t or "").split()
        assert not words or (own[0].startswith(words[0][:60]) and own[-1].endswith(words[-1][-10:]))


def test_section_chain(spark):
    rows = [(1, "other", "EDUCATION"), (2, "other", "B.Tech\n2018 - 2022"), (3, "work_experience", "did things"), (4, "other", "- a point"), (5, "other", "2019-2020"), (6, "skills", "python\nme@x.org"), (7, "other", "tail"), (8, "other", "x@y.org")]
    df = spark.createDataFrame([(0, i, k, t, 1, 1) for i, k, t in rows], "doc_id int, sec_no long, section_type string, text string, first_page int, last_page int")
    got = [(r.section_type, r.text) for r in sections.post_process(df).orderBy("sec_no").collect()]
    assert got == [("education", "B.Tech\n2018 - 2022"), ("work_experience", "did things\n- a point\n2019-2020"), ("skills", "python"), ("other", "tail")]


def _cut(spark, *rows):
    return spark.createDataFrame([(0, i, k, t, i, i + 1) for i, (k, t) in enumerate(rows)], "doc_id int, sec_no long, section_type string, text string, first_page int, last_page int")


def test_sections_are_cut_at_the_first_line_that_names_a_label(spark):
    got = sections.split_inline_headers(_cut(spark, ("other", "intro\nTechnical Skills\npython\nEDUCATION\nB.Tech"), ("projects", "Skills"), ("summary", "Work Experience :\n did\n\nmore"), ("other", None)))
    assert [(r.sec_no, r.section_type, r.text, r.first_page) for r in got.orderBy("sec_no").collect()] == [
        (1, "other", "intro", 0), (2, "skills", "Technical Skills\npython\nEDUCATION\nB.Tech", 0), (3, "projects", "Skills", 1), (4, "work_experience", "Work Experience :\ndid\nmore", 2), (5, "other", None, 3),
    ]


def test_every_other_header_of_a_run_goes(spark):
    rng = random.Random(8)
    for _ in range(4):
        kinds = [(rng.choice(["other", "skills", "education"]), rng.choice(["EDUCATION", "plain text", "RULE ____"])) for _ in range(30)]
        want, i = [], 0
        while i < len(kinds):
            kind, text = kinds[i]
            if text != "plain text" and i + 1 < len(kinds):
                below = kinds[i + 1]
                want.append((kind if below[0] == "other" else below[0], below[1]))
                i += 2
            else:
                want.append((kind, text))
                i += 1
        got = sections.collapse_headers(_cut(spark, *kinds))
        assert [(r.section_type, r.text) for r in got.orderBy("sec_no").collect()] == want
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_contacts_join_the_candidate_once(spark):
    kind = "doc_id int, full_name string, emails array<string>, phones array<string>, linkedin string, github string"
    known = spark.createDataFrame([(0, "Ann", ["a@b.co"], None, None, "github.com/ann")], kind)
    df = _cut(spark, ("other", "again a@b.co\nnew c@d.org and a@b.co\nphone +1 555 010 0001"), ("skills", "sql\ncall +15550100001\ngithub.com/other\nlinkedin.com/in/a"), ("other", "linkedin.com/in/b\nhttps://x.y/z\nhttps://x.y/z\n2018 - 2020"), ("other", None), ("other", "c@d.org"))
    kept, grown = sections.promote_contacts(df.unionByName(df.withColumn("doc_id", F.lit(1)).where("sec_no = 4")), known)
    assert [r.text for r in kept.where("doc_id = 0").orderBy("sec_no").collect()] == ["again a@b.co", "sql\ncall +15550100001\ngithub.com/other", "linkedin.com/in/b\nhttps://x.y/z\n2018 - 2020", "", "c@d.org"]
    a, b = grown.orderBy("doc_id").collect()
    assert (a.full_name, a.emails, a.phones, a.linkedin, a.github, a.links_other) == ("Ann", ["a@b.co", "c@d.org"], ["+15550100001"], "linkedin.com/in/a", "github.com/ann", ["https://x.y/z"])
    assert (b.full_name, b.emails, b.phones, b.linkedin, b.links_other) == (None, ["c@d.org"], [], None, [])
    assert sections.promote_contacts(df.limit(0), known.limit(0))[1].count() == 0


def test_a_name_is_no_patent(spark):
    df = _cut(spark, ("patents", "ANN  LEE"), ("patents", "Ann Lee"))
    names = spark.createDataFrame([(0, "Ann Lee Smith")], "doc_id int, full_name string")
    assert [r.section_type for r in sections.guard_names(df, names).orderBy("sec_no").collect()] == ["summary", "patents"]
    assert [r.section_type for r in sections.guard_names(df, names.limit(0)).orderBy("sec_no").collect()] == ["patents", "patents"]
    assert sections.guard_names(_cut(spark, ("skills", "Ann Lee")), names).first().section_type == "skills"


def test_contacts_come_from_the_top_or_else_from_the_first_line_that_has_them(spark):
    def found(texts, sizes=None, **more):
        rows = [(7, i, 1 + i // 20, t, (sizes or {}).get(i, 10.0)) for i, t in enumerate(texts)]
        return sections.contacts(spark.createDataFrame(rows, "doc_id int, line_no int, page int, text string, font_size double"), **more).first()

    r = found(["J O N LEE | a@b.co", "github.com/x linkedin.com/in/one", "linkedin.com/in/two", *["-"] * 12, "c@d.org", "987 654 3210, 2018 - 2022", "912 345 6789"], {0: 20.0})
    assert (r.full_name, r.emails, r.phones, r.linkedin, r.github) == ("Jon Lee", ["a@b.co"], ["+91 9876543210"], "linkedin.com/in/two", "github.com/x")
    r = found(["JO O'NEIL-SMITH", None, *["-"] * 12, "x@y.zz u@v.ww", "late@z.zz github.com/late"], {0: None, 1: 0.0, 2: 9.0, 3: 9.0, 4: 9.0})
    assert (r.full_name, r.emails, r.phones, r.github) == ("JO O'Neil-Smith", ["x@y.zz", "u@v.ww"], [], "github.com/late")
    r = found(["a@b.co +1 555 010 0001 github.com/x", *["-"] * 12, "linkedin.com/in/never"])
    assert (r.linkedin, r.github) == (None, "github.com/x")
    r = found(["ANN LEE", "987-654-3210", "987-654-3210"], normalise=False, title_case=False)
    assert (r.full_name, r.phones) == ("ANN LEE", ["987-654-3210"])


def test_sections_from_header_lines(spark):
    texts = ["Jane", "WORK EXPERIENCE", "Acme", "did", "Skills:", "sql", "", "python"]
    df = spark.createDataFrame([(0, i, 1 + i // 4, t) for i, t in enumerate(texts)], "doc_id int, line_no int, page int, text string")
    got = sorted((r.section_type, r.text, r.first_page, r.last_page) for r in sections.sections_from_headers(df).collect())
    assert got == [("skills", "sql\npython", 2, 2), ("work_experience", "Acme\ndid", 1, 1)]
    assert sections.sections_from_headers(df, reference=False).where("section_type = 'other'").first().text == "Jane"


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        start = rng.randint(0, 10_000) * 60
        rows.append((i, rng.randint(0, 3), start, start + rng.randint(1, 3000) * 60))
    df = spark.createDataFrame(rows, "id int, interviewer_id int, s long, e long").select("id", "interviewer_id", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"))
    want = {(a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and a[3] > b[2] and (a[2], a[0]) < (b[2], b[0])}
    got = [tuple(r) for r in schedule.overlap_join(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_exclusive_schedule_uses_a_slot_once(spark):
    slots = spark.createDataFrame([(i, i % 2, f"2024-01-0{1 + i} 10:00:00", "free") for i in range(3)], "id int, interviewer_id int, s string, status string").selectExpr("id", "interviewer_id", "cast(s as timestamp) start_ts", "cast(s as timestamp) + interval 1 hour end_ts", "status")
    people_ = spark.createDataFrame([(i,) for i in range(5)], "candidate_id int")
    staff = spark.createDataFrame([(0, True), (1, True)], "interviewer_id int, is_active boolean")
    window = (F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(4 * 10**9)))
    got = schedule.match_exclusive(people_, slots, staff, *window, 30).orderBy("candidate_id").collect()
    assert [r.slot_id for r in got] == [0, 1, 2, None, None] and [r.status for r in got] == ["scheduled"] * 3 + ["failed"] * 2
    assert {r.slot_id for r in schedule.match_reference(people_, slots, staff, *window, 30).collect()} == {0}


def test_upsert_and_points(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, t int")
    new = spark.createDataFrame([(2, None, 7), (2, "x", 6), (3, "c", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in people.upsert(old, new, ["k"], "t").collect()) == [(1, "a", 5), (2, None, 7), (3, "c", 1)]
    assert sorted(tuple(r) for r in people.upsert(old, new, ["k"], "t", ("v",)).collect()) == [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
    assert people.one_row(old.where("k = 1")).v == "a"
    with pytest.raises(LookupError):
        people.one_row(old)


def test_sql_gate(spark):
    views = {"t": spark.createDataFrame([("A@x.org", 1), ("b@x.org", 2)], "primary_email string, n int")}
    assert sqlgate.run(spark, "/* c */ select * from t ;", views, scope=["a@X.org"]).first().n == 1
    for bad in ("drop table t", "insert into t values ('c', 3)", "create table u as select 1", "with x as (select 1) insert into t select 'd', 1", "set a=b", "select 1; drop table t"):
        with pytest.raises(Exception):  # noqa: B017
            sqlgate.run(spark, bad, views)
    with pytest.raises(KeyError):
        sqlgate.run(spark, "select n from t", views, scope=["a@x.org"])


def test_spelling(spark):
    words = spark.createDataFrame([("teh",), ("pythn",), ("zzzzz",), ("java",)], "word string")
    known = spark.createDataFrame([("python", 5), ("the", 9), ("ten", 1), ("java", 2)], "term string, freq int")
    assert dict((r.word, r.correction) for r in matching.spell(words, known).collect()) == {"teh": "the", "pythn": "python", "zzzzz": "zzzzz", "java": "java"}


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one\n two ")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.md").write_text("no")
    names = [r.name for r in readers.list_files(spark, str(tmp_path)).orderBy("name").collect()]
    assert names == ["a.txt", "b.pdf"] and readers.manifest(spark, str(tmp_path)).count() == 2
    assert readers.read_texts(spark, str(tmp_path / "a.txt")).first().page_content == "one two"
    doc = {"meta": {"source_path": "x.pdf", "pages": 1}, "lines": [{"page": 1, "text": "hi", "bbox": [0, 1, 2, 3], "font_size": 9.0, "is_bold": True}, {"page": 2, "text": "yo", "bbox": [0, 1, 2, 3]}]}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    lines = readers.read_lines(spark, str(tmp_path / "l.json"))
    assert [(r.line_no, r.text, r.y1) for r in lines.collect()] == [(0, "hi", 3.0), (1, "yo", 3.0)]
    assert readers.payload(lines).first().text_all == "hi\n\nyo"
    readers.write_text(lines, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["hi", "yo"]


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", i % 3, "click", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.read(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " ")))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda r: (str(r.window_start), r.n, r.total)
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, events.tumbling(df).collect()))
    assert events.sessions(df).count() > 0
    again = events.once(events.read(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " ")))
    query = again.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("once").count() == events.once(df.union(df)).count() == 50


def _lines(spark, texts, bold=()):
    rows = [(0, i, 1, 0, t, i in bold, 10.0, 0.0, 90.0, i * 12.0, i * 12.0 + 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, line_no int, page int, column int, text string, is_bold boolean, font_size double, x0 double, x1 double, y0 double, y1 double")


def texts_of(df):
    return [r.text for r in df.orderBy("line_no").collect()]


def test_bullets_take_their_lines(spark):
    df = _lines(spark, ["Intro", "more", "• built a pipe-", "line of things", "and tests", "Software Engineer, x", "tail", "- next", "Bold"], bold=(8,))
    assert texts_of(layout.merge_bullet_lines(df)) == ["Intro", "more", "• built a pipeline of things and tests", "Software Engineer, x", "tail", "- next", "Bold"]
    df = _lines(spark, ["Intro", "HONORS & AWARDS", "Spot Award for work", "in the team", "Education", "Merit Scholarship"])
    assert texts_of(layout.collapse_award_bullets(df)) == ["Intro", "• HONORS & AWARDS", "• Spot Award for work in the team Education Merit Scholarship"]


def test_degrees_and_titles_take_what_follows(spark):
    df = _lines(spark, ["B.Tech in", "computer science", "Some University", "Senior", "engineer of data", "Lead", "• bullet"])
    assert texts_of(layout.merge_education_and_titles(df)) == ["B.Tech in computer science, Some University", "Senior engineer of data", "Lead", "• bullet"]
    df = _lines(spark, ["built good products Data Scientist, Acme", "Data at the start"])
    assert texts_of(layout.split_glued_roles(df)) == ["built good products", "Data Scientist, Acme", "Data at the start"]


def test_rules_find_sections(spark):
    df = _lines(spark, ["Jane Doe", "WORK EXPERIENCE", "acme corp", "did this", "TECHNCAL SKILLS", "sql, python", "|", "EDUCATION ____", "a school"])
    got = [(r.section_type, r.text) for r in layout.rule_sections(df).orderBy("sec_no").collect()]
    assert got == [("work_experience", "acme corp did this"), ("skills", "sql, python"), ("education", "a school")]
    assert [(r.section_type, r.text) for r in layout.rule_sections(_lines(spark, ["no headers", "here"])).collect()] == [("other", "no headers here")]
    assert one(spark, layout.plain_glyphs(F.col("a")), a="\\ faPhone ★ ﬁx ,y") == "Phone: ★ fix, y"


def test_question_entities(spark):
    df = spark.createDataFrame([("Spark with 5+ years, M.Tech projects",), (None,), ("Backend enginer",)], "question string")
    got = matching.query_entities(df).collect()
    assert got[2].roles == ["backend engineer"] and got[0].skills == ["spark"] and got[0].degrees == ["m.tech"] and got[0].sections == ["project"] and got[0].min_years == 5
    assert got[1].skills == [] and got[1].min_years is None
    assert fuzzy.weighted_ratio_of("data engineer", "engineer data") == 95.0 and fuzzy.weighted_ratio_of("", "a") == 0.0


def test_nearest_vectors_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(80)] + [(90, None), (91, [0.0] * 3), (92, [1.0]), (93, [1.0, 0.0, 0.0, 2.0])]
    store = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(1, 2.0, [1.0, 0.0, 0.5]), (2, 1.0, [0.0, 0.0, 0.0]), (3, 1.0, [0.3, -0.2, 0.9])], "qid int, weight double, embedding array<float>")
    key = lambda r: (r.qid, r.rank, r.id, r.weight, round(r.dist, 6))
    want = retrieval.top_k(retrieval.distances(store, queries), 7)
    got = retrieval.knn(store, queries, 7)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert retrieval.knn(store, queries.limit(0), 7).count() == 0


def test_extraction_from_sections(spark):
    work = "Software Engineer | Acme Corp | Aug 2020 - Present\n• cut cost by 30% with python\nand sql\n\nresearch intern at Beta Labs\nMay 2018 - Jul 2018\nhelped"
    rows = [(0, 1, "work_experience", work), (0, 2, "education", "B.Tech, dual degree 2014 - 2018 CGPA 8.5/10"), (0, 3, "projects", "Search Tool\nbuilt with docker https://github.com/x/y 250 qps\nSecond One\nplain")]
    df = spark.createDataFrame(rows, "doc_id int, sec_no int, section_type string, text string")
    a, b = people.extract_experience(df).orderBy("block_no").collect()
    assert (a.title_norm, a.company_raw, a.start, a.end, a.is_current, a.extraction_confidence) == ("software engineer", "Aug 2020 - Present", "2020-08", None, True, 1.0)
    assert [x.bullet_text for x in a.bullets] == ["cut cost by 30% with python", "and sql"] and a.bullets[0].metrics == {"percent": 30} and a.bullets[0].skills_mentioned == ["python"]
    assert (b.title_norm, b.employment_type, b.company_raw, b.start, b.end) == ("research intern", "internship", "Beta Labs", "2018-05", "2018-07")
    e = people.extract_education(df).first()
    assert (e.degree_raw, e.degree_level, e.gpa, e.start_date, e.end_date, e.extraction_confidence) == ("Dual Degree", "bachelors", "8.5/10", "2014-01", "2018-01", 0.6)
    p, q = people.extract_projects(df).orderBy("block_no").collect()
    assert (p.name, p.repo_url, p.impact_metrics, q.name, q.summary) == ("Search Tool", "https://github.com/x/y", {"throughput_qps": 250}, "Second One", "plain") and "docker" in p.tech_stack


def test_paths_batches_and_the_newest(spark, tmp_path):
    df = spark.createDataFrame([("/in/b.pdf", 20), ("/in/a.pdf", 10)], "path string, t long")
    made = readers.batch_summary(readers.output_paths(df), "/in").first()
    assert made.batch_dir == "/in" and made["items"][0].input == "/in/a.pdf" and json.loads(made["items"][1].outputs)["lines"] == "/in/b_lines.json"
    files = df.withColumn("mtime", F.timestamp_seconds("t"))
    assert readers.newest(files, F.timestamp_seconds(F.lit(21))).first().path == "/in/b.pdf"
    assert readers.newest(files, F.timestamp_seconds(F.lit(30))).first().path is None
    readers.write_store(df, str(tmp_path / "s"))
    readers.write_store(df.limit(1), str(tmp_path / "s"))
    readers.write_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1 and spark.read.json(str(tmp_path / "j")).count() == 2
    tables = spark.createDataFrame([("x.pdf", 0, [["a", None], ["b ", "c"]])], "source string, page int, rows array<array<string>>")
    assert readers.table_documents(tables).first().page_content == "| a |  |\n| b | c |"
    assert one(spark, X.merge_wrapped_bullets(F.col("a")), a="one\ntwo\nThree") == "one two\nThree"


def test_large_lists_are_joined_in_blocks(spark, monkeypatch):
    words = spark.createDataFrame([("aple",), ("bannana",), ("zzzzz",)], "word string")
    known = spark.createDataFrame([("apple", 5), ("maple", 9), ("banana", 2), ("kiwi", 1), ("pear", 3)], "term string, freq int")
    people = spark.createDataFrame([("Ann Lee", "a@x"), ("Bo Ray", "b@x")], "full_name string, email string")
    tokens = spark.createDataFrame([(0, "ann"), (1, "ray"), (2, "lee")], "pos int, token string")
    store = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id int, embedding array<float>")
    asked = spark.createDataFrame([(i, 1.0, [1.0, float(i)]) for i in range(5)], "qid int, weight double, embedding array<float>")
    both = lambda: [sorted(map(tuple, df.collect())) for df in (matching.spell(words, known), matching.fuzzy_names(tokens, people), retrieval.distances(store, asked), retrieval.knn(store, asked, 2))]
    whole = both()
    monkeypatch.setattr(matching, "MOST_ROWS", 2)
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 2)
    assert both() == whole and dict(whole[0])["aple"] == "maple"


def test_word_processor_files_become_lines(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t, size=None, bold=None: f"<w:r><w:rPr>{f'<w:sz w:val=\"{size}\"/>' if size else ''}{f'<w:b w:val=\"{bold}\"/>' if bold is not None else ''}</w:rPr>{t}</w:r>"
    body = "".join(f"<w:p>{x}</w:p>" for x in (
        run("<w:t>Ann  Lee</w:t>", 32, "true"), "", run("<w:t>a</w:t><w:tab/><w:t>b</w:t>") + run("<w:t> c</w:t>", None, "0"), run("<w:t>x</w:t>", 20) + run("<w:t>y</w:t>", 24, "1"),
    )) + f"<w:tbl><w:tr><w:tc><w:p>{run('<w:t>in a table</w:t>')}</w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "b.txt").write_text("text")
    got = readers.read_docx(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.font_size, r.is_bold, r.y0, r.y1) for r in got] == [(0, "Ann Lee", 16.0, True, 0.0, 20.0), (1, "a b c", 11.0, False, 36.0, 51.0), (2, "xy", 11.0, True, 55.0, 70.0)]
    assert all(r.page == 1 and r.x1 == 600.0 and r.doc_id.endswith("a.docx") for r in got)


def test_windows_over_a_stream_equal_those_over_a_batch(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * (i // 2)), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    schema = "event_id long, ts timestamp, user_id int, event_type string, value double"
    batch = spark.createDataFrame([*rows, rows[5], rows[90]], schema)
    for part in range(4):
        batch.where(f"event_id % 100 div 25 = {part}" if part else "event_id % 100 < 25").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, query in {"tumbling": events.tumbling, "sessions": lambda e: events.sessions(e, gap="10 minutes"), "once": events.once}.items():
        out, at = f"{tmp_path}/{name}", f"{tmp_path}/state-{name}"
        stream = query(events.read(spark, f"{tmp_path}/in", schema))
        stream.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).outputMode("append").start(out).awaitTermination()
        got = {tuple(map(str, r)) for r in spark.read.parquet(out).select(sorted(stream.columns)).collect()}
        want = {tuple(map(str, r)) for r in query(batch).select(sorted(stream.columns)).collect()}
        # A stream holds back what late events may still change.
        assert got and got <= want and len(want) - len(got) <= 40, name


def test_chunks_are_cut_at_the_strongest_separator(spark):
    text = "para one is here\n\npara two\n• bullet one\n• bullet two is longer than ten\n- x"
    df = spark.createDataFrame([(0, text), (1, "x" * 25), (2, ""), (3, None)], "doc_id int, text string")
    got = retrieval.chunk_texts(df, size=20, overlap=5, collapse=False).orderBy("doc_id", "chunk_no").collect()
    assert [r.chunk for r in got if r.doc_id == 0] == ["para one is here", "para two", "• bullet one", "• bullet two is", "is longer than ten", "- x"]
    assert [len(r.chunk) for r in got if r.doc_id == 1] == [20, 10] and not [r for r in got if r.doc_id > 1]


def test_two_means_reject_uneven_or_close_clusters(spark):
    pages = {1: [0, 1, 2, 100, 101, 102], 2: [0, 1, 2, 3, 4, 5, 6, 7, 8, 100], 3: [0, 10, 20, 30, 40], 4: [7], 5: [5, 5, 5]}
    df = spark.createDataFrame([(0, p, float(x), float(x)) for p, xs in pages.items() for x in xs], "doc_id int, page int, x0 double, x1 double")
    got = {r.page: (r.low, r.high, r.cut) for r in sections.two_means(df).collect()}
    assert got[1] == (1.0, 101.0, 51.0) and [got[p][2] is None for p in (2, 4, 5)] == [True] * 3 and got[4][:2] == (7.0, 7.0)


def test_comparison_of_systems_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(e, "f", s, rng.choice(["", None, " A  b", "a b", *(f"i{k}" for k in range(60))])) for e in "xy" for s in ("p", "q", "r") for _ in range(60)]
    rows += [("z", "f", "p", None), ("z", "f", "q", " "), ("w", "f", "p", "only"), ("w", "f", "q", "")]
    df = spark.createDataFrame(rows, "entity string, field string, system string, item string")
    sets = {}
    for e, _, s, i in rows:
        sets.setdefault(e, {}).setdefault(s, set()).update({" ".join(i.lower().split())} - {""} if i else ())
    got = {(r.entity, r.system_a, r.system_b): r for r in evaluation.compare(df).collect()}
    assert len(got) == 3 + 3 + 1 + 1
    for (e, a, b), r in got.items():
        x, y = sets[e][a], sets[e][b]
        assert (r.size_a, r.size_b, r.jaccard) == (len(x), len(y), round(len(x & y) / len(x | y), 4) if x | y else 1.0)
        assert r.a_minus_b == sorted(x - y)[:20] and r.b_minus_a == sorted(y - x)[:20]
    best = {r.entity: (r.winner, r.union_count) for r in evaluation.winners(df).collect()}
    assert best == {e: (min(s, key=lambda k: (-len(s[k]), k)), len(set().union(*s.values()))) for e, s in sets.items()}


def test_numbers_in_parts_are_those_of_one_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, id int")
    got = {r.id: r.k for r in schedule.numbered(df, F.floor(F.col("a") / 7), "a", "id").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {i: k for k, (_, i) in enumerate(want, 1)}


@pytest.mark.parametrize("cutoff", [40, 70, 85, 92, 100])
def test_grams_lose_no_pair(spark, cutoff):
    rng = random.Random(cutoff)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    left = [word(rng.randint(1, 14)) for _ in range(60)]
    right = [word(rng.randint(1, 25)) for _ in range(60)] + [w[:3] + rng.choice("ab") + w[4:] + word(4) for w in left[:30]] + left[:5] + ["", "aaaa", "aaaaaaab"]
    as_df = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "x string")
    got = {(r.a, r.b) for r in gramjoin.partial_ratio_join(as_df(left), as_df(right), cutoff).collect()}
    assert got == {(a, b) for a in left for b in right if b and fuzzy.partial_ratio_of(a, b) >= cutoff}


def test_grams_leave_few_pairs_to_score(spark):
    rng = random.Random(3)
    letters = "".join(chr(97 + i) for i in range(26))
    name = lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(5, 9))).title() for _ in range(2))
    names = [name() for _ in range(2000)]
    tokens = [n.split()[0].lower() for n in names[:200]]
    a, b = spark.createDataFrame([(t,) for t in set(tokens)], "a string"), spark.createDataFrame([(n.lower(),) for n in set(names)], "b string")
    tried = gramjoin.candidates(a, b, 85, strict=False)
    assert tried.count() * 100 < a.count() * b.count()
    assert "BroadcastNestedLoopJoin" not in tried._jdf.queryExecution().executedPlan().toString()


def test_bands_look_both_ways_across_columns(spark):
    rows = [(0, 1, 0, 10.0, 10.0, "left"), (0, 1, 1, 60.0, 8.0, "r8"), (0, 1, 1, 60.0, 12.0, "r12"), (0, 1, 1, 60.0, 14.9, "late"), (0, 2, 0, 10.0, 10.0, "next page"), (0, 1, 0, 10.0, 13.0, "below")]
    df = spark.createDataFrame(rows, "doc_id int, page int, column int, x0 double, y0 double, text string")
    assert {r.text: r.line_no for r in sections.bands(df).collect()} == {"left": 1, "r8": 1, "r12": 1, "below": 2, "late": 2, "next page": 3}
    rng = random.Random(6)
    rows = [(d, 1, rng.randint(0, 1), float(rng.randint(0, 9)), rng.randint(0, 40) / 2, f"t{i}") for d in range(5) for i in range(30)]
    want = {}
    for d in range(5):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[4], r[3], r[5]))
        taken, n = {}, 0
        for i, a in enumerate(own):
            if i not in taken:
                n += 1
                taken |= {j: n for j in range(i, len(own)) if j not in taken and abs(own[j][4] - a[4]) < 3}
        want |= {(d, r[5]): taken[i] for i, r in enumerate(own)}
    got = sections.bands(spark.createDataFrame(rows, df.schema)).collect()
    assert {(r.doc_id, r.text): r.line_no for r in got} == want


def aligned(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_swaps_count_once_in_spelling(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(3000)] + [("ca", "abc"), ("", "ab"), ("ab", "")]
    assert all(fuzzy.alignment_of(a, b) == aligned(a, b) for a, b in pairs)
    words, terms = sorted({word() or "a" for _ in range(60)}), {word() or "b": rng.randint(1, 5) for _ in range(25)}
    got = dict(map(tuple, matching.spell(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, freq int")).collect()))
    near = {w: min((aligned(w, t), -n, t) for t, n in terms.items()) for w in words}
    assert got == {w: best[2] if best[0] <= 2 else w for w, best in near.items()}
    assert dict(map(tuple, matching.spell(spark.createDataFrame([("recieve",), (None,)], "word string"), spark.createDataFrame([("receive", 1), ("receiver", 9)], "term string, freq int")).collect())) == {"recieve": "receive"}


def test_variants_of_questions(spark):
    df = spark.createDataFrame([(1, "Engineer with sql and R "), (2, " "), (3, None), (4, "developer")], "id int, question string")
    got = {}
    for r in retrieval.variants(df, 4).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.variant)
    q = "Engineer with sql and R"
    assert got == {1: [q, f"{q} projects", f"{q} experience", f"{q} resume", q], 4: ["developer", "engineer", "developer projects", "developer experience", "developer"]}
    assert [r.variant for r in retrieval.variants(df.where("id = 4"), 1).collect()] == ["developer"]


def test_scores_of_a_model_take_the_place_of_the_cosine(spark):
    pool = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.7, 2)], "id int, score double, first_rank int")
    scores = spark.createDataFrame([(2, 0.4), (2, 1.7), (9, 1.0), (3, -1.0)], "id int, score double")
    assert sorted((r.id, r.score) for r in retrieval.rerank_by(pool, scores).collect()) == [(1, 0.0), (2, 1.0), (3, 0.0)]
    assert [r.id for r in retrieval.rerank_by(pool, scores, 1).collect()] == [1]


def test_the_one_column_reader_cuts_at_the_left_midpoint(spark):
    rows = [(0, 1, float(x), x + 2.0) for x in (0, 1, 2, 10, 11, 12)] + [(0, 2, float(x), x + 2.0) for x in (0, 10, 20, 30, 40, 50)]
    df = spark.createDataFrame(rows, "doc_id int, page int, x0 double, x1 double")
    one_column = sections.column_cut(df, strict=True, at_left=True, least_lines=6)
    assert [(r.page, r.cut) for r in one_column.collect()] == [(1, 3.0)] and sections.column_cut(df).first().cut == 7.0
    assert sections.column_cut(df.where("x0 < 12"), strict=True, at_left=True, least_lines=6).count() == 0


ENTITY = "doc_id int, sec_no int, system string, label string, word string, start int, end int, score double"


def test_better_entities_stand(spark):
    rng = random.Random(15)
    rows = [(d, 1, rng.choice(["hf", "spacy"]), "org", f" w{i} ", a := rng.randint(0, 400), a + rng.randint(1, 150), rng.choice([0.2, 0.5, None])) for d in range(3) for i in range(40)]
    rows += [(9, 1, "hf", "org", " ", 0, 3, 0.9), (9, 1, "hf", "org", "x", 2, 2, 0.9), (9, 1, "hf", "misc", "y", 1, 4, 0.1), (9, 1, "hf", "misc", "y", 1, 4, 0.1)]
    rank = lambda r: (-(r[7] or 0.0), r[5], -r[6], r[4])
    real = {r for r in rows if r[4].strip() and r[5] < r[6]}
    want = {(r[0], r[2], r[4].strip()) for r in real if not any(o[0] == r[0] and o[2] == r[2] and o[5] < r[6] and o[6] > r[5] and rank(o) < rank(r) for o in real)}
    got = people.standing(spark.createDataFrame(rows, ENTITY)).collect()
    assert {(r.doc_id, r.system, r.word) for r in got} == want and len(got) == len(want) and {r.label for r in got} == {"ORG", "MISC"}


def test_entities_name_companies_and_institutions(spark):
    work = "  \n Data Analyst at Nowhere\n2019 - 2020\n\n\n\nClerk\nat Beta"
    df = spark.createDataFrame([(0, 1, "work_experience", work), (1, 1, "work_experience", None), (0, 2, "education", "B.Tech\nSome School\n\nDiploma")], "doc_id int, sec_no int, section_type string, text string")
    at = lambda t, w: (t.index(w), t.index(w) + len(w))
    edu = "B.Tech\nSome School\n\nDiploma"
    rows = [(0, 1, "spacy", "ORG", "Nowhere", *at(work, "Nowhere"), 0.9), (0, 1, "spacy", "ORG", "Data", *at(work, "Data"), 0.8), (0, 1, "hf", "ORG", "Beta", *at(work, "Beta"), 0.9), (0, 2, "hf", "ORG", "Some School", *at(edu, "Some School"), 0.7), (0, 2, "hf", "PER", "Diploma", *at(edu, "Diploma"), 0.7)]
    found = spark.createDataFrame(rows, ENTITY)
    name = lambda **more: [r.company_raw for r in people.extract_experience(df, found, **more).orderBy("block_no").collect() if r.title_raw]
    assert name() == ["Data", None] and name(systems=("hf",)) == ["Nowhere", None]
    assert [r.company_raw for r in people.extract_experience(df).where("title_norm = 'data analyst'").collect()] == ["Nowhere"]
    assert [(r.institution_raw, r.extraction_confidence) for r in people.extract_education(df, found).orderBy("block_no").collect()] == [("Some School", 0.7), (None, 0.4)]


def test_strict_dates_are_ranges_alone(spark):
    read = lambda t: tuple(one(spark, X.date_range_strict(F.col("a")), a=t))
    assert read("Aug 2020 - Sept. 2021") == ("2020-08-01", "2021-09-01", False)
    assert read("from March, 2019 to present") == ("2019-03-01", None, True)
    assert read("2016 – 2020 x") == ("2016-01-01", "2020-01-01", False)
    assert read("in 2020, Aug '20 - Sep '21") == (None, None, False)


def test_flips_are_suppressed_as_by_a_scan(spark):
    rng = random.Random(18)
    rows = [(d, i, rng.choice("ab") if rng.random() < 0.9 else rng.choice(["c", None]), rng.choice([0.1, 0.9, None])) for d in range(4) for i in range(60)]
    want = {}
    for d in range(4):
        own = [list(r) for r in rows if r[0] == d]
        for x, y, z in zip(own, own[1:], own[2:], strict=False):
            if None not in (x[2], y[2], z[2], y[3]) and y[2] != x[2] == z[2] and y[3] < 0.55:
                y[2] = x[2]
        want |= {(r[0], r[1]): r[2] for r in own}
    got = sections.suppress_flips(spark.createDataFrame(rows, "doc_id int, line_no int, label string, score double"))
    assert {(r.doc_id, r.line_no): r.label for r in got.collect()} == want
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_folds_keep_documents_whole_across_batches(spark):
    rows = [(d, i) for d, n in ((1, 7), (2, 1), (3, 40), (None, 3), (5, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = folding.fold(df, lambda rows: [{"doc_id": rows[0]["doc_id"], "line_no": len(rows)}], df.schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 7), (2, 1), (3, 40), (None, 3), (5, 2)]))
