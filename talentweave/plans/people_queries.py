"""Queries of candidate lists, stages, records, tables, scheduling and agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentweave.operators import evaluation as E
from talentweave.operators import matching as M
from talentweave.operators import people as P
from talentweave.operators import retrieval as R
from talentweave.operators import schedule as S
from talentweave.operators.dealing import dealt, parts
from talentweave.plans import catalog as C
from talentweave.plans import sqlgate
from talentweave.sources import scratch, store
from talentweave.streaming import events as V
from talentweave.streaming import ingest

WINDOW = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")


def candidate_list_filtered(spark, sf):
    return P.candidate_list(C.people(spark, sf), None, "BUILDING", ["candidate_id", "full_name", "job_score"])


def candidate_top_nulls_first(spark, sf):
    p = C.people(spark, sf)
    return p.orderBy(F.desc_nulls_first("job_score"), "candidate_id").limit(200).select("candidate_id", "job_score")


def in_list_conjunction(spark, sf):
    return C.people(spark, sf).where(F.col("candidate_id").isin(*range(0, 400, 7)) & (F.col("stage_of_process") == "MACHINERY")).select("candidate_id", "stage_of_process")


def stage_transition(spark, sf):
    moved, _ = P.move_stage(C.people(spark, sf), list(range(0, 900, 3)), "BUILDING", "ASSESSMENT")
    return moved.select("candidate_id", "stage_of_process")


def stage_changed_rows(spark, sf):
    return P.move_stage(C.people(spark, sf), list(range(0, 900, 3)), "BUILDING", "ASSESSMENT")[1].select("candidate_id", "stage_of_process")


def stage_counts(spark, sf):
    return C.people(spark, sf).groupBy("stage_of_process").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("job_score"), 4).alias("score"))


def stage_dropoff(spark, sf):
    n = C.people(spark, sf).groupBy("stage_of_process").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("before", F.lag("n").over(Window.orderBy("stage_of_process"))).withColumn("dropped", F.col("before") - F.col("n"))


def scope_wrapper(spark, sf):
    views = {"candidate": C.people(spark, sf)}
    return sqlgate.run(spark, "select candidate_id, primary_email, job_score from candidate where job_score > 100;", views, scope=[{"email": "Customer000000010@example.com"}, "customer000000011@example.com", "customer000000012@example.com"])


def gated_sql(spark, sf):
    views = {"candidate": C.people(spark, sf)}
    return sqlgate.run(spark, "-- by stage\nwith t as (select stage_of_process, job_score from candidate where job_score > :least) select stage_of_process, count(*) as n from t group by 1", views, args={"least": 5000})


def scope_filter(spark, sf):
    return R.scope_filter(C.people(spark, sf), ["CUSTOMER000000020@example.com", {"email": "customer000000021@example.com"}]).select("candidate_id")


def enrich_left_join(spark, sf):
    p = C.people(spark, sf)
    chosen = p.where("candidate_id % 11 = 0").select(F.col("candidate_id").alias("pos"), F.col("primary_email").alias("email"))
    matches = p.where("candidate_id % 2 = 0").select(F.col("primary_email").alias("email"), F.lit("q").alias("query_name"), F.col("full_name").alias("matched_name"))
    return M.enrich_scope(chosen, matches)


def job_score_weighted(spark, sf):
    li = C.table(spark, sf, "lineitem")
    kind = F.coalesce(*[F.when(F.col("l_linenumber") == i + 1, F.lit(k)) for i, k in enumerate(("work_experience", "skills", "education", "projects"))], F.lit("summary"))
    s = li.select(F.col("l_orderkey").alias("doc_id"), kind.alias("section_type"), F.when(F.col("l_returnflag") == "R", F.lit(" ")).otherwise(F.col("l_returnflag")).alias("text"), F.col("l_discount").alias("similarity"))
    return P.job_score(s)


def _records(spark, sf):
    """Canonical records from orders and their lines."""
    li = C.table(spark, sf, "lineitem")
    work = F.struct(
        F.col("l_returnflag").alias("company_raw"), F.col("l_returnflag").alias("company_norm"), F.concat(F.lit("Title "), "l_linenumber").alias("title_raw"), F.when(F.col("l_linenumber") % 2 == 0, "research intern").otherwise("sde").alias("title_norm"),
        F.lit(None).cast("string").alias("seniority"), F.lit(None).cast("string").alias("employment_type"), F.lit(None).cast("string").alias("location"), F.date_format("l_shipdate", "yyyy-MM").alias("start_date"), F.lit("junk").alias("end_date"),
        F.lit(None).cast("boolean").alias("is_current"), F.lit(0.5).alias("extraction_confidence"), F.lit(None).cast("int").alias("source_page"),
    )
    g = dealt(li, parts(li), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", work.alias("w")))).alias("w"), F.sort_array(F.collect_set(F.struct(F.lower("l_linestatus").alias("name"), F.lit(None).cast("string").alias("category")))).alias("skills"))
    o = C.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    empty = lambda t: F.array().cast(t)
    return o.select(
        F.col("o_orderkey").alias("candidate_id"), F.struct(F.concat(F.lit("/in/"), "o_orderkey", F.lit(".pdf")).alias("source_path")).alias("meta"),
        F.struct(
            F.concat(F.lit("Name "), "o_custkey").alias("full_name"), F.array(F.concat(F.lit("b"), "o_custkey", F.lit("@x.com")), F.concat(F.lit("a"), "o_custkey", F.lit("@x.com")), F.concat(F.lit("b"), "o_custkey", F.lit("@x.com"))).alias("emails"),
            F.array(F.concat(F.lit("98765-"), F.lpad("o_custkey", 5, "0")), F.lit("12")).alias("phones"), F.struct(F.lit(None).cast("string").alias("linkedin"), F.lit("github.com/x").alias("github")).alias("links"),
        ).alias("candidate"),
        F.transform("w", lambda s: s["w"].withField("bullets", empty("array<struct<bullet_text:string,metrics:map<string,int>,skills_mentioned:array<string>,source_page:int>>"))).alias("experience"), empty("array<struct<degree_raw:string,degree_level:string,field_raw:string,institution_raw:string,start_date:string,end_date:string,gpa:string,extraction_confidence:double,source_page:int>>").alias("education"), "skills",
        empty("array<struct<name:string,summary:string,role:string,tech_stack:array<string>,start_date:string,end_date:string,repo_url:string,impact_metrics:map<string,int>,source_page:int>>").alias("projects"),
        empty("array<struct<name:string,summary:string,issue_date:string,credential_id:string,url:string>>").alias("certifications"), empty("array<struct<title:string,year:int,url:string>>").alias("publications"),
        F.array(F.col("o_orderpriority"), F.lit(None).cast("string"), F.lit("prize")).alias("achievements"), F.array(F.struct(F.lit("English").alias("name"), F.lit("fluent").alias("level"))).alias("languages"),
        F.array(F.struct(F.lit("skills").alias("section_type"), F.col("o_orderpriority").alias("text"), F.array(F.lit(1), F.lit(2)).alias("page_range")), F.struct(F.lit("other").alias("section_type"), F.lit("end").alias("text"), F.array(F.lit(2), F.lit(2)).alias("page_range"))).alias("sectioned_text"),
    )


def _tables(spark, sf):
    return P.fan_out(P.canonical(_records(spark, sf), F.lit("2024-01-01T00:00:00Z")))


def canonical_candidate(spark, sf):
    return _tables(spark, sf)["candidate"].select("candidate_id", "full_name", "primary_email", F.array_join("alt_emails", ",").alias("alt_emails"), "primary_phone", "github_url", "resume_text_hash", "source_file_id")


def explode_children(spark, sf):
    return _tables(spark, sf)["experience"].groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_date").alias("first"), F.count("end_date").alias("ends"), F.count_if(F.col("employment_type") == "internship").alias("internships"))


def child_tables(spark, sf):
    t = _tables(spark, sf)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(t.items()) if name in ("achievement", "candidate_language", "raw_section_text", "skill", "project", "publication")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def achievements_row(spark, sf):
    return _tables(spark, sf)["achievement"]


def skills_row(spark, sf):
    return _tables(spark, sf)["skill"].select("candidate_id", F.array_join("name_norm", ",").alias("skills"))


def record_chunks(spark, sf):
    return P.chunks_of_record(P.canonical(_records(spark, sf), F.lit("x"))).groupBy(F.col("metadata")["section"].alias("section")).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest_wins(spark, sf):
    c = C.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(0).alias("version"))
    new = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").cast("int").alias("version"))
    return P.upsert(c, new, ["c_custkey"], "version", keep_old=("c_name",))


def upsert_batches(spark, sf):
    """Orders as three batches of records, upserted one after the other."""
    o = C.table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("name"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 3).alias("batch"))
    at = scratch.folder(spark)
    rows.repartition("batch").write.partitionBy("batch").parquet(at)
    return ingest.current(spark, at, ["id"], "version", keep_old=("name",))


def _versions(spark, sf):
    """Documents as files: an earlier state, some texts and files of which differ, and the present one."""
    d = C.table(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    old = d.where("doc_id % 89 <> 1").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    gone = d.where("doc_id % 83 = 2").withColumn("name", F.concat(F.lit("old"), "name"))
    return old.unionByName(gone), d


def _store(spark, sf):
    at, found = scratch.folder(spark), None
    for files in _versions(spark, sf):
        lines = lambda names, files=files: files.join(names, "name", "left_semi").select("name", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        found = store.update(spark, at, files.select("name", F.sha1("text").alias("sha1")), lines)
    return at, found


def store_rows(spark, sf):
    """The lines that a store holds after an update."""
    return store.rows(spark, _store(spark, sf)[0]).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def store_changes(spark, sf):
    return _store(spark, sf)[1].select("name", "change")


def append_once(spark, sf):
    n = C.table(spark, sf, "nation")
    return P.append_children(n.where("n_nationkey < 15"), n.where("n_nationkey >= 10"), once=True)


def score_update(spark, sf):
    s = C.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.max("o_totalprice").alias("job_score"))
    return P.set_scores(C.people(spark, sf).select("candidate_id", "job_score"), s)


def interval_containment(spark, sf):
    s = C.slots(spark, sf)
    return s.where(S.within(F.col("start_ts"), F.col("end_ts"), F.to_timestamp_ntz(F.lit(WINDOW[0])), F.to_timestamp_ntz(F.lit(WINDOW[1])))).select("id", "start_ts", "end_ts")


def interval_overlap_join(spark, sf):
    return S.overlap_join(C.slots(spark, sf).where("status = 'free'"))


def open_slots(spark, sf):
    a, b = (F.to_timestamp_ntz(F.lit(w)) for w in WINDOW)
    return S.open_slots(C.slots(spark, sf), C.interviewers(spark, sf), a, b).select("id", "interviewer_id", "nth")


def schedule_reference(spark, sf):
    a, b = (F.to_timestamp_ntz(F.lit(w)) for w in WINDOW)
    return S.match_reference(C.people(spark, sf), C.slots(spark, sf), C.interviewers(spark, sf), a, b, 45)


def schedule_exclusive(spark, sf):
    a, b = (F.to_timestamp_ntz(F.lit(w)) for w in WINDOW)
    return S.match_exclusive(C.people(spark, sf), C.slots(spark, sf), C.interviewers(spark, sf), a, b, 45)


def _booked(spark, sf):
    a, b = (F.to_timestamp_ntz(F.lit(w)) for w in WINDOW)
    staff = C.interviewers(spark, sf).withColumn("email", F.concat(F.lit("iv"), "interviewer_id", F.lit("@example.com")))
    return S.book(C.people(spark, sf), C.slots(spark, sf), staff, a, b, 45, "7")


def booking_results(spark, sf):
    return _booked(spark, sf).results.select("candidate_id", "slot_id", "interviewer_id", "start_ts", "end_ts", "status", "reason")


def booking_interviews(spark, sf):
    return _booked(spark, sf).interviews.select("candidate_id", "candidate_email", "interviewer_id", "interviewer_email", "job_id", "slot_id", "start_ts", "end_ts", "title", "status")


def booking_notifications(spark, sf):
    return _booked(spark, sf).notifications.select("kind", "to_email", "subject", F.get_json_object("payload_json", "$.slot_id").cast("long").alias("slot_id"), "status")


def booking_states(spark, sf):
    """The slots and candidates after the bookings."""
    b = _booked(spark, sf)
    return b.slots.select(F.lit("slot").alias("what"), "id", F.col("status").alias("state")).unionByName(b.candidates.select(F.lit("candidate").alias("what"), F.col("candidate_id").alias("id"), F.col("stage_of_process").alias("state")))


def slot_add_minutes(spark, sf):
    return C.table(spark, sf, "events").select("event_id", F.timestamp_add("MINUTE", (F.col("user_id") % 90).cast("int"), F.col("ts")).alias("end_ts"))


def notification_log(spark, sf):
    n = S.notifications(C.people(spark, sf).select(F.col("primary_email").alias("candidate_email"), F.lit("iv@example.com").alias("interviewer_email"), F.lit("Interview").alias("title")))
    return S.mark_sent(n, ["iv@example.com"], "Interview Scheduled: Interview")


def quick_booking(spark, sf):
    s = C.slots(spark, sf).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("candidate_id"), F.when(F.col("id") % 5 > 0, F.col("interviewer_id")).alias("interviewer_id"), "start_ts", "end_ts")
    ok, bad = S.quick_book(s)
    return ok.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(bad.groupBy(F.array_join("missing", ",").alias("status")).agg(F.count(F.lit(1)).alias("n")))


def availability_requests(spark, sf):
    return S.request_availability(C.interviewers(spark, sf), "1", F.concat(F.lit("t-"), "interviewer_id"))


def availability_answers(spark, sf):
    i = C.interviewers(spark, sf)
    asked = S.request_availability(i, "1", F.concat(F.lit("t-"), "interviewer_id")).select("id", "interviewer_id", F.lit(None).cast("timestamp_ntz").alias("start_ts"), F.lit(None).cast("timestamp_ntz").alias("end_ts"), "status")
    answers = i.where("interviewer_id % 2 = 0").select(F.concat(F.lit("t-"), "interviewer_id").alias("token"), F.array(*[F.struct(F.to_timestamp_ntz(F.lit(w)).alias("start_ts"), F.to_timestamp_ntz(F.lit(w)).alias("end_ts")) for w in WINDOW]).alias("slots"))
    return S.ingest_availability(asked, answers).select("id", "interviewer_id", "status")


def _items(spark, sf):
    w = C.words(spark, sf)
    return w.select(F.col("source").alias("entity"), F.lit("word").alias("field"), F.col("lang").alias("system"), F.col("word").alias("item"))


def jaccard_pairs(spark, sf):
    return E.compare(_items(spark, sf), differences=0).select("entity", "system_a", "system_b", "size_a", "size_b", "jaccard")


def set_diff_clip20(spark, sf):
    return E.compare(_items(spark, sf)).select("entity", "system_a", "system_b", F.array_join("a_minus_b", ",").alias("a_minus_b"), F.array_join("b_minus_a", ",").alias("b_minus_a"))


def winner_by_size(spark, sf):
    return E.winners(_items(spark, sf)).select("entity", "winner", "union_count")


def manifest_diff(spark, sf):
    o = C.table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").cast("string").alias("name"), F.sha1(F.col("o_orderstatus")).alias("sha1"))
    new = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").cast("string").alias("name"), F.sha1(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("sha1"))
    return E.manifest_changes(old, new)


def required_fields(spark, sf):
    p = C.people(spark, sf)
    missing = F.array_compact(F.array(F.when(F.col("job_score").isNull(), "job_score"), F.when(F.col("job_id") == 0, "job_id")))
    return p.select("candidate_id", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def job_lookup(spark, sf):
    n = C.table(spark, sf, "nation").select(F.col("n_nationkey").alias("job_id"), F.col("n_name").alias("job_title"))
    return C.people(spark, sf).join(n, "job_id", "left").select("candidate_id", "job_title")


def tumbling_events(spark, sf):
    return V.tumbling(C.table(spark, sf, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def event_sessions(spark, sf):
    s = V.sessions(C.table(spark, sf, "events"))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def events_once(spark, sf):
    e = C.table(spark, sf, "events")
    return V.once(e.union(e.where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def experience_extraction(spark, sf):
    o = C.table(spark, sf, "orders")
    text = F.concat(F.lit("Data Analyst at Firm"), F.expr("char(65 + o_custkey % 26)"), F.lit("\n"), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - Present\n• grew by "), F.col("o_orderkey") % 90 + 10, F.lit("% with sql\n- more"))
    e = P.extract_experience(o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("sec_no"), F.lit("work_experience").alias("section_type"), text.alias("text")))
    return e.select("doc_id", "title_norm", "company_raw", "start", "is_current", "extraction_confidence", F.get("bullets", F.lit(1))["metrics"]["percent"].alias("percent"), F.size("bullets").alias("n_bullets"))


def _entities(df, *spans):
    """Entities (system, label, word, start, score) of a table's rows as a model would give them; a null word is none."""
    made = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(label).alias("label"), w.alias("word"), a.alias("start"), F.lit(score).alias("score")) for s, label, w, a, score in spans])
    return df.select("doc_id", F.lit(1).alias("sec_no"), F.explode(made).alias("e")).select("doc_id", "sec_no", "e.*").withColumn("end", F.col("start") + F.length("word")).where("word is not null")


def experience_entities(spark, sf):
    """Two blocks an order: a header with a company that systems found or not, and one of words alone."""
    k = F.col("o_orderkey")
    firm = F.concat(F.lit("Firm"), F.expr("char(65 + o_custkey % 26)"))
    head = F.concat(F.lit("  machne learning engineer, "), firm)
    o = C.table(spark, sf, "orders").select("o_orderkey", "o_custkey", k.alias("doc_id"), firm.alias("firm"), F.concat(head, F.lit("\nMay 2020 to Present\n- at Acme\n\n\nClerk @ Other Works\n2018 - 2019")).alias("text"))
    sections = o.select("doc_id", F.lit(1).alias("sec_no"), F.lit("work_experience").alias("section_type"), "text")
    found = _entities(o, ("hf", "org", F.when(k % 3 == 0, F.col("firm")), F.lit(28), 0.9), ("hf", "ORG", F.when(k % 3 == 0, F.lit("engineer, F")), F.lit(18), 0.5), ("spacy", "ORG", F.when(k % 2 == 0, F.lit("learning")), F.lit(9), 0.7),
                      ("hf", "ORG", F.lit("Acme"), F.lit(60), 0.99), ("hf", "PER", F.lit("machne"), F.lit(2), 0.8), ("other", "ORG", F.lit("machne"), F.lit(2), 0.8))
    e = P.extract_experience(sections, found, strict_dates=True)
    return e.select("doc_id", "block_no", "title_norm", "company_raw", F.col("start").alias("start_day"), F.col("end").alias("end_day"), "is_current", "extraction_confidence")


def education_entities(spark, sf):
    k = F.col("s_suppkey")
    s = C.table(spark, sf, "supplier").select("s_suppkey", k.alias("doc_id"), F.concat(F.lit("M.Tech 2001 - 2003\nState School\n\nB.Tech, College "), k).alias("text"))
    sections = s.select("doc_id", F.lit(1).alias("sec_no"), F.lit("education").alias("section_type"), "text")
    found = _entities(s, ("hf", "ORG", F.when(k % 2 == 0, F.lit("State School")), F.lit(19), 0.9), ("spacy", "ORG", F.lit("School"), F.lit(25), 0.6), ("spacy", "ORG", F.concat(F.lit("College "), k), F.lit(41), 0.4))
    return P.extract_education(sections, found).select("doc_id", "block_no", "degree_raw", "institution_raw", "start_date", "extraction_confidence")


def skills_entities(spark, sf):
    p = C.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Sql, K8S and "), "p_name").alias("text"))
    # Docker is beaten by what overlaps it, Flask comes from a system that is not asked.
    sections = p.select("doc_id", F.lit(1).alias("sec_no"), F.lit("skills").alias("section_type"), F.lit("SQL and more").alias("text"))
    found = _entities(p, ("hf", "MISC", F.when(F.col("doc_id") % 2 == 0, F.lit("Docker")), F.lit(0), 0.5), ("hf", "MISC", F.lit("Nonsense"), F.lit(4), 0.9), ("hf", "LANGUAGE", F.when(F.col("doc_id") % 3 == 0, F.lit("Java")), F.lit(20), 0.5), ("spacy", "MISC", F.lit("Flask"), F.lit(0), 0.5))
    return P.extract_skills(sections, found).select("doc_id", F.array_join("names", ",").alias("names"))


def education_extraction(spark, sf):
    s = C.table(spark, sf, "supplier")
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "B.Tech ").otherwise("Diploma "), F.col("s_suppkey") % 20 + 1990, F.lit(" - "), F.col("s_suppkey") % 20 + 1994, F.lit(" CGPA 8."), F.col("s_suppkey") % 10, F.lit("/10"))
    return P.extract_education(s.select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("sec_no"), F.lit("education").alias("section_type"), text.alias("text"))).drop("sec_no", "block_no")


def project_extraction(spark, sf):
    p = C.table(spark, sf, "part")
    text = F.concat(F.lit("Tool "), "p_partkey", F.lit("\nuses docker https://github.com/x/"), "p_partkey", F.lit("\nSecond Thing\nplain"))
    e = P.extract_projects(p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("sec_no"), F.lit("projects").alias("section_type"), text.alias("text")))
    return e.select("doc_id", "block_no", "name", "summary", "repo_url", F.array_join("tech_stack", ",").alias("tech"))


QUERIES = {f.__name__: f for f in (experience_extraction, experience_entities, education_entities, skills_entities, education_extraction, project_extraction, event_sessions, events_once, candidate_list_filtered, candidate_top_nulls_first, in_list_conjunction, stage_transition, stage_changed_rows, stage_counts, stage_dropoff, scope_wrapper, gated_sql, scope_filter, enrich_left_join, job_score_weighted, canonical_candidate, explode_children, child_tables, achievements_row, skills_row, record_chunks, upsert_latest_wins, upsert_batches, store_rows, store_changes, append_once, score_update, interval_containment, interval_overlap_join, open_slots, schedule_reference, schedule_exclusive, booking_results, booking_interviews, booking_notifications, booking_states, slot_add_minutes, notification_log, quick_booking, availability_requests, availability_answers, jaccard_pairs, set_diff_clip20, winner_by_size, manifest_diff, required_fields, job_lookup, tumbling_events)}

_P, _S, _I = C.PEOPLE_SQL, C.SLOTS_SQL, C.INTERVIEWERS_SQL
_OPEN = f"{_S}, {_I}, open as (select s.*, row_number() over (partition by s.interviewer_id order by start_ts, id)::int as nth from slots s join interviewers i on i.interviewer_id = s.interviewer_id and is_active where status = 'free' and start_ts >= timestamp '{WINDOW[0]}' and end_ts <= timestamp '{WINDOW[1]}')"
_SETS = f"{C.WORDS_SQL}, sets as (select source as entity, lang as system, list_sort(list(distinct word)) as items from words group by 1, 2), pairs as (select a.entity, a.system as system_a, b.system as system_b, a.items as x, b.items as y from sets a join sets b on a.entity = b.entity and a.system < b.system)"
_MOVED = "candidate_id % 3 = 0 and candidate_id < 900 and stage_of_process = 'BUILDING'"
_BOOKED = f"""{_P}, {_OPEN}, fit as (select * from open o where not exists (select 1 from slots b where b.interviewer_id = o.interviewer_id and b.status = 'booked' and b.start_ts < o.start_ts + interval 45 minute and b.end_ts > o.start_ts)),
    starts as (select interviewer_id, start_ts, min(id) as id from fit group by 1, 2), nexts as (select *, min(start_ts) over (partition by interviewer_id order by start_ts range between interval 45 minute following and unbounded following) as nxt from starts),
    chain as (select interviewer_id, min(start_ts) as start_ts from starts group by 1 union all select c.interviewer_id, n.nxt from chain c join nexts n on n.interviewer_id = c.interviewer_id and n.start_ts = c.start_ts where n.nxt is not null),
    given as (select s.*, row_number() over (order by start_ts, id) as k from starts s join chain using (interviewer_id, start_ts)), wanted as (select *, row_number() over (order by candidate_id) as k from people),
    matched as (select w.*, g.id as slot_id, g.interviewer_id, g.start_ts, g.start_ts + interval 45 minute as end_ts from wanted w left join given g using (k))"""
ORACLES = {
    "experience_entities": """select o_orderkey as doc_id, 0 as block_no, 'machine learning engineer' as title_norm, case when o_orderkey % 3 = 0 then 'Firm' || chr((65 + o_custkey % 26)::int) when o_orderkey % 2 = 0 then 'learning' end as company_raw, '2020-05-01' as start_day, null::varchar as end_day, true as is_current,
            case when o_orderkey % 3 = 0 or o_orderkey % 2 = 0 then 1.0 else 0.9 end::double as extraction_confidence from orders
        union all select o_orderkey, 1, null, 'Other Works', '2018-01-01', '2019-01-01', false, 0.9 from orders""",
    "education_entities": """select s_suppkey as doc_id, 0 as block_no, 'M.Tech/M.E.' as degree_raw, case when s_suppkey % 2 = 0 then 'State School' else 'School' end as institution_raw, '2001-01' as start_date, 0.8::double as extraction_confidence from supplier
        union all select s_suppkey, 1, 'B.Tech/B.E.', 'College ' || s_suppkey, case when s_suppkey between 1000 and 9999 then s_suppkey || '-01' end, case when s_suppkey between 1000 and 9999 then 0.8 else 0.7 end from supplier""",
    "skills_entities": "select p_partkey as doc_id, array_to_string(list_sort(list_filter([case when p_partkey % 3 = 0 then 'java' end, 'sql'], lambda x: x is not null)), ',') as names from part",
    "booking_results": f"with recursive {_BOOKED} select candidate_id, slot_id, interviewer_id, start_ts, end_ts, case when slot_id is null then 'failed' else 'scheduled' end as status, case when slot_id is null then 'No available slots' end as reason from matched",
    "booking_interviews": f"with recursive {_BOOKED} select candidate_id, primary_email as candidate_email, interviewer_id, 'iv' || interviewer_id || '@example.com' as interviewer_email, '7' as job_id, slot_id, start_ts, end_ts, 'Interview' as title, 'scheduled' as status from matched where slot_id is not null",
    "booking_notifications": f"with recursive {_BOOKED} select 'email' as kind, unnest([primary_email, 'iv' || interviewer_id || '@example.com']) as to_email, 'Interview Scheduled: Interview' as subject, slot_id, 'pending' as status from matched where slot_id is not null",
    "booking_states": f"with recursive {_BOOKED} select 'slot' as what, s.id, case when m.slot_id is not null then 'booked' else s.status end as state from slots s left join matched m on m.slot_id = s.id union all select 'candidate', candidate_id, case when slot_id is not null then 'interview' else stage_of_process end from matched",
    "experience_extraction": "select o_orderkey as doc_id, 'data analyst' as title_norm, 'Firm' || chr((65 + o_custkey % 26)::int) as company_raw, strftime(o_orderdate, '%Y-%m') as start, true as is_current, 1.0::double as extraction_confidence, (o_orderkey % 90 + 10)::int as percent, 3 as n_bullets from orders",
    "education_extraction": "select s_suppkey as doc_id, null::varchar as institution_raw, case when s_suppkey % 2 = 0 then 'B.Tech/B.E.' end as degree_raw, case when s_suppkey % 2 = 0 then 'bachelors' end as degree_level, '8.' || (s_suppkey % 10) || '/10' as gpa, (s_suppkey % 20 + 1990) || '-01' as start_date, (s_suppkey % 20 + 1994) || '-01' as end_date, case when s_suppkey % 2 = 0 then 0.6 else 0.5 end::double as extraction_confidence from supplier",
    "project_extraction": """select p_partkey as doc_id, 0 as block_no, 'Tool ' || p_partkey as name, 'uses docker https://github.com/x/' || p_partkey as summary, 'https://github.com/x/' || p_partkey as repo_url, 'docker,git,github' as tech from part
        union all select p_partkey, 1, 'Second Thing', 'plain', null, '' from part""",
    "event_sessions": """with a as (select user_id, ts, (lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute)::int as f from events window w as (partition by user_id order by ts)),
        b as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from b group by user_id, s""",
    "events_once": "select event_type, count(*) as n from events group by 1",
    "candidate_list_filtered": f"with {_P} select candidate_id, full_name, job_score from people where stage_of_process = 'BUILDING'",
    "candidate_top_nulls_first": f"with {_P} select candidate_id, job_score from people order by job_score desc nulls first, candidate_id limit 200",
    "in_list_conjunction": f"with {_P} select candidate_id, stage_of_process from people where candidate_id % 7 = 0 and candidate_id < 400 and stage_of_process = 'MACHINERY'",
    "stage_transition": f"with {_P} select candidate_id, case when {_MOVED} then 'ASSESSMENT' else stage_of_process end as stage_of_process from people",
    "stage_changed_rows": f"with {_P} select candidate_id, 'ASSESSMENT' as stage_of_process from people where {_MOVED}",
    "stage_counts": f"with {_P} select stage_of_process, count(*) as n, round(avg(job_score), 4) as score from people group by 1",
    "stage_dropoff": f"with {_P}, c as (select stage_of_process, count(*) as n from people group by 1) select *, lag(n) over (order by stage_of_process) as before, lag(n) over (order by stage_of_process) - n as dropped from c",
    "scope_wrapper": f"with {_P} select candidate_id, primary_email, job_score from people where job_score > 100 and primary_email in ('customer000000010@example.com', 'customer000000011@example.com', 'customer000000012@example.com')",
    "gated_sql": f"with {_P} select stage_of_process, count(*) as n from people where job_score > 5000 group by 1",
    "scope_filter": f"with {_P} select candidate_id from people where primary_email in ('customer000000020@example.com', 'customer000000021@example.com')",
    "enrich_left_join": f"with {_P} select candidate_id as pos, primary_email as email, case when candidate_id % 2 = 0 then 'q' end as query_name, case when candidate_id % 2 = 0 then full_name end as matched_name from people where candidate_id % 11 = 0",
    "job_score_weighted": """with s as (select l_orderkey as doc_id, case l_linenumber when 1 then 0.5 when 2 then 0.3 when 3 then 0.2 else 0.1 end::double as w, l_discount as x from lineitem where l_returnflag <> 'R')
        select doc_id, round(100 * sum(w * x) / sum(w), 2) as job_score from s group by 1""",
    "canonical_candidate": """select o_orderkey as candidate_id, 'Name ' || o_custkey as full_name, 'a' || o_custkey || '@x.com' as primary_email, 'b' || o_custkey || '@x.com' as alt_emails, '+91 98765' || lpad(o_custkey::varchar, 5, '0') as primary_phone, 'github.com/x' as github_url,
        'sha256:' || sha256(o_orderpriority || chr(10) || chr(10) || 'end') as resume_text_hash, o_orderkey || '.pdf' as source_file_id from orders where o_orderkey in (select l_orderkey from lineitem)""",
    "explode_children": "select l_orderkey as candidate_id, count(*) as n, min(date_trunc('month', l_shipdate))::date as first, 0::bigint as ends, sum((l_linenumber % 2 = 0)::int)::bigint as internships from lineitem where l_orderkey in (select o_orderkey from orders) group by 1",
    "child_tables": "with k as (select count(*) as n from orders where o_orderkey in (select l_orderkey from lineitem)) select name, n * f as n from k, (values ('achievement', 1), ('candidate_language', 1), ('raw_section_text', 2), ('skill', 1), ('project', 0), ('publication', 0)) as v(name, f)",
    "achievements_row": "select o_orderkey as candidate_id, o_orderpriority || ' prize' as description from orders where o_orderkey in (select l_orderkey from lineitem)",
    "skills_row": "select l_orderkey as candidate_id, array_to_string(list_sort(list(distinct lower(l_linestatus))), ',') as skills from lineitem where l_orderkey in (select o_orderkey from orders) group by 1",
    "record_chunks": "select 'experience' as section, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders)",
    "upsert_latest_wins": """with n as (select o_custkey, case when o_orderkey % 2 = 0 then o_orderpriority end as c_name, o_totalprice, o_orderkey::int as version from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
        select coalesce(c.c_custkey, n.o_custkey) as c_custkey, coalesce(n.c_name, c.c_name) as c_name, coalesce(n.o_totalprice, c.c_acctbal) as c_acctbal, coalesce(n.version, 0) as version from customer c full join n on n.o_custkey = c.c_custkey""",
    "upsert_batches": """with r as (select o_custkey as id, o_orderkey as version, case when o_orderkey % 2 = 0 then o_orderpriority end as name, o_orderstatus as state, o_orderkey % 3 as batch from orders qualify row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderkey desc) = 1)
        select id, arg_max(version, batch) as version, arg_max(name, batch) filter (where name is not null) as name, arg_max(state, batch) as state from r group by id""",
    "store_rows": "select 'f' || doc_id as name, len(string_split(coalesce(text, ''), chr(10))) as n, (length(coalesce(text, '')) - len(string_split(coalesce(text, ''), chr(10))) + 1)::bigint as chars from documents",
    "store_changes": "select 'f' || doc_id as name, case when doc_id % 89 = 1 then 'added' else 'changed' end as change from documents where doc_id % 89 = 1 or doc_id % 97 = 0 union all select 'oldf' || doc_id, 'removed' from documents where doc_id % 83 = 2",
    "append_once": "select * from nation",
    "score_update": f"with {_P} select candidate_id, coalesce(s, job_score) as job_score from people left join (select o_custkey, max(o_totalprice) as s from orders group by 1) on o_custkey = candidate_id",
    "interval_containment": f"with {_S} select id, start_ts, end_ts from slots where start_ts >= timestamp '{WINDOW[0]}' and end_ts <= timestamp '{WINDOW[1]}'",
    "interval_overlap_join": f"with {_S}, f as (select * from slots where status = 'free') select a.interviewer_id, a.id as a, b.id as b from f a join f b on a.interviewer_id = b.interviewer_id and a.start_ts < b.end_ts and a.end_ts > b.start_ts and (a.start_ts < b.start_ts or (a.start_ts = b.start_ts and a.id < b.id))",
    "open_slots": f"with {_OPEN} select id, interviewer_id, nth from open",
    "schedule_reference": f"with {_P}, {_OPEN}, one as (select * from open where nth = 1 order by interviewer_id limit 1) select candidate_id, id as slot_id, interviewer_id, start_ts, start_ts + interval 45 minute as end_ts, case when id is null then 'failed' else 'scheduled' end as status from people left join one on true",
    "schedule_exclusive": f"with {_P}, {_OPEN}, n as (select *, row_number() over (order by start_ts, id) as k from open), c as (select candidate_id, row_number() over (order by candidate_id) as k from people) select candidate_id, id as slot_id, interviewer_id, start_ts, start_ts + interval 45 minute as end_ts, case when id is null then 'failed' else 'scheduled' end as status from c left join n using (k)",
    "slot_add_minutes": "select event_id, ts + to_minutes((user_id % 90)::int) as end_ts from events",
    "notification_log": f"""with {_P} select 'email' as kind, unnest([primary_email, 'iv@example.com']) as to_email, 'Interview Scheduled: Interview' as subject, '{{"title":"Interview"}}' as payload_json, unnest(['pending', 'sent']) as status from people""",
    "quick_booking": f"with {_S} select case when id % 3 > 0 and id % 5 > 0 then 'scheduled' when id % 3 > 0 then 'interviewer_id' when id % 5 > 0 then 'candidate_id' else 'candidate_id,interviewer_id' end as status, count(*) as n from slots group by 1",
    "availability_requests": f"with {_I} select 't-' || interviewer_id as id, interviewer_id, job_id, 'tentative' as status from interviewers where is_active",
    "availability_answers": f"with {_I}, a as (select * from interviewers where is_active) select 't-' || interviewer_id as id, interviewer_id, case when interviewer_id % 2 = 0 then 'used' else 'tentative' end as status from a union all select 't-' || interviewer_id || '-' || p, interviewer_id, 'free' from a, range(2) as t(p) where interviewer_id % 2 = 0",
    "jaccard_pairs": f"with {_SETS} select entity, system_a, system_b, len(x)::int as size_a, len(y)::int as size_b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) as jaccard from pairs",
    "set_diff_clip20": f"with {_SETS} select entity, system_a, system_b, array_to_string(list_filter(x, lambda v: not list_contains(y, v))[1:20], ',') as a_minus_b, array_to_string(list_filter(y, lambda v: not list_contains(x, v))[1:20], ',') as b_minus_a from pairs",
    "winner_by_size": f"with {_SETS} select s.entity, winner, union_count from (select entity, system as winner from sets qualify row_number() over (partition by entity order by len(items) desc, system) = 1) s join (select source as entity, count(distinct word)::int as union_count from words group by 1) u using (entity)",
    "manifest_diff": "select o_orderkey::varchar as name, case when o_orderkey % 3 = 0 then 'added' when o_orderkey % 5 = 0 then 'removed' when o_orderkey % 7 = 0 then 'changed' else 'unchanged' end as change from orders where not (o_orderkey % 3 = 0 and o_orderkey % 5 = 0)",
    "required_fields": f"with {_P} select candidate_id, concat_ws(',', case when job_score is null then 'job_score' end, case when job_id = 0 then 'job_id' end) as missing from people where job_score is null or job_id = 0",
    "job_lookup": f"with {_P} select candidate_id, n_name as job_title from people left join nation on n_nationkey = job_id",
    "tumbling_events": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
