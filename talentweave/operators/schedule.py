"""Interview scheduling over time ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import text as X
from talentweave.sources import scratch


def within(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """The slot lies inside the window; both ends may touch."""
    return (start >= window_start) & (end <= window_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def overlap_join(slots: DataFrame, by: str = "interviewer_id", bucket: str = "DAY") -> DataFrame:
    """(by, a, b) of slots (id, by, start_ts, end_ts) of one owner that overlap, a before b in (start, id) order.

    Slots meet in the time buckets that they touch, so that only slots near each other in time are compared; a pair
    counts in the bucket in which the later one starts.
    """
    seconds = {"DAY": 86_400, "HOUR": 3_600}[bucket]
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000 * seconds))
    own = slots.select("id", by, "start_ts", "end_ts", number("start_ts").alias("_first"), number("end_ts").alias("_last"))
    spread = own.withColumn("_b", F.explode(F.sequence("_first", F.greatest("_last", "_first"))))
    a = spread.select(by, "_b", F.col("id").alias("a"), F.col("start_ts").alias("a_start"), F.col("end_ts").alias("a_end"))
    b = own.select(by, F.col("_first").alias("_b"), F.col("id").alias("b"), F.col("start_ts").alias("b_start"), F.col("end_ts").alias("b_end"))
    near = a.join(b, [by, "_b"]).where((F.struct("a_start", "a") < F.struct("b_start", "b")) & overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return near.select(by, "a", "b")


def open_slots(slots: DataFrame, interviewers: DataFrame, window_start: Column, window_end: Column) -> DataFrame:
    """Free slots of active interviewers inside the window, earliest first for each."""
    free = slots.where((F.col("status") == "free") & within(F.col("start_ts"), F.col("end_ts"), window_start, window_end))
    active = interviewers.where("is_active").select("interviewer_id")
    joined = free.join(active, "interviewer_id")
    return joined.withColumn("nth", F.row_number().over(Window.partitionBy("interviewer_id").orderBy("start_ts", "id")))


def match_reference(candidates: DataFrame, slots: DataFrame, interviewers: DataFrame, window_start: Column, window_end: Column, minutes: int) -> DataFrame:
    """Every candidate gets the earliest slot of the first interviewer (by id) who has one; failed where none has."""
    chosen = open_slots(slots, interviewers, window_start, window_end).where("nth = 1").orderBy("interviewer_id").limit(1)
    start = chosen.select(F.col("id").alias("slot_id"), "interviewer_id", "start_ts", X.minutes_later(F.col("start_ts"), F.lit(minutes)).alias("end_ts"))
    return candidates.select("candidate_id").join(F.broadcast(start), F.lit(True), "left").withColumn("status", _status())


def numbered(df: DataFrame, bucket: Column, *order: str, out: str = "k") -> DataFrame:
    """df with its rows' numbers in order, from 1. bucket must not fall in that order: rows are numbered inside their
    buckets and moved by the number of rows in earlier ones, so that no task holds all of them, only a row a bucket."""
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = df.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return inside.join(starts, inside["_b"].eqNullSafe(starts["_b"])).withColumn(out, F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def match_exclusive(candidates: DataFrame, slots: DataFrame, interviewers: DataFrame, window_start: Column, window_end: Column, minutes: int, candidate_bucket: Column | None = None, slot_bucket: Column | None = None) -> DataFrame:
    """The k-th candidate (by id) gets the k-th open slot (by start and id); each slot once. The buckets say how both are
    numbered in parts: by default ten thousand ids, where they are numbers, and the hours of the slots' starts."""
    if candidate_bucket is None:
        candidate_bucket = F.floor(F.col("candidate_id") / 10_000) if isinstance(candidates.schema["candidate_id"].dataType, T.NumericType) else F.left(F.col("candidate_id"), F.lit(4))
    slot_bucket = F.date_trunc("hour", F.col("start_ts")) if slot_bucket is None else slot_bucket
    free = open_slots(slots, interviewers, window_start, window_end)
    given = numbered(free, slot_bucket, "start_ts", "id").select(F.col("id").alias("slot_id"), "interviewer_id", "start_ts", "k")
    wanted = numbered(candidates.select("candidate_id"), candidate_bucket, "candidate_id")
    joined = wanted.join(given, "k", "left")
    return joined.select("candidate_id", "slot_id", "interviewer_id", "start_ts", X.minutes_later(F.col("start_ts"), F.lit(minutes)).alias("end_ts")).withColumn("status", _status())


def _status() -> Column:
    return F.when(F.col("slot_id").isNotNull(), F.lit("scheduled")).otherwise(F.lit("failed"))


def notifications(interviews: DataFrame) -> DataFrame:
    """Two pending mails for each interview (candidate_email, interviewer_email, title, …)."""
    payload = F.to_json(F.struct(*[c for c in interviews.columns if c not in ("candidate_email", "interviewer_email")]))
    to = F.explode(F.array("candidate_email", "interviewer_email"))
    return interviews.select(F.lit("email").alias("kind"), to.alias("to_email"), F.concat(F.lit("Interview Scheduled: "), F.col("title")).alias("subject"), payload.alias("payload_json"), F.lit("pending").alias("status"))


def mark_sent(log: DataFrame, addresses: list[str], subject: str) -> DataFrame:
    hit = F.col("to_email").isin(addresses) & (F.col("subject") == subject)
    return log.withColumn("status", F.when(hit, F.lit("sent")).otherwise(F.col("status")))


def quick_book(requests: DataFrame, required: tuple[str, ...] = ("candidate_id", "interviewer_id", "start_ts", "end_ts")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests; the rejected ones name the fields that are missing."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]))
    checked = requests.withColumn("missing", missing)
    return checked.where(F.size("missing") == 0).drop("missing").withColumn("status", F.lit("scheduled")), checked.where(F.size("missing") > 0)


def request_availability(interviewers: DataFrame, job: str, token: Column) -> DataFrame:
    """One tentative row for each active interviewer of a job."""
    return interviewers.where(F.col("is_active") & (F.col("job_id") == job)).select(token.alias("id"), "interviewer_id", "job_id", F.lit("tentative").alias("status"))


def ingest_availability(slots: DataFrame, answers: DataFrame) -> DataFrame:
    """Slots after answers (token, slots array of struct(start_ts, end_ts)): a tentative row with the token is used, and
    its submitted ranges are new free rows of its interviewer. Tokens of any other state change nothing."""
    guarded = answers.join(slots.where("status = 'tentative'").select(F.col("id").alias("token"), "interviewer_id"), "token")
    spent = slots.join(guarded.select(F.col("token").alias("id")).distinct().withColumn("_used", F.lit(True)), "id", "left")
    changed = spent.withColumn("status", F.when(F.col("_used"), F.lit("used")).otherwise(F.col("status"))).drop("_used")
    fresh = guarded.select("token", "interviewer_id", F.posexplode("slots")).select(
        F.concat("token", F.lit("-"), F.col("pos")).alias("id"), "interviewer_id", F.col("col.start_ts").alias("start_ts"), F.col("col.end_ts").alias("end_ts"), F.lit("free").alias("status")
    )
    return changed.unionByName(fresh, allowMissingColumns=True)


@dataclass(frozen=True)
class Bookings:
    """What a round of bookings leaves: the outcome of each candidate, new interview rows and notifications, and the
    slots and candidates with their new states."""

    results: DataFrame
    interviews: DataFrame
    notifications: DataFrame
    slots: DataFrame
    candidates: DataFrame


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def unbusy(open_: DataFrame, busy: DataFrame, minutes: int, by: str = "interviewer_id") -> DataFrame:
    """The open slots (id, by, start_ts) at whose start an interview of that length meets no busy range (by, start_ts,
    end_ts) of the same owner. Both are compared day by day."""
    day = 86_400_000_000
    spread = lambda df, a, b: df.withColumn("_d", F.explode(F.sequence(F.floor(a / day), F.greatest(F.floor(a / day), F.floor((b - 1) / day)))))
    own = open_.select("id", by, _micros("start_ts").alias("_s")).withColumn("_e", F.col("_s") + minutes * 60_000_000)
    taken = busy.select(by, _micros("start_ts").alias("_bs"), _micros("end_ts").alias("_be")).where("_bs < _be")
    near = spread(own, F.col("_s"), F.col("_e")).join(spread(taken, F.col("_bs"), F.col("_be")), [by, "_d"]).where("_bs < _e and _be > _s")
    return open_.join(near.select("id").distinct(), "id", "left_anti")


def without_overlaps(open_: DataFrame, minutes: int, by: str = "interviewer_id") -> DataFrame:
    """Of each owner the open slots (id, by, start_ts) at which interviews of that length are held so that none overlap:
    the earliest end first, hence as many as possible; of equal starts the smallest id.

    Every start points to the first one that an interview there leaves free, which a window finds. A start that begins no
    earlier than an interview at the start before it could end is always taken. From those heads the chains of pointers
    are walked by doubling: each round takes what lies one, two, four, ... steps behind the taken, so the rounds grow with
    the logarithm of the longest chain, and no task holds an owner's slots.
    """
    length = minutes * 60_000_000
    starts = open_.select(by, "id", _micros("start_ts").alias("s")).groupBy(by, "s").agg(F.min("id").alias("id"))
    order = Window.partitionBy(by).orderBy("s")
    after = F.min("s").over(order.rangeBetween(length, Window.unboundedFollowing))
    head = F.coalesce(F.col("s") - F.lag("s").over(order) >= length, F.lit(True))
    nodes = scratch.written(starts.withColumns({"next": after, "head": head}))
    taken = nodes.where("head").select(by, "s")
    # Pointers stop at the next head: that one is taken anyway.
    heads = nodes.where("head").select(F.col(by).alias("_o"), F.col("s").alias("_h"))
    jump = nodes.where("next is not null").select(by, "s", "next").join(heads, (F.col(by) == F.col("_o")) & (F.col("next") == F.col("_h")), "left_anti")
    jump = scratch.written(jump)
    while not jump.isEmpty():
        reached = taken.join(jump, [by, "s"]).select(by, F.col("next").alias("s"))
        taken = scratch.written(taken.unionByName(reached).distinct())
        onward = jump.select(F.col(by).alias("_o"), F.col("s").alias("_s"), F.col("next").alias("_next"))
        jump = scratch.written(jump.join(onward, (F.col(by) == F.col("_o")) & (F.col("next") == F.col("_s"))).select(by, "s", F.col("_next").alias("next")))
    chosen = nodes.join(taken, [by, "s"]).select("id")
    return open_.join(chosen, "id", "left_semi")


def book(candidates: DataFrame, slots: DataFrame, interviewers: DataFrame, window_start: Column, window_end: Column, minutes: int, job: str, title: str = "Interview",
         candidate_bucket: Column | None = None) -> Bookings:
    """Gives the k-th candidate (by id) the k-th interview (by start, then slot) that can be held, and carries it out.

    Interviews are held from the start of free slots that lie in the window, of active interviewers, for the given length,
    and no interviewer has two that overlap, nor one beside a slot that is booked already. The interview's slot becomes
    booked and its candidate moves to the stage "interview"; candidates left over fail with a reason. candidates:
    (candidate_id, full_name, primary_email, stage_of_process), slots: (id, interviewer_id, start_ts, end_ts, status),
    interviewers: (interviewer_id, full_name, email, is_active); a row an id each.
    """
    free = unbusy(open_slots(slots, interviewers, window_start, window_end).drop("nth"), slots.where("status = 'booked'"), minutes)
    given = numbered(without_overlaps(free, minutes), F.date_trunc("hour", F.col("start_ts")), "start_ts", "id").select(F.col("id").alias("slot_id"), "interviewer_id", "start_ts", "k")
    if candidate_bucket is None:
        candidate_bucket = F.floor(F.col("candidate_id") / 10_000) if isinstance(candidates.schema["candidate_id"].dataType, T.NumericType) else F.left(F.col("candidate_id"), F.lit(4))
    wanted = numbered(candidates.select("candidate_id"), candidate_bucket, "candidate_id")
    found = wanted.join(given, "k", "left").drop("k").withColumn("end_ts", X.minutes_later(F.col("start_ts"), F.lit(minutes)))
    matched = scratch.written(found.withColumn("status", _status()))
    people = candidates.select("candidate_id", F.col("full_name").alias("candidate_name"), F.col("primary_email").alias("candidate_email"))
    staff = interviewers.select("interviewer_id", F.col("full_name").alias("interviewer_name"), F.col("email").alias("interviewer_email"))
    held = matched.where("status = 'scheduled'").join(people, "candidate_id").join(staff, "interviewer_id")
    interviews = held.select("candidate_id", "candidate_name", "candidate_email", "interviewer_id", "interviewer_name", "interviewer_email", F.lit(job).alias("job_id"), "slot_id", "start_ts", "end_ts", F.lit(title).alias("title"), "status")
    done = matched.where("status = 'scheduled'")
    booked = slots.join(done.select(F.col("slot_id").alias("id"), F.lit(True).alias("_done")), "id", "left").withColumn("status", F.when(F.col("_done"), F.lit("booked")).otherwise(F.col("status"))).select(slots.columns)
    moved = candidates.join(done.select("candidate_id", F.lit(True).alias("_done")), "candidate_id", "left").withColumn("stage_of_process", F.when(F.col("_done"), F.lit("interview")).otherwise(F.col("stage_of_process"))).select(candidates.columns)
    results = matched.withColumn("reason", F.when(F.col("status") == "failed", F.lit("No available slots")))
    return Bookings(results, interviews, notifications(interviews), booked, moved)
