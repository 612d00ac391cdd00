"""Bookings with state against a plain greedy choice."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from talentweave.operators import schedule

START = datetime.datetime(2024, 1, 1)
SLOT = "id long, interviewer_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, status string"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def slots_of(rng, n, owners, span, length=30):
    return [(i, rng.randrange(owners), s := at(rng.randrange(0, span, 5)), s + datetime.timedelta(minutes=length), rng.choice(["free"] * 9 + ["booked"])) for i in range(n)]


def plain(slots, active, minutes, window):
    """By owner: open slots beside nothing booked, the earliest that starts after the last interview's end."""
    length, out = datetime.timedelta(minutes=minutes), []
    for owner in sorted(active):
        own = [s for s in slots if s[1] == owner]
        busy = [(s[2], s[3]) for s in own if s[4] == "booked"]
        free_from = None
        for s in sorted((s for s in own if s[4] == "free" and s[2] >= window[0] and s[3] <= window[1]), key=lambda s: (s[2], s[0])):
            if any(a < s[2] + length and b > s[2] for a, b in busy) or (free_from and s[2] < free_from):
                continue
            out.append((s[2], s[0], owner))
            free_from = s[2] + length
    return sorted(out)


@pytest.mark.parametrize(("n", "owners", "span", "minutes"), [(300, 3, 3000, 45), (250, 1, 900, 10), (200, 2, 30_000, 240), (40, 5, 60, 45)])
def test_bookings_equal_a_plain_choice(spark, n, owners, span, minutes):
    rng = random.Random(n)
    slots = slots_of(rng, n, owners, span)
    active = set(range(owners)) - ({owners - 1} if owners > 2 else set())
    window = (at(30), at(span - 30))
    want = plain(slots, active, minutes, window)
    people = [(i, f"P{i}", f"p{i}@x.org", "assessment") for i in range(0, 3 * (len(want) + 5), 3)]
    staff = [(i, f"I{i}", f"i{i}@x.org", i in active) for i in range(owners)]
    made = schedule.book(
        spark.createDataFrame(people, "candidate_id long, full_name string, primary_email string, stage_of_process string"), spark.createDataFrame(slots, SLOT),
        spark.createDataFrame(staff, "interviewer_id long, full_name string, email string, is_active boolean"), F.lit(window[0]).cast("timestamp_ntz"), F.lit(window[1]).cast("timestamp_ntz"), minutes, "j",
    )
    results = made.results.orderBy("candidate_id").collect()
    assert [(r.start_ts, r.slot_id, r.interviewer_id) for r in results[: len(want)]] == want
    assert [(r.status, r.reason) for r in results[len(want) :]] == [("failed", "No available slots")] * 5
    held = made.interviews.collect()
    for a in held:
        assert (a.candidate_name, a.interviewer_email, a.end_ts - a.start_ts) == (f"P{a.candidate_id}", f"i{a.interviewer_id}@x.org", datetime.timedelta(minutes=minutes))
        assert not any(b.interviewer_id == a.interviewer_id and b.slot_id != a.slot_id and b.start_ts < a.end_ts and b.end_ts > a.start_ts for b in held)
    assert made.notifications.count() == 2 * len(want) and made.notifications.where("status = 'pending'").count() == 2 * len(want)
    taken = {s[1] for s in want}
    assert {r.id: r.status for r in made.slots.collect()} == {s[0]: "booked" if s[0] in taken else s[4] for s in slots}
    moved = {r.candidate_id for r in made.candidates.where("stage_of_process = 'interview'").collect()}
    assert moved == {p[0] for p in people[: len(want)]} and made.candidates.count() == len(people)
    # A second round finds the booked slots taken.
    again = schedule.open_slots(made.slots, spark.createDataFrame(staff, "interviewer_id long, full_name string, email string, is_active boolean"), F.lit(window[0]).cast("timestamp_ntz"), F.lit(window[1]).cast("timestamp_ntz"))
    assert not {r.id for r in again.collect()} & taken


def test_no_slots_and_no_candidates(spark):
    slots = spark.createDataFrame([], SLOT)
    people = spark.createDataFrame([("a", "A", "a@x", "applied")], "candidate_id string, full_name string, primary_email string, stage_of_process string")
    staff = spark.createDataFrame([(1, "I", "i@x", True)], "interviewer_id long, full_name string, email string, is_active boolean")
    w = [F.lit(at(m)).cast("timestamp_ntz") for m in (0, 100)]
    made = schedule.book(people, slots, staff, *w, 45, "j")
    assert [(r.candidate_id, r.status) for r in made.results.collect()] == [("a", "failed")] and made.interviews.count() == 0 and made.candidates.first().stage_of_process == "applied"
    assert schedule.book(people.limit(0), slots, staff, *w, 45, "j").results.count() == 0
