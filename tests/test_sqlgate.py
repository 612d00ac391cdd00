"""What the SQL gate lets through, and what it refuses however it is spelt."""

import pytest

from talentweave.plans import sqlgate


@pytest.fixture(scope="module")
def views(spark):
    people = spark.createDataFrame([(1, "Ann", "a@x.org", '{"k": {"n": ["p", "q"]}, "s": "t"}'), (2, "bo", "b@x.org", None)], "id int, name string, primary_email string, props string")
    return {"people": people, "other": people.select("id")}


REFUSED = [
    "select java_method('java.lang.System', 'getProperty', 'user.dir') from people", "select `reflect`('java.lang.System', 'exit', '1')", "select TRY_REFLECT('java.lang.Runtime', 'x') from people",
    "select id from people where id in (select length(java_method('java.lang.System', 'lineSeparator')))", "with c as (select reflect('a', 'b')) select * from c",
    "select * from parquet.`/root/x`", "select * from people, csv.`/etc/passwd`", "select (select max(value) from text.`/etc/hosts`) from people", "with p as (select * from json.`/x`) select * from p",
    "select * from secrets", "table default.people", "select input_file_name() from people", "insert into people select * from people", "from people insert overwrite table other select id", "select transform(id) using 'cat' from people", "drop table people", "set spark.x = 1", "select * from people order by upper(reflect('a', 'b'))",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, views, text):
    with pytest.raises((sqlgate.NotReadOnly, Exception)) as e:
        sqlgate.run(spark, text, views)
    assert isinstance(e.value, sqlgate.NotReadOnly) or "PARSE" in str(e.value)


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("select id from people order by id", [(1,), (2,)]), ("with c as (select id from people), d as (select id + 1 as id from c) select d.id from d join other using (id)", [(2,)]),
        ("select count(*) from people p where exists (select 1 from OTHER o where o.id = p.id)", [(2,)]), ("select id from people union all select id from other order by id", [(1,), (1,), (2,), (2,)]),
        ("-- note\nselect (select max(id) from other) as m, x from people lateral view explode(array(7)) t as x where id = 1 ;", [(2, 7)]), ("select id from range(2) order by id", [(0,), (1,)]), ("values (1)", [(1,)]), ("select transform(array(id), x -> x + 1) from people where id = 1", [([2],)]),
    ],
)
def test_let_through(spark, views, text, rows):
    assert list(map(tuple, sqlgate.run(spark, text, views).collect())) == rows


@pytest.mark.parametrize(
    ("text", "args", "rows"),
    [
        ("select id::text || '%s' from people where id = %s", [1], [("1%s",)]), ("select name from people where name ilike any (array('a%', 'z%'))".replace("(array('a%', 'z%'))", "('a%', 'z%')"), None, [("Ann",)]),
        ("select props->'k'->'n'->>1 as x, props ->> 's' as y from people where id = %s and name = 'Ann -> x'", [1], []), ("select props->'k'->'n'->>1 as x, props ->> 's' as y from people where id = 1", None, [("q", "t")]),
        ("select p.props->>'s' from people p where p.props->>'s' = 't' and p.name ilike 'ANN'", None, [("t",)]),
    ],
)
def test_postgres_words(spark, views, text, args, rows):
    assert list(map(tuple, sqlgate.run(spark, sqlgate.postgres(text), views, args=args).collect())) == rows


def test_scope_is_kept(spark, views):
    assert [r.id for r in sqlgate.run(spark, "select * from people", views, scope=[{"email": "A@x.org"}]).collect()] == [1]
    with pytest.raises(KeyError):
        sqlgate.run(spark, "select id from people", views, scope=["a@x.org"])
