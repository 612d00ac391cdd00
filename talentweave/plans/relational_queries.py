"""Queries of the SQL surface: joins, set operations, grouping sets, windows, subqueries, analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentweave.plans import catalog as C


def _t(spark, sf, *names):
    return [C.table(spark, sf, n) for n in names]


def _sql(text):
    def run(spark, sf):
        C.register(spark, sf)
        return spark.sql(text)

    return run


def pricing_summary(spark, sf):
    (li,) = _t(spark, sf, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00"))).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def revenue_by_nation(spark, sf):
    li, o, c, n = _t(spark, sf, "lineitem", "orders", "customer", "nation")
    price = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(price)


def semi_anti_join(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    have = c.join(o, on, "left_semi").select("c_custkey", F.lit("with").alias("kind"))
    return have.unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit("without").alias("kind")))


def join_kinds(spark, sf):
    n, s = _t(spark, sf, "nation", "supplier")
    a, b = n.where("n_nationkey < 15"), s.where("s_nationkey > 5")
    out = None
    for how in ("inner", "left", "right", "full"):
        one = a.join(b, F.col("n_nationkey") == F.col("s_nationkey"), how).agg(F.lit(how).alias("kind"), F.count(F.lit(1)).alias("n"), F.count("n_name").alias("lefts"), F.count("s_name").alias("rights"))
        out = one if out is None else out.unionByName(one)
    return out


def setops_intersect_except(spark, sf):
    o, c = _t(spark, sf, "orders", "customer")
    a, b = o.select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    parts = {"intersect": a.intersect(b), "except": b.subtract(a), "union": a.union(b).distinct(), "except_all": a.exceptAll(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def window_rank_frames(spark, sf):
    (o,) = _t(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rk"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("drk"),
        F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.ntile(4).over(w).alias("quarter"),
    )


def top_per_group(spark, sf):
    (p,) = _t(spark, sf, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("p_brand", "p_partkey", "rank")


def as_of_join(spark, sf):
    """Each order with the last event of its customer before it (an extra): one union and one window, no pairs."""
    o, e = _t(spark, sf, "orders", "events")
    marks = e.select((F.col("user_id")).alias("k"), F.col("ts").alias("t"), F.col("event_id").alias("mark"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("o_orderkey"))
    wants = o.select(F.col("o_custkey").alias("k"), F.expr("timestampadd(DAY, o_orderkey % 30, timestamp_ntz'2024-01-01 12:00:00')").alias("t"), F.lit(None).cast("long").alias("mark"), F.lit(1).alias("side"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("t", "side", "mark").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(wants).withColumn("event_id", F.last("mark", ignorenulls=True).over(w)).where("side = 1").select("o_orderkey", "event_id")


_PLAIN = {
    "grouping_sets_rollup_cube": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty from lineitem group by cube (l_returnflag, l_linestatus) union all select l_returnflag, null as l_linestatus, count(*) as n, sum(l_quantity) as qty from lineitem group by rollup (l_returnflag)",
    "having_distinct": "select o_custkey, count(distinct o_orderpriority) as kinds, count(*) as n from orders group by o_custkey having count(*) > 5",
    "correlated_subquery": "select o_orderkey, o_totalprice from orders o where o_totalprice > (select 1.5 * avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "exists_subquery": "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49) and not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity < 1)",
    "case_and_coalesce": "select c_mktsegment, cast(sum(case when c_acctbal > 0 then 1 else 0 end) as bigint) as plus, cast(sum(coalesce(nullif(c_nationkey, 3), 0)) as bigint) as keys from customer group by c_mktsegment",
    "self_join_pairs": "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "union_of_lists": "select distinct k from (select l_suppkey as k from lineitem where l_quantity > 40 union all select s_suppkey from supplier where s_acctbal < 0) t",
    "filtered_aggregates": "select event_type, count(*) filter (where value > 50) as high, count(*) as n, max(value) as top from events group by event_type",
}
for _name in _PLAIN:
    globals()[_name] = _sql(_PLAIN[_name])

QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation, semi_anti_join, join_kinds, setops_intersect_except, window_rank_frames, top_per_group, as_of_join)} | {name: globals()[name] for name in _PLAIN}

ORACLES = _PLAIN | {
    "pricing_summary": "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "revenue_by_nation": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "semi_anti_join": "select c_custkey, case when c_custkey in (select o_custkey from orders) then 'with' else 'without' end as kind from customer",
    "join_kinds": "with a as (select * from nation where n_nationkey < 15), b as (select * from supplier where s_nationkey > 5) " + " union all ".join(f"select '{k}' as kind, count(*) as n, count(n_name) as lefts, count(s_name) as rights from a {k} join b on n_nationkey = s_nationkey" for k in ("inner", "left", "right", "full")),
    "setops_intersect_except": "with a as (select o_custkey as k from orders), b as (select c_custkey as k from customer where c_acctbal > 0) " + " union all ".join(f"select '{n}' as op, count(*) as n, sum(k)::bigint as total from ({q}) t" for n, q in (("intersect", "select k from a intersect select k from b"), ("except", "select k from b except select k from a"), ("union", "select k from a union select k from b"), ("except_all", "select k from a except all select k from b"))),
    "window_rank_frames": """select o_orderkey, (row_number() over w)::int as rn, (rank() over p)::int as rk, (dense_rank() over p)::int as drk, lag(o_orderkey) over w as prev, lead(o_orderkey) over w as next,
        round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as last3, (ntile(4) over w)::int as quarter
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey), p as (partition by o_custkey order by o_orderpriority)""",
    "top_per_group": "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::int as rank from part qualify rank <= 5",
    "as_of_join": "with w as (select o_orderkey, o_custkey, timestamp '2024-01-01 12:00:00' + to_days((o_orderkey % 30)::int) as t from orders), e as (select user_id, ts, event_id from events qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) select o_orderkey, event_id from w asof left join e on w.o_custkey = e.user_id and w.t >= e.ts",
}
