"""Queries of the change log, throttling and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import lookups
from codeloom.plans.registry import query
from codeloom.sources.testbed import table
from codeloom.streaming import watch


@query("select event_id, 'u' || user_id as file_path, event_type as status from events order by ts desc, event_id desc limit 25")
def q_recent_changes(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_type").alias("status"), "ts")
    return lookups.newest(log, "ts", 25, key="event_id").drop("ts")


@query("""with recursive e as (select user_id as key, epoch(ts) as t, row_number() over (partition by user_id order by ts) as n from events),
f(key, n, t, last) as (select key, n, t, t from e where n = 1 union all select e.key, e.n, e.t, case when e.t - f.last >= 86400 then e.t else f.last end from f join e on e.key = f.key and e.n = f.n + 1)
select key, round(t, 3) as ts from f where t = last""")
def q_throttle(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return watch.throttle(events, seconds=86400.0).select("key", F.round("ts", 3).alias("ts"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def q_ext_tumbling(spark, sf_dir):
    return watch.tumbling(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from m) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def q_ext_session(spark, sf_dir):
    return watch.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
