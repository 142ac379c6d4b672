"""Streaming queries over the event log, each drained into a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wachbuch.session import table
from wachbuch.streaming import jobs


def _events(s, d):
    e = table(s, d, "events")
    return jobs.read(s, f"{d}/events.parquet", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))


QUERIES = {
    "stream_first_of_key": lambda s, d: jobs.drain(jobs.first_of_key(_events(s, d).withColumn("key", F.concat_ws(":", "user_id", "event_type")), "key", "ts")).groupBy("key").agg(F.count("*").alias("n")),
    "stream_sessions": lambda s, d: jobs.drain(jobs.sessions(_events(s, d), "ts", ["user_id"], "6 hours", "1 hour")).select("user_id", "n"),
}
SQL = {"stream_sessions": """with g as (select user_id, ts, case when date_diff('microsecond', lag(ts) over w, ts) <= 21600000000 then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from g)
select user_id, count(*) as n from s group by user_id, k having max(ts) + interval 7 hour <= (select max(ts) from events)""", "stream_first_of_key": "select user_id || ':' || event_type as key, cast(1 as bigint) as n from events group by all"}
