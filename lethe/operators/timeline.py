"""Holds and erasures over time, and labels of container members, as queries over event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Errors place a hold, views release one, purchases ask for erasure; pins never fall below zero.
_PINS = """select user_id, event_id, us, event_type, total - least(0, min(total) over (partition by user_id order by us, event_id rows between unbounded preceding and current row)) as pins
    from (select user_id, event_id, us, event_type, sum(case event_type when 'error' then 1 when 'view' then -1 else 0 end) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) as total from moved)"""
# the events after a row are the ones before it in descending order: a running frame in either engine
_NEXT = "select *, min(case when pins = 0 then us end) over (partition by user_id order by us desc, event_id desc rows between unbounded preceding and 1 preceding) as free_us from pinned"
_TIMELINE = f"pinned as ({_PINS}), later as ({_NEXT})"
_QUERIES = {
    "pin_timeline": "select event_id, user_id, cast(pins as bigint) as pins from pinned",
    "deferred_erase": "select event_id, user_id, cast(pins as bigint) as pins, pins > 0 as deferred from pinned where event_type = 'purchase'",
    "recoverability_windows": "select event_id, user_id, cast(pins as bigint) as holds, free_us - us as wait_us from later where event_type = 'purchase' and pins > 0",
    "released_erases": "select user_id, free_us - min(us) as longest_us, count(*) as erases from later where event_type = 'purchase' and pins > 0 and free_us is not null group by user_id, free_us",
    "hold_window_totals": "select count(*) as requests, cast(sum(case when pins > 0 then 1 else 0 end) as bigint) as deferred, cast(sum(case when pins > 0 and free_us is null then 1 else 0 end) as bigint) as open, cast(max(pins) as bigint) as most_pins, cast(sum(case when pins > 0 then free_us - us end) as bigint) as wait_us from later where event_type = 'purchase'",
}
_MAIL = """with one as (select conv_id, turn, coalesce(role, 'unknown') as subject, trim(coalesce(text, '')) as body from conversations),
    seen as (select body, min(subject) <> max(subject) as several from one group by body)
    select concat('conv', cast(conv_id as varchar(20)), '.mbox/msg/', cast(turn as varchar(20)), '/', subject) as path, subject, case when several then 'identical' else 'unique' end as file_class from one join seen on one.body = seen.body"""
_PHOTO = """with named as (select url, lower(regexp_extract(url, '://([^/]*)', 1)) as stem from pages),
    owners as (select url, case when stem like '%th%' and stem like '%er%' then 'th,er' when stem like '%er%' then 'er' else 'th' end as who, stem like '%th%' and stem like '%er%' or stem like '%group%' as mixed from named)
    select url, subject, case when mixed then 'mixed' else 'unique' end as file_class from (select url, mixed, {explode} as subject from owners)"""


def _timeline(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        moved = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as us", "event_type")
        return spark.sql(f"with moved as (select * from {{moved}}), {_TIMELINE} {sql}", moved=moved)

    return query


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MAIL.replace("from conversations", "from {conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PHOTO.replace("{explode}", "explode(split(who, ','))").replace("from pages", "from {pages}"), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _timeline(q) for n, q in _QUERIES.items()} | {"mail_inner_objects": _mail, "photo_owner_labels": _photos}
ORACLES = {n: f"with moved as (select user_id, event_id, epoch_us(ts) as us, event_type from events), {_TIMELINE} {q}" for n, q in _QUERIES.items()}
ORACLES |= {"mail_inner_objects": _MAIL, "photo_owner_labels": _PHOTO.replace("{explode}", "unnest(string_split(who, ','))")}
