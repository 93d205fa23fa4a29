"""The same queries as SQL, for a row-by-row check against another engine."""

from __future__ import annotations

from isobar.schema import DAILY_VARIABLES, HOURLY_VARIABLES

RAW = """
select ts as time, event_type as city_id,
       upper(substr(event_type, 1, 1)) || substr(event_type, 2) as city_name,
       case when event_id % 17 = 0 then null else value end as temperature_2m,
       case when event_id % 29 = 0 then null else event_id % 101 end as relative_humidity_2m,
       case when event_id % 23 = 0 then null when event_id % 3 = 0 then cast(0 as double)
            else value / 10 end as precipitation,
       case when event_id % 37 = 0 then null else value / 5 end as wind_speed_10m,
       case when event_id % 31 = 0 then null else user_id % 101 end as cloud_cover,
       case when event_id % 41 = 0 then null else 1013.25 + value / 100 end as pressure_msl,
       cast(length(event_type) as double) as latitude,
       cast(-length(event_type) as double) as longitude,
       'UTC' as timezone,
       ts + interval '1' day as ingestion_timestamp,
       cast(cast(ts as date) as varchar) as batch_id,
       event_id
from events
"""

CONSTANT_RAW = f"""
select * replace (case when city_id = 'error' then 20.0 else temperature_2m end as temperature_2m)
from ({RAW})
"""

FAULTY_RAW = f"""
select * replace (
    case when wind_speed_10m > 50 then null else time end as time,
    case when city_id = 'view' and precipitation < 0.5 then null else city_id end as city_id,
    case when cloud_cover = 13 then null else city_name end as city_name)
from ({RAW})
"""

OVERLAPPING_RAW = f"""
select * from ({RAW})
union all
select * replace (temperature_2m + 1 as temperature_2m,
                  ingestion_timestamp + interval '1' day as ingestion_timestamp,
                  'rerun' as batch_id)
from ({RAW}) where cast(time as date) >= date '2024-01-29'
"""


def stg(raw: str = RAW, fill: bool = True) -> str:
    def measure(name: str, value: str) -> str:
        return f"coalesce({name}, {value}) as {name}" if fill else name

    return f"""
select time, cast(time as date) as date,
       extract(year from time) as year, extract(month from time) as month,
       extract(day from time) as day, extract(hour from time) as hour,
       extract(dow from time) as day_of_week, extract(quarter from time) as quarter,
       {measure('temperature_2m', '0.0')}, {measure('relative_humidity_2m', '0')},
       {measure('precipitation', '0.0')}, {measure('wind_speed_10m', '0.0')},
       {measure('cloud_cover', '0')}, {measure('pressure_msl', '1013.25')},
       city_id, city_name, latitude, longitude, timezone, ingestion_timestamp, batch_id,
       case when temperature_2m is null then 1 else 0 end as has_missing_temp,
       case when precipitation is null then 1 else 0 end as has_missing_precip
from ({raw})
"""


def daily(staged: str, updated: bool = True, precip_gaps: bool = True) -> str:
    optional = ", cast(sum(has_missing_precip) as bigint) as missing_precip_count"
    return f"""
select city_id, city_name, date,
       min(temperature_2m) as temp_min, max(temperature_2m) as temp_max,
       round(avg(temperature_2m), 6) as temp_avg,
       round(stddev_samp(temperature_2m), 6) as temp_stddev,
       round(sum(precipitation), 6) as precip_total, max(precipitation) as precip_max,
       count(case when precipitation > 0 then 1 end) as hours_with_rain,
       round(avg(wind_speed_10m), 6) as wind_avg, max(wind_speed_10m) as wind_max,
       round(avg(relative_humidity_2m), 6) as humidity_avg,
       round(avg(pressure_msl), 6) as pressure_avg,
       round(avg(cloud_cover), 6) as cloud_cover_avg,
       count(*) as total_hours,
       cast(sum(has_missing_temp) as bigint) as missing_temp_count
       {optional if precip_gaps else ''}
       {', max(ingestion_timestamp) as last_updated' if updated else ''}
from ({staged}) group by city_id, city_name, date
"""


STATS = """
select city_id, avg(temperature_2m) as avg_temp, stddev_samp(temperature_2m) as stddev_temp,
       avg(precipitation) as avg_precip, stddev_samp(precipitation) as stddev_precip
from stg group by city_id
"""


def city_stats(staged: str) -> str:
    return f"""
with stg as ({staged})
select city_id, round(avg_temp, 6) as avg_temp, round(stddev_temp, 6) as stddev_temp,
       round(avg_precip, 6) as avg_precip, round(stddev_precip, 6) as stddev_precip
from ({STATS})
"""


def anomalies(staged: str) -> str:
    return f"""
with stg as ({staged}), stats as ({STATS}), scored as (
    select time, city_id, city_name, temperature_2m, precipitation,
           (temperature_2m - avg_temp) / nullif(stddev_temp, 0) as temp_zscore,
           (precipitation - avg_precip) / nullif(stddev_precip, 0) as precip_zscore
    from stg join stats using (city_id))
select time, city_id, city_name, temperature_2m, precipitation,
       round(temp_zscore, 6) as temp_zscore, round(precip_zscore, 6) as precip_zscore,
       coalesce(abs(temp_zscore) > 3, false) as is_temp_anomaly,
       coalesce(abs(precip_zscore) > 3, false) as is_precip_anomaly
from scored where temp_zscore is not null
"""


def bootstrap_anomalies(staged: str) -> str:
    return f"""
with stg as ({staged}), stats as ({STATS}), scored as (
    select time, city_id, city_name, temperature_2m, precipitation,
           (temperature_2m - avg_temp) / nullif(stddev_temp, 0) as temp_zscore
    from stg join stats using (city_id) where stddev_temp is not null)
select time, city_id, city_name, temperature_2m, precipitation,
       round(temp_zscore, 6) as temp_zscore,
       coalesce(abs(temp_zscore) > 3, false) as is_temp_anomaly
from scored
"""


DAILY_GRAIN = """
select cast(cast(time as date) as timestamp) as time, city_id from raw
group by city_id, cast(time as date)
"""

NOT_NULL = {
    "raw.weather_hourly": ("raw", ["time", "city_id", "city_name"]),
    "raw.weather_daily": ("daily_grain", ["time", "city_id"]),
    "staging.stg_weather": (
        "stg", ["time", "date", "city_id", "temperature_2m", "precipitation"]
    ),
    "mart.weather_daily": ("mart_daily", ["city_id", "date", "total_hours"]),
    "mart.weather_anomalies": ("mart_anomalies", ["time", "city_id", "is_temp_anomaly"]),
}


def layers(raw: str) -> str:
    return f"""
with raw as ({raw}), daily_grain as ({DAILY_GRAIN}), stg as ({stg('raw')}),
     mart_daily as ({daily('stg')}), mart_anomalies as ({anomalies('select * from stg')})
"""


def result(table: str, check: str, column: str, failures: str, source: str) -> str:
    return f"""
select '{table}' as table_name, '{check}' as check_name, '{column}' as column_name,
       cast({failures} as bigint) as failures from {source}
"""


def not_null_results() -> list[str]:
    return [
        result(table, "not_null", column, f"count(*) filter (where {column} is null)", source)
        for table, (source, columns) in NOT_NULL.items()
        for column in columns
    ]


def unique_result() -> str:
    copies = """(select 1 from stg where time is not null and city_id is not null
                 group by time, city_id having count(*) > 1)"""
    return result("staging.stg_weather", "unique", "time,city_id", "count(*)", copies)


def relationships_result(table: str, parent: str) -> str:
    missing = f"""(select 1 from stg where city_id is not null and city_id not in
                   (select city_id from {parent} where city_id is not null))"""
    return result(table, "relationships", "city_id", "count(*)", missing)


def range_results(table: str = "staging.stg_weather", source: str = "stg") -> list[str]:
    return [
        result(table, "range", column,
               f"count(*) filter (where {column} < {low} or {column} > {high})", source)
        for column, low, high in (("temperature_2m", 0.5, 200.0), ("precipitation", 0.0, 20.0))
    ]


def filled_results() -> list[str]:
    return [
        result("staging.stg_weather", "filled", column, f"sum({flag})", "stg")
        for column, flag in (
            ("temperature_2m", "has_missing_temp"), ("precipitation", "has_missing_precip")
        )
    ]


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


MEASURES = """temperature_2m, cast(relative_humidity_2m as double) as relative_humidity_2m,
       precipitation, wind_speed_10m, cast(cloud_cover as double) as cloud_cover, pressure_msl"""
PLACE = "city_id, city_name, latitude, longitude, timezone"
STAMP = "timestamp '2024-02-01 03:04:05' as ingestion_timestamp, '20240201_030405' as batch_id"
LAST_DAY = f"(select cast(max(time) as date) from ({RAW}))"

HOURLY = f"select time, {MEASURES}, {PLACE} from ({RAW})"


def payload_daily(extra: str = "", where: str = "true") -> str:
    return f"""
select cast(cast(time as date) as timestamp) as time,
       max(temperature_2m) as temperature_2m_max, min(temperature_2m) as temperature_2m_min,
       round(sum(precipitation), 6) as precipitation_sum,
       max(wind_speed_10m) as wind_speed_10m_max,
       cast(cast(time as date) as varchar) || 'T08:00' as sunrise, {PLACE} {extra}
from ({RAW}) where {where}
group by cast(time as date), {PLACE}, event_id // 1024
"""


def ingest_stats(where: str) -> str:
    return f"""
select city_id, '20240201_030405' as batch_id, count(*) as records,
       cast(min(time) as date) as start_date, cast(max(time) as date) as end_date
from ({RAW}) where {where} group by city_id
"""


def manifest(mode: str, endpoint: str, start: str, end: str) -> str:
    return f"""
select distinct {PLACE}, '{mode}' as mode, '{endpoint}' as endpoint,
       {start} as start_date, {end} as end_date,
       '{','.join(HOURLY_VARIABLES)}' as hourly, '{','.join(DAILY_VARIABLES)}' as daily
from ({RAW})
"""


YESTERDAY = f"cast({LAST_DAY} - interval '1' day as date)"

SNAPSHOTS = f"""
with old as (select time, city_id, temperature_2m as t, precipitation as p from ({RAW})
             where cast(time as date) <= date '2024-01-25'),
     new as (select time, city_id, precipitation as p,
                    case when relative_humidity_2m is null and temperature_2m is not null
                         then temperature_2m + 1 else temperature_2m end as t
             from ({RAW}) where cast(time as date) >= date '2024-01-05'),
     met as (
         select coalesce(o.city_id, n.city_id) as city_id, coalesce(o.time, n.time) as time,
                case when o.time is null then 'added' when n.time is null then 'removed'
                     when o.t is distinct from n.t or o.p is distinct from n.p then 'changed'
                end as status
         from old o full outer join new n on o.city_id = n.city_id and o.time = n.time)
"""


HOURS = f"""
hours as (select distinct city_id, date_trunc('hour', time) as hour from ({RAW}) where time is not null),
steps as (
    select city_id, hour, before, date_diff('hour', before, hour) as away
    from (select *, lag(hour) over (partition by city_id order by hour) as before from hours))
"""

STORED = f"""
with old as (select time, city_id, temperature_2m as t, precipitation as p from ({RAW})
             where cast(time as date) <= date '2024-01-25'),
     new as (select time, city_id, precipitation as p,
                    case when cast(time as date) in (date '2024-01-09', date '2024-01-10', date '2024-01-21')
                              and relative_humidity_2m is null then temperature_2m + 1 else temperature_2m end as t
             from ({RAW}) where cast(time as date) >= date '2024-01-05'),
     met as (
         select coalesce(o.city_id, n.city_id) as city_id, coalesce(o.time, n.time) as time,
                case when o.time is null then 'added' when n.time is null then 'removed'
                     when o.t is distinct from n.t or o.p is distinct from n.p then 'changed'
                end as status
         from old o full outer join new n on o.city_id = n.city_id and o.time = n.time)
"""

#: rows of the middle without one city set the watermark that this city's rows meet; the first days come last
TAKEN = f"""
time >= date '2024-01-08' and (city_id <> 'view' or time >= date '2024-01-21' or time > (
    select date_trunc('milliseconds', max(time)) - interval '10' day from ({RAW})
    where city_id <> 'view' and time < date '2024-01-21'))
"""

LOADS = f"""
select city_id, cast(time as date) as day, event_id // 1024 as block, date_trunc('week', time) as week,
       case when date_trunc('week', time) < date '2024-01-15' then 0
            when date_trunc('week', time) < date '2024-01-22' then 1 else 2 end as load
from ({RAW})
"""


def ledger(good: str) -> str:
    """What three loads bring, if the documents of some cities are good."""
    return f"""
select cast(load as bigint) as load, count(distinct (city_id, week, block)) as documents,
       count(distinct (city_id, week, block)) filter (where not ({good})) as refused,
       count(*) filter (where {good}) as hourly,
       count(distinct (city_id, day, block)) filter (where {good}) as daily
from ({LOADS}) group by load
"""


def oracle_sql() -> dict[str, str]:
    anomaly_rows = anomalies(stg())
    return {
        "stg_weather": stg(),
        "weather_daily": daily(stg()) + "order by date, city_id",
        "weather_daily_bootstrap": daily(stg(), precip_gaps=False),
        "weather_daily_unfilled": daily(stg(fill=False)),
        "daily_preview": daily(stg()) + "order by date, city_id limit 5",
        "city_stats": city_stats(stg()),
        "city_stats_merged": city_stats(stg(CONSTANT_RAW)),
        "weather_anomalies": anomaly_rows,
        "weather_anomalies_unfilled": anomalies(stg(fill=False)),
        "weather_anomalies_constant": anomalies(stg(CONSTANT_RAW)),
        "weather_anomalies_bootstrap": bootstrap_anomalies(stg(CONSTANT_RAW)),
        "anomalies_in_time_order": anomaly_rows + "order by time, city_id",
        "flagged_anomalies": f"select * from ({anomaly_rows}) where is_temp_anomaly",
        "anomaly_counts": f"""
            select count(*) as scored_rows,
                   count(*) filter (where is_temp_anomaly) as temp_anomalies
            from ({anomaly_rows})""",
        "cloud_temp_corr": f"""
            select city_id, round(corr(cloud_cover, temperature_2m), 6) as cloud_temp_corr,
                   count(*) as rows from ({stg()}) group by city_id""",
        "dq_not_null": layers(FAULTY_RAW) + union(not_null_results()),
        "dq_unique": f"with stg as ({stg(OVERLAPPING_RAW)}) "
        + unique_result(),
        "duplicate_keys": f"""
            select time, city_id, count(*) as copies from ({stg(OVERLAPPING_RAW)})
            group by time, city_id having count(*) > 1""",
        "dq_relationships": f"with raw as ({FAULTY_RAW}), stg as ({stg('raw')}), "
        "stormy as (select * from raw where wind_speed_10m > 69) "
        + union([
            relationships_result("staging.stg_weather", "raw"),
            relationships_result("staging.stg_weather_stormy", "stormy"),
        ]),
        "city_orphans": f"""
            with raw as ({RAW})
            select city_id, count(*) as rows from raw
            where city_id not in (select city_id from raw where wind_speed_10m > 69)
            group by city_id""",
        "dq_range": f"with stg as ({stg()}) " + union(range_results()),
        "layer_row_counts": layers(RAW) + union([
            f"select '{name.split('.')[0]}' as schema_name, '{name.split('.')[1]}' as table_name, "
            f"count(*) as row_count from {source}"
            for name, (source, _) in NOT_NULL.items()
        ]),
        "coverage": f"""
            select min(date) as min_date, max(date) as max_date,
                   count(distinct city_id) as city_count from ({stg()})""",
        "request_manifest": union([
            manifest("backfill", "archive", "date '2024-01-01'", "date '2025-12-31'"),
            manifest("incremental", "forecast", YESTERDAY, YESTERDAY),
            manifest("custom", "archive", "date '2024-01-05'", "date '2024-01-09'"),
        ]),
        "payload_validate": f"""
            with documents as (
                select distinct city_id, date_trunc('week', time) as week, event_id // 1024 as block
                from ({RAW}))
            select city_id, case city_id when 'click' then 'accepted'
                                         when 'error' then 'missing_daily'
                                         when 'purchase' then 'bad_hourly_time'
                                         when 'signup' then 'empty_hourly_time'
                                         when 'view' then 'ragged_hourly' end as verdict,
                   count(*) as documents
            from documents group by city_id""",
        "payload_hourly": f"select time, {MEASURES}, {PLACE}, {STAMP} from ({RAW})",
        "payload_daily": payload_daily(", " + STAMP),
        "payload_quarantine": HOURLY + " where city_id = 'click'",
        "ingest_stats": ingest_stats("true"),
        "custom_ingest": HOURLY + """ where city_id in ('click', 'view')
            and cast(time as date) between date '2024-01-05' and date '2024-01-09'""",
        "incremental_ingest": ingest_stats(f"cast(time as date) = {YESTERDAY}"),
        "landing_roundtrip": HOURLY,
        "daily_scan": payload_daily(),
        "hourly_files": HOURLY,
        "daily_files": f"""
            select cast(cast(time as date) as timestamp) as time, city_id,
                   max(temperature_2m) as temperature_2m_max,
                   min(temperature_2m) as temperature_2m_min
            from ({RAW}) group by city_id, cast(time as date)""",
        "drifted_scan": f"""
            select * replace (
                case when city_id = 'click' then floor(temperature_2m) else temperature_2m
                end as temperature_2m,
                case when city_id = 'error' then null else cloud_cover end as cloud_cover)
            from ({HOURLY})""",
        "full_refresh": daily(stg(), updated=False),
        "incremental_refresh": daily(stg()),
        "newest_refresh": anomalies(stg(f"""
            select * from ({OVERLAPPING_RAW})
            qualify row_number() over (partition by city_id, time
                                       order by ingestion_timestamp desc, batch_id desc) = 1""")),
        "refresh_after_empty_batch": daily(stg()),
        "streamed_refresh": daily(stg(), updated=False),
        "manifest_ingest": ingest_stats(
            "cast(time as date) = cast(date '2024-01-01' + to_days(cast(length(city_id) as integer)) as date)"),
        "full_refresh_anomalies": anomaly_rows,
        "table_listing": f"""
            with raw as ({RAW}), stg as ({stg()})
            select 'mart' as schema_name, 'weather_anomalies' as table_name, count(*) as row_count
            from ({bootstrap_anomalies('select * from stg')})
            union all select 'mart', 'weather_daily', count(*) from ({daily('stg')})
            union all select 'raw', 'weather_daily', count(*)
                from ({payload_daily()})
            union all select 'raw', 'weather_hourly', count(*) from stg
            union all select 'staging', 'weather_hourly', count(*) from stg""",
        "build_once": daily(stg()),
        "legacy_table": f"""
            select time, temperature_2m, cast(relative_humidity_2m as integer)
                   as relative_humidity_2m, precipitation, wind_speed_10m,
                   cast(cloud_cover as integer) as cloud_cover, pressure_msl, {PLACE},
                   ingestion_timestamp, batch_id from ({RAW})""",
        "legacy_marts": anomaly_rows,
        "dq_results": layers(FAULTY_RAW) + f""", results as ({union([
            *not_null_results(),
            unique_result(),
            relationships_result("staging.stg_weather", "raw"),
            *filled_results(),
            *range_results(),
        ])})
            select *, timestamp '2024-02-01 03:04:05' as checked_at, '20240201_030405' as run_id
            from results
            union all
            select *, timestamp '2024-02-02 03:04:05', '20240202_030405' from results""",
        "incremental_load": HOURLY,
        "hour_coverage": f"""
            with {HOURS}
            select city_id, min(hour) as first_hour, max(hour) as last_hour, count(*) as present_hours,
                   cast(date_diff('hour', min(hour), max(hour)) + 1 - count(*) as bigint) as missing_hours,
                   count(*) filter (where away > 1) as gaps, coalesce(max(away - 1), 0) as longest_gap_hours
            from steps group by city_id""",
        "missing_intervals": f"""
            with {HOURS}
            select city_id, before + interval '1' hour as first_missing, hour - interval '1' hour as last_missing,
                   away - 1 as missing_hours
            from steps where away > 1""",
        "distinct_sketch": f"""
            select city_id, count(distinct time) as times, count(distinct pressure_msl) as pressures,
                   true as times_near, true as pressures_near
            from ({stg()}) group by city_id""",
        "quantile_sketch": f"""
            select city_id, count(temperature_2m) as n, true as q0_near, true as q1_near, true as q2_near
            from ({stg()}) group by city_id""",
        "range_from_data": f"""
            select city_id, count(temperature_2m) as checked, true as failures_near from ({stg()}) group by city_id""",
        "snapshot_diff_stored": STORED + "select city_id, time, status from met where status is not null",
        "snapshot_changed_days": STORED + "select distinct city_id, cast(time as date) as day from met where status is not null",
        "landed_extras": """
            select ts as time, event_type as city_id, cast(props ->> '$.k' as bigint) as k, user_id, cast(null as double) as absent
            from events""",
        "extra_schema": """
            select 'props' as variable, 'OBJECT<k: BIGINT>' as type, count(*) as readings from events
            union all select 'user_id', 'BIGINT', count(*) from events""",
        "duplicate_keys_by_batch": f"""
            select time, city_id, cast(count(*) as bigint) as copies from ({OVERLAPPING_RAW})
            group by time, city_id having count(*) > 1""",
        "new_duplicates": f"""
            select case when extract(day from time) % 2 = 0 then 'rerun' else 'odd' end as batch, count(*) as keys
            from (select time, city_id from ({OVERLAPPING_RAW}) group by time, city_id having count(*) > 1)
            group by batch""",
        "streamed_marts": daily(stg(), updated=False),
        "streamed_marts_stats": city_stats(stg()),
        "load_ledger": ledger("city_id = 'click'"),
        "streamed_city_state": f"""
            with stg as ({stg(CONSTANT_RAW)}), marks as (
                select city_id, count(*) as rows, max(time) as high_water from stg group by city_id)
            select city_id, rows, high_water, round(avg_temp, 6) as avg_temp, round(stddev_temp, 6) as stddev_temp,
                   round(avg_precip, 6) as avg_precip, round(stddev_precip, 6) as stddev_precip
            from ({STATS}) join marks using (city_id)""",
        "streamed_unique": f"{HOURLY} where {TAKEN}",
        "late_rows": f"{HOURLY} where not ({TAKEN})",
        "streamed_checks": f"with raw as ({FAULTY_RAW}) " + union([
            *[result("raw.weather_hourly", "not_null", column, f"count(*) filter (where {column} is null)", "raw")
              for column in NOT_NULL["raw.weather_hourly"][1]],
            *range_results("raw.weather_hourly", "raw"),
        ]),
        "replayed_rows": HOURLY,
        "replay_ledger": f"""
            {ledger("city_id not in ('view', 'signup')")}
            union all select -1, count(distinct (week, block)), 0, count(*), count(distinct (day, block))
            from ({LOADS}) where city_id = 'view'
            union all select -2, count(distinct (week, block)), 0, count(*), count(distinct (day, block))
            from ({LOADS}) where city_id = 'signup'""",
        "high_water_delta": f"""
            with raw as ({RAW}), marks as (
                select city_id, max(time) as high_water from raw
                where city_id <> 'view'
                  and time < timestamp '2024-01-10' + to_days(cast(length(city_id) as integer))
                group by city_id)
            select time, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m,
                   cloud_cover, pressure_msl, {PLACE}
            from raw left join marks using (city_id)
            where high_water is null or time > high_water""",
        "high_water_bounded": f"""
            with raw as ({RAW}), marks as (
                select city_id, max(time) as high_water from raw
                where time < timestamp '2024-01-10' group by city_id)
            select time, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m,
                   cloud_cover, pressure_msl, {PLACE}
            from raw join marks using (city_id) where time > high_water""",
        "latest_batch": f"""
            select time, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m,
                   cloud_cover, pressure_msl, {PLACE}, ingestion_timestamp, batch_id
            from ({OVERLAPPING_RAW})
            qualify row_number() over (partition by city_id, time
                                       order by ingestion_timestamp desc, batch_id desc) = 1""",
        "snapshot_diff": SNAPSHOTS
        + "select city_id, time, status from met where status is not null",
        "snapshot_diff_copies": f"""
            with rows as (select date_trunc('day', time)::timestamp as time, city_id,
                                 temperature_2m as t, precipitation as p from ({RAW})),
                 old as (select city_id, time, list_sort(list(coalesce(t::varchar, 'gap') || '/' || coalesce(p::varchar, 'gap'))) as all_rows
                         from rows where time < date '2024-01-26' group by city_id, time),
                 new as (select city_id, time, list_sort(list(coalesce(t::varchar, 'gap') || '/' || coalesce(
                             (case when extract(day from time) % 2 = 0 then coalesce(p, 0) else p end)::varchar, 'gap'))) as all_rows
                         from rows where time >= date '2024-01-05' group by city_id, time)
            select coalesce(o.city_id, n.city_id) as city_id, coalesce(o.time, n.time) as time,
                   case when o.time is null then 'added' when n.time is null then 'removed' else 'changed' end as status
            from old o full outer join new n on o.city_id = n.city_id and o.time = n.time
            where o.all_rows is distinct from n.all_rows""",
        "snapshot_diff_counts": SNAPSHOTS
        + "select city_id, status, count(*) as keys from met where status is not null "
        "group by city_id, status",
    }
