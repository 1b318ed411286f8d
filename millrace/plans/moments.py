"""The project's event tables with their moments, and the same in oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.events import distinct_events
from millrace.sources.tables import table


def events(spark: SparkSession, d: str, columns: dict[str, Column | str], where: Column | None = None) -> DataFrame:
    """Rows of tiny_interactions, one for each event_id, with readable ts; `where` filters the raw rows."""
    raw = table(spark, d, "tiny_interactions")
    return distinct_events(raw if where is None else raw.where(where), "event_id", columns, ts="ts", tz="tz")


def moment_sql(name: str, columns: str) -> str:
    """Body of a CTE: the columns of a table and utc_us, null where ts is unreadable. Zones by DuckDB's own
    library, which reads a repeated wall time as the later moment: the earlier is tried first."""
    return rf"""
    SELECT {columns},
      CASE WHEN num IS NOT NULL THEN num
           WHEN wall IS NULL THEN NULL
           WHEN z <> '' AND z IN ('Z','UTC','GMT','CET','CEST','EST','EDT','PST','PDT') THEN epoch_us(wall) + frac - 3600000000 *
                CASE z WHEN 'CET' THEN 1 WHEN 'CEST' THEN 2 WHEN 'EST' THEN -5 WHEN 'EDT' THEN -4 WHEN 'PST' THEN -8 WHEN 'PDT' THEN -7 ELSE 0 END
           WHEN z <> '' THEN epoch_us(wall) + frac - (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * 1000000 *
                (CAST(substr(replace(z, ':', ''), 2, 2) AS BIGINT) * 3600 + CAST(substr(replace(z, ':', ''), 4, 2) AS BIGINT) * 60)
           WHEN timezone(zone, timezone(zone, wall) - INTERVAL 1 HOUR) = wall THEN epoch_us(timezone(zone, wall)) - 3600000000 + frac
           ELSE epoch_us(timezone(zone, wall)) + frac END AS utc_us
    FROM (SELECT *, try_strptime(day || ' ' || clock, '%Y-%m-%d %H:%M:%S') AS wall,
        coalesce(TRY_CAST(substr(rpad(digits, 6, '0'), 1, 6) AS BIGINT), 0) AS frac, coalesce(tz, 'UTC') AS zone
      FROM (SELECT *,
        CASE WHEN regexp_full_match(t, '\d{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '\d{{13}}') THEN CAST(t AS BIGINT) * 1000
             WHEN regexp_full_match(t, '\d{{16}}') THEN CAST(t AS BIGINT) END AS num,
        CASE WHEN iso THEN substr(t, 1, 10) WHEN compact THEN substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2)
             WHEN us THEN substr(t, 7, 4) || '-' || substr(t, 1, 2) || '-' || substr(t, 4, 2)
             WHEN eu THEN substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2)
             WHEN mail THEN strftime(try_strptime(substr(t, 6, 11), '%d %b %Y'), '%Y-%m-%d') END AS day,
        CASE WHEN iso AND length(t) = 10 THEN '00:00:00' WHEN iso THEN substr(t, 12, 8)
             WHEN compact THEN substr(t, 10, 2) || ':' || substr(t, 12, 2) || ':' || substr(t, 14, 2)
             WHEN us THEN strftime(try_strptime(substr(t, 12), '%I:%M:%S %p'), '%H:%M:%S')
             WHEN eu THEN substr(t, 12, 5) || ':00' WHEN mail THEN substr(t, 18, 8) END AS clock,
        CASE WHEN iso THEN regexp_extract(t, '[.,](\d+)', 1) ELSE '' END AS digits,
        CASE WHEN compact THEN 'Z' WHEN mail THEN substr(t, 27, 5)
             WHEN iso THEN regexp_extract(t, ':\d\d(?:[.,]\d+)? ?(Z|[A-Z]{{3,4}}|[+-]\d\d:?\d\d)(?:\[.*\])?$', 1) ELSE '' END AS z
        FROM (SELECT *, regexp_full_match(t, '\d{{4}}-\d\d-\d\d([T ]\d\d:\d\d:\d\d([.,]\d+)? ?(Z|[A-Z]{{3,4}}|[+-]\d\d:?\d\d)?(\[.*\])?)?') AS iso,
            regexp_full_match(t, '\d{{8}}T\d{{6}}Z') AS compact, regexp_full_match(t, '\d\d/\d\d/\d{{4}} \d\d:\d\d:\d\d [AP]M') AS us,
            regexp_full_match(t, '\d\d\.\d\d\.\d{{4}} \d\d:\d\d') AS eu, regexp_full_match(t, '[A-Z][a-z]{{2}}, \d\d [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d:\d\d [+-]\d{{4}}') AS mail
          FROM (SELECT *, trim(ts, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS t FROM {name}))))"""


def events_sql(columns: str) -> str:
    """Bodies of CTEs ending in `ev`: one row for each event_id with a readable ts."""
    names = ", ".join(f"any_value({c}) AS {c}" for c in columns.split(", "))
    return f"""raw AS ({moment_sql("tiny_interactions", "event_id, " + columns)}),
    ev AS (SELECT event_id, min(utc_us) AS utc_us, {names} FROM raw WHERE event_id IS NOT NULL AND utc_us IS NOT NULL GROUP BY event_id)"""
