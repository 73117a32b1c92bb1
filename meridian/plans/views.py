"""Tile, frame and score tables derived from the driver's tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from meridian.operators.deal import tasks

#: The driver's tables that the views read.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

#: Read alike by both dialects.
SHARED = {
    "addresses": """select grid, level, k % w as x, k2 % h as y, count(*) as n from (select grid, level, cast(pow(2e0, level) as bigint) * (case when grid = 'geographic' then 2 else 1 end) as w, cast(pow(2e0, level) as bigint) as h, l_orderkey * 7919 as k, l_partkey * 104729 as k2 from
  (select case when l_linenumber % 2 = 0 then 'geographic' else 'web-mercator' end as grid, l_suppkey % 20 as level, l_orderkey, l_partkey from lineitem) a) b group by 1, 2, 3, 4""",
    "places": """select c_custkey as place, radians((c_custkey * 7919 % 36000) / 100e0 - 180e0) as lon, radians((c_custkey * 104729 % 17801) / 100e0 - 89e0) as lat, cast(c_custkey * 31 % 9000 - 400 as double) as height,
  radians((c_custkey * 6007 % 36000) / 100e0 - 180e0) as lon2, radians((c_custkey * 15013 % 17001) / 100e0 - 85e0) as lat2 from customer""",
    "rects": """select p_partkey as rect, case when p_partkey % 2 = 0 then 'geographic' else 'web-mercator' end as grid, radians((p_partkey * 7919 % 35000) / 100e0 - 180e0) as west, radians((p_partkey * 104729 % 16000) / 100e0 - 84e0) as south,
  radians((p_partkey * 7919 % 35000) / 100e0 - 180e0 + p_size / 10e0) as east, radians((p_partkey * 104729 % 16000) / 100e0 - 84e0 + p_size % 7 / 2e0 + 0.1e0) as north, cast(p_size as double) as height from part""",
    "stars": """select p_partkey as star, p_size / 4e0 - 2e0 as v, p_partkey % 30 / 10e0 - 0.6e0 as bv, p_partkey % 19 - 9e0 as x, p_partkey % 23 - 11e0 as y, p_size - 25.5e0 as z from part""",
    "needs": """select event_id as need, case when event_id % 50 = 0 then null else value / 20e0 - 10e0 end as sse, event_id % 120 / 100e0 as centrality, event_id * 1.5e0 as distance, user_id % 6000 as waited, event_id % 40 as waiting from events""",
    "keys": """select s_suppkey as id, case s_suppkey % 6 when 0 then 'a/b/' || s_suppkey when 1 then '/a' || s_suppkey when 2 then 'a/../' || s_suppkey when 3 then 'a//' || s_suppkey when 4 then './' || s_suppkey else 'x.' || s_suppkey end as key, case s_suppkey % 3 when 0 then 'W/"1", "2"' when 1 then '*' else '"' || s_suppkey || '"' end as tags, case when s_suppkey % 2 = 0 then 'W/"2"' else '"' || s_suppkey || '"' end as etag,
  case s_suppkey % 7 when 0 then null when 1 then 'bytes=5-' when 2 then 'bytes=0-99' when 3 then 'bytes=90-10' when 4 then 'items=1-2' when 5 then 'bytes=-5' else 'bytes= 3 - 5000 ' end as spec, case s_suppkey % 5 when 0 then '1995-03-04' when 1 then '1995-03-04T10:20Z' when 2 then '1995-03-04T10:20:30.25Z' when 3 then '12345.5' else 'noon' end as clock from supplier""",
}
SPARK = SHARED | {
    "session_frames": """select user_id as session, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame,
  unix_micros(to_timestamp(ts)) div 1000 as wall_ms, event_type <> 'error' as pictured, value / 500e0 as sky_luma, (500e0 - value) / 1000e0 as ground_luma,
  cast(1000 + event_id % 7 as bigint) as sky_pixels, cast(event_id % 5 * 400 as bigint) as ground_pixels,
  cast(get_json_object(props,'$.k') as bigint) as stars, cast(event_id % 11 * 3 as bigint) as black_ground,
  cast(640 + event_id % 3 * 640 as bigint) as picture_width, cast(360 + event_id % 3 * 360 as bigint) as picture_height,
  cast(user_id * 100 + 1000 as double) as altitude,
  case when event_id % 17 = 0 then null else event_id % 4 * 400e0 end as instant, array(cos(event_id % 3 * 0.006e0), sin(event_id % 3 * 0.006e0), 0e0) as direction, array(0e0, 0e0, 1e0) as up from events""",
    "tile_puts": """select event_type as layer, cast(10 + event_id % 3 as bigint) as level, user_id * 7 % 64 as x, user_id * 13 % 64 as y,
  unix_micros(to_timestamp(ts)) div 1000 as fetched_ms, event_id as arrival, user_id * 31 % 17 as digest from events""",
    "archive_entries": """select 'z' || cast(z as varchar(10)) as zone, date_format(month, 'yyyyMM') as epoch, date_format(month, 'yyyyMM') || '-' || cast(n as varchar(10)) as archive, tile_id, bytes, digest, oldest_fetch, newest_fetch from (
  select l_suppkey % 8 as z, trunc(l_shipdate, 'MM') as month, l_linenumber as n, l_partkey as tile_id, cast(max(l_quantity) as bigint) as bytes, max(l_orderkey) as digest, cast(min(datediff(l_shipdate, date'1995-01-01')) as bigint) as oldest_fetch, cast(max(datediff(l_shipdate, date'1995-01-01')) as bigint) as newest_fetch
  from lineitem group by 1, 2, 3, 4) t""",
    "absences": """select 'z' || cast(l_suppkey % 8 as varchar(10)) as zone, l_partkey as tile_id, cast(max(datediff(l_shipdate, date'1995-01-01')) as bigint) as said, cast(max(datediff(l_shipdate, date'1995-01-01')) + 90 as bigint) as expires
  from lineitem where l_returnflag = 'R' group by 1, 2""",
    "tile_light": """select level, x, y, max(red) as red, max(green) as green, max(blue) as blue, count(*) as drapes from (
  select level, k % w as x, k div w % w as y, red, green, blue from (
  select cast(3 + p_partkey % 4 as bigint) as level, p_partkey div 4 as k, shiftleft(1L, cast(3 + p_partkey % 4 as int)) as w,
  (p_retailprice % 97e0 + 1e0) / 98e0 as red, (p_size % 50 + 1) / 51e0 as green, (p_partkey % 89 + 1) / 90e0 as blue from part) t) u group by 1, 2, 3""",
    "pack_frames": """select distinct o_orderkey as frame, l_partkey as tile_id, cast(l_linenumber % 3 as bigint) as drape from orders join lineitem on l_orderkey = o_orderkey""",
    "scores": """select user_id as sample, event_type as input, 'm' || cast(event_id % 5 as varchar(10)) as method,
  avg(value) as psnr_y, avg((value * 7) % 1) as lpips, max(case when user_id % 4 = 0 then 'other' when user_id % 4 = 1 then null else 'same' end) as kind
  from events group by 1, 2, 3""",
    "quadtree": """select cast(lv as bigint) as level, cast(n % shiftleft(1L, cast(lv as int)) as bigint) as x, cast(n div shiftleft(1L, cast(lv as int)) as bigint) as y, 77067.34e0 / shiftleft(1L, cast(lv as int)) as geometric_error from (select explode(sequence(0,5)) lv) q, lateral (select explode(sequence(0, cast(pow(4,lv)-1 as int))) n) c""",
    "cells": """select vec_id as tile, cast(i as bigint) as cell, cast(element_at(embedding, cast(i as int)) as double) as v, cast(label as bigint) as label from embeddings cross join (select explode(sequence(1,64)) i) g""",
    "eyes": """select s_suppkey as eye, (s_suppkey * 7919 % 36000) / 100e0 - 180e0 as lon, (s_suppkey * 104729 % 17000) / 100e0 - 85e0 as lat, cast(1000 + s_suppkey % 50 * 1000 as double) as height from supplier""",
}

DUCKDB = SHARED | {
    "session_frames": """select user_id as session, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame,
  epoch_us(ts) // 1000 as wall_ms, event_type <> 'error' as pictured, value / 500e0 as sky_luma, (500e0 - value) / 1000e0 as ground_luma,
  cast(1000 + event_id % 7 as bigint) as sky_pixels, cast(event_id % 5 * 400 as bigint) as ground_pixels,
  cast(json_extract_string(props,'$.k') as bigint) as stars, cast(event_id % 11 * 3 as bigint) as black_ground,
  cast(640 + event_id % 3 * 640 as bigint) as picture_width, cast(360 + event_id % 3 * 360 as bigint) as picture_height,
  cast(user_id * 100 + 1000 as double) as altitude,
  case when event_id % 17 = 0 then null else event_id % 4 * 400e0 end as instant, [cos(event_id % 3 * 0.006e0), sin(event_id % 3 * 0.006e0), 0e0] as direction, [0e0, 0e0, 1e0] as up from events""",
    "tile_puts": """select event_type as layer, cast(10 + event_id % 3 as bigint) as level, user_id * 7 % 64 as x, user_id * 13 % 64 as y,
  epoch_us(ts) // 1000 as fetched_ms, event_id as arrival, user_id * 31 % 17 as digest from events""",
    "archive_entries": """select 'z' || cast(l_suppkey % 8 as varchar(10)) as zone, strftime(l_shipdate,'%Y%m') as epoch, strftime(l_shipdate,'%Y%m') || '-' || cast(l_linenumber as varchar(10)) as archive,
  l_partkey as tile_id, cast(max(l_quantity) as bigint) as bytes, max(l_orderkey) as digest, cast(min(date_diff('day', date '1995-01-01', cast(l_shipdate as date))) as bigint) as oldest_fetch, cast(max(date_diff('day', date '1995-01-01', cast(l_shipdate as date))) as bigint) as newest_fetch
  from lineitem group by 1, 2, 3, 4""",
    "absences": """select 'z' || cast(l_suppkey % 8 as varchar(10)) as zone, l_partkey as tile_id, cast(max(date_diff('day', date '1995-01-01', cast(l_shipdate as date))) as bigint) as said, cast(max(date_diff('day', date '1995-01-01', cast(l_shipdate as date))) + 90 as bigint) as expires
  from lineitem where l_returnflag = 'R' group by 1, 2""",
    "tile_light": """select level, x, y, max(red) as red, max(green) as green, max(blue) as blue, count(*) as drapes from (
  select level, k % w as x, k // w % w as y, red, green, blue from (
  select cast(3 + p_partkey % 4 as bigint) as level, p_partkey // 4 as k, (1::bigint << cast(3 + p_partkey % 4 as int)) as w,
  (p_retailprice % 97e0 + 1e0) / 98e0 as red, (p_size % 50 + 1) / 51e0 as green, (p_partkey % 89 + 1) / 90e0 as blue from part) t) u group by 1, 2, 3""",
    "pack_frames": """select distinct o_orderkey as frame, l_partkey as tile_id, cast(l_linenumber % 3 as bigint) as drape from orders join lineitem on l_orderkey = o_orderkey""",
    "scores": """select user_id as sample, event_type as input, 'm' || cast(event_id % 5 as varchar(10)) as method,
  avg(value) as psnr_y, avg((value * 7) % 1) as lpips, max(case when user_id % 4 = 0 then 'other' when user_id % 4 = 1 then null else 'same' end) as kind
  from events group by 1, 2, 3""",
    "quadtree": """select cast(lv as bigint) as level, cast(n % (1::bigint << cast(lv as int)) as bigint) as x, cast(n // (1::bigint << cast(lv as int)) as bigint) as y, 77067.34e0 / (1::bigint << cast(lv as int)) as geometric_error from (select unnest(range(0,6)) lv) q, lateral (select unnest(range(0, cast(pow(4,lv) as bigint))) n) c""",
    "cells": """select vec_id as tile, cast(i as bigint) as cell, cast(embedding[i] as double) as v, cast(label as bigint) as label from embeddings cross join (select unnest(range(1,65)) i) g""",
    "eyes": """select s_suppkey as eye, (s_suppkey * 7919 % 36000) / 100e0 - 180e0 as lon, (s_suppkey * 104729 % 17000) / 100e0 - 85e0 as lat, cast(1000 + s_suppkey % 50 * 1000 as double) as height from supplier""",
}


#: Large tables that a view joins by a key or groups: they are dealt by these columns to as many tasks as they are large. The rest of the columns are those that the view reads.
DEALT = {"pack_frames": ("lineitem", ("l_orderkey",), ("l_partkey", "l_linenumber")), "archive_entries": ("lineitem", ("l_partkey",), ("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` over the Parquet tables in ``sf_dir``."""
    sql = SPARK[name]
    if name in DEALT:
        table, by, more = DEALT[name]
        n = tasks(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        sql = re.sub(rf"\b(from|join) {table}\b", rf"\1 (select /*+ repartition({n}, {', '.join(by)}) */ {', '.join(by + more)} from {table}) as {table}", sql)
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))


def duck(name: str, select: str, *more: str) -> str:
    """``select`` over the derived table ``name`` (and ``more``) for DuckDB."""
    return "with " + ", ".join(f"{n} as ({DUCKDB[n]})" for n in (name, *more)) + " " + select
