"""The registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import tiles
from meridian.operators import measure, session
from meridian.plans import addressing, measures, more, scenes, stores  # noqa: F401  each module registers its own queries
from meridian.plans.catalogue import ORACLE, QUERIES, register  # noqa: F401

_STEPS = """
s0 as (select *, lag(frame) over w as pf, lag(sky_luma) over w as ps, lag(ground_luma) over w as pg, lag(sky_pixels) over w as psp,
  lag(ground_pixels) over w as pgp, lag(stars) over w as pst, lag(altitude) over w as pa, lag(instant) over w as pi_, lag(direction) over w as pd from session_frames where pictured window w as (partition by session order by frame)),
s1 as (select *, pf is not null and frame - pf <= 2 and abs(altitude - pa) / greatest(abs(pa), 1.0) <= 0.02 and degrees(acos(least(1, greatest(-1, list_dot_product(direction, pd))))) <= 0.5 and coalesce(abs(instant - pi_) <= 900, true) as still from s0),
s2 as (select *, case when still and sky_pixels >= 1000 and psp >= 1000 then sky_luma - ps end as sky, case when still and ground_pixels >= 1000 and pgp >= 1000 then ground_luma - pg end as ground,
  case when still then pst end as before from s1),
s3 as (select *, list_concat(coalesce(list(abs(sky)) filter (sky is not null) over b, []), coalesce(list(abs(sky)) filter (sky is not null) over a, [])) as ls,
  list_concat(coalesce(list(abs(ground)) filter (ground is not null) over b, []), coalesce(list(abs(ground)) filter (ground is not null) over a, [])) as lg from s2
  window b as (partition by session order by frame rows between 5 preceding and 1 preceding), a as (partition by session order by frame rows between 1 following and 5 following)),
s4 as (select session, frame, coalesce(abs(sky) > 0.03 and abs(sky) > 3 * coalesce(list_sort(ls)[len(ls) // 2 + 1], 0), false) as sky,
  coalesce(abs(ground) > 0.03 and abs(ground) > 3 * coalesce(list_sort(lg)[len(lg) // 2 + 1], 0), false) as ground,
  coalesce(before >= 10 and stars < 0.5 * before, false) as stars, black_ground >= 16 as black from s3)
select * from s4 where sky or ground or stars or black"""
register("flicker_flags", ("session_frames",), session.flicker_flags, "," + _STEPS)
register("picture_deltas", ("session_frames",), session.picture_deltas, """select session, frame, round(sky_luma - lag(sky_luma) over w, 6) as sky_delta, round(ground_luma - lag(ground_luma) over w, 6) as ground_delta,
  lag(picture_width) over w = picture_width and lag(picture_height) over w = picture_height as same_size from session_frames where pictured window w as (partition by session order by frame)""")
register("recorded_fps", ("session_frames",), session.recorded_fps, """, p as (select session, arg_min(wall_ms, frame) as a, arg_max(wall_ms, frame) as b, count(*) as n from session_frames where pictured and wall_ms is not null group by 1)
  select s.session, cast(case when b > a and n > 1 then least(240, greatest(1, round((n - 1) / ((b - a) / 1000)))) else 30 end as bigint) as fps from (select distinct session from session_frames) s left join p using (session)""")
register("frame_size_mode", ("session_frames",), session.frame_size_mode, "select session, picture_width, picture_height, n from (select *, row_number() over (partition by session order by n desc, picture_width desc, picture_height desc) as r from (select session, picture_width, picture_height, count(*) as n from session_frames group by 1, 2, 3)) where r = 1")
register("sliding_max", ("session_frames",), measure.sliding_max, "select session, frame, round(max(sky_luma) over (partition by session order by frame rows between 3 preceding and 3 following), 6) as peak from session_frames")
register("hold_runs", ("session_frames",), lambda f: measure.hold_runs(f, "sky_pixels"), """select session, min(frame) as frame, min(sky_pixels) as sky_pixels, count(*) as hold from (select *, sum(fresh) over (partition by session order by frame) as run from
  (select *, coalesce(cast(lag(sky_pixels) over (partition by session order by frame) <> sky_pixels as int), 1) as fresh from session_frames)) group by session, run""")
register("median_kinds", ("cells",), lambda c: measure.medians(c, "tile", "v"), "select tile, round(list_sort(list(v))[count(*) // 2 + 1], 6) as upper, round(quantile_cont(v, 0.5), 6) as averaged, round(list_sort(list(v))[(count(*) - 1) // 2 + 1], 6) as low from cells group by 1")
register("weighted_median", ("tile_light",), lambda t: measure.weighted_median(t, "level", "red", "drapes"), "select level, round(min(red), 6) as median from (select level, red, sum(drapes) over (partition by level order by red range between unbounded preceding and current row) as run, sum(drapes) over (partition by level) as whole from tile_light) where run * 2 >= whole group by 1")
register("level_summary", ("tile_light",), measure.level_summary, "select level, count(*) as tiles, round(avg((red + green + blue) / 3), 6) as mean, round(min((red + green + blue) / 3), 6) as least, round(max((red + green + blue) / 3), 6) as most, cast(sum(drapes) as bigint) as drapes from tile_light group by 1")
register("nearest_ancestors", ("tile_light",), measure.nearest_ancestors, """select level, x, y, nth, a_level, a_x, a_y, a_red from (select t.level, t.x, t.y, a.level as a_level, a.x as a_x, a.y as a_y, round(a.red, 6) as a_red, row_number() over (partition by t.level, t.x, t.y order by a.level desc) as nth
  from tile_light t join tile_light a on a.level between t.level - 3 and t.level - 1 and a.x = t.x >> (t.level - a.level) and a.y = t.y >> (t.level - a.level)) where nth <= 2""")
register("edge_joints", ("tile_light",), measure.edge_joints, """select t.level, t.x, t.y, 'right' as side, round(n.green - t.green, 6) as step from tile_light t join tile_light n on n.level = t.level and n.x = t.x + 1 and n.y = t.y
  union all select t.level, t.x, t.y, 'below', round(n.green - t.green, 6) from tile_light t join tile_light n on n.level = t.level and n.x = t.x and n.y = t.y + 1""")
register("frame_diff", ("pack_frames",), measure.frame_diff, """, o as (select frame, lag(frame) over (order by frame) as prev from (select distinct frame from pack_frames)), b as (select o.frame, tile_id, drape, 1 as was from pack_frames p join o on p.frame = o.prev),
  n as (select *, 1 as own from pack_frames) select frame, cast(sum(cast(was is null as int)) as bigint) as entered, cast(sum(cast(own is null as int)) as bigint) as "left", cast(sum(cast(was is not null and own is not null as int)) as bigint) as kept from n full join b using (frame, tile_id, drape) group by frame""")
register("tile_usage", ("pack_frames",), measure.tile_usage, "select tile_id, count(distinct frame) as frames, min(frame) as first, max(frame) as last from pack_frames group by 1")
register("score_medians", ("scores",), measure.score_medians, "select input, method, round(quantile_cont(psnr_y, 0.5), 3) as psnr_y, round(quantile_cont(lpips, 0.5), 3) as lpips, count(*) as n from scores where coalesce(kind <> 'other', true) group by 1, 2")
register("score_table", ("scores",), lambda s: measure.score_table(s, "lpips", [f"m{i}" for i in range(5)]), "select input, " + ", ".join(f"round(quantile_cont(lpips, 0.5) filter (method = 'm{i}'), 3) as m{i}" for i in range(5)) + " from scores where coalesce(kind <> 'other', true) group by 1")
register("stratified_sample", ("scores",), lambda s: measure.stratified(s.groupBy("sample").agg(F.min("kind").alias("kind"), (F.min("psnr_y") > 200).alias("bright")), ["kind", "bright"], "sample", 60, 7).select("sample"), """, d as (select sample, min(kind) as kind, min(psnr_y) > 200 as bright, md5('7:' || sample) as h from scores group by 1), r as (select *, row_number() over (partition by kind, bright order by h, sample) as nth, count(*) over (partition by kind, bright) as n, count(*) over () as total from d)
  select sample from r where nth <= least(n, greatest(1, round_even(60 * n / total, 0))) order by h, sample limit 60""")
register("score_pivot", ("scores",), measure.score_pivot, "select sample, input, " + ", ".join(f"round(max(psnr_y) filter (method = 'm{i}'), 6) as m{i}" for i in range(5)) + " from scores group by 1, 2")
register("win_rate", ("scores",), measure.win_rate, """, m as (select sample, input, method, avg(lpips) as lpips from scores where coalesce(kind <> 'other', true) group by 1, 2, 3 having avg(lpips) is not null), p as (select input, count(distinct sample) as n from m group by 1)
  select a.input, a.method, round(count(*) filter (a.lpips < b.lpips) / any_value(p.n), 6) as wins, any_value(p.n) as n from m a left join m b on b.sample = a.sample and b.input = a.input and b.method = 'm0' join p on p.input = a.input where a.method <> 'm0' group by 1, 2""")
register("first_samples", ("scores",), measure.first_samples, "select sample, input, n from (select *, row_number() over (partition by input order by sample) as n from (select distinct sample, input from scores)) where n <= 20")
register("class_counts", ("scores",), measure.class_counts, "select input, " + ", ".join(f"cast(sum(coalesce(cast(kind = '{k}' as int), 0)) as bigint) as {k}" for k in ("same", "other")) + ", cast(sum(cast(kind is null as int)) as bigint) as unknown from scores group by 1")
register("request_order", ("quadtree",), measure.request_order, "select level, x, y, round(geometric_error, 6) as geometric_error from quadtree order by geometric_error desc, level, y, x limit 64")
register("select_tiles", ("quadtree",), lambda t: measure.descend(t, 0.3, 0.7, 60000.0), """, d as (select *, geometric_error > 60000.0 * sqrt(pow(greatest(0.0, x * pow(2.0, -level) - 0.3, 0.3 - (x + 1) * pow(2.0, -level)), 2) + pow(greatest(0.0, y * pow(2.0, -level) - 0.7, 0.7 - (y + 1) * pow(2.0, -level)), 2)) and level < 5 as split from quadtree)
  select d.level, d.x, d.y from d left join d p on p.level = d.level - 1 and p.x = d.x // 2 and p.y = d.y // 2 where not d.split and (d.level = 0 or p.split)""")
_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"
register("haversine", ("eyes",), lambda e: e.select("eye", F.round(tiles.haversine(F.col("lon"), F.col("lat"), F.lit(2.35), F.lit(48.85)), 3).alias("metres")), "select eye, round(" + _HAVERSINE.format(a="lon", b="lat", c="2.35e0", d="48.85e0") + ", 3) as metres from eyes")
register("geodetic_to_ecef", ("eyes",), lambda e: e.select("eye", *[(F.round(c, 3) + 0.0).alias(n) for n, c in zip(("px", "py", "pz"), tiles.ecef(F.col("lon"), F.col("lat"), F.col("height")))]), f""", g as (select *, radians(lat) as p, radians(lon) as l, {tiles.A} / sqrt(1 - {tiles.E2!r}::double * pow(sin(radians(lat)), 2)) as n from eyes)
  select eye, round((n + height) * cos(p) * cos(l), 3) + 0.0 as px, round((n + height) * cos(p) * sin(l), 3) + 0.0 as py, round((n * (1 - {tiles.E2!r}::double) + height) * sin(p), 3) + 0.0 as pz from g""")
register("tile_of_point", ("eyes",), lambda e: e.select("eye", *[c.alias(n) for n, c in zip(("x", "y"), tiles.tile_of(F.col("lon"), F.col("lat"), 12))]), """select eye, cast(least(4095, greatest(0, floor((lon + 180) / 360 * 4096))) as bigint) as x,
  cast(least(4095, greatest(0, floor((1 - ln(tan(radians(greatest(-85.05112877980659e0, least(85.05112877980659e0, lat)))) + 1 / cos(radians(greatest(-85.05112877980659e0, least(85.05112877980659e0, lat))))) / pi()) / 2 * 4096))) as bigint) as y from eyes""")
register("tile_rect", ("tile_light",), lambda t: t.select("level", "x", "y", *[F.round(c, 6).alias(n) for n, c in zip(("west", "south", "east", "north"), tiles.bounds(F.col("level"), F.col("x"), F.col("y")))]), """select level, x, y, round(x / pow(2.0, level) * 360 - 180, 6) as west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, level))))), 6) as south,
  round((x + 1) / pow(2.0, level) * 360 - 180, 6) as east, round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, level))))), 6) as north from tile_light""")
register("quadkey", ("quadtree",), lambda t: t.select("level", "x", "y", tiles.quadkey(F.col("level"), F.col("x"), F.col("y")).alias("key"), tiles.level_base(F.col("level")).alias("base")), """select level, x, y, array_to_string(list_transform(range(cast(level as int) - 1, -1, -1), lambda i: ((x >> i) & 1) + 2 * ((y >> i) & 1)), '') as key,
  cast((pow(4, level) - 1) / 3 as bigint) as base from quadtree""")
register("footprint_keeps", ("addresses", "eyes"), lambda t, e: measure.footprint_keeps(t.where("level between 2 and 9"), e), """, k as (select grid, level, x, y, pow(2e0, level) as k from addresses where level between 2 and 9), b as (select grid, level, x, y, case when grid = 'geographic' then -180 + x * (180 / k) else x / k * 360 - 180 end as w, case when grid = 'geographic' then -180 + x * (180 / k) + 180 / k else (x + 1) / k * 360 - 180 end as e,
  case when grid = 'geographic' then -90 + y * (180 / k) else degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / k)))) end as s, case when grid = 'geographic' then -90 + y * (180 / k) + 180 / k else degrees(atan(sinh(pi() * (1 - 2 * y / k)))) end as n from k), r as (select *, 6371008.8 * pi() / 180 as m, 2 * greatest((e - w) * m * cos(radians((s + n) / 2)), (n - s) * m) + 500 * sqrt(2) as reach from b),
  j as (select r.grid, r.level, r.x, r.y, reach, height, """ + _HAVERSINE.format(a="lon", b="lat", c="least(greatest(lon, w), e)", d="least(greatest(lat, s), n)") + """ as ground from r, eyes)
  select distinct grid, level, x, y from j where ground <= sqrt(2 * 6371008.8 * greatest(height, 0) + height * height) + sqrt(2 * 6371008.8 * 4800) and sqrt(ground * ground + pow(greatest(height - 4800, 0), 2)) <= reach""")