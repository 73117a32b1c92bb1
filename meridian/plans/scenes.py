"""Queries of films, ground, tile trees and images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.functions import geodesy as geo
from meridian.functions import grid
from meridian.operators import frames, images, terrain, tree
from meridian.plans.catalogue import register

C = F.col

# Films
_OTHER = "other as (select frame, case when frame % 5 = 0 and tile_id % 3 = 0 then tile_id + 1 else tile_id end as tile_id, case when frame % 7 = 0 then drape + 1 else drape end as drape from pack_frames where frame % 11 <> 0)"


def _other(p):
    return p.where("frame % 11 <> 0").select("frame", F.when((C("frame") % 5 == 0) & (C("tile_id") % 3 == 0), C("tile_id") + 1).otherwise(C("tile_id")).alias("tile_id"), F.when(C("frame") % 7 == 0, C("drape") + 1).otherwise(C("drape")).alias("drape"))


register("frame_changes", ("pack_frames",), frames.changes, """, o as (select frame, lead(frame) over (order by frame) as nxt from (select distinct frame from pack_frames)), b as (select o.nxt as frame, p.tile_id, p.drape from pack_frames p join o using (frame) where o.nxt is not null)
  select n.*, 'enter' as change from pack_frames n anti join b using (frame, tile_id, drape) union all select b.*, 'leave' from b anti join pack_frames n using (frame, tile_id, drape)""")
register("referred_tiles", ("pack_frames",), lambda p: frames.referred(p, 100, 2000), "select distinct tile_id, drape from pack_frames where frame between 100 and 2000")
register("region_usage", ("pack_frames",), lambda p: frames.region_usage(p, p.select("tile_id").distinct().select("tile_id", (C("tile_id") % 7 + 2).alias("level"), (C("tile_id") % 37).alias("x"), (C("tile_id") % 41).alias("y")), 4), "select x >> (l - 4)::int as rx, y >> (l - 4)::int as ry, cast(count(*) as bigint) as uses from (select tile_id % 7 + 2 as l, tile_id % 37 as x, tile_id % 41 as y from pack_frames) where l >= 4 group by 1, 2")
register("films_compared", ("pack_frames",), lambda p: frames.compared(p, _other(p)), f""", {_OTHER}, a as (select frame, list_sort(list(tile_id)) as t, list_sort(list([tile_id, drape])) as d from pack_frames group by 1), b as (select frame, list_sort(list(tile_id)) as t, list_sort(list([tile_id, drape])) as d from other group by 1)
  select frame, case when a.t is null or b.t is null then 'missing' when a.t <> b.t then 'selection' when a.d <> b.d then 'drapes' else 'identical' end as verdict from a full join b using (frame)""")


def _eyes(p, name, lon="lon", lat="lat"):
    return p.select(C("place").alias(name), *[(c / 100).alias(n) for n, c in zip("xyz", geo.geodetic_to_ecef(C(lon), C(lat), C("height")))])


register("nearest_views", ("places",), lambda p: frames.nearest_view(_eyes(p, "frame"), _eyes(p, "ask", "lon2", "lat2"), 9000.0).select("ask", "frame", F.round("metres", 4).alias("metres")), f""", c as (select place, height, lon, lat, lon2, lat2, {geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat) * sin(lat)) as n, {geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat2) * sin(lat2)) as n2 from places),
  v as (select place as frame, (n + height) * cos(lat) * cos(lon) / 100 as x, (n + height) * cos(lat) * sin(lon) / 100 as y, (n * (1 - {geo.E2!r}::double) + height) * sin(lat) / 100 as z from c), a as (select place as ask, (n2 + height) * cos(lat2) * cos(lon2) / 100 as x, (n2 + height) * cos(lat2) * sin(lon2) / 100 as y, (n2 * (1 - {geo.E2!r}::double) + height) * sin(lat2) / 100 as z from c),
  d as (select ask, frame, sqrt(pow(a.x - v.x, 2) + pow(a.y - v.y, 2) + pow(a.z - v.z, 2)) as m from a, v) select ask, frame, round(m, 4) as metres from (select *, row_number() over (partition by ask order by m, frame) as k from d where m <= 9000) where k = 1""")
_LISTS = "b as (select need % 500 as tile, list(need % 7 order by need) as l from needs where need % 3 <> 0 group by 1), a as (select need % 500 as tile, list(case when need % 501 = 0 then 9 else need % 7 end order by need) as l from needs where need % 3 <> 0 and need % 500 <> 4 or need % 500 = 3 group by 1)"


def _needs(n, after):
    kept = n.where("need % 3 <> 0 and need % 500 <> 4 or need % 500 = 3") if after else n.where("need % 3 <> 0")
    return kept.select((C("need") % 500).alias("tile"), C("need").alias("nth"), (F.when(C("need") % 501 == 0, 9).otherwise(C("need") % 7) if after else C("need") % 7).cast("long").alias("entry"))


register("need_changes", ("needs",), lambda n: frames.need_changes(_needs(n, False), _needs(n, True)).withColumn("entries", F.array_join(F.transform("entries", lambda e: e.cast("string")), ",")), f", {_LISTS} select tile, case when a.l is null then 'left' when b.l is null then 'entered' else 'changed' end as change, coalesce(array_to_string(a.l, ','), '') as entries from b full join a using (tile) where a.l is distinct from b.l")
register("needs_applied", ("needs",), lambda n: frames.apply_changes(_needs(n, False), frames.need_changes(_needs(n, False), _needs(n, True))).groupBy("tile").agg(F.count("*").alias("n"), F.sum("entry").alias("total")), f", {_LISTS} select tile, len(l)::bigint as n, cast(list_sum(l) as bigint) as total from a")
register("todo", ("scores",), lambda s: frames.todo(s, s.where("input = 'click' and method = 'm1'"), "sample", 1, 3), "select sample from (select sample, row_number() over (order by sample) - 1 as nth from (select distinct sample from scores)) where nth % 3 = 1 and sample not in (select sample from scores where input = 'click' and method = 'm1')")
register("payload_summary", ("archive_entries",), frames.payload_summary, """, d as (select zone, digest, count(*) as n, max(bytes) as b, sum(bytes) as a from archive_entries group by 1, 2), t as (select zone, tile_id, count(distinct digest) as n from archive_entries group by 1, 2)
  select zone, e.*, t2.* from (select zone, cast(sum(n) as bigint) as entries, count(*) as payloads, cast(sum(b) as bigint) as distinct_bytes, cast(sum(a) as bigint) as bytes, cast(sum(n - 1) as bigint) as duplicates from d group by 1) e0 join (select zone, count(*) as tiles, count(*) filter (n = 1) as one, count(*) filter (n > 1) as several from t group by 1) t0 using (zone), lateral (select entries, payloads, distinct_bytes, bytes, duplicates) e, lateral (select tiles, one, several) t2""")
register("medians_of_medians", ("archive_entries",), lambda e: frames.medians_of_medians(e, "zone", ["archive"], "bytes"), "select zone, round(quantile_cont(m, 0.5), 6) as median, round(min(m), 6) as least, round(max(m), 6) as most, count(*) as groups from (select zone, archive, quantile_cont(bytes, 0.5) as m from archive_entries group by 1, 2) group by 1")

# Ground: a vector is a row of 64 heights
_HEIGHTS = "heights as (select tile as row, cell - 1 as col, v * 100 as h from cells where tile < 500)"
_PROBES = "probes as (select place as probe, place % 6700 / 100e0 - 1 as x, place * 31 % 50200 / 100e0 - 1 as y, height / 40e0 as z from places)"


def _heights(c):
    return c.where("tile < 500").select(C("tile").alias("row"), (C("cell") - 1).alias("col"), (C("v") * 100).alias("h"))


def _probes(p):
    return p.select(C("place").alias("probe"), (C("place") % 6700 / 100.0 - 1).alias("x"), (C("place") * 31 % 50200 / 100.0 - 1).alias("y"), (C("height") / 40.0).alias("z"))


_BILINEAR = """bil as (select probe, x, y, z, x between 0 and 63 and y between 0 and 499 as inside, least(floor(x), 62)::bigint as c0, least(floor(y), 498)::bigint as r0, x - c0 as fx, y - r0 as fy from probes),
  at_h as (select b.*, case when inside then coalesce((1 - fx) * (1 - fy) * h00.h + fx * (1 - fy) * h10.h + (1 - fx) * fy * h01.h + fx * fy * h11.h, 0) else 0 end as h from bil b left join heights h00 on h00.row = r0 and h00.col = c0 left join heights h10 on h10.row = r0 and h10.col = c0 + 1 left join heights h01 on h01.row = r0 + 1 and h01.col = c0 left join heights h11 on h11.row = r0 + 1 and h11.col = c0 + 1)"""
register("ground_heights", ("cells", "places"), lambda c, p: terrain.bilinear(_heights(c), _probes(p), 500, 64).select("probe", (F.round("h", 6) + 0.0).alias("h")), f", {_HEIGHTS}, {_PROBES}, {_BILINEAR} select probe, round(h, 6) + 0.0 as h from at_h")
register("ground_queries", ("cells", "places"), lambda c, p: terrain.ground_queries(_heights(c), _probes(p), 500, 64).select("probe", F.round("surface", 6).alias("surface"), "solid"), f", {_HEIGHTS}, {_PROBES}, {_BILINEAR} select probe, round(case when inside and h <= z then h end, 6) as surface, inside and z < h as solid from at_h")
register("ground_box_means", ("cells", "places"), lambda c, p: terrain.box_means(_heights(c), _probes(p).select(C("probe").alias("box"), "x", "y", (C("probe") % 9 / 2.0).alias("across"), (C("probe") % 5 * 1.0).alias("down"))).select("box", (F.round("mean", 6) + 0.0).alias("mean")), f""", {_HEIGHTS}, {_PROBES}, b as (select probe as box, x, y, greatest(probe % 9 / 2e0, 1) as w, greatest(probe % 5 * 1e0, 1) as d from probes),
  s as (select box, sum(greatest(least(x + w / 2, col + 0.5e0) - greatest(x - w / 2, col - 0.5e0), 0) * greatest(least(y + d / 2, row + 0.5e0) - greatest(y - d / 2, row - 0.5e0), 0) * h) as s from b, heights where col between x - w / 2 - 1 and x + w / 2 + 1 and row between y - d / 2 - 1 and y + d / 2 + 1 group by 1) select b.box, round(coalesce(s.s, 0) / (w * d), 6) + 0.0 as mean from b left join s using (box)""")


def _brushes(p):
    a, b = (C("x"), C("y"), C("z")), (C("x") + 3, C("y") + 2, C("z") + 5)
    low, high = terrain.brush_extent(F.when(C("probe") % 2 == 0, "ball").otherwise("box"), (C("x") + C("probe") % 7, C("y") + 1), a, b, F.lit(4.0))
    return p.select("probe", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


register("brush_extents", ("places",), lambda p: _brushes(_probes(p)), f", {_PROBES} select probe, round(case when probe % 2 = 0 then case when 15 - pow(probe % 7, 2) >= 0 then z - sqrt(15 - pow(probe % 7, 2)) end when probe % 7 <= 3 then z end, 6) as low, round(case when probe % 2 = 0 then case when 15 - pow(probe % 7, 2) >= 0 then z + sqrt(15 - pow(probe % 7, 2)) end when probe % 7 <= 3 then z + 5 end, 6) as high from probes")
register("tiles_over", ("rects",), lambda r: terrain.tiles_over(r.select("rect", *[F.degrees(b).alias(a) for a, b in zip(("x0", "y0", "x1", "y1"), ("west", "south", "east", "north"))]), 5, 64.0), "select rect, tx, unnest(range(floor(degrees(south) / 2)::bigint, floor(degrees(north) / 2)::bigint + 1)) as ty from (select *, unnest(range(floor(degrees(west) / 2)::bigint, floor(degrees(east) / 2)::bigint + 1)) as tx from rects)")
register("finest_heights", ("addresses", "eyes"), lambda t, e: terrain.finest_heights(t.where("grid = 'geographic'").select("level", "x", "y", F.when(C("x") % 10 == 0, F.lit(float("nan"))).otherwise((C("level") * 100 + C("x") % 7) * 1.0).alias("height"), C("n").alias("arrival")), e.select(C("eye").alias("probe"), "lon", "lat"), 19).select("probe", "height", C("level").cast("double").alias("level")),
         """, r as (select level, x, y, (level * 100 + x % 7) * 1e0 as height from addresses where grid = 'geographic' and x % 10 <> 0), a as (select eye as probe, lon, lat, unnest(range(0, 20)) as level from eyes), f as (select probe, r.level, r.height as top from a join r on r.level = a.level and r.x = least(floor((lon + 180) / 360 * 2 * pow(2e0, a.level)), 2 * pow(2e0, a.level) - 1)::bigint and r.y = least(floor((lat + 90) / 180 * pow(2e0, a.level)), pow(2e0, a.level) - 1)::bigint)
  select eye as probe, arg_max(top, level) as height, max(level)::double as level from eyes left join f on f.probe = eye group by 1""")


def _degrees(r, shift=0.0, grow=1.0):
    return r.select("rect", *[F.degrees(c).alias(c) for c in ("west", "south")], (F.degrees("west") + F.degrees(C("east") - C("west")) * grow + shift).alias("east"), (F.degrees("south") + F.degrees(C("north") - C("south")) * grow + shift).alias("north"))


register("covered_ground", ("rects",), lambda r: terrain.covered(_degrees(r, 0.0, 0.9), _degrees(r.where("rect % 3 = 0"), 2.0), 5.0), """, g as (select rect, degrees(west) as w, degrees(south) as s, degrees(west) + degrees(east - west) * 0.9e0 as e, degrees(south) + degrees(north - south) * 0.9e0 as n from rects), f as (select degrees(west) as w, degrees(south) as s, degrees(west) + degrees(east - west) + 2 as e, degrees(south) + degrees(north - south) + 2 as n from rects where rect % 3 = 0),
  p as (select rect, w as lon, s as lat from g union all select rect, e, s from g union all select rect, w, n from g union all select rect, e, n from g union all select rect, (w + e) / 2, (s + n) / 2 from g) select rect from p group by rect having bool_and(exists (select 1 from f where lon between f.w and f.e and lat between f.s and f.n))""")
register("seen_at_night", ("places",), lambda p: terrain.seen_at_night(p.where("place % 10 = 0").select("lon", "lat", (C("height") * 100).alias("height")), 4), f""", t as (select x, y, x * (1e0 / 32) * {2 * math.pi!r}::double - pi() as w, (x + 1) * (1e0 / 32) * {2 * math.pi!r}::double - pi() as e, (0.5e0 - y * (1e0 / 16)) * pi() as n, (0.5e0 - (y + 1) * (1e0 / 16)) * pi() as s from (select unnest(range(0, 32)) as x), (select unnest(range(0, 16)) as y)),
  j as (select t.*, lon, lat, height * 100 as up, least(greatest(lat, s), n) as la, ((w - lon) - {2 * math.pi!r}::double * floor((w - lon) / {2 * math.pi!r}::double)) as dw, ((e - lon) - {2 * math.pi!r}::double * floor((e - lon) / {2 * math.pi!r}::double)) as de, case when lon between w and e then lon when least(dw, {2 * math.pi!r}::double - dw) <= least(de, {2 * math.pi!r}::double - de) then w else e end as lo from t, places where place % 10 = 0)
  select distinct x, y from j where acos(least(1, greatest(-1, sin(lat) * sin(la) + cos(lat) * cos(la) * cos(lo - lon)))) <= acos({geo.A} / ({geo.A} + greatest(up, 0))) + 0.05e0""")

# Trees: the geographic addresses with all their ancestors
_VIEWS = [(2.35, 48.85, 40_000.0), (-70.0, -33.0, 900_000.0)]
_TREE = "tree as (select distinct level - r as level, x >> r::int as x, y >> r::int as y from (select level, x, y, unnest(range(0, level + 1)) as r from addresses where grid = 'geographic' and level <= 12))"


def _tree(t):
    return tree.closed(t.where("grid = 'geographic' and level <= 12").select("level", "x", "y"))


def _sse(i):
    lon, lat, up = _VIEWS[i]
    d = f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(least(greatest({lat}e0, s), n)) - radians({lat}e0)) / 2), 2) + cos(radians({lat}e0)) * cos(radians(least(greatest({lat}e0, s), n))) * pow(sin(radians(least(greatest({lon}e0, w), e) - {lon}e0) / 2), 2))))"
    return f"{d} as g{i}, {grid.level_zero_error()!r}::double / pow(2e0, level) * 960 / (greatest(sqrt(g{i} * g{i} + {up * up!r}::double), 1e-7) * 1.1547e0) as e{i}, g{i} <= {(2 * geo.MEAN_RADIUS * up + up * up) ** 0.5 + (2 * geo.MEAN_RADIUS * 4800.0) ** 0.5!r}::double as s{i}"


_LOOK = f"""{_TREE}, look as (select *, greatest(e0, e1) as sse, s0 or s1 as seen from (select *, {_sse(0)}, {_sse(1)} from (select *, -180 + x * (180 / pow(2e0, level)) as w, -90 + y * (180 / pow(2e0, level)) as s, -180 + x * (180 / pow(2e0, level)) + 180 / pow(2e0, level) as e, -90 + y * (180 / pow(2e0, level)) + 180 / pow(2e0, level) as n from tree))),
  cut as (select l.*, exists (select 1 from tree c where c.level = l.level + 1 and c.x >> 1 = l.x and c.y >> 1 = l.y) and sse > {{limit}} as cuts from look l), ends as (select * from cut where not seen or not cuts), chosen as (select level, x, y, sse from ends e where seen and not exists (select 1 from ends a where a.level < e.level and a.x = e.x >> (e.level - a.level)::int and a.y = e.y >> (e.level - a.level)::int))"""
register("chosen_tiles", ("addresses",), lambda t: tree.chosen(_tree(t), _VIEWS, 8.0).select("level", "x", "y", F.round("sse", 5).alias("sse")), f", {_LOOK.format(limit='8')} select level, x, y, round(sse, 5) as sse from chosen")
register("chosen_again", ("addresses",), lambda t: tree.chosen(_tree(t), _VIEWS, 8.0, _tree(t).where("(x + y) % 2 = 0"), 0.25).select("level", "x", "y", F.round("sse", 5).alias("sse")), f", {_LOOK.format(limit='case when (l.x + l.y) % 2 = 0 then 8 * 1.25e0 else 8 / 1.25e0 end')} select level, x, y, round(sse, 5) as sse from chosen")
_DRAWN = f"""{_LOOK.format(limit='8')}, res as (select * from tree where (x * 7 + y) % 3 <> 0), mis as (select * from chosen c where not exists (select 1 from res r where r.level = c.level and r.x = c.x and r.y = c.y)), hold as (select distinct r.level, r.x, r.y from mis m, res r where r.level < m.level and r.x = m.x >> (m.level - r.level)::int and r.y = m.y >> (m.level - r.level)::int
  qualify row_number() over (partition by m.level, m.x, m.y order by r.level desc) = 1), shown as (select level, x, y from chosen semi join res using (level, x, y) union select level, x, y from hold)"""
register("drawn_tiles", ("addresses",), lambda t: tree.drawn(tree.chosen(_tree(t), _VIEWS, 8.0), _tree(t).where("(x * 7 + y) % 3 <> 0"))[0], f", {_DRAWN} select * from shown s where not exists (select 1 from hold h where h.level < s.level and h.x = s.x >> (s.level - h.level)::int and h.y = s.y >> (s.level - h.level)::int)")
register("tile_requests", ("addresses",), lambda t: tree.drawn(tree.chosen(_tree(t), _VIEWS, 8.0), _tree(t).where("(x * 7 + y) % 3 <> 0"))[1].select("level", "x", "y", F.round("sse", 5).alias("sse"), C("nth").cast("long").alias("nth")), f", {_DRAWN} select level, x, y, round(sse, 5) as sse, row_number() over (order by sse desc, level, x, y) as nth from mis")
register("best_drapes", ("addresses",), lambda t: tree.best_drapes(t.where("grid = 'geographic'").select("level", "x", "y"), _tree(t).where("(x + y) % 4 = 0").withColumn("drape", C("x") * 10 + C("y")), 3), f", {_TREE}, d as (select *, x * 10 + y as drape from tree where (x + y) % 4 = 0) select t.level, t.x, t.y, arg_max(d.drape, d.level) as drape, max(d.level) as from_level from addresses t join d on d.level between t.level - 3 and t.level and d.x = t.x >> (t.level - d.level)::int and d.y = t.y >> (t.level - d.level)::int where grid = 'geographic' group by 1, 2, 3")

# Images: the first 48 numbers of two vectors as 4 x 4 colours
_PAIR = "img as (select tile, list(least(1e0, greatest(0e0, (v + 1) / 2))::float order by cell) as a from cells where cell <= 48 group by 1), pair as (select p.tile, p.a, q.a as b from img p join img q on q.tile = p.tile + 1)"


def _pairs(c):
    v = F.least(F.greatest((C("v") + 1) / 2, F.lit(0.0)), F.lit(1.0)).cast("float")
    img = c.where("cell <= 48").groupBy("tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", v.alias("v")))), lambda s: s["v"]).alias("a"))
    return img.join(img.select((C("tile") - 1).alias("tile"), C("a").alias("b")), "tile")


_LUMA = "list_transform(range(0, 16), lambda i: (16 + 65.481e0 * {v}[3 * i + 1] + 128.553e0 * {v}[3 * i + 2] + 24.966e0 * {v}[3 * i + 3]) / 255)"
register("image_psnr", ("cells",), lambda c: images.measured(_pairs(c), ["tile"], 4, {"psnr": images.psnr_y, "texture": lambda a, b: images.texture(a)}).select("tile", F.round("psnr", 3).alias("psnr"), F.round("texture", 4).alias("texture")), f""", {_PAIR}, l as (select tile, a, {_LUMA.format(v='a')} as la, {_LUMA.format(v='b')} as lb from pair)
  select tile, round(-10 * log10(greatest(list_avg(list_transform(range(1, 17), lambda i: pow(la[i] - lb[i], 2))), 1e-12)), 3) as psnr, round(list_avg(list_transform(range(0, 12), lambda i: abs(0.299e0 * (a[3 * i + 13] - a[3 * i + 1]) + 0.587e0 * (a[3 * i + 14] - a[3 * i + 2]) + 0.114e0 * (a[3 * i + 15] - a[3 * i + 3])))), 4) as texture from l""")
register("image_measures", ("cells",), lambda c: images.measured(_pairs(c), ["tile"], 4, {"delta_e": lambda a, b: images.delta_e(a, b, 1.0), "cast": images.colour_cast, "structure": lambda a, b: images.structure(a, b, 1.0)}).select("tile", *[F.round(m, 4).alias(m) for m in ("delta_e", "cast", "structure")]), None)
