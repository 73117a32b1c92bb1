"""Queries of addresses, zones, tiling schemes and geodesy."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.functions import geodesy as geo
from meridian.functions import grid as g
from meridian.plans.catalogue import Columns, register

C = F.col
TAU = repr(2 * math.pi) + "::double"
ADDRESS = Columns(lambda: (C("grid"), C("level"), C("x"), C("y")))
KEY = ("grid", "level", "x", "y")


def named(pairs, digits=None):
    return [(F.round(c, digits) + 0.0 if digits is not None else c).alias(n) for n, c in pairs.items()]


def rounded(cols, digits):
    return ", ".join(f"round({expr}, {digits}) + 0.0 as {name}" for name, expr in cols.items())


_SIZE = "cast(pow(2e0, level) as bigint) as h, case when grid = 'geographic' then 2 * h else h end as w"
_LEVEL_BASE = "((cast(pow(4e0, {z}) as hugeint) - 1) // 3)"
_HILBERT = """list_reduce(list_concat([[0::hugeint, x::hugeint, y::hugeint]], list_transform(range(z::int - 1, -1, -1), lambda i: [(1::hugeint << i::int), 0::hugeint, 0::hugeint])),
  lambda a, b: [a[1] + b[1] * b[1] * xor(case when a[2] & b[1] > 0 then 3 else 0 end::bigint, case when a[3] & b[1] > 0 then 1 else 0 end::bigint),
   case when a[3] & b[1] > 0 then a[2] & (b[1] - 1) when a[2] & b[1] > 0 then b[1] - 1 - (a[3] & (b[1] - 1)) else a[3] & (b[1] - 1) end,
   case when a[3] & b[1] > 0 then a[3] & (b[1] - 1) when a[2] & b[1] > 0 then b[1] - 1 - (a[2] & (b[1] - 1)) else a[2] & (b[1] - 1) end])[1]"""
_IDS = f"ids as (select *, level + (grid = 'geographic')::bigint as z, cast({_LEVEL_BASE.format(z='z')} + {_HILBERT} as bigint) as tile_id from addresses)"

register("grid_size", ("addresses",), lambda t: t.select(*KEY, *named(dict(zip(("w", "h"), g.grid_size(C("grid"), C("level"))))), g.in_grid(*ADDRESS).alias("inside"), g.in_grid(C("grid"), C("level"), C("x") + C("level") * 1000, C("y")).alias("moved_inside"), g.archive_level(C("grid"), C("level")).alias("z"), g.level_base(C("level")).alias("base")),
         f"select grid, level, x, y, w, h, true as inside, x + level * 1000 < w as moved_inside, level + (grid = 'geographic')::bigint as z, cast({_LEVEL_BASE.format(z='level')} as bigint) as base from (select *, {_SIZE} from addresses)")
register("tile_ids", ("addresses",), lambda t: t.select(*KEY, g.to_id(*ADDRESS).alias("tile_id")), f", {_IDS} select grid, level, x, y, tile_id from ids")
register("tile_from_id", ("addresses",), lambda t: t.select("grid", g.to_id(*ADDRESS).alias("tile_id")).select("grid", "tile_id", g.from_id(C("grid"), C("tile_id")).alias("at")).select("grid", "tile_id", "at.*"), f", {_IDS} select grid, tile_id, level, x, y from ids")
register("zones", ("addresses",), lambda t: t.withColumn("zone", g.zone_of(6, C("level"), C("x"), C("y"))).select(*KEY, "zone", g.zone_prefix(C("grid"), 6, C("zone")).alias("prefix")),
         "select grid, level, x, y, case when level < 6 then 'top' else (x >> (level - 6)::int)::varchar || '/' || (y >> (level - 6)::int)::varchar end as zone, case when zone = 'top' then grid || '/top' else grid || '/zones/z6/' || zone end as prefix from addresses")
register("zone_id_ranges", ("addresses",), lambda t: t.where("level = 6").select("grid", "x", "y", F.explode(g.zone_id_ranges(C("grid"), 6, C("x"), C("y"))).alias("r")).where("r.z <= 24").select("grid", "x", "y", "r.*"),
         f""", {_IDS}, c as (select grid, x, y, z as zone_z, tile_id - cast({_LEVEL_BASE.format(z='z')} as bigint) as along from ids where level = 6), r as (select *, unnest(range(zone_z, 25)) as z from c)
  select grid, x, y, z, cast({_LEVEL_BASE.format(z='z')} + along * cast(pow(4e0, z - zone_z) as hugeint) as bigint) as "first", cast({_LEVEL_BASE.format(z='z')} + (along + 1) * cast(pow(4e0, z - zone_z) as hugeint) - 1 as bigint) as "last" from r""")
register("zone_neighbours", ("addresses",), lambda t: t.where("level <= 6").select(*KEY, F.explode(g.neighbours(*ADDRESS)).alias("c")).select(*KEY, C("c.x").alias("nx"), C("c.y").alias("ny")),
         f"""select distinct grid, level, x, y, ((x + dx) % w + w) % w as nx, y + dy as ny from (select *, {_SIZE} from addresses where level <= 6), (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy) where (dx <> 0 or dy <> 0) and y + dy between 0 and h - 1""")
register("epochs", ("archive_entries",), lambda e: e.select("archive", "epoch").distinct().withColumn("days", F.when(F.length("archive") % 2 == 0, F.lit(None)).otherwise(F.lit(400))).select("archive", "epoch", g.epoch(F.to_date("epoch", "yyyyMM"), C("days")).alias("named"), F.datediff(g.expires_at(C("epoch"), F.lit(400)), F.lit("1995-01-01").cast("date")).cast("long").alias("expires"), g.is_expired(C("epoch"), F.lit(400), F.lit("1997-01-01").cast("date")).alias("expired"), g.is_expired(F.lit("d"), C("days"), F.lit("1997-01-01").cast("date")).alias("durable_expired")),
         """select distinct archive, epoch, case when length(archive) % 2 = 0 then 'd' else epoch end as named, date_diff('day', date '1995-01-01', cast(strptime(epoch || '01', '%Y%m%d') + interval 1 month as date)) + 400 as expires,
  date_diff('day', cast(strptime(epoch || '01', '%Y%m%d') + interval 1 month as date), date '1997-01-01') > 400 as expired, false as durable_expired from archive_entries""")
register("stored_bounds", ("addresses",), lambda t: t.select(*KEY, *named(dict(zip(("west", "south", "east", "north"), g.bounds_degrees(*ADDRESS))), 7), F.round(g.width_m(*ADDRESS), 3).alias("width")),
         f"""select grid, level, x, y, {rounded({'west': 'w', 'south': 's', 'east': 'e', 'north': 'n'}, 7)}, round(greatest((e - w) * m * cos(radians((s + n) / 2)), (n - s) * m), 3) as width from
  (select grid, level, x, y, pow(2e0, level) as k, {g.M_PER_DEG!r}::double as m, case when grid = 'geographic' then -180 + x * (180 / k) else x / k * 360 - 180 end as w, case when grid = 'geographic' then -180 + x * (180 / k) + 180 / k else (x + 1) / k * 360 - 180 end as e,
  case when grid = 'geographic' then -90 + y * (180 / k) else degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / k)))) end as s, case when grid = 'geographic' then -90 + y * (180 / k) + 180 / k else degrees(atan(sinh(pi() * (1 - 2 * y / k)))) end as n from addresses)""")

_NORM = "least(1e0, greatest(0e0, ({lon} + pi()) / " + TAU + ")) as {u}, least(1e0, greatest(0e0, case when grid = 'geographic' then 0.5e0 - {lat} / pi() else 0.5e0 - ln(tan(pi() / 4 + least(" + repr(g.MERCATOR_MAX_LAT) + "::double, greatest(-" + repr(g.MERCATOR_MAX_LAT) + "::double, {lat})) / 2)) / " + TAU + " end)) as {v}"
register("normalized_places", ("rects",), lambda r: r.select("rect", "grid", *named(dict(zip(("u", "v"), g.to_normalized(C("grid"), C("west"), C("south")))), 9)), f"select rect, grid, round(u, 9) + 0.0 as u, round(v, 9) + 0.0 as v from (select *, {_NORM.format(lon='west', lat='south', u='u', v='v')} from rects)")
register("places_from_normalized", ("addresses",), lambda t: t.select(*KEY, *named(dict(zip(("x0", "y0", "x1", "y1"), g.tile_extent(*ADDRESS))), 10), *named(dict(zip(("west", "south", "east", "north"), g.tile_rect(*ADDRESS))), 9)),
         f"""select grid, level, x, y, round(u0, 10) + 0.0 as x0, round(v0, 10) + 0.0 as y0, round(u1, 10) + 0.0 as x1, round(v1, 10) + 0.0 as y1, round(u0 * {TAU} - pi(), 9) + 0.0 as west, round(u1 * {TAU} - pi(), 9) + 0.0 as east,
  round(case when grid = 'geographic' then (0.5e0 - v1) * pi() else 2 * atan(exp((0.5e0 - v1) * {TAU})) - pi() / 2 end, 9) + 0.0 as south, round(case when grid = 'geographic' then (0.5e0 - v0) * pi() else 2 * atan(exp((0.5e0 - v0) * {TAU})) - pi() / 2 end, 9) + 0.0 as north from
  (select grid, level, x, y, x * (1e0 / w) as u0, y * (1e0 / h) as v0, (x + 1) * (1e0 / w) as u1, (y + 1) * (1e0 / h) as v1 from (select *, {_SIZE} from addresses))""")
register("terrain_rects", ("addresses",), lambda t: t.where("grid = 'geographic'").select("level", "x", "y", *named(dict(zip(("west", "south", "east", "north"), g.terrain_rect(C("level"), C("x"), C("y")))), 9), F.round(g.level_error(C("level")), 6).alias("error")),
         f"""select level, x, y, round(-pi() + x * tw, 9) + 0.0 as west, round(-pi() / 2 + y * th, 9) + 0.0 as south, round(-pi() + x * tw + tw, 9) + 0.0 as east, round(-pi() / 2 + y * th + th, 9) + 0.0 as north, round({geo.A} * 2 * pi() * 0.25e0 / (65 * 2) / k, 6) as error
  from (select *, pow(2e0, level) as k, 2 * pi() / (2 * k) as tw, pi() / k as th from addresses where grid = 'geographic')""")
register("children", ("addresses",), lambda t: t.where("level <= 4").select(*KEY, F.explode(F.array(*[F.struct((C("x") * 2 + dx).alias("cx"), (C("y") * 2 + dy).alias("cy")) for dy in (0, 1) for dx in (0, 1)])).alias("c")).select("grid", "level", "x", "y", (C("level") + 1).alias("c_level"), "c.*", F.shiftright("c.cx", 1).alias("px"), F.shiftright("c.cy", 1).alias("py"), (C("c.cx") % 2).alias("qx"), (C("c.cy") % 2).alias("qy")),
         "select grid, level, x, y, level + 1 as c_level, 2 * x + dx as cx, 2 * y + dy as cy, x as px, y as py, cast(dx as bigint) as qx, cast(dy as bigint) as qy from addresses, (values (0), (1)) a(dx), (values (0), (1)) b(dy) where level <= 4")

_RANGE = f"{_NORM.format(lon='west', lat='north', u='u0', v='v0')}, {_NORM.format(lon='east', lat='south', u='u1', v='v1')}"
_COVER = "cast(pow(2e0, {level}) as bigint) as h, case when grid = 'geographic' then 2 * h else h end as w, least(cast(floor(u0 * w) as bigint), w - 1) as x0, least(cast(floor(greatest(u0, u1) * w) as bigint), w - 1) as x1, least(cast(floor(v0 * h) as bigint), h - 1) as y0, least(cast(floor(greatest(v0, v1) * h) as bigint), h - 1) as y1"
_RECT = Columns(lambda: (C("west"), C("south"), C("east"), C("north")))
register("levels_for", ("rects",), lambda r: r.select("rect", "grid", g.level_for_rectangle(C("grid"), C("east") - C("west"), C("height") * 64).alias("by_width"), g.level_for_spacing(C("grid"), C("height") * 3 + 0.7, C("south")).alias("by_spacing")),
         f"""select rect, grid, cast(least(19, greatest(0, ceil(log2(greatest(height * 64, 1) / (greatest(greatest(east - west, 0) / {TAU}, 1e-12) * case when grid = 'geographic' then 2 else 1 end * 256))))) as bigint) as by_width,
  cast(least(19, greatest(0, round(log2({geo.A * 2 * math.pi / 256!r}::double * case when grid = 'geographic' then 0.5e0 else cos(south) end / greatest(height * 3 + 0.7e0, 1e-3))))) as bigint) as by_spacing from rects""")
register("tiles_in_rects", ("rects",), lambda r: r.select("rect", "grid", *named(dict(zip(("x0", "x1", "y0", "y1"), g.tile_range(C("grid"), F.lit(7).cast("long"), *_RECT))))).select("rect", "grid", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("rect", "grid", F.explode(F.sequence("x0", "x1")).alias("x"), "y"),
         f"select rect, grid, x, unnest(range(y0, y1 + 1)) as y from (select rect, grid, y0, y1, unnest(range(x0, x1 + 1)) as x from (select *, {_RANGE}, {_COVER.format(level=7)} from rects))")


def _containing(r):
    """The deepest level at which one tile holds the rectangle and does so at every level above."""
    levels = r.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("level"))
    at = levels.select("rect", "grid", "level", *named(dict(zip(("x0", "x1", "y0", "y1"), g.tile_range(C("grid"), C("level"), *_RECT)))))
    one = (C("x0") == C("x1")) & (C("y0") == C("y1"))
    best = at.withColumn("one", one).groupBy("rect", "grid").agg(F.coalesce(F.min(F.when(~C("one"), C("level"))), F.lit(20).cast("long")).alias("first"), F.collect_list(F.struct("level", "x0", "y0")).alias("a"))
    chosen = F.get(F.filter("a", lambda v: v["level"] == C("first") - 1), F.lit(0))
    return best.select("rect", "grid", F.coalesce(chosen["level"], F.lit(0).cast("long")).alias("level"), F.coalesce(chosen["x0"], F.lit(0).cast("long")).alias("x"), F.coalesce(chosen["y0"], F.lit(0).cast("long")).alias("y"))


register("containing_tile", ("rects",), _containing,
         f""", a as (select *, unnest(range(0, 20)) as level from (select *, {_RANGE} from rects)), b as (select *, {_COVER.format(level='level')} from a), f as (select rect, coalesce(min(level) filter (x0 <> x1 or y0 <> y1), 20) as "first" from b group by 1)
  select f.rect, r.grid, coalesce(b.level, 0) as level, coalesce(b.x0, 0) as x, coalesce(b.y0, 0) as y from f join rects r using (rect) left join b on b.rect = f.rect and b.level = f."first" - 1""")


def _mosaic(r, most: int = 16):
    """The finest level, from the one wanted back to 0, whose tiles over the rectangle are ``most`` at most."""
    wanted = r.withColumn("wanted", g.level_for_rectangle(C("grid"), C("east") - C("west"), C("height") * 64))
    fits = F.filter(F.transform(g.mosaic_levels(C("wanted")), lambda v: F.struct(v.alias("level"), *named(dict(zip(("x0", "x1", "y0", "y1"), g.tile_range(C("grid"), v, *_RECT)))))), lambda s: ((s["x1"] - s["x0"] + 1) * (s["y1"] - s["y0"] + 1) <= most) | (s["level"] == 0))
    at = wanted.withColumn("m", fits[0])
    w, h = g.tiles_at(C("grid"), C("m.level"))
    return at.select("rect", "grid", "m.level", "m.x0", "m.y0", (C("m.x1") - C("m.x0") + 1).alias("cols"), (C("m.y1") - C("m.y0") + 1).alias("rows"), F.round(C("m.x0") / w, 9).alias("from_x"), F.round((C("m.y1") + 1) / h, 9).alias("to_y"))


register("mosaics", ("rects",), _mosaic,
         f""", a as (select *, cast(least(19, greatest(0, ceil(log2(greatest(height * 64, 1) / (greatest(greatest(east - west, 0) / {TAU}, 1e-12) * case when grid = 'geographic' then 2 else 1 end * 256))))) as bigint) as wanted, {_RANGE} from rects),
  b as (select *, {_COVER.format(level='level')} from (select *, unnest(range(0, wanted + 1)) as level from a)), c as (select *, row_number() over (partition by rect order by level desc) as k from b where (x1 - x0 + 1) * (y1 - y0 + 1) <= 16 or level = 0)
  select rect, grid, level, x0, y0, x1 - x0 + 1 as cols, y1 - y0 + 1 as rows, round(x0 / w, 9) as from_x, round((y1 + 1) / h, 9) as to_y from c where k = 1""")


def _coverage(r, level: int = 7):
    """Of each tile over a rectangle, its share of it along x and y; inner edges are the same number on both sides, the outer ones reach a little beyond."""
    lv = F.lit(level).cast("long")
    d = r.select("*", *named(dict(zip(("x0", "x1", "y0", "y1"), g.tile_range(C("grid"), lv, *_RECT))))).select("*", F.explode(F.sequence("x0", "x1")).alias("x")).select("*", F.explode(F.sequence("y0", "y1")).alias("y"))
    wide, high = (F.greatest(C(b) - C(a), F.lit(1e-15)) for a, b in (("west", "east"), ("south", "north")))

    def edge(x, y, side):
        w, s, e, n = g.tile_rect(C("grid"), lv, x, y)
        return geo.clamp((e - C("west")) / wide if side == "x" else (C("north") - s) / high, 0, 1)

    reach = g.EDGE_REACH
    left = F.when(C("x") == C("x0"), -reach).otherwise(edge(C("x") - 1, C("y0"), "x"))
    right = F.when(C("x") == C("x1"), 1 + reach).otherwise(edge(C("x"), C("y0"), "x"))
    top = F.when(C("y") == C("y0"), -reach).otherwise(edge(C("x0"), C("y") - 1, "y"))
    low = F.when(C("y") == C("y1"), 1 + reach).otherwise(edge(C("x0"), C("y"), "y"))
    return d.select("rect", "grid", "x", "y", *named({n: c + 1.7e-10 for n, c in {"left": left, "top": top, "right": right, "low": low}.items()}, 7))  # no share lies on a rounding border


_LAT = f"case when grid = 'geographic' then (0.5e0 - ({{y}}) / (h * 1e0)) * pi() else 2 * atan(exp((0.5e0 - ({{y}}) / (h * 1e0)) * {TAU})) - pi() / 2 end"
register("mosaic_coverage", ("rects",), _coverage,
         f""", a as (select *, {_RANGE}, {_COVER.format(level=7)} from rects), b as (select *, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from a))
  select rect, grid, x, y, round(case when x = x0 then -1e-4 else least(1e0, greatest(0e0, (x / (w * 1e0) * {TAU} - pi() - west) / greatest(east - west, 1e-15))) end + 1.7e-10, 7) + 0.0 as "left", round(case when x = x1 then 1 + 1e-4 else least(1e0, greatest(0e0, ((x + 1) / (w * 1e0) * {TAU} - pi() - west) / greatest(east - west, 1e-15))) end + 1.7e-10, 7) + 0.0 as "right",
  round(case when y = y0 then -1e-4 else least(1e0, greatest(0e0, (north - ({_LAT.format(y='y')})) / greatest(north - south, 1e-15))) end + 1.7e-10, 7) + 0.0 as top, round(case when y = y1 then 1 + 1e-4 else least(1e0, greatest(0e0, (north - ({_LAT.format(y='y + 1')})) / greatest(north - south, 1e-15))) end + 1.7e-10, 7) + 0.0 as low from b""")

# Geodesy
_ECEF = f"{geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat) * sin(lat)) as n, (n + height) * cos(lat) * cos(lon) as px, (n + height) * cos(lat) * sin(lon) as py, (n * (1 - {geo.E2!r}::double) + height) * sin(lat) as pz"


def _ecef(p, lon="lon", lat="lat", height="height", names=("px", "py", "pz")):
    return p.select("*", *[c.alias(n) for n, c in zip(names, geo.geodetic_to_ecef(C(lon), C(lat), C(height)))])


register("ecef_round_trip", ("places",), lambda p: geo.with_geodetic(_ecef(p), "px", "py", "pz", ("lon_", "lat_", "height_")).select("place", *named({"lon_": C("lon_"), "lat_": C("lat_")}, 9), *named({"height_": C("height_")}, 4)),
         "select place, round(lon, 9) + 0.0 as lon_, round(lat, 9) + 0.0 as lat_, round(height, 4) + 0.0 as height_ from places")
register("enu_frames", ("places",), lambda p: p.select("place", *[(F.round(c, 9) + 0.0).alias(f"{a}{i}") for a, v in zip("enu", geo.enu_frame(C("lon"), C("lat"))) for i, c in zip("xyz", v)]),
         "select place, " + rounded({"ex": "-sin(lon)", "ey": "cos(lon)", "ez": "0e0", "nx": "-sin(lat) * cos(lon)", "ny": "-sin(lat) * sin(lon)", "nz": "cos(lat)", "ux": "cos(lat) * cos(lon)", "uy": "cos(lat) * sin(lon)", "uz": "sin(lat)"}, 9) + " from places")
register("great_circles", ("places",), lambda p: p.withColumn("d", geo.arc(C("lon"), C("lat"), C("lon2"), C("lat2"))).select("place", F.round("d", 8).alias("d"), *named(dict(zip(("at_lon", "at_lat"), geo.along(C("lon"), C("lat"), C("lon2"), C("lat2"), C("d"), F.lit(0.25)))), 6), F.round(geo.turn_between(C("lon"), C("lon2")), 8).alias("turn")),
         f"""select place, round(d, 8) as d, round(atan2(y, x), 6) + 0.0 as at_lon, round(atan2(z, sqrt(x * x + y * y)), 6) + 0.0 as at_lat, round(((lon2 - lon + pi()) - {TAU} * floor((lon2 - lon + pi()) / {TAU})) - pi(), 8) as turn from (select *, acos(least(1, greatest(-1, sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon2 - lon)))) as d,
  sin(0.75e0 * d) / sin(d) as sa, sin(0.25e0 * d) / sin(d) as sb, sa * cos(lat) * cos(lon) + sb * cos(lat2) * cos(lon2) as x, sa * cos(lat) * sin(lon) + sb * cos(lat2) * sin(lon2) as y, sa * sin(lat) + sb * sin(lat2) as z from places)""")
_DIRECTION = Columns(lambda: (F.cos(C("lon2")) * F.cos(C("lat2")), F.sin(C("lon2")) * F.cos(C("lat2")), F.sin(C("lat2"))))
_DIR_SQL = "cos(lon2) * cos(lat2) as dx, sin(lon2) * cos(lat2) as dy, sin(lat2) as dz"
_FRAME_SQL = "-sin(lon) as ex, cos(lon) as ey, -sin(lat) * cos(lon) as nx, -sin(lat) * sin(lon) as ny, cos(lat) as nz, cos(lat) * cos(lon) as ux, cos(lat) * sin(lon) as uy, sin(lat) as uz"
register("camera_angles", ("places",), lambda p: p.select("place", (F.round(geo.heading(C("lon"), C("lat"), _DIRECTION, (F.lit(0.0), F.lit(0.0), F.lit(1.0))), 6) % 6.283185).alias("heading"), F.round(geo.pitch(C("lon"), C("lat"), _DIRECTION), 8).alias("pitch")),
         f"select place, round(a - {TAU} * floor(a / {TAU}), 6) % 6.283185e0 as heading, round(asin(least(1, greatest(-1, -(dx * ux + dy * uy + dz * uz)))), 8) as pitch from (select *, {_DIR_SQL}, {_FRAME_SQL}, dx * ux + dy * uy + dz * uz as du, atan2((dx - ux * du) * ex + (dy - uy * du) * ey, (dx - ux * du) * nx + (dy - uy * du) * ny + (dz - uz * du) * nz) as a from places)")
_PXYZ = Columns(lambda: (C("px"), C("py"), C("pz")))
register("bearings", ("places",), lambda p: _ecef(_ecef(p), "lon2", "lat2", "height", ("qx", "qy", "qz")).select("place", F.round(geo.bearing(C("lon"), C("lat"), _PXYZ, (C("qx"), C("qy"), C("qz"))), 7).alias("bearing"), *named(dict(zip(("lx", "ly", "lz"), geo.leash((C("qx"), C("qy"), C("qz")), _PXYZ, C("height") * 1000))), 3), *named(dict(zip(("fx", "fy", "fz"), geo.follow_camera(_PXYZ, C("lon"), C("lat"), C("lon2"), F.abs(C("lat2")), C("height") + 500))), 3)),
         f"""select place, round(b - {TAU} * floor(b / {TAU}), 7) as bearing, round(px + tx * k, 3) + 0.0 as lx, round(py + ty * k, 3) + 0.0 as ly, round(pz + tz * k, 3) + 0.0 as lz, round(px - (nx * cos(lon2) + ex * sin(lon2)) * cos(abs(lat2)) * (height + 500) + ux * sin(abs(lat2)) * (height + 500), 3) + 0.0 as fx,
  round(py - (ny * cos(lon2) + ey * sin(lon2)) * cos(abs(lat2)) * (height + 500) + uy * sin(abs(lat2)) * (height + 500), 3) + 0.0 as fy, round(pz - nz * cos(lon2) * cos(abs(lat2)) * (height + 500) + uz * sin(abs(lat2)) * (height + 500), 3) + 0.0 as fz from
  (select *, {_ECEF}, {geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat2) * sin(lat2)) as n2, (n2 + height) * cos(lat2) * cos(lon2) - px as tx, (n2 + height) * cos(lat2) * sin(lon2) - py as ty, (n2 * (1 - {geo.E2!r}::double) + height) * sin(lat2) - pz as tz, {_FRAME_SQL},
  atan2(tx * ex + ty * ey, tx * nx + ty * ny + tz * nz) as b, sqrt(tx * tx + ty * ty + tz * tz) as size, greatest(height * 1000, 0) as held, case when size > held then held / size else 1 end as k from places)""")


def _rays(p):
    eye = _ecef(p.withColumn("up", C("height") + 10_000), "lon", "lat", "up")
    t = geo.ray_ellipsoid(_PXYZ, tuple(-c for c in _DIRECTION))
    return eye.select("place", F.round(t, 2).alias("distance"), geo.hits_globe(_PXYZ, tuple(-c for c in _DIRECTION), 1000.0).alias("hits"), geo.hides((F.lit(0.0),) * 3, F.lit(6_300_000.0), tuple(c * 6_400_000 for c in _DIRECTION), F.lit(20_000.0), _PXYZ).alias("hidden"))


_RAY = """{p}x / {a} as {q}ox, {p}y / {a} as {q}oy, {p}z / {b} as {q}oz, -dx / {a} as {q}dx, -dy / {a} as {q}dy, -dz / {b} as {q}dz, {q}dx * {q}dx + {q}dy * {q}dy + {q}dz * {q}dz as {q}a, 2 * ({q}ox * {q}dx + {q}oy * {q}dy + {q}oz * {q}dz) as {q}b, {q}ox * {q}ox + {q}oy * {q}oy + {q}oz * {q}oz - 1 as {q}c, {q}b * {q}b - 4 * {q}a * {q}c as {q}disc"""
register("rays", ("places",), _rays,
         f"""select place, round(case when edisc >= 0 then case when (-eb - sqrt(edisc)) > 0 then (-eb - sqrt(edisc)) / (2 * ea) when (-eb + sqrt(edisc)) > 0 then (-eb + sqrt(edisc)) / (2 * ea) end end, 2) as distance, coalesce(idisc >= 0 and (-ib - sqrt(greatest(idisc, 0))) > 0, false) as hits,
  horizon > 0 and depth > horizon and depth * depth > horizon * far as hidden from (select *, {_ECEF.replace('height', '(height + 10000)')}, {_DIR_SQL}, {_RAY.format(p='p', q='e', a=geo.A, b=repr(geo.B))}, {_RAY.format(p='p', q='i', a=geo.A - 1000, b=repr(geo.B - 1000))},
  px * px + py * py + pz * pz - 6280000e0 * 6280000e0 as horizon, dx * 6400000 - px as vx, dy * 6400000 - py as vy, dz * 6400000 - pz as vz, -(vx * px + vy * py + vz * pz) as depth, vx * vx + vy * vy + vz * vz as far from places)""")


def _boxes(p):
    """A box at each place along its east, north and up, against the eye at the other place."""
    d = _ecef(_ecef(p), "lon2", "lat2", "height", ("qx", "qy", "qz"))
    frame = geo.enu_frame(C("lon"), C("lat"))
    axes = [tuple(c * s for c in v) for v, s in zip(frame, (3000.0, 2000.0, 500.0))]
    eye = (C("qx"), C("qy"), C("qz"))
    toward = geo.minus(_PXYZ, eye)
    planes = [(frame[0], -geo.dot(frame[0], eye)), (frame[2], -geo.dot(frame[2], eye) + 1e6)]
    return d.select("place", F.round(geo.box_distance(_PXYZ, axes, eye), 2).alias("distance"), geo.box_hit(_PXYZ, axes, eye, toward).alias("hit"), geo.box_hit(_PXYZ, axes, eye, tuple(-c for c in toward)).alias("behind"), geo.box_in_planes(planes, _PXYZ, axes).alias("box_kept"), geo.sphere_in_planes(planes, _PXYZ, F.lit(4000.0)).alias("ball_kept"))


_Q = f"{geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat2) * sin(lat2)) as n2, (n2 + height) * cos(lat2) * cos(lon2) as qx, (n2 + height) * cos(lat2) * sin(lon2) as qy, (n2 * (1 - {geo.E2!r}::double) + height) * sin(lat2) as qz"
register("boxes", ("places",), _boxes,
         f"""select place, round(sqrt(pow(greatest(abs(le) - 3000, 0), 2) + pow(greatest(abs(ln_) - 2000, 0), 2) + pow(greatest(abs(lu) - 500, 0), 2)), 2) as distance, true as hit, abs(le) <= 3000 and abs(ln_) <= 2000 and abs(lu) <= 500 as behind, -le >= -3000 and -lu + 1e6 >= -500 as box_kept, -le >= -4000 and -lu + 1e6 >= -4000 as ball_kept
  from (select *, {_ECEF}, {_Q}, {_FRAME_SQL}, (qx - px) * ex + (qy - py) * ey as le, (qx - px) * nx + (qy - py) * ny + (qz - pz) * nz as ln_, (qx - px) * ux + (qy - py) * uy + (qz - pz) * uz as lu from places)""")
register("screen_error", ("addresses",), lambda t: t.select(*KEY, F.round(geo.screen_space_error(g.level_error(C("level")), C("x") * 1.5, F.lit(960.0), F.lit(1.1547)), 4).alias("sse")), f"select grid, level, x, y, round({g.level_zero_error()!r}::double / pow(2e0, level) * 960 / (greatest(x * 1.5e0, 1e-7) * 1.1547e0), 4) as sse from addresses")


def _extents(r):
    """The box of a geographic rectangle as least and greatest coordinates along the axes of its middle."""
    e = geo.rectangle_extents(*_RECT, F.lit(-100.0), C("height") * 100)
    return r.select("rect", *named(e, 2))


def _along(axis, lon, lat, h):
    n = f"({geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin({lat}) * sin({lat})))"
    p = f"(({n} + {h}) * cos({lat}) * cos({lon}) - ox)", f"(({n} + {h}) * cos({lat}) * sin({lon}) - oy)", f"(({n} * (1 - {geo.E2!r}::double) + {h}) * sin({lat}) - oz)"
    e = {"e": ("-sin(lon)", "cos(lon)", "0"), "n": ("-sin(lat) * cos(lon)", "-sin(lat) * sin(lon)", "cos(lat)"), "u": ("cos(lat) * cos(lon)", "cos(lat) * sin(lon)", "sin(lat)")}[axis]
    return " + ".join(f"{a} * ({b})" for a, b in zip(p, e))


register("rectangle_boxes", ("rects",), _extents,
         f"""select rect, round(x, 2) + 0.0 as min_x, round(-x, 2) + 0.0 as max_x, round(least({_along('n', 'west', 'south', 'hi')}, {_along('n', 'lon', 'south', 'hi')}), 2) + 0.0 as min_y, round(greatest({_along('n', 'west', 'north', 'hi')}, {_along('n', 'lon', 'north', 'hi')}), 2) + 0.0 as max_y,
  round(least({_along('u', 'west', 'north', '-100')}, {_along('u', 'west', 'south', '-100')}), 2) + 0.0 as min_z, round(hi, 2) + 0.0 as max_z from (select *, (west + east) / 2 as lon, (south + north) / 2 as lat, height * 100 as hi, {geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat) * sin(lat)) as n, n * cos(lat) * cos(lon) as ox, n * cos(lat) * sin(lon) as oy, n * (1 - {geo.E2!r}::double) * sin(lat) as oz,
  case when south < 0 and north > 0 then 0e0 else lat end as widest, least({_along('e', 'west', 'north', 'hi')}, {_along('e', 'west', 'widest', 'hi')}, {_along('e', 'west', 'south', 'hi')}) as x from rects)""")
register("digests", ("eyes",), lambda e: e.select("eye", g.digest(F.concat(F.lit("tile-"), C("eye").cast("string"))).alias("digest"), g.digest(F.lit("")).alias("empty")),
         """select eye, printf('%016x', list_reduce(list_concat([14695981039346656037::hugeint], list_transform(range(1, length('tile-' || eye) + 1), lambda i: ascii(substr('tile-' || eye, i, 1))::hugeint)), lambda h, b: (xor(h::ubigint, b::ubigint)::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint) as digest, 'cbf29ce484222325' as empty from eyes""")
