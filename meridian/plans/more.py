"""Queries of seams, solves, caches, comparisons and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import colour, grid, tiles
from meridian.operators import caches, light, measure, seams, solve
from meridian.plans.catalogue import register

C = F.col

# Seams: each frame draws the geographic tiles of a mixed-level mosaic
_DRAWN = "drawn as (select frame, level, x, y from (select frame, 3 as level, cx * 2 + dx as x, cy * 2 + dy as y, h from base, (values (0), (1)) a(dx), (values (0), (1)) b(dy) where h % 3 <> 0 union all select frame, 2, cx, cy, h from base where h % 3 = 0) where (x * 5 + y * 3 + frame) % 11 <> 0)"
_BASE = "base as (select frame, cx, cy, frame * 7 + cx * 3 + cy * 5 as h from (select distinct frame % 40 as frame from pack_frames), (select unnest(range(0, 8)) as cx), (select unnest(range(0, 4)) as cy))"


def _mosaic(p):
    base = p.select((C("frame") % 40).alias("frame")).distinct().select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("cx")).select("frame", "cx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cy"))
    base = base.withColumn("h", C("frame") * 7 + C("cx") * 3 + C("cy") * 5)
    fine = base.where("h % 3 <> 0").select("frame", F.lit(3).cast("long").alias("level"), F.explode(F.array(*[F.struct((C("cx") * 2 + dx).alias("x"), (C("cy") * 2 + dy).alias("y")) for dx in (0, 1) for dy in (0, 1)])).alias("t")).select("frame", "level", "t.*")
    coarse = base.where("h % 3 = 0").select("frame", F.lit(2).cast("long").alias("level"), C("cx").alias("x"), C("cy").alias("y"))
    return fine.unionByName(coarse).where("(x * 5 + y * 3 + frame) % 11 <> 0")


_SIDES = f"""{_BASE}, {_DRAWN}, u as (select *, 1::bigint << (40 - level)::int as one from drawn), sides as (select frame, level, x, y, 'west' as side, true as upright, x * one as line, y * one as s, (y + 1) * one as e from u union all select frame, level, x, y, 'east', true, ((x + 1) * one) % (2::bigint << 40), y * one, (y + 1) * one from u
  union all select frame, level, x, y, 'south', false, y * one, x * one, (x + 1) * one from u where y > 0 union all select frame, level, x, y, 'north', false, (y + 1) * one, x * one, (x + 1) * one from u where (y + 1) * one < (1::bigint << 40)),
  met as (select a.frame, a.upright, a.level as a_level, a.x as a_x, a.y as a_y, b.level as b_level, b.x as b_x, b.y as b_y, a.side as sa, b.side as sb, (least(a.e, b.e) - greatest(a.s, b.s)) / (a.e - a.s) as share, (least(a.e, b.e) - greatest(a.s, b.s)) / (b.e - b.s) as b_share
  from sides a join sides b on a.frame = b.frame and a.upright = b.upright and a.line = b.line and a.side in ('east', 'north') and b.side in ('west', 'south') and a.s < b.e and b.s < a.e)"""
register("shared_sides", ("pack_frames",), lambda p: seams.shared(_mosaic(p), "frame").drop("b_share"), f", {_SIDES} select frame, upright, a_level::bigint as a_level, a_x, a_y, b_level::bigint as b_level, b_x, b_y, share from met")
register("bare_sides", ("pack_frames",), lambda p: seams.uncovered(_mosaic(p), "frame").withColumn("bare", F.round("bare", 9)), f", {_SIDES}, c as (select frame, a_level as level, a_x as x, a_y as y, sa as side, share from met union all select frame, b_level, b_x, b_y, sb, b_share from met), k as (select frame, level, x, y, side, sum(share) as covered from c group by all) select s.frame, s.level::bigint as level, s.x, s.y, s.side, round(1 - coalesce(covered, 0), 9) as bare from sides s left join k using (frame, level, x, y, side) where 1 - coalesce(covered, 0) > 1e-12")
register("seam_level_steps", ("pack_frames",), lambda p: seams.level_steps(seams.shared(_mosaic(p), "frame")), f", {_SIDES} select abs(a_level - b_level)::bigint as apart, count(*) as n from met group by 1")

# Gains between levels
_OBS = "obs as (select level, level - rise as ancestor, log2((ar + 0.1e0) / (red + 0.1e0)) as r, log2((ag + 0.1e0) / (green + 0.1e0)) as g, red - green as b, drapes * 1e0 as weight from (select t.*, a.level as al, a.red as ar, a.green as ag, t.level - a.level as rise from tile_light t join tile_light a on a.level between t.level - 2 and t.level - 1 and a.x = t.x >> (t.level - a.level)::int and a.y = t.y >> (t.level - a.level)::int))"


def _observations(t):
    up = t.select("level", "x", "y", "red", "green", "drapes", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("rise"))
    n = F.pow(F.lit(2.0), "rise").cast("long")
    up = up.select("level", "red", "green", "drapes", (C("level") - C("rise")).alias("ancestor"), F.call_function("div", C("x"), n).alias("ax"), F.call_function("div", C("y"), n).alias("ay"))
    a = t.select(C("level").alias("ancestor"), C("x").alias("ax"), C("y").alias("ay"), C("red").alias("ar"), C("green").alias("ag"))
    d = up.join(a, ["ancestor", "ax", "ay"])
    return d.select("level", "ancestor", F.log2((C("ar") + 0.1) / (C("red") + 0.1)).alias("r"), F.log2((C("ag") + 0.1) / (C("green") + 0.1)).alias("g"), (C("red") - C("green")).alias("b"), (C("drapes") * 1.0).alias("weight"))


def _medians(name, source, cols):
    parts = ", ".join(f"{name}_{c} as (select level, ancestor, min(v) as {c} from (select level, ancestor, {e} as v, sum(weight) over (partition by level, ancestor order by {e} range between unbounded preceding and current row) as run, sum(weight) over (partition by level, ancestor) as whole from {source}) where run * 2 >= whole group by 1, 2)" for c, e in cols.items())
    return parts


register("level_pairs", ("tile_light",), lambda t: solve.level_pairs(_observations(t)).select("level", "ancestor", *[(F.round(c, 6) + 0.0).alias(c) for c in ("r", "g", "b", "spread")], "n"), f""", {_OBS}, {_medians('m', 'obs', {c: c for c in 'rgb'})}, j as (select o.*, m_r.r as mr, m_g.g as mg, m_b.b as mb from obs o join m_r using (level, ancestor) join m_g using (level, ancestor) join m_b using (level, ancestor)), {_medians('s', 'j', {'r': 'abs(r - mr)', 'g': 'abs(g - mg)', 'b': 'abs(b - mb)'})},
  k as (select level, ancestor, count(*) as n from obs group by 1, 2) select level, ancestor, round(m_r.r, 6) + 0.0 as r, round(m_g.g, 6) + 0.0 as g, round(m_b.b, 6) + 0.0 as b, round(greatest(s_r.r, s_g.g, s_b.b), 6) + 0.0 as spread, n from m_r join m_g using (level, ancestor) join m_b using (level, ancestor) join s_r using (level, ancestor) join s_g using (level, ancestor) join s_b using (level, ancestor) join k using (level, ancestor)""")


def _gains(t):
    found = solve.level_gains(_observations(t), anchor=4)
    return t.sparkSession.createDataFrame([(x, s, *map(float, v)) for x, (s, v) in found.items()], "level long, source long, r double, g double, b double")


register("level_gains", ("tile_light",), _gains, None)

# Caches and recurrences
register("cache_hits", ("tile_puts",), lambda p: caches.hits(p.where("arrival % 3 = 0").select(C("digest").alias("k"), (C("fetched_ms") + C("arrival") % 5).alias("at")), p.where("arrival % 3 <> 0").select(C("digest").alias("k"), (C("fetched_ms") + C("arrival") % 7).alias("at"), C("arrival").alias("v")).groupBy("k", "at").agg(F.max("v").alias("v")), "k", 60_000).groupBy("k").agg(F.count("*").alias("reads"), F.count("v").alias("hits"), F.sum("v").cast("double").alias("total")), """, r as (select digest as k, fetched_ms + arrival % 5 as t from tile_puts where arrival % 3 = 0), p as (select digest as k, fetched_ms + arrival % 7 as t, max(arrival) as v from tile_puts where arrival % 3 <> 0 group by 1, 2),
  j as (select r.k, r.t, p.t as pt, p.v from r asof left join p on r.k = p.k and r.t >= p.t) select k, count(*) as reads, count(case when t - pt < 60000 then v end) as hits, sum(case when t - pt < 60000 then v end)::double as total from j group by 1""")
register("relaxation", ("session_frames",), lambda f: caches.relaxation(f.select("session", "frame", F.when(C("stars") % 5 == 0, 2).when(C("stars") % 5 < 3, 1).when(C("stars") % 5 == 3, 0).otherwise(-1).cast("long").alias("state"), (C("sky_pixels") * 20).alias("dt")), "session", "frame", 900, 700, 4000), ("recursive", """, t as (select session, frame, case when stars % 5 = 0 then 2 when stars % 5 < 3 then 1 when stars % 5 = 3 then 0 else -1 end as st, sky_pixels * 20 as dt, row_number() over (partition by session order by frame) as i from session_frames),
  p as (select session, 0::bigint as frame, 0::bigint as i, 1000000000::bigint as fine from (select distinct session from t) union all select t.session, t.frame, t.i, case when st > 0 then least(fine + 900 * case when st = 2 then 4 else 1 end * dt, 4000000000) when st = 0 then greatest(fine - 700 * dt, 1000000000) else fine end from p join t on t.session = p.session and t.i = p.i + 1) select session, frame, fine // 1000000 as scale from p where i > 0"""))
register("violations", ("needs",), lambda n: caches.violations(n.withColumn("k", C("need") % 10), "k", {"late": C("waited") < 5500, "crowded": C("waiting") <= 30, "odd": C("sse") < 9}), "select need % 10 as k, count(*) filter (not waited < 5500) as late, count(*) filter (not waiting <= 30) as crowded, count(*) filter (not sse < 9) as odd from needs group by 1")
register("counters_since", ("tile_puts",), lambda p: caches.counters_since(*[p.where(f"arrival < {n}").groupBy(C("layer").alias("name")).agg(F.count("*").alias("value")) for n in (900, 400)]), "select layer as name, count(*) - count(*) filter (arrival < 400) as value from tile_puts where arrival < 900 group by 1")
register("folded_ranges", ("addresses",), lambda t: caches.folded(t.where("n = 1 and level < 9").select("level", (C("x") % 50).alias("x")).distinct(), t.where("level < 12").select("level", (C("x") % 70).alias("x")), ["level", "x"])[1], "select distinct level, x % 70 as x from addresses where level < 12 except select level, x % 50 from addresses where n = 1 and level < 9")

# Pictures: a vector's first 63 numbers as 3 columns of 7 x 3 colours
_PIX = "pix as (select tile, (cell - 1) // 9 as row, (cell - 1) // 3 as p, least(255e0, greatest(0e0, 127.5e0 * (v + 1))) as s, (cell - 1) % 3 as ch from cells where cell <= 63), lin as (select tile, row, p, max(case when ch = 0 then l end) as r, max(case when ch = 1 then l end) as g, max(case when ch = 2 then l end) as b from (select *, case when s / 255 <= 0.04045e0 then s / 255 / 12.92e0 else pow((s / 255 + 0.055e0) / 1.055e0, 2.4e0) end as l from pix) group by 1, 2, 3)"


def _picture(c):
    """Mean light, casts and the light of the upper, middle and lower third."""
    s = F.least(F.greatest(127.5 * (C("v") + 1), F.lit(0.0)), F.lit(255.0))
    d = c.where("cell <= 63").select("tile", F.expr("(cell - 1) div 9").alias("row"), F.expr("(cell - 1) div 3").alias("p"), F.expr("(cell - 1) % 3").alias("ch"), colour.linear(s).alias("l"))
    m = d.groupBy("tile").agg(*[F.avg(F.when(C("ch") == i, C("l"))).alias(n) for i, n in enumerate("rgb")])
    px = d.groupBy("tile", "row", "p").agg(*[F.max(F.when(C("ch") == i, C("l"))).alias(n) for i, n in enumerate("rgb")])
    band = F.least(F.floor(C("row") / 2), F.lit(2))
    bands = px.groupBy("tile").agg(*[F.round(F.log2(F.greatest(F.avg(F.when(band == i, colour.luma([C(x) for x in "rgb"]))), F.lit(1e-6))), 5).alias(n) for i, n in enumerate(("top", "middle", "low"))])
    cast = lambda a: F.round(F.log2(F.greatest(C(a) / F.greatest(C("g"), F.lit(1e-6)), F.lit(1e-6))), 5)
    return m.select("tile", F.round(colour.stops([C(x) for x in "rgb"]), 5).alias("mean"), cast("r").alias("red"), cast("b").alias("blue")).join(bands, "tile")


register("picture_light", ("cells",), _picture, f""", {_PIX}, m as (select tile, avg(r) as r, avg(g) as g, avg(b) as b from lin group by 1) select m.tile, round(log2(greatest(0.2126e0 * m.r + 0.7152e0 * m.g + 0.0722e0 * m.b, 1e-6)), 5) as mean, round(log2(greatest(m.r / greatest(m.g, 1e-6), 1e-6)), 5) as red, round(log2(greatest(m.b / greatest(m.g, 1e-6), 1e-6)), 5) as blue, """ + ", ".join(f"(select round(log2(greatest(avg(0.2126e0 * l.r + 0.7152e0 * l.g + 0.0722e0 * l.b), 1e-6)), 5) from lin l where l.tile = m.tile and least(l.row // 2, 2) = {i}) as {n}" for i, n in enumerate(("top", "middle", "low"))) + " from m")
register("tile_moments", ("cells",), lambda c: c.groupBy("tile").agg(F.round(F.when(F.stddev_pop("v") > 1e-4, 0.25 / F.stddev_pop("v")).otherwise(1.0), 5).alias("gain"), F.round(F.coalesce(F.corr("v", C("cell").cast("double")), F.lit(0.0)), 6).alias("corr")), "select tile, round(case when stddev_pop(v) > 1e-4 then 0.25e0 / stddev_pop(v) else 1e0 end, 5) as gain, round(coalesce(corr(v, cell::double), 0), 6) as corr from cells group by 1")

# Comparisons and keys
register("comparisons", ("scores",), lambda s: s.select("sample", "kind").distinct().join(F.broadcast(s.select("input").distinct()), F.lit(True)).where(F.coalesce(C("kind") != "other", F.lit(True))).select("sample", "input").distinct(), "select distinct a.sample, b.input from scores a, (select distinct input from scores) b where coalesce(a.kind <> 'other', true)")
register("valid_scores", ("scores",), lambda s: measure.valid(s).groupBy("input").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("samples")), "select input, count(*) as n, count(distinct sample) as samples from scores where coalesce(kind <> 'other', true) group by 1")
register("tiles_under", ("addresses",), lambda t: t.where("grid = 'geographic' and level between 1 and 6").select("level", "x", "y", *[c.alias(n) for n, c in zip(("x0", "x1", "y0", "y1"), grid.tile_range(F.lit("web-mercator"), C("level"), *grid.tile_rect(C("grid"), C("level"), C("x"), C("y"))))]).select("level", "x", "y", F.explode(F.sequence("y0", "y1")).alias("uy"), "x0", "x1").select("level", "x", "y", F.explode(F.sequence("x0", "x1")).alias("ux"), "uy"),
         f""", r as (select level, x, y, pow(2e0, level) as k, greatest(-{grid.MERCATOR_MAX_LAT!r}::double, least({grid.MERCATOR_MAX_LAT!r}::double, (0.5e0 - y / k) * pi())) as n, greatest(-{grid.MERCATOR_MAX_LAT!r}::double, least({grid.MERCATOR_MAX_LAT!r}::double, (0.5e0 - (y + 1) / k) * pi())) as s from addresses where grid = 'geographic' and level between 1 and 6),
  c as (select level, x, y, k, least(floor(least(1, greatest(0, (x * (1 / (2 * k)) * {grid.TAU!r}::double - pi() + pi()) / {grid.TAU!r}::double)) * k), k - 1)::bigint as x0, least(floor(least(1, greatest(0, ((x + 1) * (1 / (2 * k)) * {grid.TAU!r}::double - pi() + pi()) / {grid.TAU!r}::double)) * k), k - 1)::bigint as x1, least(floor(least(1, greatest(0, 0.5e0 - ln(tan(pi() / 4 + n / 2)) / {grid.TAU!r}::double)) * k), k - 1)::bigint as y0, least(floor(least(1, greatest(0, 0.5e0 - ln(tan(pi() / 4 + s / 2)) / {grid.TAU!r}::double)) * k), k - 1)::bigint as y1 from r)
  select level, x, y, ux, unnest(range(y0, y1 + 1)) as uy from (select *, unnest(range(x0, x1 + 1)) as ux from c)""")
register("store_keys", ("keys",), lambda k: k.select("id", F.concat(F.lit('"'), grid.digest(C("key")), F.lit('"')).alias("etag_of"), F.sha2(F.concat_ws("|", F.lit("projection 1"), "key", "etag", "clock"), 256).alias("projection"), F.format_string("%s/tone/9/%d/%d.json", F.regexp_replace("key", r"\.absent$", ""), C("id"), C("id") * 2).alias("region"), F.regexp_replace(F.concat("key", F.when(C("id") % 2 == 0, ".absent").otherwise("")), r"\.absent$", "").isin("a/b/6", "/a1").alias("projected")),
         """select id, '"' || printf('%016x', list_reduce(list_concat([14695981039346656037::hugeint], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::hugeint)), lambda h, b: (xor(h::ubigint, b::ubigint)::hugeint * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint) || '"' as etag_of, sha256('projection 1|' || key || '|' || etag || '|' || clock) as projection, key || '/tone/9/' || id || '/' || id * 2 || '.json' as region, key in ('a/b/6', '/a1') as projected from keys""")


def _reached(t, e):
    """Zones whose nearest point lies within an eye's horizon."""
    at = (C("grid"), F.lit(6).cast("long"), C("x"), C("y"))
    w, s, ea, n = grid.bounds_degrees(*at)
    z = t.where("level = 6").select("grid", "x", "y", w.alias("w"), s.alias("s"), ea.alias("e"), n.alias("n"))
    ground = tiles.haversine(C("lon"), C("lat"), F.least(F.greatest("lon", "w"), C("e")), F.least(F.greatest("lat", "s"), C("n")))
    r = 2 * tiles.MEAN_RADIUS
    return z.join(e, ground <= F.sqrt(r * F.greatest("height", F.lit(0.0)) + C("height") * C("height")) + (r * measure.HIGHEST_GROUND) ** 0.5, "left_semi").select("grid", "x", "y")


register("reached_zones", ("addresses", "eyes"), _reached, """, b as (select grid, x, y, case when grid = 'geographic' then -180 + x * (180 / 64e0) else x / 64e0 * 360 - 180 end as w, case when grid = 'geographic' then -180 + x * (180 / 64e0) + 180 / 64e0 else (x + 1) / 64e0 * 360 - 180 end as e, case when grid = 'geographic' then -90 + y * (180 / 64e0) else degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64e0)))) end as s, case when grid = 'geographic' then -90 + y * (180 / 64e0) + 180 / 64e0 else degrees(atan(sinh(pi() * (1 - 2 * y / 64e0)))) end as n from addresses where level = 6)
  select distinct grid, x, y from b, eyes where 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(least(greatest(lat, s), n)) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(least(greatest(lat, s), n))) * pow(sin(radians(least(greatest(lon, w), e) - lon) / 2), 2)))) <= sqrt(2 * 6371008.8 * greatest(height, 0) + height * height) + sqrt(2 * 6371008.8 * 4800)""")
register("seen_parts", ("tile_light",), lambda t: light.observed(t.select(F.lit(2).cast("long").alias("level"), (C("x") % 4).alias("x"), (C("y") % 4).alias("y"), "drapes", (C("level") * 100 + C("x")).alias("payload"), F.struct("level", "x", "y").alias("part"))), "select 2::bigint as level, x % 4 as x, y % 4 as y, cast(sum(drapes) as bigint) as drapes, arg_min(level * 100 + x, {'a': level, 'b': x, 'c': y}) as payload from tile_light group by 1, 2, 3")
