"""Queries of light, budgets, texts and time series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.functions import colour, text
from meridian.functions import geodesy as geo
from meridian.operators import budget, light, series
from meridian.plans.catalogue import Columns, register

C = F.col


def rounded(cols, digits=6):
    return [(F.round(c, digits) + 0.0).alias(n) for n, c in cols.items()]


# Colour
_LIN = "(case when {v} / 255e0 <= 0.04045e0 then {v} / 255e0 / 12.92e0 else pow(({v} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)"
_LUMA = "(0.2126e0 * {0} + 0.7152e0 * {1} + 0.0722e0 * {2})"
_RGB = Columns(lambda: [C(c) for c in ("red", "green", "blue")])
_L = _LUMA.format("red", "green", "blue")
register("light_steps", ("tile_light",), lambda t: t.select("level", "x", "y", *rounded({"lin": colour.linear(C("red") * 255), "stops": colour.stops(_RGB), "step": colour.step(_RGB, [C("green"), C("blue"), C("red")])})),
         f"""select level, x, y, round({_LIN.format(v='(red * 255)')}, 6) + 0.0 as lin, round(log2(greatest({_L}, 1e-6)), 6) + 0.0 as stops, round(greatest(abs(log2((red + 0.004e0) / (green + 0.004e0))), abs(log2((green + 0.004e0) / (blue + 0.004e0))), abs(log2((blue + 0.004e0) / (red + 0.004e0)))), 6) + 0.0 as step from tile_light""")


def _grade():
    contrast, saturation = F.when(C("level") % 2 == 0, F.lit(1.0)).otherwise(F.lit(1.3)), F.when(C("level") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.8))
    return dict(zip(("r", "g", "b"), colour.graded(_RGB, [F.lit(0.02)] * 3, [F.lit(1.1), F.lit(1.0), F.lit(0.9)], contrast, F.lit(0.18), saturation)))


register("graded_light", ("tile_light",), lambda t: t.select("level", "x", "y", *rounded(_grade()), *rounded({"times": colour.multiplier((C("level") - 4) * 0.25, F.lit(0.5))})),
         f"""select level, x, y, round(case when s <> 1 then greatest(y2 + (r1 - y2) * s, 0) else r1 end, 6) + 0.0 as r, round(case when s <> 1 then greatest(y2 + (g1 - y2) * s, 0) else g1 end, 6) + 0.0 as g, round(case when s <> 1 then greatest(y2 + (b1 - y2) * s, 0) else b1 end, 6) + 0.0 as b, round(case when level = 4 then 1e0 else pow(2e0, (level - 4) * 0.25e0 * 0.5e0) end, 6) + 0.0 as times from
  (select *, greatest(red - 0.02e0, 0) * 1.1e0 as r0, greatest(green - 0.02e0, 0) as g0, greatest(blue - 0.02e0, 0) * 0.9e0 as b0, case when level % 2 = 0 then 1e0 else 1.3e0 end as k, case when level % 3 = 0 then 1e0 else 0.8e0 end as s, case when k <> 1 then pow(greatest({_LUMA.format('r0', 'g0', 'b0')}, 1e-5) / 0.18e0, k - 1) else 1e0 end as by_,
  r0 * by_ as r1, g0 * by_ as g1, b0 * by_ as b1, {_LUMA.format('r1', 'g1', 'b1')} as y2 from tile_light)""")
_STAR = "p_size / 4e0 - 2 as v, p_partkey % 30 / 10e0 - 0.6e0 as bv"
register("stars", ("stars",), lambda s: s.select("star", *rounded({"irradiance": F.log10(colour.irradiance(C("v"))), "kelvin": colour.temperature(C("bv"))}, 4), colour.magnitude_code(C("v")).alias("code"), colour.sky_cell(C("x"), C("y"), C("z")).alias("cell"), *rounded(dict(zip(("r", "g", "b"), colour.body_colour(colour.temperature(C("bv"))))), 5)),
         """, w as (select unnest(range(380, 781, 5))::double as l), g as (select l, 1.056e0 * exp(-0.5e0 * pow((l - 599.8e0) / case when l < 599.8e0 then 37.9e0 else 31e0 end, 2)) + 0.362e0 * exp(-0.5e0 * pow((l - 442e0) / case when l < 442e0 then 16e0 else 26.7e0 end, 2)) - 0.065e0 * exp(-0.5e0 * pow((l - 501.1e0) / case when l < 501.1e0 then 20.4e0 else 26.2e0 end, 2)) as fx,
  0.821e0 * exp(-0.5e0 * pow((l - 568.8e0) / case when l < 568.8e0 then 46.9e0 else 40.5e0 end, 2)) + 0.286e0 * exp(-0.5e0 * pow((l - 530.9e0) / case when l < 530.9e0 then 16.3e0 else 31.1e0 end, 2)) as fy, 1.217e0 * exp(-0.5e0 * pow((l - 437e0) / case when l < 437e0 then 11.8e0 else 36e0 end, 2)) + 0.681e0 * exp(-0.5e0 * pow((l - 459e0) / case when l < 459e0 then 26e0 else 13.8e0 end, 2)) as fz from w),
  k as (select distinct kelvin from (select 4600 * (1 / (0.92e0 * least(2.2e0, greatest(-0.4e0, bv)) + 1.7e0) + 1 / (0.92e0 * least(2.2e0, greatest(-0.4e0, bv)) + 0.62e0)) as kelvin from stars) union select 5772e0), p as (select kelvin, sum(fx * e) as sx, sum(fy * e) as sy, sum(fz * e) as sz from (select *, 1 / (pow(l * 1e-9, 5) * (exp(1.4387769e-2 / (l * 1e-9 * kelvin)) - 1)) as e from k, g) group by 1),
  b as (select kelvin, 3.2406e0 * sx - 1.5372e0 * sy - 0.4986e0 * sz as r, -0.9689e0 * sx + 1.8758e0 * sy + 0.0415e0 * sz as g, 0.0557e0 * sx - 0.204e0 * sy + 1.057e0 * sz as b from p), n as (select b.kelvin, greatest(b.r / s.r, 0) as r, greatest(b.g / s.g, 0) as g, greatest(b.b / s.b, 0) as b from b, b s where s.kelvin = 5772e0),
  q as (select *, 4600 * (1 / (0.92e0 * least(2.2e0, greatest(-0.4e0, bv)) + 1.7e0) + 1 / (0.92e0 * least(2.2e0, greatest(-0.4e0, bv)) + 0.62e0)) as kelvin, abs(x) >= abs(y) and abs(x) >= abs(z) as on_x, abs(y) >= abs(z) as on_y, case when on_x then abs(x) when on_y then abs(y) else abs(z) end as m, case when on_x then y else x end as u, case when on_x or on_y then z else y end as w from stars)
  select star, round(log10(pow(10e0, -0.4e0 * (v + 26.76e0))), 4) + 0.0 as irradiance, round(kelvin, 4) + 0.0 as kelvin, cast(least(1023, greatest(0, round((v + 2) * 100))) as bigint) as code, cast((case when on_x then (x <= 0)::int when on_y then 2 + (y <= 0)::int else 4 + (z <= 0)::int end) * 1024 + least(31, greatest(0, floor((w / m * 0.5e0 + 0.5e0) * 32))) * 32 + least(31, greatest(0, floor((u / m * 0.5e0 + 0.5e0) * 32))) as bigint) as cell,
  round(r / greatest(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 1e-12), 5) + 0.0 as r, round(g / greatest(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 1e-12), 5) + 0.0 as g, round(b / greatest(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 1e-12), 5) + 0.0 as b from q join n using (kelvin)""")

# Histograms and blocks; a texel is a cell of a vector as a number from 0 to 255
_UNIT = "least(0.999999e0, greatest(0e0, (v + 1) / 2))"


def _unit():
    return F.least(F.greatest((C("v") + 1) / 2, F.lit(0.0)), F.lit(0.999999))



register("light_quantiles", ("cells",), lambda c: light.bin_quantiles(c.select("tile", _unit().alias("y")), "tile", "y", {"p5": 0.05, "p50": 0.5, "p95": 0.95}), f""", b as (select tile, cast(floor({_UNIT} * 4096) as bigint) as bin, count(*) as n from cells group by 1, 2), r as (select tile, bin, sum(n) over (partition by tile order by bin) as seen, sum(n) over (partition by tile) as n from b)
  select tile, {', '.join(f"round(log2((min(bin) filter (seen > floor(n * {q}e0)) + 0.5e0) / 4096), 6) as {k}" for k, q in (('p5', 0.05), ('p50', 0.5), ('p95', 0.95)))} from r group by 1""")
_KEPT = f"kept as (select tile, cast(floor({_UNIT} * 16) as bigint) as bin, count(*) as n from cells group by 1, 2)"
register("kept_quantile", ("cells",), lambda c: light.kept_quantile(light.bin_counts(c.select("tile", _unit().alias("y")), "tile", "y", 16), "tile", 0.3, 16).select("tile", F.round("light", 6).alias("light")), f""", {_KEPT}, r as (select *, sum(n) over (partition by tile order by bin) as upto, sum(n) over (partition by tile) as total from kept)
  select tile, round(arg_min((bin + (0.3e0 * total - (upto - n)) / n) / 16 * 12 - 12, bin) filter (upto >= 0.3e0 * total), 6) as light from r group by 1""")
register("kept_share", ("cells",), lambda c: light.kept_share(light.bin_counts(c.select("tile", _unit().alias("y")), "tile", "y", 16), "tile", -5.4, 16).select("tile", F.round("share", 6).alias("share")), f", {_KEPT}, p as (select (-5.4e0 + 12) / 12 * 16 as a) select tile, round(sum(case when bin < floor(a) then n when bin = floor(a) then n * (a - floor(a)) else 0 end) / sum(n), 6) as share from kept, p group by 1")
_TEXELS = "texels as (select tile, (cell - 1) // 16 as block, 127.5e0 * (v + 1) as r, 127.5e0 * (v * 0.9e0 + 1) as g, 127.5e0 * (1 - v) as b from cells)"


def _texels(c, child=False):
    v = C("v") * (0.8 if child else 1.0)
    return c.select("tile", F.expr("(cell - 1) div 16").alias("block"), (127.5 * (v + 1)).alias("r"), (127.5 * (v * 0.9 + 1)).alias("g"), (127.5 * (1 - v)).alias("b"))


_COUNTS = "greatest(r, g, b) > 6 and least(r, g, b) < 250"
for _first in (True, False):
    register("block_means" if _first else "tone_means", ("cells",), lambda c, f=_first: light.block_means(_texels(c), ["tile", "block"], f).select("tile", "block", *rounded({x: C(x) for x in ("r", "g", "b", "valid")})), f", {_TEXELS} select tile, block, " + ", ".join(f"round(coalesce({('avg(' + _LIN.format(v=x) + ') filter (' + _COUNTS + ')') if _first else _LIN.format(v='(avg(' + x + ') filter (' + _COUNTS + '))')}, 0), 6) + 0.0 as {x}" for x in "rgb") + f", round(avg(({_COUNTS})::int), 6) + 0.0 as valid from texels group by 1, 2")
_BLOCKS = "{n} as (select tile, block, " + ", ".join(f"coalesce(avg({_LIN.format(v=x)}) filter ({_COUNTS}), 0) as {x}" for x in "rgb") + f", avg(({_COUNTS})::int) as valid from {{t}} group by 1, 2)"
_CHILD = _TEXELS.replace("texels as", "dim as").replace("(v + 1)", "(v * 0.8e0 + 1)").replace("(v * 0.9e0 + 1)", "(v * 0.8e0 * 0.9e0 + 1)").replace("(1 - v)", "(1 - v * 0.8e0)")
_GAINS = f"{_TEXELS}, {_CHILD}, {_BLOCKS.format(n='pa', t='texels')}, {_BLOCKS.format(n='ch', t='dim')}, gains as (select c.tile, c.block, " + ", ".join(f"log2(p.{x} / c.{x}) as g_{x}" for x in "rgb") + f", least(c.valid, p.valid) as valid, ln({_LUMA.format('c.r', 'c.g', 'c.b')}) as lc, ln({_LUMA.format('p.r', 'p.g', 'p.b')}) as lp from ch c join pa p using (tile, block) where c.valid >= 0.5 and p.valid >= 0.5 and least(c.r, c.g, c.b, p.r, p.g, p.b) > 0)"


def _gains(c):
    return light.block_gains(light.block_means(_texels(c, True), ["tile", "block"], True), light.block_means(_texels(c), ["tile", "block"], True), "tile")


_OFF = "o as (select tile, " + ", ".join(f"quantile_cont(g_{x}, 0.5) as o_{x}" for x in "rgb") + " from gains group by 1), f as (select g.*, o_r, o_g, o_b, greatest(abs(g_r - o_r), abs(g_g - o_g), abs(g_b - o_b)) as off from gains g join o using (tile)), t as (select tile, any_value(o_r) as o_r, any_value(o_g) as o_g, any_value(o_b) as o_b, quantile_cont(off, 0.5) as spread, max(off) as furthest, case when count(*) < 8 then 0e0 else corr(lc, lp) end as agreement from f group by 1)"
register("transfer_overall", ("cells",), lambda c: light.transfers(_gains(c), "tile")[0].select("tile", *rounded({x: C(x) for x in ("o_r", "o_g", "o_b", "agreement")}), "same_source"), f", {_GAINS}, {_OFF} select tile, round(o_r, 6) + 0.0 as o_r, round(o_g, 6) + 0.0 as o_g, round(o_b, 6) + 0.0 as o_b, round(agreement, 6) + 0.0 as agreement, greatest(abs(o_r), abs(o_g), abs(o_b)) < 0.06 and agreement >= 0.98 and furthest < 0.12 as same_source from t")
register("transfer_confidence", ("cells",), lambda c: light.transfers(_gains(c), "tile")[1].select("tile", "block", F.round("confidence", 5).alias("confidence")), f", {_GAINS}, {_OFF} select f.tile, f.block, round(f.valid / (1 + pow(f.off / greatest(t.spread * 2.5e0, 0.05e0), 2)), 5) as confidence from f join t using (tile)")
register("merged_grades", ("tile_light",), lambda t: light.merged_grades(t.select("level", (C("x") % 4 - 1).cast("double").alias("weight"), (C("red") / 10).alias("black"), (C("green") + 0.5).alias("gain"), (C("blue") + 0.5).alias("contrast"), (C("red") + 0.5).alias("saturation"))).select("level", *rounded({x: C(x) for x in ("black", "gain", "contrast", "saturation")})), """, p as (select level, (x % 4 - 1)::double as w, red / 10 as black, green + 0.5e0 as gain, blue + 0.5e0 as contrast, red + 0.5e0 as saturation from tile_light)
  select level, round(sum(w * black) / sum(w), 6) + 0.0 as black, round(exp(sum(w * ln(gain)) / sum(w)), 6) + 0.0 as gain, round(exp(sum(w * ln(contrast)) / sum(w)), 6) + 0.0 as contrast, round(exp(sum(w * ln(saturation)) / sum(w)), 6) + 0.0 as saturation from p where w > 0 group by 1""")
register("observed_tiles", ("addresses",), lambda t: light.observed(t.select(F.lit(3).cast("long").alias("level"), (C("x") % 8).alias("x"), (C("y") % 8).alias("y"), C("n").alias("drapes"), (C("level") * 1000003 + C("x") * 1009 + C("y")).alias("payload"), F.struct("level", "grid", "x", "y").alias("part"))), "select 3::bigint as level, x % 8 as x, y % 8 as y, cast(sum(n) as bigint) as drapes, arg_min(level * 1000003 + x * 1009 + y, {'a': level, 'b': grid, 'c': x, 'd': y}) as payload from addresses group by 1, 2, 3")

# Budgets
_NEED = "value / 20e0 - 10 as sse, (event_id % 120) / 100e0 as centrality, event_id * 1.5e0 as distance"
register("need_scores", ("needs",), lambda n: n.select("need", *[c.alias(k) for k, c in budget.quantised(C("sse"), C("centrality"), C("distance")).items()], "waited", "waiting").select("need", "sse_excess", "centrality", "distance", "rejected", budget.score(C("sse_excess"), C("centrality"), C("waited"), F.lit(5000).cast("long"), C("waiting")).alias("score")),
         """, q as (select *, cast(round(least(16, greatest(-16, coalesce(sse, 0))) * 1000) as bigint) as sse_excess, cast(round(least(1, greatest(0, centrality)) * 1000) as bigint) as ce, cast(floor(least(4294967295, greatest(0, distance))) as bigint) as di from needs), s as (select *, sse_excess * (500 + ce // 2) as e from q)
  select need, sse_excess, ce as centrality, di as distance, sse is null as rejected, cast(trunc(e / 1000e0) as bigint) + least(waited, 5000) * 1000 // 5000 + least(waiting * 250, 4000) as score from s""")
register("requests", ("needs",), lambda n: budget.requests(n.select((C("need") % 300).alias("tile"), (C("need") % 3).alias("group"), F.round("distance", 3).alias("priority"))), "select need % 300 as tile, max(need % 3) as \"group\", arg_max(round(distance, 3), {'g': need % 3, 'p': -round(distance, 3)}) as priority from needs group by 1")
register("request_ranks", ("needs",), lambda n: n.select("need", (C("need") % 4).alias("urgency"), C("waited").alias("score"), (C("need") % 2).alias("tier"), C("need").alias("resource")).orderBy(*budget.priority_order()).limit(200).select("need", "urgency", "score", "tier"), "select need, need % 4 as urgency, waited as score, need % 2 as tier from needs order by urgency, score desc, tier, need limit 200")
register("evicted", ("needs",), lambda n: budget.evicted(n.select((C("need") % 5).alias("class"), C("waited").alias("order"), C("need").alias("resource"), (C("waiting") * 10 + 5).alias("bytes"), (C("need") % 7 == 0).alias("kept")), 20_000), """, r as (select need % 5 as class, waited as o, need as resource, waiting * 10 + 5 as bytes, need % 7 = 0 as kept from needs), u as (select class, sum(bytes) as used from r group by 1 having sum(bytes) > 19000),
  f as (select *, coalesce(sum(bytes) over (partition by class order by o, resource rows between unbounded preceding and 1 preceding), 0) as before from r where not kept) select class, resource, bytes from f join u using (class) where used - before > 17000""")
register("backoffs", ("needs",), lambda n: n.select("need", budget.backoff(C("waiting"), C("need") % 9 == 0, 250, 60_000).alias("wait")), "select need, cast(case when need % 9 = 0 then 60000 else least(60000, 250 * pow(2e0, least(30, greatest(0, waiting - 1)))) end as bigint) as wait from needs")
register("pow2_histogram", ("archive_entries",), lambda e: e.groupBy(budget.pow2_bucket(C("bytes")).alias("bucket")).agg(F.count("*").alias("n")), "select cast(case when bytes <= 0 then 0 else length(bin(bytes)) end as bigint) as bucket, count(*) as n from archive_entries group by 1")
register("pow2_quantiles", ("archive_entries",), lambda e: budget.pow2_quantiles(e, "zone", "bytes", {"p50": 500, "p99": 990}), """, b as (select zone, case when bytes <= 0 then 0 else length(bin(bytes)) end as bucket, count(*) as n from archive_entries group by 1, 2), r as (select *, sum(n) over (partition by zone order by bucket) as seen, sum(n) over (partition by zone) as total from b)
  select zone, """ + ", ".join(f"cast(pow(2, min(bucket) filter (seen >= greatest(1, ceil(total * {q} / 1000)))) - 1 as bigint) as {k}" for k, q in (("p50", 500), ("p99", 990))) + " from r group by 1")
register("levels_occupied", ("addresses",), lambda t: budget.levels_occupied(t, "level", 12), "select least(level, 11) as level, count(*) as n from addresses group by 1")
register("bucket_counts", ("archive_entries",), lambda e: budget.buckets(e, "zone", "bytes", [5.0, 20.0, 45.0]), "select zone, count(*) filter (bytes <= 5) as le_0, count(*) filter (bytes <= 20) as le_1, count(*) filter (bytes <= 45) as le_2, count(*) as n, cast(sum(bytes) as bigint) as sum from archive_entries group by 1")

# Texts
register("key_checks", ("keys",), lambda k: k.select("key", text.safe_key(C("key")).alias("safe"), text.names_tag(C("tags"), C("etag")).alias("named"), text.expand_template(F.lit("{level}/{x}/{y}.png?l={level}"), C("id") % 20, C("id"), C("id") * 3).alias("url")), """select key, key <> '' and len(list_filter(string_split(key, '/'), lambda p: p in ('', '.', '..'))) = 0 as safe, list_contains(list_transform(string_split(tags, ','), lambda t: regexp_replace(trim(t), '^(W/)+', '')), '*') or list_contains(list_transform(string_split(tags, ','), lambda t: regexp_replace(trim(t), '^(W/)+', '')), regexp_replace(etag, '^(W/)+', '')) as named,
  (id % 20)::varchar || '/' || id || '/' || id * 3 || '.png?l=' || (id % 20)::varchar as url from keys""")
register("byte_ranges", ("keys",), lambda k: k.select("key", "spec", text.byte_range(C("spec"), C("id") * 10, 3000, 500).alias("r")).select("key", "spec", *[C(f"r.{c}").cast("double").alias(c) for c in ("start", "end")], C("r.partial").cast("double").alias("partial")), """, p as (select *, regexp_extract(spec, '^bytes=\\s*(\\d+)\\s*-\\s*(\\d*)\\s*$', 1) as a, regexp_extract(spec, '^bytes=\\s*(\\d+)\\s*-\\s*(\\d*)\\s*$', 2) as b from keys), q as (select *, case when a <> '' then a::bigint end as s, case when a <> '' then case when b = '' then least(a::bigint + 500, id * 10) else least(b::bigint + 1, id * 10) end end as e from p)
  select key, spec, case when spec is null then case when id * 10 <= 3000 then 0 end when s < e then s end::double as start, case when spec is null then case when id * 10 <= 3000 then id * 10 end when s < e then e end::double as "end", case when spec is null then case when id * 10 <= 3000 then 0e0 end when s < e then 1e0 end as partial from q""")
register("instants", ("keys",), lambda k: k.select("key", "clock", F.round(text.parse_utc(C("clock")), 3).alias("at"), F.round(text.instant(text.parse_utc(C("clock")), F.lit(0.5), C("id")), 3).alias("shown")), """, c as (select *, case when regexp_matches(clock, '^[+-]?\\d+(\\.\\d+)?$') then clock::double when regexp_matches(clock, '^\\d{4}-\\d{2}-\\d{2}(T\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?Z?$') then epoch_us(cast(replace(replace(clock, 'T', ' '), 'Z', '') || case when length(replace(clock, 'Z', '')) = 16 then ':00' else '' end as timestamp)) / 1e6 end as t from keys)
  select key, clock, round(t, 3) as at, round(t + greatest(id - 1, 0) * 0.5e0, 3) as shown from c""")
register("deep_links", ("places",), lambda p: p.select("place", text.deep_link(F.degrees("lon"), F.degrees("lat"), C("height"), F.degrees("lon2") + 180, F.degrees("lat2")).alias("link")), "select place, printf('goto?lon=%.7f&lat=%.7f&altitude=%.2f&heading=%.3f&pitch=%.3f', degrees(lon), degrees(lat), height, case when degrees(lon2) + 180 > 359.9995 then 0e0 else degrees(lon2) + 180 end, least(90e0, greatest(0e0, degrees(lat2)))) as link from places")

# Series
_DT, _TAU = 1.0, 2.0
_B0, _B1, _B2, _A1, _A2 = series.low_pass(_DT, _TAU)


def _sql_pass(name, source, value, order):
    """A pass of the filter as a recursion over the rows of each session."""
    return f"""{name}_i as (select session, frame, {value} as v, row_number() over (partition by session order by frame {order}) as i, first_value({value}) over (partition by session order by frame {order}) as r from {source}), {name} as (select session, frame, i, r, v, v - r as x1, 0e0 as x2, {_B0!r}::double * (v - r) as y1, 0e0 as y2 from {name}_i where i = 1 union all
  select n.session, n.frame, n.i, n.r, n.v, n.v - n.r, p.x1, {_B0!r}::double * (n.v - n.r) + {_B1!r}::double * p.x1 + {_B2!r}::double * p.x2 - ({_A1!r}::double) * p.y1 - ({_A2!r}::double) * p.y2, p.y1 from {name} p join {name}_i n on n.session = p.session and n.i = p.i + 1)"""


_SMOOTHED = f"{_sql_pass('fw', '{src}', '{val}', 'asc')}, ahead as (select session, frame, r + y1 as v from fw), {_sql_pass('bw', 'ahead', 'v', 'desc')}"
register("smooth_series", ("session_frames",), lambda f: series.along(f, "session", "frame", {"smooth": ("sky_luma", lambda v: series.smooth(v, _DT, _TAU))}).select("session", "frame", F.round("smooth", 6).alias("smooth")), ("recursive", ", " + _SMOOTHED.replace("{src}", "session_frames").replace("{val}", "sky_luma") + " select session, frame, round(r + y1, 6) as smooth from bw"))
register("envelope", ("session_frames",), lambda f: series.envelope(f, "session", "frame", "sky_luma", _DT, _TAU).select("session", "frame", F.round("envelope", 6).alias("envelope")), ("recursive", f", peaks as (select session, frame, sky_luma, max(sky_luma) over (partition by session order by frame rows between {series.envelope_reach(_DT, _TAU)} preceding and {series.envelope_reach(_DT, _TAU)} following) as peak from session_frames), " + _SMOOTHED.replace("{src}", "peaks").replace("{val}", "peak") + " select session, frame, round(greatest(sky_luma, r + y1), 6) as envelope from bw join peaks using (session, frame)"))
register("pursuit", ("session_frames",), lambda f: series.along(f, "session", "frame", {"angle": ("sky_luma", lambda v: series.pursue(v * 6, 0.1, 0.8, 0.5))}).select("session", "frame", F.round("angle", 6).alias("angle")), ("recursive", f""", t as (select session, frame, sky_luma * 6 as v, row_number() over (partition by session order by frame) as i from session_frames), p as (select session, frame, i, v as angle, 0e0 as rate from t where i = 1 union all
  select session, frame, i, angle + nr * 0.1e0, nr from (select *, least(0.8e0, greatest(-0.8e0, rate + least(0.05e0, greatest(-0.05e0, wanted - rate)))) as nr from (select *, sign(turn) * least(sqrt(0.025e0 * 0.025e0 + 2 * 0.5e0 * abs(turn)) - 0.025e0, 0.8e0, abs(turn) / 0.1e0) as wanted from (select t.session, t.frame, t.i, p.angle, p.rate, (t.v - p.angle + pi()) - {2 * math.pi!r}::double * floor((t.v - p.angle + pi()) / {2 * math.pi!r}::double) - pi() as turn from p join t on t.session = p.session and t.i = p.i + 1))))
  select session, frame, round(angle, 6) as angle from p"""))
register("thinned_frames", ("session_frames",), lambda f: series.thinned(f, "session", "frame", 4).select("session", "frame", "wall_ms"), "select session, frame, wall_ms from (select *, row_number() over (partition by session order by frame) - 1 as i, count(*) over (partition by session) as n from session_frames) where i % greatest(1, cast(ceil(n / 4e0) as bigint)) = 0 or i = n - 1")


def _route(f):
    return f.select("session", "frame", (C("sky_luma") * 100).alias("x"), (C("ground_luma") * 50).alias("y"), (C("stars") * 1.0).alias("z"))


register("route_centres", ("session_frames",), lambda f: series.route_centre(_route(f), "session", "frame", 30.0).select("session", *rounded({c: C(c) for c in "xyz"})), """, r as (select session, frame, sky_luma * 100 as x, ground_luma * 50 as y, stars * 1e0 as z from session_frames), d as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)) >= 30 * (frame - lag(frame) over w), false) as moving from r window w as (partition by session order by frame))
  select session, round(coalesce(avg(x) filter (moving), avg(x)), 6) + 0.0 as x, round(coalesce(avg(y) filter (moving), avg(y)), 6) + 0.0 as y, round(coalesce(avg(z) filter (moving), avg(z)), 6) + 0.0 as z from d group by 1""")
register("route_positions", ("session_frames",), lambda f: series.polyline_position(f, "session", "frame", "sky_luma", 1.35).select("session", "frame", F.round("t", 6).alias("t")), """, c as (select session, frame, sky_luma as leg, sum(sky_luma) over (partition by session order by frame) as upto, sum(sky_luma) over (partition by session) as whole, lead(frame) over (partition by session order by frame) is null as final from session_frames), h as (select *, row_number() over (partition by session order by frame) as k from c where whole * (1.35e0 - 1) <= upto or final)
  select session, frame, round(case when leg > 1e-12 then (whole * (1.35e0 - 1) - (upto - leg)) / leg else 0 end, 6) as t from h where k = 1""")


def _diagonal(p):
    """Of the places of each group the diagonal of the box along east and north of the first of them."""
    d = p.select((C("place") % 40).alias("route"), "place", *[c.alias(n) for n, c in zip(("px", "py", "pz"), geo.geodetic_to_ecef(C("lon"), C("lat"), C("height")))], "lon", "lat")
    first = d.groupBy("route").agg(F.min_by(F.struct("px", "py", "pz", "lon", "lat"), "place").alias("o"))
    e, n, _ = geo.enu_frame(C("o.lon"), C("o.lat"))
    off = geo.minus((C("px"), C("py"), C("pz")), (C("o.px"), C("o.py"), C("o.pz")))
    both = d.join(first, "route").select("route", geo.dot(off, e).alias("e"), geo.dot(off, n).alias("n"))
    return both.groupBy("route").agg(F.round(F.sqrt(F.pow(F.max("e") - F.min("e"), 2) + F.pow(F.max("n") - F.min("n"), 2)), 2).alias("diagonal"))


register("route_diagonals", ("places",), _diagonal, f""", c as (select place % 40 as route, place, lon, lat, {geo.A}::double / sqrt(1 - {geo.E2!r}::double * sin(lat) * sin(lat)) as n, (n + height) * cos(lat) * cos(lon) as px, (n + height) * cos(lat) * sin(lon) as py, (n * (1 - {geo.E2!r}::double) + height) * sin(lat) as pz from places), o as (select * from c where place in (select min(place) from c group by route)),
  f as (select c.route, -sin(o.lon) * (c.px - o.px) + cos(o.lon) * (c.py - o.py) as e, -sin(o.lat) * cos(o.lon) * (c.px - o.px) - sin(o.lat) * sin(o.lon) * (c.py - o.py) + cos(o.lat) * (c.pz - o.pz) as nn from c join o using (route)) select route, round(sqrt(pow(max(e) - min(e), 2) + pow(max(nn) - min(nn), 2)), 2) as diagonal from f group by 1""")
