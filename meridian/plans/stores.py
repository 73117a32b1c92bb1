"""Queries of the tile store: listings, liveness, duplicates, merging, registers, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import grid
from meridian.operators import ranges, store
from meridian.operators.deal import tasks
from meridian.plans.catalogue import register

C = F.col


def today():
    return F.lit("1998-06-01").cast("date")


def days():
    return F.lit(700)



_LIVE = "live as (select * from archive_entries where date_diff('day', cast(strptime(epoch || '01', '%Y%m%d') + interval 1 month as date), date '1998-06-01') <= 700)"
_SUMMARY = """summary as (select zone, epoch, archive, count(*) as tiles, cast(sum(bytes) as bigint) as bytes, case when count(oldest_fetch) = count(*) then min(oldest_fetch) end as oldest_fetch, case when count(newest_fetch) = count(*) then max(newest_fetch) end as newest_fetch from live group by 1, 2, 3)"""
_LISTING = "listing as (select zone, tile_id, arg_max(digest, archive) as digest, max(archive) as archive, arg_max(bytes, archive) as bytes, count(*) as listed from live group by 1, 2)"


def _live(e):
    return store.live(e, today(), days())


register("newest_wins", ("tile_puts",), store.newest_wins, "select layer, level, x, y, fetched_ms, arrival, digest, offers from (select *, row_number() over (partition by layer, level, x, y order by fetched_ms desc, arrival desc) as r, count(*) over (partition by layer, level, x, y) as offers from tile_puts) where r = 1")
register("census", ("archive_entries",), lambda e: store.census(_live(e)), f""", {_LIVE} select zone, cast(sum(copies) as bigint) as copies, count(*) as tiles, cast(sum(cast(copies > 1 as int)) as bigint) as repeated, max(archives) as archives from
  (select zone, tile_id, count(*) as copies from live group by 1, 2) join (select zone, count(distinct archive) as archives from live group by 1) using (zone) group by zone""")
register("zone_listing", ("archive_entries",), lambda e: store.zone_listing(_live(e)), f", {_LIVE}, {_LISTING} select * from listing")
register("expired_archives", ("archive_entries",), lambda e: store.expired(e, today(), days()), "select distinct zone, epoch, archive from archive_entries where date_diff('day', cast(strptime(epoch || '01', '%Y%m%d') + interval 1 month as date), date '1998-06-01') > 700")
register("archive_summary", ("archive_entries",), lambda e: store.archive_summary(_live(e).withColumn("oldest_fetch", F.when(C("bytes") != 50, C("oldest_fetch")))).withColumn("oldest_fetch", C("oldest_fetch").cast("double")), f", {_LIVE.replace('select *', 'select * replace (case when bytes <> 50 then oldest_fetch end as oldest_fetch)')}, {_SUMMARY} select * replace (oldest_fetch::double as oldest_fetch) from summary")
_FRESH = "fresh as (select 'z' || (user_id % 8)::varchar as zone, user_id as tile_id, fetched_ms // 86400000 - 9131 as fetched, digest from (select *, arrival % 2000 as user_id from tile_puts))"


def _fresh(p):
    user = C("arrival") % 2000
    return p.select(F.concat(F.lit("z"), (user % 8).cast("string")).alias("zone"), user.alias("tile_id"), F.expr("fetched_ms div 86400000 - 9131").alias("fetched"), "digest")


register("drop_duplicates", ("archive_entries", "tile_puts"), lambda e, p: store.drop_duplicates(_fresh(p), _live(e).withColumn("digest", C("digest") % 17)), f""", {_LIVE.replace('select *', 'select * replace (digest % 17 as digest)')}, {_LISTING}, {_SUMMARY}, {_FRESH}
  select f.* from fresh f left join (select l.zone, l.tile_id, l.digest as sd, s.oldest_fetch as so from listing l join summary s using (zone, archive)) using (zone, tile_id) where not (coalesce(digest = sd, false) or coalesce(so > fetched, false))""")
register("stored_copies", ("archive_entries", "tile_puts"), lambda e, p: store.stored_copies(_fresh(p).select("zone", "tile_id").distinct(), _live(e)).withColumn("s_digest", C("s_digest").cast("double")).withColumn("s_oldest", C("s_oldest").cast("double")), f""", {_LIVE}, {_LISTING}, {_SUMMARY}, {_FRESH}
  select f.zone, f.tile_id, sd::double as s_digest, sa as s_archive, so::double as s_oldest from (select distinct zone, tile_id from fresh) f left join (select l.zone, l.tile_id, l.digest as sd, l.archive as sa, s.oldest_fetch as so from listing l join summary s using (zone, archive)) using (zone, tile_id)""")
_RUNS = """r as (select zone, epoch, archive, sum(bytes) over w as cost, max(bytes) over w as most, min(bytes) over w as least, count(*) over w as n, min(epoch) over w as e0, max(epoch) over w as e1, count(*) over (partition by zone, epoch) as held from summary window w as (partition by zone order by archive rows between current row and 2 following)),
  k as (select *, most > {ratio} * greatest(least, 1) as forced from r where n = 3 and e0 = e1), chosen as (select zone, epoch, archive as "first", cast(cost as bigint) as cost, forced from (select *, row_number() over (partition by zone, epoch order by forced, cost, archive) as i from k where not forced or held > 6) where i = 1)"""
_HOW = {"fanout": 3, "ratio": 1.2, "most_archives": 6}
register("tiering_select", ("archive_entries",), lambda e: store.tiering_select(store.archive_summary(_live(e)), **_HOW), f", {_LIVE}, {_SUMMARY}, {_RUNS.format(ratio='1.2')} select * from chosen")
_ONE = "one as (select zone, min(\"first\") as \"first\" from chosen group by 1), placed as (select zone, archive, row_number() over (partition by zone order by archive) as at from summary), members as (select p.zone, p.archive, o.\"first\" from placed p join one o using (zone) join placed s on s.zone = o.zone and s.archive = o.\"first\" where p.at >= s.at and p.at < s.at + 3)"


def _members(e):
    a = store.archive_summary(_live(e))
    return store.run_members(a, store.tiering_select(a, **_HOW).groupBy("zone").agg(F.min("first").alias("first")), 3)


register("run_members", ("archive_entries",), _members, f", {_LIVE}, {_SUMMARY}, {_RUNS.format(ratio='1.2')}, {_ONE} select * from members")
register("merged_archives", ("archive_entries",), lambda e: store.merged(_live(e), _members(e)), f""", {_LIVE}, {_SUMMARY}, {_RUNS.format(ratio='1.2')}, {_ONE}
  select zone, epoch, into_ as archive, tile_id, bytes, digest, oldest_fetch, newest_fetch from (select l.*, coalesce(m."first", l.archive) as into_, row_number() over (partition by l.zone, coalesce(m."first", l.archive), tile_id order by l.archive desc) as r from live l left join members m using (zone, archive)) where r = 1""")
register("scrub", ("archive_entries",), lambda e: store.scrub(_live(e), C("digest") % 5 == 0)[1], f""", {_LIVE}, m as (select zone, tile_id, archive, digest % 5 = 0 as gone from live), t as (select zone, tile_id, arg_max(gone, archive) as newest_gone, bool_and(gone) as all_gone, count(*) filter (gone) as removed from m group by 1, 2)
  select zone, cast(sum(removed) as bigint) as removed, count(*) filter (newest_gone and not all_gone) as uncovered, count(*) filter (all_gone) as lost, max(coalesce(r, 0)) as rewritten from t left join (select zone, count(distinct archive) as r from m where gone group by 1) using (zone) group by 1""")
register("scrubbed_entries", ("archive_entries",), lambda e: store.zone_listing(store.scrub(_live(e), C("digest") % 5 == 0)[0]), f", {_LIVE.replace(' <= 700)', ' <= 700 and digest % 5 <> 0)')}, {_LISTING} select * from listing")
register("orphans", ("archive_entries",), lambda e: store.orphans(e.select("zone", "archive", "epoch").distinct(), _live(e).select("zone", "archive").distinct(), F.datediff(today(), grid.epoch_end(C("epoch"))), 900), "select distinct zone, archive, epoch from archive_entries where date_diff('day', cast(strptime(epoch || '01', '%Y%m%d') + interval 1 month as date), date '1998-06-01') > 900")
register("due", ("archive_entries",), lambda e: store.due(store.archive_summary(e), today(), days(), 1247, **_HOW), f""", live as (select * from archive_entries), {_SUMMARY}, {_RUNS.format(ratio='1.2')},
  ends as (select distinct zone, epoch, date_diff('day', date '1995-01-01', cast(strptime(epoch || '01', '%Y%m%d') + interval 1 month as date)) + 700 as day from archive_entries), w as (select zone, day from ends union all select zone, 1247 from chosen join ends using (zone, epoch) where 1247 - (ends.day - 700) <= 700)
  select zone, cast(greatest(min(day), 1247) as bigint) as "at", count(*) as reasons from w group by 1""")
register("tile_ladder", ("archive_entries", "absences"), lambda e, a: store.ladder(e, a, 0), """, c as (select zone, tile_id, max(newest_fetch) as fetched from archive_entries group by 1, 2), v as (select * from absences where expires > 0)
  select zone, tile_id, case when said is null then 'copy' when fetched is null or said > fetched then 'absent' else 'copy' end as answer from c full join v using (zone, tile_id)""")
register("register", ("archive_entries", "absences"), lambda e, a: store.register(_live(e), a).withColumn("digest", C("digest").cast("double")), f""", {_LIVE}, {_LISTING}, {_SUMMARY}, c as (select l.zone, l.tile_id, l.archive, l.digest, s.newest_fetch as f from listing l join summary s using (zone, archive)), b as (select *, said is not null and (f is null or said > f) as absent from c full join absences using (zone, tile_id))
  select zone, tile_id, absent, case when not absent then archive end as archive, case when not absent then digest end::double as digest, case when absent then said else f end as fetched from b""")
register("index_lookup", ("archive_entries", "tile_puts"), lambda e, p: store.indexed(_fresh(p).select("zone", "tile_id").distinct(), _fresh(p).where("tile_id % 10 = 0"), e.where("zone <> 'z3'"), e.where("zone <> 'z3'")), f""", {_FRESH}, h as (select distinct zone, tile_id, true as held from archive_entries)
  select f.zone, f.tile_id, case when f.tile_id % 10 = 0 or f.zone = 'z3' or f.zone not in (select zone from archive_entries) then 'unknown' when held then 'held' else 'not held' end as lookup from (select distinct zone, tile_id from fresh) f left join h using (zone, tile_id)""")
for _first in (False, True):
    register("tile_sources" + "_absences_first" * _first, ("archive_entries", "tile_puts", "absences"), lambda e, p, a, f=_first: store.tile_sources(_fresh(p).select("zone", "tile_id").distinct(), _live(e), a, C("bytes") % 11 == 0, f), f""", {_LIVE}, {_LISTING}, {_FRESH}, g as (select distinct zone, tile_id, true as gone from absences)
  select f.zone, f.tile_id, case when {str(_first).lower()} and coalesce(gone, false) then 'absent' when digest is not null and bytes % 11 = 0 then 'absent' when digest is not null then 'store' when coalesce(gone, false) then 'absent' else 'upstream' end as source from (select distinct zone, tile_id from fresh) f left join listing using (zone, tile_id) left join g using (zone, tile_id)""")
register("extract", ("archive_entries", "tile_puts"), lambda e, p: store.extract(_fresh(p), _live(e))[0], f", {_LIVE}, {_LISTING}, {_FRESH} select * from listing semi join fresh using (zone, tile_id)")
register("extract_missing", ("archive_entries", "tile_puts"), lambda e, p: store.extract(_fresh(p), _live(e))[1], f", {_LIVE}, {_LISTING}, {_FRESH} select zone, count(*) as missing, min(tile_id) as least from (select distinct zone, tile_id from fresh) anti join listing using (zone, tile_id) group by 1")
register("merge_ranges", ("archive_entries",), lambda e: store.merge_ranges(e, "zone", "tile_id", 8), """, d as (select distinct zone, tile_id from archive_entries), f as (select *, coalesce(cast(tile_id - lag(tile_id) over (partition by zone order by tile_id) > 8 as int), 0) as far from d),
  g as (select *, sum(far) over (partition by zone order by tile_id) as run from f) select zone, min(tile_id) as start, max(tile_id) as "end", count(*) as members from g group by zone, run""")
_SPANS = "spans as (select distinct zone, tile_id * 300 as start, tile_id * 300 + bytes * 7 as \"end\" from archive_entries)"


def _spans(e):
    return e.select("zone", (C("tile_id") * 300).alias("start"), (C("tile_id") * 300 + C("bytes") * 7).alias("end")).repartition(tasks(e), "zone", "start").distinct()


register("merged_spans", ("archive_entries",), lambda e: ranges.merged(_spans(e), "zone"), f""", {_SPANS}, f as (select *, coalesce(cast(start > max("end") over (partition by zone order by start, "end" rows between unbounded preceding and 1 preceding) + 1 as int), 0) as far from spans),
  g as (select *, sum(far) over (partition by zone order by start, "end" rows between unbounded preceding and current row) as run from f) select zone, min(start) as start, max("end") as "end" from g group by zone, run""")
for _whole, _limit in ((True, 'greatest(last, "end") - "first"'), (False, '"end" - "first"')):
    register("coalesced_fetches" if _whole else "coalesced_spans", ("archive_entries",), lambda e, w=_whole: ranges.coalesced(_spans(e), "zone", 400, 6000, w), f""", {_SPANS}, o as (select *, row_number() over (partition by zone order by start, "end") as i from spans),
  folded as (select zone, unnest(list_reduce(list_concat([[[-1, -1, 0]]], list([[start, "end", 1]] order by i)), lambda acc, s: case when acc[len(acc)][3] > 0 and s[1][1] <= acc[len(acc)][2] + 400 and {'greatest(acc[len(acc)][2], s[1][2])' if _whole else 's[1][2]'} - acc[len(acc)][1] <= 6000
    then list_concat(acc[1:len(acc) - 1], [[acc[len(acc)][1], greatest(acc[len(acc)][2], s[1][2]), acc[len(acc)][3] + 1]]) else list_concat(acc, s) end)) as f from o group by zone)
  select zone, f[1] as start, f[2] as "end", f[3] as serves from folded where f[3] > 0""")
register("block_plan", ("archive_entries",), lambda e: ranges.block_plan(e.select(C("digest").alias("frame"), (C("tile_id") * 300).alias("start"), (C("tile_id") * 300 + C("bytes") * 7).alias("end")), 1024), """, b as (select digest as frame, unnest(range(tile_id * 300 // 1024, (tile_id * 300 + bytes * 7 + 1023) // 1024)) as block from archive_entries)
  select block, max(frame) as frame from b group by 1""")
_BOXES = "boxes as (select l_suppkey % 20 as level, x0, x0 + w as x1, y0, y0 + w as y1 from (select distinct l_suppkey, l_partkey % 997 as x0, l_partkey % 463 as y0, l_linenumber * 40 as w from (select tile_id as l_partkey, digest % 1000 as l_suppkey, bytes % 7 as l_linenumber from archive_entries)))"


def _boxes(e):
    return e.select((C("digest") % 1000 % 20).alias("level"), (C("tile_id") % 997).alias("x0"), (C("tile_id") % 463).alias("y0"), (C("bytes") % 7 * 40).alias("w")).distinct().select("level", "x0", (C("x0") + C("w")).alias("x1"), "y0", (C("y0") + C("w")).alias("y1"))


register("available_tiles", ("addresses", "archive_entries"), lambda t, e: ranges.available(t.where("grid = 'geographic'").select("level", "x", "y").distinct(), _boxes(e)).select("level", "x", "y"), f", {_BOXES} select distinct t.level, t.x, t.y from addresses t where grid = 'geographic' and exists (select 1 from boxes b where b.level = t.level and t.x between b.x0 and b.x1 and t.y between b.y0 and b.y1)")
