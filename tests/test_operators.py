"""Operators without SQL: files, streams, images; and rules on cases of their own."""

import gzip
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian import extensions
from meridian.functions import colour, grid, text
from meridian.operators import caches, deal, edits, frames, images, light, measure, ranges, seams, series, solve, store, terrain
from meridian.plans import registry
from meridian.plans.views import view
from meridian.sources import archives, datasets, documents, fixed_width, logs, meshes, sidecar
from meridian.streaming import publish


def nodes(plan):
    """All nodes of a plan that was run, those of its stages among them."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan] + [n for p in inner for n in nodes(p)]


def rows_out(df, kind):
    """The rows that each node of a kind gave when ``df`` was written."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return [n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if kind in n.getClass().getSimpleName()]


def test_archive_ids(spark):
    """Known ids of the curve, and each address back from its id, at every level."""
    rows = [("web-mercator", z, x, y) for z in range(4) for x in range(1 << z) for y in range(1 << z)] + [("geographic", 0, 1, 0), ("web-mercator", 31, 2**31 - 1, 5), ("geographic", 30, 2**31 - 1, 2**30 - 1), ("web-mercator", 2, 4, 0), ("geographic", 31, 0, 0)]
    d = spark.createDataFrame(rows, "grid string, level long, x long, y long").withColumn("id", grid.to_id(F.col("grid"), F.col("level"), F.col("x"), F.col("y"))).withColumn("at", grid.from_id(F.col("grid"), F.col("id")))
    got = {(r.grid, r.level, r.x, r.y): (r.id, r["at"]) for r in d.collect()}
    assert [got["web-mercator", 1, *xy][0] for xy in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]
    assert sorted(i for (g, z, *_), (i, _) in got.items() if g == "web-mercator" and z < 4 and i is not None) == list(range(85))
    assert got["web-mercator", 2, 4, 0] == (None, None) and got["geographic", 31, 0, 0] == (None, None)
    assert all(tuple(at) == key[1:] for key, (i, at) in got.items() if i is not None)


def test_tiering_cases(spark):
    """A similar run before a cheaper unlike one, unlike ones only beyond the cap, an empty archive as one byte, and runs of one epoch only."""

    def chosen(sizes, most=16, epochs=None):
        rows = [("z", (epochs or ["e"] * len(sizes))[i], f"a{i}", b) for i, b in enumerate(sizes)]
        return [(r["first"], r.cost, r.forced) for r in store.tiering_select(spark.createDataFrame(rows, "zone string, epoch string, archive string, bytes long"), 3, 4.0, most).collect()]

    assert chosen([1, 100, 1, 50, 60, 70]) == [("a3", 180, False)]
    assert chosen([1, 100, 1, 1000]) == [] and chosen([1, 100, 1, 1000], 3) == [("a0", 102, True)]
    assert chosen([0, 4, 4]) == [("a0", 8, False)] and chosen([0, 5, 4]) == []
    assert chosen([9, 9, 9], epochs=["d", "e", "e"]) == []


def test_greedy_fetches(spark):
    spans = [(0, 10), (12, 20), (100, 5000), (101, 102), (5001, 5002), (9000, 9001)]
    d = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, start long, end long")
    got = sorted((r.start, r.end, r.serves) for r in ranges.coalesced(d, "k", gap=90, most=1000).collect())
    assert got == [(0, 20, 2), (100, 5000, 1), (101, 102, 1), (5001, 5002, 1), (9000, 9001, 1)]
    assert ranges.coalesced(d.where("false"), "k").count() == 0


def test_smoothing():
    """No delay, a constant stays, an unfit time constant changes nothing, and pieces with the margin equal the whole."""
    v = np.sin(np.arange(400) / 25) + np.random.default_rng(1).normal(0, 0.2, 400)
    s = series.smooth(v, 0.1, 0.5)
    assert np.allclose(series.smooth(np.full(50, 3.5), 0.1, 0.5), 3.5)
    assert series.low_pass(1.0, 0.3) is None and (series.smooth(v, 1.0, 0.3) == v).all() and series.low_pass(0.0, 1.0) is None
    assert np.abs(s[50:350] - np.sin(np.arange(400) / 25)[50:350]).max() < 0.25 and np.std(np.diff(s)) < np.std(np.diff(v)) / 5
    assert series.envelope_margin(0.1, 0.5) == math.ceil(21 * 0.5 / 0.1)
    m = series.envelope_margin(0.1, 0.5)
    piece = series.smooth(v[150 - m : 250 + m], 0.1, 0.5)[m : m + 100]
    assert np.allclose(piece, s[150:250], atol=1e-4)


def test_pursuit():
    t = np.concatenate([np.zeros(5), np.full(200, 3.0)])
    a = series.pursue(t, 0.1, 0.8, 0.5)
    rate = np.diff(a) / 0.1
    assert a[0] == 0 and abs(a[-1] - 3) < 0.05 and np.abs(rate).max() <= 0.8 + 1e-9 and np.abs(np.diff(rate)).max() <= 0.05 + 1e-9
    assert series.pursue(np.zeros(0), 0.1, 1, 1).size == 0


def test_image_measures():
    rng = np.random.default_rng(3)
    a = rng.random((32, 32, 3)).astype(np.float32)
    assert images.psnr_y(a, a) == pytest.approx(120) and images.ssim_y(a, a) == pytest.approx(1) and images.delta_e(a, a) == 0 and images.structure(a, a, 2.0) == pytest.approx(1)
    white, black = images.lab(np.ones((1, 3))), images.lab(np.zeros((1, 3)))
    assert white[0] == pytest.approx([100, 0, 0], abs=0.02) and black[0] == pytest.approx([0, 0, 0])
    # published pairs of the colour difference
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082), ((50, 0, 0), (50, -1, 2), 2.3669)]
    for x, y, want in pairs:
        assert images.ciede2000(np.array([x], float), np.array([y], float))[0] == pytest.approx(want, abs=1e-4)
    assert images.box_down2(np.arange(27).reshape(3, 3, 3)).tolist() == [[[6.0, 7.0, 8.0]]]
    assert images.bicubic(np.full((4, 4, 3), 0.25, np.float32), 4) == pytest.approx(0.25) and images.bicubic(a, 2).shape == (64, 64, 3)
    given = images.reduced(a, 2)
    fixed = images.back_project(images.bicubic(given, 2), given, 2)
    assert np.abs(images.reduced(fixed, 2) - given).mean() < 0.02
    seam = np.full((16, 32, 3), 0.5, np.float32)
    seam[:, 16:] += 0.2
    assert images.seam_score(seam + rng.normal(0, 0.001, seam.shape), 16) > 20
    f, p = images.radial_spectrum(images.lowpass(a, 3.0), 8)
    assert len(f) == len(p) == 8 and p[0] > p[-1]
    child = images.lowpass(rng.random((64, 64, 3)).astype(np.float32), 2.0)
    assert images.check_pair(images.box_down2(child), child)["kind"] == "same"
    assert images.check_pair(images.box_down2(child) * 0.6, child)["kind"] == "tinted"
    assert images.check_pair(images.lowpass(rng.random((32, 32, 3)).astype(np.float32), 2.0), child)["kind"] == "other"
    assert images.degraded(a, 1.0, 1, 0.02, [1, 2]).shape == (16, 16, 3) and (images.degraded(a, 1.0, 1, 0.02, [1, 2]) == images.degraded(a, 1.0, 1, 0.02, [1, 2])).all()


def test_jpeg_quality():
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    for q in (30, 50, 75, 92):
        scale = 5000 / q if q < 50 else 200 - 2 * q
        table = np.clip(np.floor((images.IJG_LUMA * scale + 50) / 100), 1, 255).astype(np.uint8)
        raw = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xdb\x00\x43\x00" + table[zigzag].tobytes() + b"\xff\xda\x00\x02"
        assert abs(images.jpeg_quality(raw) - q) <= 1
    assert images.jpeg_quality(b"") == images.jpeg_quality(b"\xff\xd8\xff\xda") == 90


def test_measured_tables(spark):
    rows = [(i, [0.1 * (i + j % 5) for j in range(192)], [0.1 * (i + j % 5) + 0.01 for j in range(192)]) for i in range(3)]
    got = images.measured(spark.createDataFrame(rows, "id long, a array<double>, b array<double>"), ["id"], 8, {"psnr": images.psnr_y, "cast": images.colour_cast}).collect()
    assert [r.id for r in sorted(got)] == [0, 1, 2] and all(r.psnr > 30 for r in got)


def test_directories():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 500):
        v = rng.integers(0, 2**62, n, dtype=np.uint64) >> rng.integers(0, 62, n).astype(np.uint64)
        assert (archives.varints(archives.put_varints(v)) == v).all()
        d = {"tile_id": np.cumsum(rng.integers(1, 9, n)), "run_length": rng.integers(1, 4, n), "length": rng.integers(1, 300, n), "offset": rng.integers(0, 10**6, n)}
        d["offset"][1::2] = (d["offset"][0::2] + d["length"][0::2])[: len(d["offset"][1::2])]
        back = archives.parse_directory(archives.serialize_directory(d))
        assert all((back[k] == d[k]).all() for k in d)
    with pytest.raises(ValueError):
        archives.parse_header(b"PMTiles\x02")


def test_archives(spark, tmp_path):
    """Tiles of two zones come back from their archives, copies are stored once, and a listing reads no tile."""
    rows = [("a", i, b"same" if i in (3, 4, 5) else b"tile %d" % i) for i in range(1, 40)] + [("b", 7, b"same"), ("b", 9, None)]
    made = archives.write(spark.createDataFrame(rows, "zone string, tile_id long, data binary"), f"file://{tmp_path}/out").collect()
    assert {r.zone: r.tiles for r in made} == {"a": 39, "b": 2}
    paths = {r.archive: r.zone for r in made}
    listed = archives.listing(spark, list(paths))
    assert listed.where("run_length = 3").count() == 1
    got = sorted((paths[r.archive], r.tile_id, bytes(r["data"])) for r in archives.tiles(listed).collect())
    assert got == sorted((z, i, d or b"") for z, i, d in rows)
    with pytest.raises(ValueError):
        archives.build([2, 1], [b"", b""])


def test_sidecar(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, True), (2, float("nan"), False), (3, float("-inf"), True), (4, None, None)], "frame long, luma double, pictured boolean")
    sidecar.write_rows(df, f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").where("luma is null").count() == 3
    back = {r.frame: r.luma for r in sidecar.read_rows(spark, f"file://{tmp_path}/s", df.schema).collect()}
    assert back[1] == 0.5 and all(math.isnan(back[i]) for i in (2, 3, 4))
    with pytest.raises(ValueError, match="no column"):
        sidecar.read_rows(spark, f"file://{tmp_path}/s", df.withColumn("more", F.lit(1)).schema)
    with pytest.raises(ValueError, match="not float"):
        sidecar.read_rows(spark, f"file://{tmp_path}/s", df.withColumn("luma", F.col("luma").cast("float")).schema)


def test_stars(spark, tmp_path):
    def line(hr, ra, dec, v, bv="", pm=""):
        out = [" "] * 160
        for at, s in ((1, hr), (76, ra), (84, dec), (103, v), (110, bv), (149, pm)):
            out[at - 1 : at - 1 + len(s)] = s
        return "".join(out).rstrip()

    lines = [line("   1", "000509.9", "+451345", " 6.70", "+0.07", "-0.012"), line("   2", "000503.8", "-003011", " 6.29"), line("   3", "", "", "5.0"), line("   4", "000503.8", "-003011", ""), "note"]
    path = tmp_path / "stars.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    rows = fixed_width.read_stars(spark, f"file://{path}", hashlib.sha256(path.read_bytes()).hexdigest()).collect()
    assert [r.hr for r in rows] == [1, 2] and rows[0].b_v_mag == 0.07 and rows[1].b_v_mag is None and rows[0].pm_ra_cosdec_arcsec_per_year == -0.012
    assert rows[1].dec_j2000_deg == pytest.approx(-(0 + 30 / 60 + 11 / 3600)) and rows[0].ra_j2000_deg == pytest.approx((5 / 60 + 9.9 / 3600) * 15)
    with pytest.raises(ValueError, match="digest"):
        fixed_width.read_stars(spark, f"file://{path}", "00")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fixed_width.parse_stars(spark.createDataFrame([(line("   5", "00x503.8", "-003011", "5.00"),)], "value string")).collect()
    fixed_width.write_stars(fixed_width.parse_stars(spark.createDataFrame([(x,) for x in lines], "value string")), f"file://{tmp_path}/p")
    assert fixed_width.load_stars(spark, f"file://{tmp_path}/p").count() == 2


def test_publishing(spark, tmp_path):
    """Three batches of a stream: later fetches win within one, identical and older offers are left out, a replayed batch publishes nothing twice."""
    batches = [[("z", 1, 5, 10, 100, 1), ("z", 1, 6, 10, 101, 2), ("z", 2, 7, 10, 100, 3)], [("z", 1, 6, 10, 200, 4), ("z", 2, 8, 10, 50, 5), ("y", 1, 1, 1, 1, 6)], [("z", 2, 9, 10, 300, 7)]]
    at, out = f"{tmp_path}/in", f"file://{tmp_path}/store"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, publish.FRESH).coalesce(1).write.mode("append").parquet(f"file://{at}")
        publish.publishing(spark.readStream.schema(publish.FRESH).parquet(f"file://{at}"), out, f"file://{tmp_path}/cp", "e").awaitTermination()
    held = sorted((r.zone, r.archive, r.tile_id, r.digest) for r in publish.stored(spark, out).collect())
    assert held == [("y", "e-000000001", 1, 1), ("z", "e-000000000", 1, 6), ("z", "e-000000000", 2, 7), ("z", "e-000000002", 2, 9)]
    publish.publish(spark.createDataFrame(batches[2], publish.FRESH), 2, out, "e")
    assert publish.stored(spark, out).count() == 4


def test_small_rules(spark):
    d = spark.createDataFrame([("a/b", "bytes=0-4", "1995-03-04T10:20"), ("../a", "bytes=4-", "1e3"), ("", None, "soon")], "k string, r string, t string")
    got = d.select(text.safe_key(F.col("k")).alias("s"), text.byte_range(F.col("r"), F.lit(10).cast("long"), 5, 3).alias("b"), text.parse_utc(F.col("t")).alias("t"), text.sniff(F.lit(b"b3dm1234")).alias("f"), text.sniff(F.lit(b"pnts")).alias("u")).collect()
    assert [r.s for r in got] == [True, False, False] and [r.b and tuple(r.b) for r in got] == [(0, 5, True), (4, 7, True), None] and got[1].t == 1000 and got[2].t is None and got[0].t == 794312400
    assert got[0].f == "b3dm" and got[0].u is None
    one = spark.range(1).select(*[c.alias(n) for n, c in zip("rgb", colour.body_colour(F.lit(5772.0)))]).first()
    assert [one.r, one.g, one.b] == pytest.approx([1, 1, 1])
    empty = spark.createDataFrame([("a", 0, 0.0)], "k string, bin long, n double")
    assert light.kept_quantile(empty, "k", 0.5, 4).first().light == -light.DEPTH and light.kept_share(empty, "k", -1.0, 4).first().share == 0


def test_windows_of_tiles(spark):
    tiles = spark.createDataFrame([(tx, 0, px, py, float(100 * tx + 10 * px + py)) for tx in (0, 1) for px in range(4) for py in range(4)], "tx long, ty long, px long, py long, v double")
    got = sorted((r.x, r.y, r.v) for r in images.window(tiles, 4, 3, 1, 2, 2).collect())
    assert got == [(0, 0, 31.0), (0, 1, 32.0), (1, 0, 101.0), (1, 1, 102.0)]
    assert images.window(tiles, 4, 6, 1, 4, 2).count() == 0


def test_kept_by_eyes(spark):
    """Ground right below a low eye is kept at fine levels; what lies beyond the horizon is not, however large its tile."""
    eyes = spark.createDataFrame([(0.0, 0.0, 5000.0)], "lon double, lat double, height double")
    at = spark.createDataFrame([("web-mercator", 12, 2048, 2047), ("web-mercator", 12, 2048 + 300, 2047), ("web-mercator", 1, 1, 0), ("web-mercator", 3, 7, 3), ("geographic", 11, 2048, 1024)], "grid string, level long, x long, y long")
    got = sorted((r.grid, r.level, r.x) for r in measure.footprint_keeps(at, eyes).collect())
    assert got == [("geographic", 11, 2048), ("web-mercator", 1, 1), ("web-mercator", 12, 2048)]


def test_models_and_meshes(spark):
    raw = meshes.build_b3dm(b"glTF" + b"x" * 13)
    parts = meshes.parse_b3dm(raw)
    assert len(raw) % 8 == 0 and parts["model"].startswith(b"glTF") and parts["feature_json"].strip() == b'{"BATCH_LENGTH":0}'
    with pytest.raises(ValueError):
        meshes.parse_b3dm(raw[:20])
    u, v = np.meshgrid(np.linspace(0, 1, 5), np.linspace(0, 1, 5))
    n = [(r * 5 + c) for r in range(4) for c in range(4)]
    triangles = np.array([t for i in n for t in ((i, i + 1, i + 5), (i + 1, i + 6, i + 5))])
    order = {}
    for i in triangles.ravel().tolist():
        order.setdefault(i, len(order))
    place = np.array(sorted(order, key=order.get))
    mesh = {"centre": (1.0, 2.0, 3.0), "low": -10.0, "high": 90.0, "sphere": (0.0, 0.0, 0.0, 5.0), "horizon": (0.0, 0.0, 1.0), "u": u.ravel()[place], "v": v.ravel()[place], "height": (u * v).ravel()[place], "triangles": np.vectorize(order.get)(triangles), "edges": {"west": [order[0], order[5]], "south": [], "east": [order[4]], "north": [order[24]]}, "extensions": {1: b"abc"}}
    raw = meshes.build_mesh(mesh)
    back = meshes.parse_mesh(raw)
    assert np.abs(back["u"] - mesh["u"]).max() < 1e-4 and (back["triangles"] == mesh["triangles"]).all() and back["edges"]["west"].tolist() == [order[0], order[5]] and back["extensions"] == {1: b"abc"}
    got = meshes.mesh_vertices(spark.createDataFrame([(7, raw), (8, None)], "tile_id long, data binary")).collect()
    assert len(got) == 25 and {r.tile_id for r in got} == {7} and max(r.height for r in got) == pytest.approx(90, abs=0.01)
    with pytest.raises(ValueError):
        meshes.build_mesh(mesh | {"triangles": np.array([[0, 2, 1]])})


def test_logs(spark, tmp_path):
    a = spark.createDataFrame([("/camera", 10 * i, i, bytes([i // 3])) for i in range(8)], logs.SCHEMA)
    b = spark.createDataFrame([("/sky", 5, 0, b"s"), ("/sky", 5, 1, b"t")], logs.SCHEMA)
    whole = logs.merged([a, b])
    assert [(r.topic, r.seq) for r in logs.ordered(whole).collect()][:4] == [("/camera", 0), ("/sky", 0), ("/sky", 1), ("/camera", 1)]
    assert {r.topic: r.n for r in logs.topic_counts(whole).collect()} == {"/camera": 8, "/sky": 2} and logs.replay(whole, "/sky").count() == 2
    with pytest.raises(ValueError, match="/camera is in 2"):
        logs.merged([a, a])
    coded = logs.channel(a, 100, 10)
    assert sorted((r.log_time, r.hold) for r in coded.collect()) == [(100, 3), (130, 3), (160, 2)]
    assert [bytes(r["data"]) for r in logs.expanded(coded, 10).orderBy("log_time").collect()] == [bytes([i // 3]) for i in range(8)]
    logs.write(whole, f"file://{tmp_path}/log")
    (tmp_path / "log" / "part-99999.parquet").write_bytes(b"PAR1 broken")
    assert logs.recovered(spark, f"file://{tmp_path}/log").count() == 10


def test_documents(spark, tmp_path):
    at = f"file://{tmp_path}/catalogue.json"
    assert documents.layers(spark, at).count() == 0 and documents.manifest(spark, at).count() == 0
    (tmp_path / "catalogue.json").write_text('{"layers": [{"name": "sat", "grid": "geographic", "zone_level": 6}]}')
    assert sorted(r.name for r in documents.layers(spark, at).collect()) == ["sat", "sat.absent"]
    (tmp_path / "wrong.json").write_text('{"layers": [{"name": "sat.absent"}]}')
    with pytest.raises(ValueError):
        documents.layers(spark, f"file://{tmp_path}/wrong.json")
    m = f"file://{tmp_path}/manifest.json"
    assert documents.replace_manifest(spark, m, 0, [{"key": "a", "epoch": "d"}, {"key": "b", "epoch": "d"}], [])
    assert not documents.replace_manifest(spark, m, 0, [], []) and documents.generation(spark, m) == 1
    found = spark.createDataFrame([("b",), ("z",), ("y",)], "key string")
    assert [r.key for r in documents.listed(documents.manifest(spark, m), found).collect()] == ["b", "a", "y", "z"]
    keys = spark.createDataFrame([("films/r1/part-0001.mp4",), ("films/r1/part-0002.mp4",), ("films/r1.ready",), ("films/r2/part-0001.mp4",), ("films/x",)], "key string")
    assert sorted((r.run, r.chunk) for r in documents.runs(keys, "films/{run}/part-{index}.mp4", "films/{run}.ready").collect()) == [("r1", 1), ("r1", 2)]
    tree = '{"root": {"geometricError": 8, "boundingVolume": {"sphere": [0, 0, 0, 1]}, "refine": "add", "children": [{"geometricError": 4, "boundingVolume": {"sphere": [0, 0, 0, 1]}, "content": {"uri": "a.glb"}}, {"geometricError": 2, "refine": "REPLACE", "boundingVolume": {"sphere": [1, 0, 0, 1]}}]}}'
    rows = documents.tile_sets(spark.createDataFrame([("s", tree)], "set string, text string"))
    assert sorted((r.id, r.parent, r.refine, r.content) for r in rows.collect()) == [(0, None, "ADD", None), (1, 0, "ADD", "a.glb"), (2, 0, "REPLACE", None)]
    both = documents.grafted(rows, 1, rows)
    assert sorted((r.id, r.parent, r.depth) for r in both.collect())[3:] == [(3, 1, 2), (4, 3, 3), (5, 3, 3)]
    assert documents.terrain_ranges('{"available": [[{"startX": 0, "startY": 0, "endX": 1, "endY": 0}], []]}') == [(0, 0, 1, 0, 0)]


def test_extensions(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5, 2.0), (1, 1.5, 3.0), (2, 0.0, 1.0)], "k long, a double, b double")
    assert [r.h for r in d.select(extensions.heights_of(lambda lon, lat: lon + lat, F.col("a"), F.col("b")).alias("h")).collect()] == [2.5, 4.5, 1.0]
    assert sorted((r.k, r.most) for r in extensions.observed(d, ["k"], {"most": lambda g: g["b"].max()}).collect()) == [(1, 3.0), (2, 1.0)]
    img = spark.createDataFrame([(1, [0.5] * 12)], "id long, image array<double>")
    assert len(extensions.upscaled(img, "id", 2, 2, lambda v: np.stack([images.bicubic(x, 2) for x in v])).first().image) == 48
    asked = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 1)], "level long, x long, y long")
    held = spark.createDataFrame([(1, 0, 0, b"held")], "level long, x long, y long, data binary")
    got = sorted((r.y, bytes(r["data"])) for r in extensions.backed_by(held, asked, lambda level, x, y: f"{level}/{x}/{y}".encode()).collect())
    assert got == [(0, b"held"), (1, b"1/0/1")]
    made = archives.write(spark.createDataFrame([("a", 5, b"x"), ("a", 6, b"x")], "zone string, tile_id long, data binary"), f"file://{tmp_path}/out").first()
    extensions.register(spark)
    assert [(r.tile_id, r.run_length) for r in spark.read.format("tile_archive").option("paths", made.archive).load().collect()] == [(5, 2)]


def test_level_gains(spark):
    """Three sources along a chain of levels: gains add up from the anchor, near levels are one source, and outliers and weightless rows don't move them."""
    steps = {(10, 9): 0.02, (11, 10): 0.5, (12, 11): -0.03, (13, 12): 0.7}
    rows = [(a, b, g, g / 2, 0.0, 1.0) for (a, b), g in steps.items() for _ in range(5)] + [(11, 10, 9.0, 9.0, 9.0, 1.0), (13, 9, 5.0, 5.0, 5.0, 0.0), (9, 9, 1.0, 1.0, 1.0, 3.0)]
    got = solve.level_gains(spark.createDataFrame(rows, "level long, ancestor long, r double, g double, b double, weight double"), anchor=10)
    assert {x: s for x, (s, _) in got.items()} == {9: 9, 10: 9, 11: 11, 12: 11, 13: 13}
    assert got[10][1] == (0, 0, 0) and got[12][1][0] == pytest.approx(0.5, abs=1e-3) and got[13][1][0] == pytest.approx(1.2, abs=1e-3) and got[13][1][1] == pytest.approx(0.6, abs=1e-3)
    assert solve.level_gains(spark.createDataFrame([], "level long, ancestor long, r double, g double, b double, weight double")) == {}


def test_gain_fields():
    n = solve.BLOCKS
    flat = solve.gain_field(np.full((n, n, 3), 0.25), np.ones((n, n)), np.full(3, 0.25))
    assert flat.shape == (n + 1, n + 1, 3) and np.abs(flat[4:-4, 4:-4] - 256).max() <= 2
    wild = np.full((n, n, 3), 0.25)
    wild[8, 8] = 1.4
    trust = np.ones((n, n))
    trust[8, 8] = 0.0
    assert np.abs(solve.gain_field(wild, trust, np.full(3, 0.25))[8, 8].astype(int) - 256).max() <= 4
    assert solve.field_at(flat, 0.5, 0.5) == pytest.approx(0.25, abs=0.01)
    high = np.full((n + 1, n + 1, 3), 1400, np.int16)
    assert solve.chained(high, high, (1, 0)).max() == round(1.5 * solve.UNITS) and (solve.chained(high, high * 0, (0, 0)) == high).all()


def test_caches(spark):
    steps = [("a", 4), ("b", 4), ("a", 5), ("c", 3), ("d", 20), ("e", 10)]
    assert caches.lru(iter(steps), 10) == [[], [], [], ["b"], ["d"], ["a", "c"]]
    d = spark.createDataFrame([("x", i, k, w) for i, (k, w) in enumerate(steps)], "cache string, at long, key string, weight long")
    assert [r.evicted for r in caches.evictions(d, "cache", "at", 10).orderBy("at").collect()] == caches.lru(iter(steps), 10)
    assert caches.relaxed(np.array([1, 2, 0, -1]), np.array([1_000_000] * 4), 500, 300, 3000).tolist() == [1500, 3000, 2700, 2700]


def test_seams(spark):
    """A coarse tile beside two fine ones, around the globe; a pole has no side; what nobody faces is bare."""
    d = spark.createDataFrame([("f", 1, 0, 0), ("f", 2, 2, 0), ("f", 2, 2, 1), ("f", 1, 3, 0)], "frame string, level long, x long, y long")
    pairs = sorted((r.a_level, r.a_x, r.b_level, r.b_x, r.share) for r in seams.shared(d, "frame").where("upright").collect())
    assert pairs == [(1, 0, 2, 2, 0.5), (1, 0, 2, 2, 0.5), (1, 3, 1, 0, 1.0)]
    bare = {(r.level, r.x, r.y, r.side): r.bare for r in seams.uncovered(d, "frame").collect()}
    assert (1, 0, 0, "south") not in bare and (1, 0, 0, "east") not in bare and bare[1, 0, 0, "north"] == 1 and bare[1, 3, 0, "west"] == 1


def test_runs_resume(spark, tmp_path):
    """A run stops at its budget, goes on where it stopped, shares its samples among ranks, and outputs are found by their keys."""
    import pandas as pd

    at = f"file://{tmp_path}/run"
    samples = spark.range(40).select(F.col("id").alias("sample"))
    assert datasets.results(spark, at).count() == 0 and datasets.output(spark, at, "f", "i", 3) is None

    def work(b):
        n = len(b)
        return pd.DataFrame({"sample": b["sample"], "z": [1] * n, "x": [0] * n, "y": [0] * n, "input": ["i"] * n, "family": ["f"] * n, "scale": [2] * n, "seconds": [0.0] * n, "png": [b"p%d" % s for s in b["sample"]]})

    first = datasets.run(samples, at, work, 0, 2, budget=0.0, batch=3)
    assert 0 < first < 20
    assert datasets.run(samples, at, work, 0, 2) == 20 - first and datasets.run(samples, at, work, 0, 2) == 0
    assert datasets.run(samples, at, work, 1, 2) == 20
    got = datasets.results(spark, at)
    assert sorted(r.sample for r in got.collect()) == list(range(40)) and datasets.output(spark, at, "f", "i", 7) == b"p7"
    assert datasets.local(got, got.select("launch").limit(1)).count() in (first, 20 - first, 20)
    assert datasets.is_current(got, samples, ["sample"]) and not datasets.is_current(got, spark.range(41).select(F.col("id").alias("sample")), ["sample"])


def test_datasets(spark, tmp_path):
    for z, x, y in ((1, 0, 0), (1, 0, 1)):
        (tmp_path / f"t/{z}/{x}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"t/{z}/{x}/{y}.jpg").write_bytes(b"old%d" % y)
    (tmp_path / "t/notes.jpg").write_bytes(b"")
    old = datasets.tile_tree(spark, f"file://{tmp_path}/t")
    new = spark.createDataFrame([(1, 0, 1, b"new")], "z long, x long, y long, data binary")
    assert sorted((r.y, bytes(r["data"])) for r in datasets.newest_first([new, old]).collect()) == [(0, b"old0"), (1, b"new")]
    index = spark.createDataFrame([(1, "same"), (2, None), (3, "other")], "sample long, near string")
    datasets.save_dataset(index, f"file://{tmp_path}/d", {"scale": 2}, ["a"], ["near"])
    back, manifest = datasets.load_dataset(spark, f"file://{tmp_path}/d")
    assert back.count() == 3 and manifest["samples"] == 3 and manifest["classes"]["near"] == {"same": 1, "tinted": 0, "other": 1}
    datasets.report({"index": index}, f"file://{tmp_path}/r")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/r/index").count() == 3


def test_edit_logs(spark):
    rows = [("g", 1, 1, True, 0.0, 0.0, 1.0, 1.0), ("g", 2, 3, True, 0.0, 0.0, 9.0, 9.0), ("g", 3, 2, False, 0.0, 0.0, 9.0, 9.0), ("g", 4, 3, True, 3.5, 0.0, 4.5, 0.5), ("g", 5, 2, True, 0.0, 0.0, 1.0, 1.0)]
    log = edits.judged(spark.createDataFrame(rows, "ground string, arrival long, seq long, valid boolean, x0 double, y0 double, x1 double, y1 double"), "ground")
    assert [r.outcome for r in log.orderBy("arrival").collect()] == ["applied", "gap", "consumed", "applied", "stale"]
    assert sorted((r.tx, r.ty, r.version) for r in edits.versions(log, "ground", 16.0, 2).collect()) == [(0, 0, 2), (1, 0, 1)]
    a, b = edits.replica_digest(log, "ground").first(), edits.replica_digest(log.where("outcome in ('applied', 'consumed')"), "ground").first()
    assert a == b and a.last == 3 and edits.replica_digest(log.where("seq < 3"), "ground").first().digest != a.digest
    events = spark.createDataFrame([(1, "a", 1, "loaded"), (1, "a", 1, "loaded"), (1, "b", 1, "loaded"), (2, "c", 4, "failed")], "step long, resource string, generation long, kind string")
    loads = spark.createDataFrame([("a", 1), ("b", 2)], "resource string, generation long")
    assert sorted((r.resource, r.stale) for r in edits.settled(events, loads).collect()) == [("a", False), ("a", True), ("b", True), ("c", True)]
    late = spark.createDataFrame([("a", 0, None), ("b", 90, 50), ("c", 90, 95)], "resource string, started long, unneeded_since long")
    assert sorted(map(tuple, edits.overdue(late, 100, 100, 50).collect())) == [("a", "timeout"), ("b", "unneeded")]
    assert edits.eased(np.array([0.0, 4.0, 4.0]), 0.5).tolist() == [0, 2, 3]
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 10.0, 0.0, 0.0, 1.0)], "tile long, x double, y double, z double, radius double")
    assert sorted(map(tuple, edits.nearest_content(t, [(0.0, 0.0, 0.0), (5.0, 0.0, 0.0)]).collect())) == [(1, 1.0), (2, 4.0)]
    w = spark.createDataFrame([(9, [4, 1]), (8, [3, 1]), (7, [])], "tile long, chain array<long>")
    assert sorted((r.tile, r.stand_in, r.role) for r in edits.stand_ins(w, spark.createDataFrame([(9,), (1,)], "tile long")).collect()) == [(7, None, "lost"), (8, 1, "fallback"), (9, 9, "exact")]


def test_nearest_views_of_dense_cameras(spark):
    """Dense, sparse and standing cameras: the nearest of all, the first of equals; and a dense place isn't compared pair by pair."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.random((4000, 3)) * [30, 30, 0], np.full((500, 3), 7.0), rng.random((40, 3)) * 4000])
    asks = np.concatenate([rng.random((3000, 3)) * [30, 30, 0], rng.random((40, 3)) * 4000, [[1e6, 0, 0], [7, 7, 7]]])
    v, a = ([(i, *map(float, p)) for i, p in enumerate(x)] for x in (at, asks))
    found = frames.nearest_view(spark.createDataFrame(v, "frame long, x double, y double, z double"), spark.createDataFrame(a, "ask long, x double, y double, z double"), 900.0)
    d = np.sqrt(((asks[:, None] - at[None]) ** 2).sum(axis=2))
    want = {i: int(r.argmin()) for i, r in enumerate(d) if r.min() <= 900}
    got = {r.ask: r for r in found.collect()}
    assert got.keys() == want.keys() and len(want) < len(asks) and got[len(asks) - 1].frame == 4000
    assert all(abs(r.metres - d[i].min()) < 1e-9 for i, r in got.items()) and sum(r.frame == want[i] for i, r in got.items()) >= len(want) - 2
    assert max(rows_out(found, "Join")) < 20 * len(asks)


def test_boxes_of_any_size(spark, monkeypatch):
    """Points in boxes by brute force, edges included, whether squares come to the driver or not; dense boxes aren't compared with each point."""
    rng = np.random.default_rng(8)
    low = rng.integers(0, 200, (300, 2))
    boxes = np.concatenate([low, low + rng.integers(0, 90, (300, 2))], axis=1)
    points = rng.integers(0, 300, (2000, 2))
    inside = ((points[:, None] >= boxes[None, :, :2]) & (points[:, None] <= boxes[None, :, 2:])).all(axis=2).any(axis=1)
    b = spark.createDataFrame([(i % 2, *map(float, r)) for i, r in enumerate(boxes)] + [(None, 0.0, 0.0, 9.0, 9.0)], "level long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(k, i, *map(float, r)) for i, r in enumerate(points) for k in (0, 1)], "level long, id long, px double, py double")
    of = ((points[:, None] >= boxes[None, :, :2]) & (points[:, None] <= boxes[None, :, 2:])).all(axis=2)
    want = sorted((k, i) for i in range(len(points)) for k in (0, 1) if of[i, k::2].any())
    for most in (10**6, 3):
        monkeypatch.setattr(ranges, "SQUARES", most)
        assert sorted((r.level, r.id) for r in ranges.within(p, b, ["level"], 16.0).collect()) == want and inside.any()
    found = terrain.covered(*(spark.range(400).select(F.col("id").alias("rect"), (F.col("id") % 7 * 0.01).alias("west"), F.lit(0.0).alias("south"), (F.col("id") % 5 * 0.01 + n).alias("east"), F.lit(n).alias("north")) for n in (8.0, 9.0)), 5.0)
    assert found.count() == 400
    assert max(rows_out(found, "Join")) < 100_000  # 800,000 pairs


def test_footprints_by_cubes(spark):
    """The tiles that eyes reach, by all pairs, at the poles and beside the date line too; no join without keys."""
    rng = np.random.default_rng(9)
    e = [(float(a), float(b), float(h)) for a, b, h in zip(rng.uniform(-180, 180, 40), rng.uniform(-90, 90, 40), rng.uniform(-100, 60_000, 40))] + [(179.99, 89.9, 9000.0), (-179.99, -60.0, 100.0)]
    t = [("geographic", z, x, y) for z in (0, 3, 4) for x in range(2 << z) for y in range(1 << z)] + [("web-mercator", z, x, y) for z in (0, 2, 5) for x in range(1 << z) for y in range(1 << z)]
    eyes, tiles_ = spark.createDataFrame(e, "lon double, lat double, height double"), spark.createDataFrame(t, "grid string, level long, x long, y long")
    kept = measure.footprint_keeps(tiles_, eyes)
    got = sorted(tuple(r) for r in kept.collect())
    con = duckdb.connect()
    con.register("addresses", tiles_.toPandas())
    con.register("eyes", eyes.toPandas())
    sql = registry.ORACLE["footprint_keeps"].replace(" where level between 2 and 9", "")
    want = sorted(map(tuple, con.sql("with k as " + sql.split(", k as ", 1)[1]).fetchall()))
    assert got == want and 0 < len(want) < len(t)
    assert not any("NestedLoop" in n.getClass().getSimpleName() and "Semi" in n.toString() for n in nodes(kept._jdf.queryExecution().executedPlan()))


def test_films_are_dealt(spark, monkeypatch):
    """Frames far apart follow each other; only runs are ordered by one task; a large film goes to more tasks than the session's, a tile's use needs no row moved."""
    f = [0, 1, 5, 70_000, 70_001, 10**7, -3, -200_000]
    film = spark.createDataFrame([(i, i % 3, 0) for i in f] + [(i, 9, 1) for i in f] * 2, "frame long, tile_id long, drape long")
    assert {r.frame: r.next for r in frames.following(film).collect()} == dict(zip(sorted(f), sorted(f)[1:] + [None]))
    diff = {r.frame: (r.entered, r["left"], r.kept) for r in measure.frame_diff(film).collect()}
    assert diff[-200_000] == (2, 0, 0) and diff[70_000] == (1, 1, 1) and len(diff) == len(f)
    for found in (frames.changes(film), measure.frame_diff(film)):
        windows = [n.toString() for n in nodes(found._jdf.queryExecution().sparkPlan()) if n.getClass().getSimpleName() == "WindowExec" and n.partitionSpec().isEmpty()]
        assert len(windows) == 1 and "run" in windows[0].split("windowspecdefinition")[1]
    monkeypatch.setattr(deal, "TASK_BYTES", 2000)
    made = view(spark, "/root/testdata/sf0.001", "pack_frames")
    assert deal.tasks(made) > 50 and made.rdd.getNumPartitions() > 50 and frames.compared(made, made).rdd.getNumPartitions() > 50


def test_work_is_done_once(spark, monkeypatch):
    """A black body's spectrum is summed once for its three channels, the curve is walked four bits at a time, boxes and listings are dealt before they grow."""
    d = spark.range(3).select((F.col("id") * 1000.0 + 3000).alias("k"), F.col("id").alias("x"))
    bodies = d.select(*[c.alias(n) for n, c in zip("rgb", colour.body_colour(F.col("k")))])
    assert bodies._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 3
    rows = [(z, x, y) for z in range(7) for x in range(1 << z) for y in range(1 << z)]

    def along(z, x, y):
        d = 0
        for i in range(z - 1, -1, -1):
            side, rx, ry = 1 << i, x >> i & 1, y >> i & 1
            d += side * side * ((3 * rx) ^ ry)
            x, y = x & (side - 1), y & (side - 1)
            if not ry:
                x, y = (side - 1 - y, side - 1 - x) if rx else (y, x)
        return d

    found = spark.createDataFrame(rows, "z long, x long, y long").select("*", grid.hilbert(F.col("z"), F.col("x"), F.col("y")).alias("d"))
    assert all(r.d == along(r.z, r.x, r.y) for r in found.collect()) and "CEIL" in found._jdf.queryExecution().optimizedPlan().toString()
    h = spark.range(100).select((F.col("id") % 10).alias("col"), F.floor(F.col("id") / 10).alias("row"), F.lit(2.0).alias("h"))
    boxes = spark.range(5, numPartitions=1).select(F.col("id").alias("box"), F.lit(5.0).alias("x"), F.lit(4.0).alias("y"), F.lit(2.0).alias("across"), F.lit(2.0).alias("down"))
    means = terrain.box_means(h, boxes)
    assert {r["mean"] for r in means.collect()} == {2.0}
    assert any(n.getClass().getSimpleName() == "GenerateExec" and "Exchange hashpartitioning(box" in n.toString() for n in nodes(means._jdf.queryExecution().executedPlan().inputPlan()))
    monkeypatch.setattr(deal, "TASK_BYTES", 2000)
    assert store.zone_listing(view(spark, "/root/testdata/sf0.001", "archive_entries")).rdd.getNumPartitions() > 50


def test_ranges_are_merged_by_shares(spark, monkeypatch):
    """Runs over many shares, ranges within others, gaps of a whole share, null keys; no task puts a whole key in order."""
    monkeypatch.setattr(ranges, "SHARE_BITS", 4)
    rng = np.random.default_rng(11)
    rows = [(k, int(a), int(a + n)) for k in ("a", "b", None) for a, n in zip(rng.integers(-300, 2000, 150), rng.choice([0, 3, 9, 120], 150, p=[0.4, 0.3, 0.25, 0.05]))]
    want = []
    for k in ("a", "b", None):
        out = []
        for a, b in sorted((a, b) for key, a, b in rows if key == k):
            if out and a <= out[-1][2] + 1:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([k, a, b])
        want += out
    found = ranges.merged(spark.createDataFrame(rows, "k string, start long, end long"), "k")
    order = lambda r: (str(r[0]), r[1])
    assert found.columns == ["k", "start", "end"] and sorted(map(list, found.collect()), key=order) == sorted(want, key=order)
    windows = [n.toString() for n in nodes(found._jdf.queryExecution().sparkPlan()) if n.getClass().getSimpleName() == "WindowExec"]
    assert windows and all("share" in t for t in windows)
