import pytest
from pyspark.sql import functions as F

from emberline.operators import proximity, spatial, verified
from emberline.plans import tables

SF = "/root/testdata/sf0.001"
RINGS = "array<array<struct<x:double,y:double>>>"


def box(x0, x1, y0, y1):
    x0, x1, y0, y1 = map(float, (x0, x1, y0, y1))
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(
        [(1, "way/1", "Reliance Petroleum Refinery", [box(69.95, 70.05, 22.35, 22.45)]),
         (2, "way/2", "Integrated Steel Works", [box(84.95, 85.05, 22.95, 23.05)])],
        f"poly_id long, osm_id string, name string, rings {RINGS}")


def match(spark, polygons, lon, lat, scan=0.375, **cfg):
    df = spark.createDataFrame([(1, float(lat), float(lon), scan)],
                               "detection_id long, latitude double, longitude double, scan double")
    return spatial.join_industrial(df, polygons, spatial.JoinConfig(**cfg)).first()


@pytest.mark.parametrize("lon,lat,scan,cfg,inside,exact", [
    (70.00, 22.40, 0.375, dict(buffer_m=500.0, adaptive=False), True, True),
    (70.052, 22.40, 0.375, dict(buffer_m=500.0, adaptive=False), True, False),
    (71.50, 24.00, 0.375, dict(buffer_m=500.0, adaptive=False), False, False),
    (70.06, 22.40, 1.6, dict(buffer_m=200.0, adaptive=False), False, False),
    (70.06, 22.40, 1.6, dict(buffer_m=1500.0), True, False),
    (70.07, 22.40, 0.375, dict(buffer_m=1500.0), False, False),
    (70.07, 22.40, 6.0, dict(buffer_m=1500.0), True, False),
    (70.05, 22.40, 0.375, dict(buffer_m=500.0), True, True),      # on an edge
    (70.05, 22.45, 0.375, dict(buffer_m=500.0), True, True),      # on a corner
])
def test_containment_and_buffer(spark, sites, lon, lat, scan, cfg, inside, exact):
    row = match(spark, sites, lon, lat, scan, **cfg)
    assert (row.inside_industrial, row.is_exact_match) == (inside, exact)
    assert row.facility_type == ("petrochemical_refinery" if inside else "non_industrial")
    assert row.dist_to_industrial_km == 0.0 if inside else row.dist_to_industrial_km > 1


def test_far_points_have_no_polygon(spark, sites):
    assert match(spark, sites, 71.6, 22.40).dist_to_industrial_km == 999.0
    assert match(spark, sites, 70.55, 22.40).dist_to_industrial_km == pytest.approx(55.66)


def test_holes_parts_and_overlaps(spark):
    polys = spark.createDataFrame(
        [(5, "a", [box(0, 1, 0, 1), box(0.4, 0.6, 0.4, 0.6)]),
         (3, "b", [box(0, 0.2, 0, 0.2), box(3, 3.2, 0, 0.2)])],
        f"poly_id long, name string, rings {RINGS}")
    pts = [(1, 0.5, 0.5), (2, 0.7, 0.7), (3, 0.1, 0.1), (4, 0.1, 3.1), (5, 0.1, 2.0)]
    df = spark.createDataFrame(pts, "detection_id long, latitude double, longitude double")
    got = {r.detection_id: r.hit.poly_id if r.hit else None for r in spatial.polygon_match(
        df, polys, spatial.JoinConfig(buffer_m=1.0, adaptive=False)).collect()}
    assert got == {1: None, 2: 5, 3: 3, 4: 3, 5: None}


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_crowded_and_shuffled_layers_agree(spark):
    df, polys = tables.detections(spark, SF), tables.sites(spark, SF)
    plain = spatial.join_industrial(df, polys)
    crowded = spatial.join_industrial(df, polys, spatial.JoinConfig(per_part=1, max_broadcast=-1))
    assert same(plain, crowded)


def test_forest_layer_is_optional(spark):
    df = tables.detections(spark, SF)
    assert spatial.forest_flag(df, None).where("in_forest").isEmpty()
    forests = tables.forests(spark, SF)
    assert same(spatial.forest_flag(df, forests),
                spatial.forest_flag(df, forests, per_part=1, max_broadcast=-1))


def event_rows(spark, rows):
    return spark.createDataFrame(rows, "seq long, event_name string, lat double, lon double, "
                                 "radius_km double, start string, stop string, label long").select(
        "seq", "event_name", "lat", "lon", "radius_km", F.to_date("start").alias("start_date"),
        F.to_date("stop").alias("end_date"), "label")


def tagged(spark, events, lat, lon, when):
    df = spark.createDataFrame([(1, lat, lon, when)], "detection_id long, latitude double, "
                               "longitude double, t string").withColumn(
        "timestamp_utc", F.to_timestamp("t"))
    return verified.attach_events(df, events).first().event_name


def test_event_window_and_radius(spark):
    ev = event_rows(spark, [(1, "e", 22.0, 70.0, 5.0, "2026-03-01", "2026-03-31", 1)])
    for lat, when, want in [(22.0, "2026-03-15", "e"), (22.5, "2026-03-15", None),
                            (22.0, "2026-05-15", None), (22.0, "2026-03-01", "e"),
                            (22.0, "2026-03-31 23:59:59", "e"), (22.0, "2026-02-28", None),
                            (22.0, "2026-04-01", None)]:
        assert tagged(spark, ev, lat, 70.0, when) == want
    north = event_rows(spark, [(1, "n", 60.0, 10.0, 10.0, "2026-03-01", "2026-03-31", 1)])
    assert tagged(spark, north, 60.0, 10.15, "2026-03-02") == "n"
    assert tagged(spark, north, 60.0, 10.30, "2026-03-02") is None
    pair = event_rows(spark, [(1, "big", 22.0, 70.0, 25.0, "2026-03-01", "2026-03-31", 1),
                              (2, "small", 22.0, 70.0, 2.0, "2026-03-01", "2026-03-31", 1)])
    assert tagged(spark, pair, 22.0, 70.0, "2026-03-02") == "small"


def test_radius_search(spark):
    df = spark.createDataFrame([(1, 23.75, 86.42), (2, 23.83, 86.42), (3, 24.80, 86.42)],
                               "detection_id long, latitude double, longitude double")
    near = proximity.within_km(df, 23.75, 86.42, 15.0, 10).collect()
    assert [r.detection_id for r in near] == [1, 2]
    assert near[1].distance_km == pytest.approx(8.9, abs=0.02)
    far = spark.createDataFrame([(1, 34.0837, 75.2473)], df.schema)
    assert proximity.within_km(far, 34.0837, 74.7973, 50.0).first().distance_km == \
        pytest.approx(41, abs=0.6)


def test_missing_responder_kind_is_reported(spark):
    df = spark.createDataFrame([(1, 20.0, 75.0)],
                               "detection_id long, latitude double, longitude double")
    resp = spark.createDataFrame([(7, "FIRE", "  ", 20.1, 75.0)], "responder_id long, "
                                 "responder_kind string, responder_name string, "
                                 "latitude double, longitude double")
    got = {r.responder_kind: r for r in proximity.nearest_responders(df, resp).collect()}
    assert got["FIRE"].responder_name == "Unnamed fire" and not got["FIRE"].travel.is_routed
    assert got["POLICE"].none_within_range and got["HOSPITAL"].responder_id is None


def test_crowded_tiles_keep_every_row(spark):
    """Repeated, missing and equal rows in tiles of many parts come back as often as given."""
    forests = spark.createDataFrame([(i, [box(i / 100, 1 + i / 100, 0, 1)]) for i in range(40)],
                                    f"forest_id long, rings {RINGS}")
    rows = [(1, 0.5, 0.5), (1, 5.5, 0.5), (None, 0.5, 0.7), (None, 0.5, 0.7), (None, 0.5, 7.0), (2, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "detection_id long, latitude double, longitude double")
    for per_part in (4, 64):
        got = spatial.forest_flag(df, forests, tile_deg=1.0, per_part=per_part)
        assert sorted((r.detection_id or 0, r.latitude, r.longitude, r.in_forest) for r in got.collect()) == sorted(
            (i or 0, la, lo, la < 1 and lo < 1.4) for i, la, lo in rows)


def test_search_across_the_date_line_and_a_pole(spark):
    df = spark.createDataFrame([(1, 10.0, -179.95), (2, 10.0, 179.95), (3, 10.0, 178.0), (4, 89.9, 0.0), (5, 89.9, 120.0)],
                               "detection_id long, latitude double, longitude double")
    near = lambda *a: sorted(r.detection_id for r in proximity.within_km(df, *a).collect())
    assert near(10.0, 179.99, 50.0) == near(10.0, -179.99, 50.0) == [1, 2]
    assert near(89.95, -90.0, 50.0) == [4, 5]
    places = spark.createDataFrame([("a", "FIRE", "A", 10.0, -179.9)],
                                   "responder_id string, responder_kind string, responder_name string, latitude double, longitude double")
    got = proximity.nearest_responders(df.where("detection_id < 4"), places, 1, 75.0)
    assert {r.detection_id: r.none_within_range for r in got.where("responder_kind = 'FIRE'").collect()} == {
        1: False, 2: False, 3: True}


def test_nearest_asks_each_place_once(spark):
    """Copies, missing places and map columns pass the rounds; only places travel between them."""
    polys = spark.createDataFrame([(i, [box(i * 0.3, i * 0.3 + 0.05, 0, 0.05)]) for i in range(20)], f"poly_id long, rings {RINGS}")
    places = [(0.1, 0.2), (0.1, 0.2), (None, 0.2), (0.1, None), (0.02, 0.31), (30.0, 30.0), (-0.0, 0.2)]
    df = spark.createDataFrame([(i % 4, la, lo, {"a": i}) for i, (la, lo) in enumerate(places * 3)],
                               "detection_id long, latitude double, longitude double, m map<string,int>")
    plain = spatial.nearest_km(df, polys)
    rounds = spatial.nearest_km(df, polys, spatial.JoinConfig(per_part=1, max_broadcast=-1))

    def rows(out):
        return sorted((r.detection_id, str(r.latitude), str(r.longitude), r.m["a"], r.nearest_km) for r in out.collect())

    assert rows(plain) == rows(rounds) and len(rows(plain)) == 21


def test_salted_match_join(spark):
    from emberline.operators import skew
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(None, i) for i in range(50)] + [(2, 0), (3, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "rk int, w string")
    out = skew.match_join(left, right, ["k"], ["rk"], salts=4, min_hot=100)
    assert out.columns == ["k", "v", "w"] and out.count() == 352
    assert {(r.k, r.w): r["count"] for r in out.groupBy("k", "w").count().collect()} == {
        (1, "a"): 300, (None, None): 50, (2, "b"): 1, (3, None): 1}


def test_crowded_lookup_without_named_inputs_keeps_rows_with_nulls(spark):
    from emberline.operators import tiles as T
    items = spark.createDataFrame([(float(i),) for i in range(30)], "v double")
    one_tile = (F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2))
    layer = T.build_layer(items, one_tile, F.struct("v"), 1.0, per_part=4)
    rows = [(1, 0.5, 0.5, None), (1, 0.5, 0.5, None), (None, 0.5, 0.6, "x"), (2, None, 0.5, "y")]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, note string")
    out = T.lookup(df, layer, lambda i: F.expr(f"array_max(transform({i}, p -> p.v))"), merge=F.max)
    assert sorted(((r.id, r.latitude, r.longitude, r.note), r.hit) for r in out.collect() if r.id) == [
        ((1, 0.5, 0.5, None), 29.0)] * 2 + [((2, None, 0.5, "y"), None)]
    assert [r.hit for r in out.where("id IS NULL").collect()] == [29.0]


def test_tiles_inside_a_forest_keep_that_alone(spark):
    """However many polygons cover a tile, it holds one item."""
    forests = spark.createDataFrame([(i, [box(i / 1000, 1 + i / 1000, 0, 1)]) for i in range(200)], f"forest_id long, rings {RINGS}")
    layer = spatial.covering_layer(forests, "forest_id", 0.1)
    inner = layer.tiles.where("_tx = 5 AND _ty = 5").first()
    assert [r.i for r in inner["items"]] == [None]
    rows = [(i, (i % 47) / 40 - 0.05, (i % 61) / 40 - 0.1) for i in range(2867)]
    df = spark.createDataFrame(rows, "detection_id long, latitude double, longitude double")
    for tile_deg in (0.1, 2.0):
        got = {r.detection_id: r.in_forest for r in spatial.forest_flag(df, forests, tile_deg=tile_deg, per_part=4).collect()}
        assert got == {i: 0 <= y <= 1 and 0 <= x <= 1.199 for i, y, x in rows}


def test_layers_not_proven_small_are_merged(spark):
    from emberline.operators import tiles as T
    points = spark.createDataFrame([(1, 1, 7)], "_tx int, _ty int, v int")
    tiles = spark.createDataFrame([(1, 1, [1])], "_tx int, _ty int, items array<int>")
    plan = T._attach(points, tiles, "left", False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_crowded_tiles_are_halved(spark):
    forests = spark.createDataFrame([(i, [box(i / 1000, 1 + i / 1000, 0, 1)]) for i in range(200)], f"forest_id long, rings {RINGS}")
    assert spatial.covering_layer(forests, "forest_id", 2.0, per_part=4).size == 0.25
    assert spatial.covering_layer(forests, "forest_id", 2.0, per_part=200).size == 2.0
    one = forests.where("forest_id = 0")
    assert spatial.covering_layer(one, "forest_id", 2.0, per_part=4).size == 2.0


def test_nearest_responders_by_rounds(spark):
    """Near and far places, crowded ones and equal facilities, against every pair; equal rows count as often as given."""
    rows = [(i, ["FIRE", "HOSPITAL", "POLICE"][i % 3], f"n{i}", 20 + (i * 7 % 50) / 500, 75 + (i * 11 % 40) / 400) for i in range(600)]
    rows += [(9000, "FIRE", "same", 22.0, 77.0)] * 2 + [(9001, "FIRE", "other", 22.1, 77.0)]
    resp = spark.createDataFrame(rows, "responder_id long, responder_kind string, responder_name string, latitude double, longitude double")
    places = [(i, 20 + i / 90, 75 + i / 70) for i in range(20)] + [(20, 22.0, 77.0), (21, 20.5, 75.5), (22, 50.0, 10.0), (23, None, 75.0)]
    df = spark.createDataFrame(places, "detection_id long, latitude double, longitude double")
    got = {}
    for r in proximity.nearest_responders(df, resp, 2, 75.0).where("responder_id IS NOT NULL").collect():
        got.setdefault((r.detection_id, r.responder_kind), []).append((r["rank"], r.responder_id))
    pairs = df.crossJoin(resp.withColumnsRenamed({"latitude": "la", "longitude": "lo"})).withColumn("km", proximity.geo.haversine_km(
        F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))).where("km <= 75").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r.km, r.responder_id)):
        found = want.setdefault((r.detection_id, r.responder_kind), [])
        if len(found) < 2:
            found.append((len(found) + 1, r.responder_id))
    assert {k: sorted(v) for k, v in got.items()} == want and want[20, "FIRE"] == [(1, 9000), (2, 9000)]


def test_radius_matches_go_by_rounds(spark, monkeypatch):
    """The nearest few of crowded centres are found without all pairs within the radius."""
    asked, within = [], proximity._within
    monkeypatch.setattr(proximity, "_within", lambda *a: asked.append((a[2], within(*a))) or asked[-1][1])
    rows = [(i, 20 + (i % 50) / 500, 75 + (i // 50 % 40) / 400) for i in range(4000)] + [(5000 + i, 20.0, 75.0) for i in range(9)] + [(6000, None, 75.0)]
    df = spark.createDataFrame(rows, "detection_id long, latitude double, longitude double")
    centres = spark.createDataFrame([(i, 20.0 + i / 300, 75.0 + i / 300) for i in range(20)] + [(20, 20.0, 75.0), (21, 20.4, 75.0), (22, 10.0, 75.0)],
                                    "centre_id long, latitude double, longitude double")
    got = sorted((r.centre_id, r["rank"], r.detection_id) for r in proximity.radius_matches(df, centres, 60.0, 5).collect())
    assert sum(pairs.count() for _, pairs in asked) < 0.2 * proximity.radius_matches(df, centres, 60.0).count()
    pairs = df.crossJoin(centres.withColumnsRenamed({"latitude": "la", "longitude": "lo"})).withColumn("km", proximity.geo.haversine_km(
        F.col("la"), F.col("lo"), F.col("latitude"), F.col("longitude"), proximity.C.EARTH_KM_RADIUS_SEARCH)).where("km <= 60").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r.km, r.detection_id)):
        found = want.setdefault(r.centre_id, [])
        if len(found) < 5:
            found.append(r.detection_id)
    assert got == sorted((c, i + 1, d) for c, ids in want.items() for i, d in enumerate(ids))


def test_hex_codes_work_out_a_cell_once(spark):
    from emberline.plans.catalog import QUERIES
    plan = QUERIES["hex_codes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == 1


def test_parts_of_a_crowded_layer_are_merged(spark):
    """Rounds over a layer of several parts plan no broadcast of its arrays, neither of whole tiles nor of parts."""
    from emberline.operators import tiles as T
    points = spark.createDataFrame([(1, 1, 7)], "_tx int, _ty int, v int")
    parts = spark.createDataFrame([(1, 1, 0, [1]), (1, 1, 1, [2])], "_tx int, _ty int, part int, items array<int>")
    out = T._attach(points, parts, "inner", False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and sorted(r["items"] for r in out.collect()) == [[1], [2]]


def test_layers_of_one_pass_are_small_together(spark, monkeypatch):
    """Rounds that are small one by one, but not together, go one after another, with the same answers."""
    from emberline.operators import spatial
    from emberline.operators import tiles as T
    from emberline.plans import tables
    built, ways = [], []
    build, in_place, by_rounds = T.build_layers, spatial._nearest_in_place, spatial._nearest_by_rounds
    monkeypatch.setattr(T, "build_layers", lambda *a: built.append(build(*a)) or built[-1])
    monkeypatch.setattr(spatial, "_nearest_in_place", lambda *a: ways.append("place") or in_place(*a))
    monkeypatch.setattr(spatial, "_nearest_by_rounds", lambda *a: ways.append("rounds") or by_rounds(*a))
    points, sites = tables.detections(spark, SF), tables.sites(spark, SF)

    def answers(limit):
        out = spatial.nearest_km(points, sites, spatial.JoinConfig(max_broadcast=limit))
        return sorted((r.detection_id, r.nearest_km) for r in out.select("detection_id", "nearest_km").collect())

    first = answers(1 << 26)
    sizes = [layer.n_bytes for layer in built[0]]
    assert answers(max(sizes)) == first and max(sizes) < sum(sizes)
    assert ways == ["place", "rounds"]
