import math

import pytest
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import facility, features, geo, grid, physics, rules, text


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


@pytest.mark.parametrize("n,frp,mu,var,inside,state,priority", [
    (12, 25.0, 24.0, 4.0, True, "PERSISTENT_BASELINE", "SUPPRESSED"),
    (15, 45.0, 20.0, 25.0, True, "ESCALATED_FLAREUP", "P1_ALERT"),
    (10, 70.0, 20.0, 400.0, True, "ESCALATED_FLAREUP", "P1_ALERT"),
    (9, 27.0, 20.0, 6.25, True, "MONITORING", "P2_ADVISORY"),
    (1, 22.5, 15.0, 2.0, True, "ACCIDENTAL_FIRE", "P0_EMERGENCY"),
    (1, 9.9, 15.0, 2.0, True, "MONITORING", "P2_ADVISORY"),
    (0, 15.0, 0.0, 0.0, False, "TRANSIENT_SUSPICION", "NON_ALERT"),
    (5, 15.0, 10.0, 1.0, True, "MONITORING", "P1_ALERT"),
    (5, 15.0, 10.0, 1.0, False, "MONITORING", "P2_ADVISORY"),
])
def test_alert_table(spark, n, frp, mu, var, inside, state, priority):
    d = one(spark, d=rules.alert_decision(*map(F.lit, (n, frp, mu, var, inside)))).d
    assert (d.state, d.priority) == (state, priority)
    assert d.rationale


@pytest.mark.parametrize("name,want", [
    ("Bhilai Steel Plant", "steel_metallurgy"), ("IOCL Panipat Refinery", "petrochemical_refinery"),
    ("Punjab Brick Kiln #4", "brick_kiln"), ("Bhadla Solar Park", "renewable_non_thermal"),
    ("Concentrated Solar Thermal Tower", "power_thermal"), ("Estate", "general_industrial"),
    ("Environment Centre", "steel_metallurgy"),      # substring semantics: "iron"
])
def test_facility_words(spark, name, want):
    got = one(spark, a=facility.facility_type(F.lit(True), {"name": F.lit(name)}),
              b=facility.facility_type(F.lit(False), {"name": F.lit(name)}),
              c=facility.facility_type(F.lit(True), {"name": F.lit("x")}, F.lit("quarry")))
    assert (got.a, got.b, got.c) == (want, "non_industrial", "mining")


def test_ladders(spark):
    for value, want in [(0.02, "UNBURNED"), (0.20, "LOW_SEVERITY"), (0.35, "MODERATE_LOW"),
                        (0.55, "MODERATE_HIGH"), (0.90, "HIGH_SEVERITY"), (-0.30, "REGROWTH"),
                        (None, "UNKNOWN"), (math.nan, "UNKNOWN")]:
        assert one(spark, s=rules.burn_severity(F.lit(value).cast("double"))).s == want
    got = one(spark, a=rules.combustion_regime(F.lit(999.0)), b=rules.frp_severity(F.lit(75.0)),
              c=rules.freshness(F.lit(48.0)), d=rules.frp_bin(F.lit(250.0)),
              e=rules.optical_verdict(F.lit(0.27)))
    assert tuple(got) == ("BIOMASS", "HIGH", "RECENT", "250+ MW", "REFUTED")


@pytest.mark.parametrize("kind,domain,forest,cls,served", [
    ("renewable_non_thermal", True, False, "ACCIDENTAL_FIRE", "TRANSIENT_HOTSPOT"),
    ("", False, True, "AGRICULTURAL_BURN", "TRANSIENT_HOTSPOT"),
    ("", True, True, "AGRICULTURAL_BURN", "FOREST_FIRE"),
    ("", True, True, "ACCIDENTAL_FIRE", "ACCIDENTAL_FIRE"),
])
def test_guards(spark, kind, domain, forest, cls, served):
    g = one(spark, g=rules.serving_guard(F.lit(cls), F.lit(kind), F.lit(domain),
                                         F.lit(forest))).g
    assert g.served_class == served
    assert (g.note is None) == (served == cls)


def test_clock_and_text(spark):
    def when(t):
        return text.acquisition_timestamp(F.lit("2026-01-02"), F.lit(t))

    got = one(spark, a=F.date_format(when("530"), "HH:mm"), b=F.date_format(when("1445"), "HH:mm"),
              c=F.date_format(when("512.0"), "HH:mm"), d=when("bad"),
              e=text.norm_str(F.lit(" None ")), f=text.norm_bool(F.lit("False")),
              g=text.mask_number(F.lit("+91 98765 43210")), h=text.probability_percent(
                  F.lit(0.9996)), i=text.timestamp_key(F.lit("2026-01-02T03:04:05")),
              j=text.timestamp_key(F.lit(None)))
    assert tuple(got) == ("05:30", "14:45", "05:12", None, None, False, "...3210", 99.9,
                          "2026-01-02 03:04:05.000000", "")
    conf = [one(spark, c=text.confidence_percent(F.lit(v).cast("string"))).c
            for v in ("h", "n", "l", "85", "12", None)]
    assert conf == [90.0, 60.0, 20.0, 85.0, 12.0, 50.0]


@pytest.mark.parametrize("name,limit", [("Plant " * 60, 160), ("इस्पात संयंत्र " * 12, 70), ("A", 160)])
def test_sms_is_one_segment(spark, name, limit):
    body = one(spark, b=text.alert_sms(
        F.lit("P0_EMERGENCY"), F.lit("FIRE"), F.lit(22.33), F.lit(69.8612), F.lit(72.5),
        F.lit(name))).b
    assert len(body) <= limit and body.endswith("-unverified sat detection")
    assert "22.3300,69.8612" in body and "72MW" in body


def test_every_sms_sign_is_one_of_the_alphabet(spark):
    basic = [0x40, 0xA3, 0x24, 0xA5, 0xE8, 0xE9, 0xF9, 0xEC, 0xF2, 0xC7, 10, 0xD8, 0xF8, 13, 0xC5, 0xE5, 0x394, 0x5F, 0x3A6,
             0x393, 0x39B, 0x3A9, 0x3A0, 0x3A8, 0x3A3, 0x398, 0x39E, 0xC6, 0xE6, 0xDF, 0xC9, 0xA4, 0xA1, 0xC4, 0xD6, 0xD1,
             0xDC, 0xA7, 0xBF, 0xE4, 0xF6, 0xF1, 0xFC, 0xE0, *range(0x20, 0x24), *range(0x25, 0x40), *range(0x41, 0x5B),
             *range(0x61, 0x7B)]
    extension = [ord(c) for c in "^{}[~]|"] + [0x5C, 0x20AC]
    assert len(set(basic)) == 127 and len(C.GSM7_ALPHABET) == 136
    assert {ord(c) for c in C.GSM7_ALPHABET} == {*basic, *extension}
    df = spark.createDataFrame([(c, chr(c)) for c in [*basic, *extension, 0x727, 0x2026, 0x60, 0xE7]], "c int, s string")
    bad = {r.c for r in df.where(~text.is_gsm7(F.col("s"))).collect()}
    assert bad == {0x727, 0x2026, 0x60, 0xE7}
    body = one(spark, b=text.alert_sms(F.lit("P0_EMERGENCY"), F.lit("FIRE"), F.lit(22.33), F.lit(69.8612), F.lit(72.5),
                                       F.lit("M\u00dcLLER \u00a7 " * 20))).b
    assert len(body) == 160


def test_unreadable_clocks_stay(spark):
    clocks = [one(spark, k=text.clock_digits(F.lit(v))).k for v in ("x", "7", "130.0", "0130", "12:30", "")]
    assert clocks == ["x", "0007", "0130", "0130", "12:30", ""]


def test_factors_are_read_back(spark):
    got = one(spark, f=text.rationale_factors(F.lit(
        "frp=0.42 [12]; fac_brick_kiln = -0.9;month=0.1; odd; =3; x=y"), 2)).f
    assert [(f.label, f.contribution, f.value, f.direction) for f in got] == [
        ("Fac Brick Kiln", -0.9, None, "against"), ("Frp", 0.42, "12", "toward")]
    assert one(spark, f=text.rationale_factors(F.lit("no model"))).f == []


def test_parents_nest(spark):
    pts = spark.createDataFrame([(22.34, 69.87), (-33.1, 151.2), (89.9, -179.9)],
                                "lat double, lon double")
    fine = grid.quad_cell("lat", "lon", 17)
    for zoom in (16, 13, 9, 3):
        assert pts.where(grid.cell_parent(fine, zoom) != grid.quad_cell("lat", "lon", zoom)) \
            .isEmpty()
    got = one(spark, a=grid.roll_up(F.lit(7 << 50), -5), b=grid.cell_parent(F.lit(5), 3),
              c=grid.edge_km(6))
    assert (got.a, got.b, got.c) == (7 << 50, None, 3.23)


def test_geometry_helpers(spark):
    got = one(spark, cone=geo.smoke_cone(F.lit(20.0), F.lit(70.0), F.lit(100.0), F.lit(180.0),
                                         F.lit(10.0)),
              u=geo.utm(F.lit(0.0), F.lit(3.0)), c=geo.compass(F.lit(359.0)),
              ring=F.size(geo.ring(F.lit(10.0), F.lit(20.0), 5.0)),
              e=geo.evacuation_km(F.lit(0.0)))
    assert got.cone[0] == got.cone[4] and got.cone[2].y > 20.0
    assert (got.u.utm_zone, got.u.easting_m, got.u.northing_m) == (31, 500000.0, 0.0)
    assert (got.c, got.ring) == ("N", 49) and got.e >= 0.5


def test_interior_point_is_inside(spark):
    u_shape = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (8.0, 9.0), (8.0, 1.0), (1.0, 1.0),
                (1.0, 9.0), (0.0, 9.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(u_shape,)], "rings array<array<struct<x:double,y:double>>>")
    shaped = df.select(geo.ring_edges("rings").alias("edges"), geo.interior_point("rings").alias("p"))
    assert shaped.select(F.expr(geo.covers("edges", "p.x", "p.y"))).first()[0]


def test_known_fire_is_recovered(spark):
    truth, area, bg = 1100.0, 0.002, 295.0

    def mixed(lam):
        inner = physics.planck_radiance(lam, F.lit(truth)) * area \
            + physics.planck_radiance(lam, F.lit(bg)) * (1 - area)
        scale = lam * 1e-6
        c1 = 2 * C.PLANCK_H * C.LIGHT_C ** 2 / scale ** 5
        c2 = C.PLANCK_H * C.LIGHT_C / C.BOLTZMANN_K / scale
        return F.lit(c2) / F.log1p(F.lit(c1) / inner)

    m, t = C.BANDS_UM["VIIRS"]
    got = one(spark, s=physics.fire_temperature(mixed(m), mixed(t), F.lit(bg), F.lit(m),
                                                F.lit(t))).s
    assert got.t_fire_k == pytest.approx(truth, abs=0.1)
    assert got.area_fraction == pytest.approx(area, rel=1e-3)
    none = one(spark, s=physics.fire_temperature(F.lit(300.0), F.lit(310.0), F.lit(290.0),
                                                 F.lit(m), F.lit(t))).s
    assert none.t_fire_k is None


def test_feature_list():
    assert len(features.FEATURES) == 33
    kept = [f for f in features.FEATURES if not f.startswith(C.RULE_INPUT_PREFIXES)]
    assert len(features.FEATURES) - len(kept) == 14
    assert not {"latitude", "longitude"} & set(features.FEATURES)


def test_missing_numbers_and_clocks(spark):
    assert one(spark, c=text.confidence_percent(F.lit("nan"))).c == 60.0
    keys = [one(spark, k=text.timestamp_key(F.lit(v).cast(kind))).k for v, kind in (
        ("2024-01-02T12:00:00.5", "string"), ("2024-01-02 12:00:00.500000", "string"),
        ("2024-01-02 12:00:00.5", "timestamp_ntz"))]
    assert set(keys) == {"2024-01-02 12:00:00.500000"}
    assert one(spark, k=text.timestamp_key(F.lit("2024-01-02 12:00:00"))).k == "2024-01-02 12:00:00.000000"
    assert [one(spark, b=rules.frp_bin(F.lit(v))).b for v in (0.0, 249.9, 250.0, 120000.0, -1.0)] == [
        "0-10 MW", "100-250 MW", "250+ MW", "250+ MW", None]


def test_hexagons_tile_the_plane(spark):
    from emberline.functions import hexgrid
    places = [(21.3, 78.1), (0.0, 0.0), (-89.9, -179.9), (89.9, 179.9), (22.5, -0.001)]
    df = spark.createDataFrame(places, "lat double, lon double")
    for res in (4, 8, 9):
        cell = hexgrid.hex_cell("lat", "lon", res)
        edge = hexgrid.EDGES[res]
        for r in df.select("*", cell.alias("c")).select("*", F.struct(*hexgrid.centre_km("c")).alias("m"), hexgrid.hex_centre("c").alias("g"),
                                                        hexgrid.hex_neighbours("c").alias("n")).collect():
            x, y = math.radians(r.lon) * hexgrid.EARTH_KM, math.sin(math.radians(r.lat)) * hexgrid.EARTH_KM
            # a place is inside its cell: no neighbour's centre is nearer, and the cell's is within an edge
            near = spark.createDataFrame([(n,) for n in r.n], "c long").select(F.struct(*hexgrid.centre_km("c")).alias("m")).collect()
            own = math.dist((x, y), tuple(r.m))
            assert own <= edge * 1.000001 and all(math.dist((x, y), tuple(v.m)) >= own - 1e-6 for v in near)
            assert [math.dist(tuple(v.m), tuple(r.m)) for v in near] == pytest.approx([edge * math.sqrt(3)] * 6)
            assert len({*r.n, r.c}) == 7
            if abs(r.lat) < 80:
                assert one(spark, c=hexgrid.hex_cell(F.lit(r.g.latitude), F.lit(r.g.longitude), res)).c == r.c
    odd = spark.createDataFrame([(None, 1.0), (1.0, None), (91.0, 0.0), (float("nan"), 0.0)], "lat double, lon double")
    assert [r.c for r in odd.select(hexgrid.hex_cell("lat", "lon").alias("c")).collect()] == [None] * 4


def test_replay_is_no_staleness(spark):
    assert one(spark, a=rules.freshness(F.lit(100.0)), b=rules.freshness(F.lit(100.0), True)) == ("STALE", "REPLAY")
