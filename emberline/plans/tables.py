"""Domain tables derived from the star-schema test tables.

Each view is a list of SQL projections that Spark and the checking engine both accept, so the
two sides start from identical inputs. Only the microsecond function has another name there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.operators.skew import ensure_parallel

EPOCH_US = 1_704_067_200_000_000          # 2024-01-01T00:00:00Z
STRETCH = 12                              # thirty days of events become 360


def _site(key: str) -> tuple[str, str]:
    """Latitude and longitude of the place a key stands for."""
    return (f"8e0 + (({key} * 7919) % 2600) / 1e2", f"69e0 + (({key} * 6101) % 2700) / 1e2")


_LAT, _LON = _site("user_id")

DETECTIONS = {
    "detection_id": "event_id",
    "us": f"{EPOCH_US} + ({{us}} - {EPOCH_US}) * {STRETCH}",
    "latitude": f"{_LAT} + (event_id % 7) * 5e-4",
    "longitude": f"{_LON} + (event_id % 5) * 5e-4",
    "frp": "value",
    "scan": "375e-3 + (event_id % 12) * 25e-2",
    "track": "375e-3 + (event_id % 5) * 1e-1",
    "bright_ti4": "300e0 + ((event_id * 37) % 700) / 1e1",
    "bright_ti5": "280e0 + ((event_id * 53) % 300) / 1e1",
    "instrument": "CASE WHEN event_id % 4 = 3 THEN 'MODIS' ELSE 'VIIRS' END",
    "satellite": "CASE event_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'N20' ELSE 'N21' END",
    "confidence": "CASE event_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'n' WHEN 2 THEN 'h' "
                  "WHEN 3 THEN '85' ELSE '' END",
    "source_key": "user_id",
}

_PLAT, _PLON = _site("s_suppkey")
_KEYWORDS = ("'Bhilai Steel Plant'", "'IOCL Panipat Refinery'", "'Khavda Solar Park'",
             "'Punjab Brick Kiln'", "'Concentrated Solar Thermal Tower'", "'Iron Ore Quarry'",
             "'Generator Works'", "'Estate'")
SITES = {
    "poly_id": "s_suppkey",
    "osm_id": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('way/', "
              "CAST(s_suppkey AS {string})) END",
    "name": "concat(CASE s_suppkey % 8 " + " ".join(
        f"WHEN {i} THEN {w}" for i, w in enumerate(_KEYWORDS)) + " END, ' ', s_name)",
    "landuse": "CASE WHEN s_suppkey % 2 = 0 THEN 'industrial' END",
    "man_made": "CASE WHEN s_suppkey % 5 = 0 THEN 'works' END",
    "industrial": "CASE WHEN s_suppkey % 9 = 4 THEN 'oil' END",
    "other_tags": "CASE WHEN s_suppkey % 7 = 3 THEN '\"industrial\"=>\"port\"' END",
    "shape": "s_suppkey % 6",
    "cx": _PLON,
    "cy": _PLAT,
}
# rings by shape as offsets in degrees from the site centre: parts and holes alike
SHAPES = {
    0: [[(-0.02, -0.02), (0.02, -0.02), (0.02, 0.02), (-0.02, 0.02), (-0.02, -0.02)]],
    1: [[(-0.02, -0.02), (0.0211, -0.02), (-0.02, 0.0231), (-0.02, -0.02)]],
    2: [[(-0.025, -0.025), (0.025, -0.025), (0.025, 0.025), (-0.025, 0.025), (-0.025, -0.025)],
        [(-0.0007, -0.0007), (0.0012, -0.0007), (0.0012, 0.0012), (-0.0007, 0.0012),
         (-0.0007, -0.0007)]],
    3: [[(0.0127, -0.02), (0.03, -0.02), (0.03, 0.02), (0.0127, 0.02), (0.0127, -0.02)]],
    4: [[(0.0513, 0.01), (0.08, 0.01), (0.08, 0.03), (0.0513, 0.03), (0.0513, 0.01)]],
    5: [[(-0.03, -0.03), (0.03, -0.03), (0.03, -0.01), (-0.0107, -0.01), (-0.0107, 0.03),
         (-0.03, 0.03), (-0.03, -0.03)],
        [(0.0003, 0.0003), (0.0203, 0.0003), (0.0203, 0.0203), (0.0003, 0.0203),
         (0.0003, 0.0003)]],
}

_FLAT, _FLON = _site("(s_suppkey * 31 + 7)")
FORESTS = {"forest_id": "s_suppkey", "cx": _FLON, "cy": _FLAT}
FOREST_RING = [(-0.4, -0.4), (0.4, -0.4), (0.4, 0.35), (0.1, 0.4), (-0.4, 0.4), (-0.4, -0.4)]

_RLAT, _RLON = _site("(c_custkey * 17 + 3)")
RESPONDERS = {
    "responder_id": "c_custkey",
    "responder_kind": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'FIRE' "
                      "WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOSPITAL' "
                      "ELSE 'POLICE' END",
    "responder_name": "c_name",
    "latitude": f"{_RLAT} + 37e-4",
    "longitude": f"{_RLON} + 53e-4",
}

_VLAT, _VLON = _site("(s_suppkey % 150)")
EVENTS = {
    "seq": "s_suppkey",
    "event_name": "s_name",
    "lat": _VLAT,
    "lon": _VLON,
    "radius_km": "2e0 + (s_suppkey % 4) * 9e0",
    "start_day": "(s_suppkey * 13) % 300",
    "span_days": "20 + s_suppkey % 90",
    "label": "s_nationkey % 4",
}


def projections(view: dict[str, str], us: str = "unix_micros(CAST(ts AS TIMESTAMP))",
                string: str = "STRING") -> list[str]:
    return [f"{expr.replace('{us}', us).replace('{string}', string)} AS {name}"
            for name, expr in view.items()]


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir, "events").selectExpr(*projections(DETECTIONS))
    df = ensure_parallel(df, "detection_id")
    return df.selectExpr(
        "*", "timestamp_micros(us) AS timestamp_utc", "to_date(timestamp_micros(us)) AS acq_date",
        "date_format(timestamp_micros(us), 'HHmm') AS acq_time",
        "CASE WHEN hour(timestamp_micros(us)) BETWEEN 1 AND 12 THEN 'D' ELSE 'N' END AS daynight")


def _rings_expr(rings, cx: str = "cx", cy: str = "cy") -> str:
    def point(dx, dy):
        return f"named_struct('x', {cx} + {dx!r}D, 'y', {cy} + {dy!r}D)"

    return "array(" + ", ".join(
        "array(" + ", ".join(point(*p) for p in ring) + ")" for ring in rings) + ")"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industrial polygons; every tenth site gets a second overlapping square."""
    base = raw(spark, sf_dir, "supplier").selectExpr(*projections(SITES))
    shape = "CASE shape " + " ".join(
        f"WHEN {k} THEN {_rings_expr(r)}" for k, r in SHAPES.items()) + " END AS rings"
    first = base.selectExpr("*", shape)
    second = base.where("poly_id % 10 = 0").selectExpr(
        "poly_id + 1000000 AS poly_id", *[c for c in base.columns if c != "poly_id"],
        f"{_rings_expr(SHAPES[0])} AS rings")
    return first.unionByName(second).drop("shape", "cx", "cy")


def forests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr(*projections(FORESTS)).selectExpr(
        "forest_id", f"{_rings_expr([FOREST_RING])} AS rings")


def responders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").selectExpr(*projections(RESPONDERS))


def verified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr(*projections(EVENTS)).selectExpr(
        "seq", "event_name", "lat", "lon", "radius_km", "label",
        "date_add(DATE'2024-01-01', CAST(start_day AS INT)) AS start_date",
        "date_add(DATE'2024-01-01', CAST(start_day + span_days AS INT)) AS end_date")


# --- tables for the operators that need other shapes ------------------------------

FEED = {
    # one detection as three feeds would report it, text columns, some of them unusable
    "latitude": "CASE WHEN event_id % 97 = 5 THEN 'n/a' ELSE CAST(8e0 + ((user_id * 7919) % 2600) "
                "/ 1e2 AS {string}) END",
    "longitude": "CAST(69e0 + ((user_id * 6101) % 2700) / 1e2 AS {string})",
    "acq_date": "CAST({day} AS {string})",
    "acq_time": "CASE WHEN event_id % 89 = 7 THEN 'x' WHEN event_id % 3 = 0 "
                "THEN concat(CAST({clock} AS {string}), '.0') ELSE CAST({clock} AS {string}) END",
    "satellite": "CASE WHEN event_type = 'view' THEN 'N20' ELSE 'N' END",
    "frp": "CASE WHEN event_id % 83 = 2 THEN '-' ELSE CAST(value AS {string}) END",
    "ingest_id": "event_id",
}
FEED_DAY = {"spark": "to_date(CAST(ts AS TIMESTAMP))", "duck": "CAST(ts AS DATE)"}
FEED_CLOCK = "(hour(ts) * 100 + (minute(ts) - minute(ts) % 6))"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = FEED_DAY["spark"]
    return raw(spark, sf_dir, "events").selectExpr(*[
        p.replace("{day}", day).replace("{clock}", FEED_CLOCK) for p in projections(FEED)])


LAND_COVER = {
    "cover_id": "p_partkey",
    "lulc_class": "CASE p_size % 6 WHEN 0 THEN 'Industrial Area' WHEN 1 THEN 'Cropland' "
                  "WHEN 2 THEN 'Mining / Quarry' WHEN 3 THEN 'Brick Kiln' WHEN 4 THEN 'Water body' "
                  "ELSE 'Steel Works' END",
    "site_desc": "p_name",
    "fclass": "CASE WHEN p_size % 4 = 1 THEN 'industrial' ELSE 'residential' END",
}
MAP_FEATURES = {
    "osm_id": "concat('way/', CAST(p_partkey AS {string}))",
    "name": "p_name",
    "landuse": "CASE WHEN p_size % 5 = 0 THEN 'industrial' WHEN p_size % 5 = 1 THEN 'forest' END",
    "man_made": "CASE WHEN p_size % 7 = 0 THEN 'works' END",
    "natural": "CASE WHEN p_size % 11 = 0 THEN 'wood' WHEN p_size % 11 = 1 THEN 'scrub' END",
    "amenity": "CASE WHEN p_size % 13 = 0 THEN 'hospital' WHEN p_size % 13 = 1 THEN 'school' END",
    "other_tags": "CASE p_size % 6 WHEN 0 THEN '\"industrial\"=>\"port\",\"ref\"=>\"7\"' "
                  "WHEN 1 THEN '\"amenity\"=>\"fire_station\"' WHEN 2 THEN "
                  "'\"natural\"=>\"wood\"' WHEN 3 THEN '\"amenity\"=>\"police\"' END",
    "latitude": "8e0 + ((p_partkey * 7919) % 2600) / 1e2",
    "longitude": "69e0 + ((p_partkey * 6101) % 2700) / 1e2",
}


def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").selectExpr(*projections(LAND_COVER))


def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").selectExpr(*projections(MAP_FEATURES))


# keys without the polygon join: every second source is a mapped site of its own
KEYED = {
    "inside_industrial": "source_key % 2 = 0",
    "poly_id": "CASE WHEN source_key % 2 = 0 THEN source_key END",
    "facility_name": "CASE WHEN source_key % 2 = 0 THEN concat('Site ', "
                     "CAST(source_key AS {string})) END",
    "facility_type": "CASE WHEN source_key % 2 = 1 THEN 'non_industrial' WHEN source_key % 14 = 0 "
                     "THEN 'renewable_non_thermal' WHEN source_key % 4 = 0 THEN 'steel_metallurgy' "
                     "ELSE 'brick_kiln' END",
    "in_forest": "source_key % 5 = 3",
}


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.operators.recurrence import with_keys

    df = detections(spark, sf_dir)
    return with_keys(df.selectExpr("*", *projections(KEYED)), ("poly_id",))


ACTIONS = {
    "seq": "o_orderkey",
    "detection_id": "o_custkey",
    "action": "CASE o_orderpriority WHEN '1-URGENT' THEN 'CONFIRM' WHEN '2-HIGH' THEN 'reclassify' "
              "WHEN '3-MEDIUM' THEN 'FALSE_POSITIVE' WHEN '4-NOT SPECIFIED' THEN 'STATUS' "
              "ELSE CASE WHEN o_orderstatus = 'F' THEN 'DISPATCH' ELSE 'NOTE' END END",
    "new_class": "CASE o_orderpriority WHEN '2-HIGH' THEN CASE o_orderkey % 4 WHEN 0 THEN "
                 "'ACCIDENTAL_FIRE' WHEN 1 THEN 'PERSISTENT_BASELINE' WHEN 2 THEN "
                 "'TRANSIENT_HOTSPOT' END WHEN '4-NOT SPECIFIED' THEN CASE o_orderkey % 3 "
                 "WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'open' ELSE 'LOST' END END",
    "operator_notes": "CASE WHEN o_orderkey % 3 = 0 THEN concat('note ', "
                      "CAST(o_orderkey AS {string})) ELSE '' END",
}


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderdate AS TIMESTAMP) AS at", *projections(ACTIONS))


SCENES = {
    "site_id": "l_suppkey",
    "scene_date": "{day}",
    "nbr_mean": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 5e0 - l_tax END",
    "sample_count": "CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 100 END",
    "no_data_count": "CAST(l_quantity * 2 AS BIGINT)",
}
SCENE_DAY = {"spark": "date_add(DATE'2024-01-01', CAST((l_orderkey * 7 + l_linenumber) % 420 AS "
                      "INT))",
             "duck": "(DATE '2024-01-01' + CAST((l_orderkey * 7 + l_linenumber) % 420 AS INT))"}


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").selectExpr(
        *[p.replace("{day}", SCENE_DAY["spark"]) for p in projections(SCENES)])
