"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import facility, features, geo, grid, hexgrid, physics, rules, text
from emberline.operators import (
    dossier, incidents, labels, optical, proximity, quantiles, recurrence, reports, skew, spatial,
    thermal, verified)
from emberline.plans import tables as T
from emberline.plans import training
from emberline.session import checkpoint_root, written
from emberline.sources import documents, firms, landuse, osm
from emberline.streaming import keyed, refreshed
from emberline.streaming.recurrence import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scored(spark: SparkSession, sf: str, neighbours: bool = False) -> DataFrame:
    return recurrence.evaluate(T.keyed(spark, sf), neighbours=neighbours)


def scored_table(spark: SparkSession, sf: str) -> DataFrame:
    """The scored corpus written once, for reports that read it more than once."""
    checkpoint_root(spark)
    return scored(spark, sf).checkpoint()


def history(spark: SparkSession, sf: str) -> DataFrame:
    return recurrence.source_history(T.keyed(spark, sf))


# --- ingest -----------------------------------------------------------------------


@query
def ingest_typed(spark, sf):
    df = firms.typed(T.feed(spark, sf))
    return df.select("ingest_id", "latitude", "longitude", "frp", "satellite",
                     F.unix_micros("timestamp_utc").alias("us"))


@query
def ingest_dedupe(spark, sf):
    # the second feed restates the first one's detections
    raw = firms.typed(T.feed(spark, sf))
    both = firms.union_feeds([raw.where("satellite = 'N20'"), raw])
    return firms.dedupe(both).select("ingest_id", "feed_rank", "satellite", "acq_time")


def _archive(spark, sf):
    df = T.detections(spark, sf)
    feed = F.when(F.col("instrument") == "MODIS", "MODIS_NRT").otherwise(
        F.concat(F.lit("VIIRS_"), F.when(F.col("satellite") == "N", "SNPP").otherwise(
            F.when(F.col("satellite") == "N20", "NOAA20").otherwise("NOAA21")), F.lit("_NRT")))
    rows = df.select(feed.alias("sensor"), "acq_date")
    spans = rows.groupBy("sensor").agg(F.min("acq_date").alias("start_date"),
                                       F.max("acq_date").alias("end_date"))
    # the near-real-time feed keeps the newer part of each sensor's span
    middle = F.date_add("start_date", 200)
    nrt = spans.select(F.col("sensor").alias("data_id"), middle.alias("min_date"),
                       F.col("end_date").alias("max_date"))
    sp = spans.select(firms.counterpart(F.col("sensor")).alias("data_id"),
                      F.date_add("start_date", 20).alias("min_date"), middle.alias("max_date"))
    available = firms.availability(nrt.unionByName(sp))
    plan = firms.request_plan(spans, available)
    page = F.floor(F.datediff("acq_date", "start_date") / C.PAGE_DAYS).cast("int") * C.PAGE_DAYS
    landed = rows.join(F.broadcast(spans), "sensor").groupBy(
        "sensor", F.date_add("start_date", page).alias("window_start")).agg(
        F.count_if(F.dayofmonth("acq_date") > 2).alias("rows"))
    return firms.window_outcomes(plan, landed)


@query
def archive_windows(spark, sf):
    return _archive(spark, sf).select(
        "sensor", F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"), "data_id", "rows", "status")


@query
def archive_tally(spark, sf):
    return firms.tally(_archive(spark, sf))


@query
def corpus_span(spark, sf):
    return reports.corpus_span(T.detections(spark, sf))


@query
def land_cover_sites(spark, sf):
    return landuse.land_cover(T.land_cover(spark, sf)).select(
        "cover_id", "site_name", "facility_type", "source")


@query
def landuse_fusion(spark, sf):
    layer = landuse.fuse(
        osm.industrial_features(T.map_features(spark, sf)).select("osm_id", "name", "landuse"),
        landuse.land_cover(T.land_cover(spark, sf)).select(
            F.col("site_name").alias("name"), "facility_type", "source"),
        landuse.industrial_landuse(T.land_cover(spark, sf)).select(
            F.col("site_desc").alias("name"), F.lit("shapefile").alias("source")))
    return layer.select("osm_id", "name", "landuse", "facility_type", "source")


@query
def map_feature_filters(spark, sf):
    df = T.map_features(spark, sf)
    return df.select(
        "osm_id", facility.industrial_feature(
            F.col("landuse"), F.col("man_made"), F.col("other_tags")).alias("industrial"),
        facility.forest_feature(F.col("landuse"), F.col("natural"), F.col("other_tags"))
        .alias("forest"),
        facility.responder_feature(F.col("amenity"), F.col("other_tags"), "points")
        .alias("responder_point"),
        facility.responder_feature(F.col("amenity"), F.col("other_tags"), "multipolygons")
        .alias("responder_polygon"),
        facility.responder_kind(F.col("amenity"), F.col("other_tags")).alias("kind"),
        F.try_element_at(text.hstore_map("other_tags"), F.lit("ref")).alias("ref_tag"))


@query
def responder_layer(spark, sf):
    points = T.map_features(spark, sf)
    polygons = T.sites(spark, sf).select(
        F.concat(F.lit("poly/"), "poly_id").alias("osm_id"), "name", "rings",
        F.lit("hospital").alias("amenity"), F.lit(None).cast("string").alias("other_tags"))
    return osm.responders(points, polygons).select(
        "osm_id", "responder_kind", "source_layer",
        text.half_up(F.col("latitude"), 6).alias("latitude"),
        text.half_up(F.col("longitude"), 6).alias("longitude"))


@query
def map_assembly(spark, sf):
    # the site polygons taken apart into nodes, ways and relations, then rebuilt
    polys = T.sites(spark, sf)
    rings = polys.select("poly_id", F.posexplode("rings").alias("r", "ring"))

    def tag(name, value):
        return F.create_map(F.lit(name), F.lit(value))

    def number(*parts):
        return F.concat_ws("/", *[p.cast("string") for p in parts])

    vertex = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: number(
        F.col("poly_id"), F.col("r"), F.pmod(i, F.size("ring") - 1)))
    ways = rings.select(number(F.col("poly_id"), F.col("r")).alias("way_id"),
                        vertex.alias("node_ids"), F.when(F.col("poly_id") % 3 == 0, tag("landuse", "industrial"))
                        .otherwise(F.create_map().cast("map<string,string>")).alias("tags"))
    nodes = rings.select("poly_id", "r", F.size("ring").alias("n"), F.posexplode("ring").alias("i", "v")) \
        .where("i < n - 1").select(number(F.col("poly_id"), F.col("r"), F.col("i")).alias("node_id"),
                                   F.col("v.x").alias("lon"), F.col("v.y").alias("lat"))
    # every fourth relation is a route, and every fourth says what it is by its type alone
    kind = F.col("poly_id") % 4
    relations = polys.select(
        F.col("poly_id").alias("relation_id"),
        F.when(kind == 0, tag("type", "route")).when(kind == 1, tag("type", "multipolygon"))
        .otherwise(tag("landuse", "industrial")).alias("tags"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.size("rings") - 1), lambda r: F.struct(
                F.lit("way").alias("type"), F.when(r == 0, "outer").otherwise("inner").alias("role"),
                number(F.col("poly_id"), r).alias("ref"))),
            # a node that has a way's number is not that way
            F.array(F.struct(F.lit("node").alias("type"), F.lit("").alias("role"),
                             number(F.col("poly_id"), F.lit(0)).alias("ref")))).alias("members"))
    built = osm.with_tag_columns(osm.assemble(ways, nodes, relations), ("landuse",))
    edges = geo.ring_edges("rings")
    return built.select("osm_id", "landuse", "missing_nodes", F.size(edges).alias("n_edges"),
                        text.half_up(F.array_max(F.transform(edges, lambda e: e["x1"])), 6)
                        .alias("max_x"))


@query
def hub_boxes(spark, sf):
    places = T.raw(spark, sf, "orders").selectExpr(
        "o_orderkey", "8e0 + ((o_orderkey * 7919) % 2600) / 1e2 AS latitude",
        "69e0 + ((o_orderkey * 6101) % 2700) / 1e2 AS longitude")
    return spatial.in_boxes(places).select("o_orderkey", "hub_name")


@query
def cited_events_check(spark, sf):
    src = T.verified_events(spark, sf)
    as_text = src.select(
        "seq", "event_name", *[F.col(c).cast("string").alias(c) for c in
                               ("lat", "lon", "start_date", "radius_km")],
        F.when(F.col("seq") % 11 == 1, "someday").otherwise(F.col("end_date").cast("string"))
        .alias("end_date"),
        F.when(F.col("seq") % 7 == 1, "VOLCANO").otherwise(
            rules.class_name(F.col("label"))).alias("label"),
        F.when(F.col("seq") % 5 == 1, " ").otherwise("a report").alias("source"))
    good, bad = documents.check_events(as_text)
    return good.select("seq", F.lit(None).cast("string").alias("reason")) \
        .unionByName(bad.select("seq", "reason"))


# --- spatial ----------------------------------------------------------------------


@query
def polygon_match(spark, sf):
    df = spatial.polygon_match(T.detections(spark, sf), T.sites(spark, sf), attrs=())
    return df.select("detection_id", F.col("hit.poly_id").alias("poly_id"),
                     (F.col("hit.rank") == 0).alias("is_exact"))


@query
def nearest_polygon(spark, sf):
    return spatial.nearest_km(T.detections(spark, sf), T.sites(spark, sf)) \
        .select("detection_id", "nearest_km")


@query
def industrial_join(spark, sf):
    return spatial.join_industrial(T.detections(spark, sf), T.sites(spark, sf)).select(
        "detection_id", "poly_id", "osm_id", "inside_industrial", "is_exact_match",
        "facility_name", "facility_type", "dist_to_industrial_km")


@query
def facility_types(spark, sf):
    df = T.sites(spark, sf)
    cols = {c: F.col(c) for c in facility.TEXT_COLUMNS}
    return df.select("poly_id", facility.facility_type(F.lit(True), cols).alias("facility_type"),
                     facility.non_combustion(facility.site_text(cols)).alias("non_combustion"))


@query
def forest_flag(spark, sf):
    return spatial.forest_flag(T.detections(spark, sf), T.forests(spark, sf)) \
        .select("detection_id", "in_forest")


@query
def crowded_tiles(spark, sf):
    # few items to a part, and ids that repeat or are missing: every row must come back once
    df = T.detections(spark, sf).withColumn("k", F.when(
        F.col("detection_id") % 5 != 0, F.col("detection_id") % 10)).drop("detection_id")
    found = spatial.forest_flag(df, T.forests(spark, sf), "k", tile_deg=2.0, per_part=4)
    return found.groupBy("k", "in_forest").agg(F.count(F.lit(1)).alias("n"))


@query
def cell_codes(spark, sf):
    df = T.detections(spark, sf)
    cell = grid.cell_at("latitude", "longitude", 9)
    return df.select("detection_id", cell.alias("cell"), grid.cell_parent(cell, 13).alias("area"),
                     grid.roll_up(cell, 4).alias("map_cell"), grid.cell_zoom(cell).alias("zoom"),
                     grid.legacy_bin("latitude", "longitude").alias("legacy_bin"),
                     grid.block_id("latitude", "longitude").alias("block"),
                     grid.edge_km(6).alias("edge_km"))


# --- recurrence -------------------------------------------------------------------


@query
def recurrence_stats(spark, sf):
    return history(spark, sf).select(
        "detection_id", "recurrence_key", "n_30d", "mu_raw", "var_raw")


@query
def source_timing(spark, sf):
    return history(spark, sf).select("detection_id", "source_age_days", "onset_lag_days")


@query
def burst(spark, sf):
    return history(spark, sf).select("detection_id", "n_24h", "burst_raw")


@query
def neighbourhood(spark, sf):
    return recurrence.neighbourhood(T.keyed(spark, sf)).select(
        "detection_id", "neighbourhood_active_keys")


@query
def alert_state(spark, sf):
    return scored(spark, sf).select(
        "detection_id", "frp", "mu_frp", "var_frp", "z_frp", "frp_ratio", "burst_ratio", "state",
        "priority", "tag", "suppressed")


# --- labels and features ----------------------------------------------------------


@query
def frp_thresholds(spark, sf):
    return labels.frp_thresholds(T.keyed(spark, sf), min_samples=1000)


@query
def weak_label(spark, sf):
    return labelled(spark, sf).select("detection_id", "target_label")


def labelled(spark, sf):
    """The scored corpus under the full labelling rule."""
    gates = labels.frp_thresholds(T.keyed(spark, sf), min_samples=1000)
    return labels.with_weak_label(scored(spark, sf, neighbours=True), gates)


@query
def class_counts(spark, sf):
    return labels.class_counts(labelled(spark, sf))


@query
def label_shares(spark, sf):
    return labels.label_shares(labelled(spark, sf), (70.0, 10.0, 90.0, 30.0))


@query
def balance_sample(spark, sf):
    return labels.balance(labelled(spark, sf), ratio_cap=2).select(
        "detection_id", "target_label")


@query
def stratified_split(spark, sf):
    parts = labels.split(labelled(spark, sf))
    return parts.select("detection_id", "target_label", "split")


@query
def prior_factors(spark, sf):
    df = labelled(spark, sf)
    return labels.prior_factors(df, labels.balance(df, ratio_cap=2))


@query
def features_projection(spark, sf):
    df = features.with_features(T.keyed(spark, sf), ("detection_id",))
    return df.select("detection_id", "temp_diff", "frp_density", "ti4_ratio",
                     "detection_confidence", "dnbr_available", "inside_industrial",
                     "dist_to_industrial_km", "is_night", "hour_utc", "month",
                     "is_harvest_season", "fac_brick_kiln", "fac_non_industrial")


# --- reports ----------------------------------------------------------------------


@query
def hex_rollup(spark, sf):
    return reports.cell_report(scored(spark, sf), 4, limit=None).drop("zoom")


@query
def hex_filtered(spark, sf):
    return reports.cell_report(
        scored(spark, sf), 3, bbox=(70.0, 10.0, 92.0, 31.0),
        states=["monitoring", "ACCIDENTAL_FIRE"], min_detections=2, limit=50).select(
        "cell", "detections", "top_priority", "frp_total_mw")


@query
def hex_summary(spark, sf):
    df = scored_table(spark, sf)
    return reports.cell_summary(df, reports.cell_report(df, 4, limit=None),
                                reports.cell_report(df, 4, limit=40), 4)


@query
def register(spark, sf):
    return reports.facility_register(scored_table(spark, sf), 5)


@query
def register_summary(spark, sf):
    df = scored_table(spark, sf)
    return reports.register_summary(reports.facility_register(df, 5, limit=25), df)


@query
def kpi(spark, sf):
    return reports.key_figures(scored(spark, sf))


@query
def chart_bins(spark, sf):
    return reports.chart_counts(scored(spark, sf))


@query
def hottest(spark, sf):
    return reports.hottest(scored(spark, sf), 10).select("detection_id", "facility_name", "frp",
                                                         "priority")


@query
def active_incidents(spark, sf):
    df = scored(spark, sf).withColumn("status", F.lit("OPEN"))
    return reports.active_incidents(df, "P1_ALERT", True, "OPEN", 200).select(
        "detection_id", "frp", "us")


@query
def freshness(spark, sf):
    return reports.freshness(T.detections(spark, sf), "2024-12-27T00:00:00Z").select(
        "age_hours", "badge")


@query
def layer_summary(spark, sf):
    return reports.layer_summary(T.responders(spark, sf))


@query
def health(spark, sf):
    return reports.health(detections=T.detections(spark, sf), polygons=T.sites(spark, sf),
                          responders=T.responders(spark, sf))


# --- verified events --------------------------------------------------------------


def _tagged(spark, sf):
    df = labelled(spark, sf)
    return verified.attach_events(df, T.verified_events(spark, sf))


@query
def verified_tag(spark, sf):
    return _tagged(spark, sf).select("detection_id", "event_name", "event_label")


@query
def event_accuracy(spark, sf):
    out = verified.event_accuracy(_tagged(spark, sf), F.col("event_label"),
                                  F.col("target_label").cast("long"))
    return out.withColumn("accuracy", text.half_up(F.col("accuracy"), 6))


@query
def event_register(spark, sf):
    df = _tagged(spark, sf).where("event_name IS NOT NULL")
    served = incidents.score(df, rules.class_name(F.col("target_label")), F.lit(0.9))
    out = verified.register(served, T.verified_events(spark, sf),
                            rules.class_name(F.col("event_label").cast("int")),
                            F.col("served_class"), rules.class_name(F.col("target_label")))
    return out.withColumns({c: text.half_up(F.col(c), 6) for c in ("served_accuracy", "model_accuracy")})


@query
def counter_register(spark, sf):
    events = T.verified_events(spark, sf)
    seen = verified.attach_events(T.detections(spark, sf), events).where("event_name IS NOT NULL").select("event_name")
    missed = events.select("seq", "event_name", "label").join(seen.distinct(), "event_name", "left_anti")
    return verified.counter_register(missed, events)


@query
def event_confusion(spark, sf):
    df = _tagged(spark, sf).where("event_name IS NOT NULL")
    return verified.confusion(df, F.col("event_label"), F.col("target_label"))


@query
def class_report(spark, sf):
    df = _tagged(spark, sf).where("event_name IS NOT NULL")
    counts = verified.confusion(df, F.col("event_label"), F.col("target_label"),
                                [F.col("daynight")])
    out = verified.class_report(counts, ["daynight"])
    return out.select("daynight", "cls", "support",
                      *[text.half_up(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def overall_scores(spark, sf):
    df = _tagged(spark, sf).where("event_name IS NOT NULL")
    out = verified.overall(verified.class_report(verified.confusion(
        df, F.col("event_label"), F.col("target_label"))))
    return out.select("n", *[text.half_up(F.col(c), 6).alias(c)
                             for c in ("accuracy", "macro_f1", "weighted_f1")])


@query
def first_corpus(spark, sf):
    df = _tagged(spark, sf).withColumn("corpus_rank", (F.col("source_key") + F.month("acq_date"))
                                       % 3)
    return verified.first_corpus(df).select("detection_id", "event_name", "corpus_rank")


@query
def served_accuracy(spark, sf):
    df = _tagged(spark, sf).where("event_name IS NOT NULL")
    served = incidents.score(df, rules.class_name(F.col("target_label")), F.lit(0.9))
    out = verified.event_accuracy(served, rules.class_name(F.col("event_label").cast("int")),
                                  F.col("served_class"))
    return out.withColumn("accuracy", text.half_up(F.col("accuracy"), 6))


# --- proximity --------------------------------------------------------------------


@query
def radius_search(spark, sf):
    near = proximity.within_km(T.detections(spark, sf), 18.0, 80.0, 300.0, 100)
    return near.select("detection_id", text.half_up(F.col("distance_km"), 6).alias("distance_km"))


def _by_the_date_line(df):
    # the same places, moved east until the date line runs through them
    moved = F.col("longitude") + 98.0
    return df.withColumn("longitude", F.when(moved > 180.0, moved - 360.0).otherwise(moved))


@query
def date_line_search(spark, sf):
    near = proximity.within_km(_by_the_date_line(T.detections(spark, sf)), 18.0, 179.9, 300.0)
    return near.select("detection_id", text.half_up(F.col("distance_km"), 6).alias("distance_km"))


@query
def date_line_bulk(spark, sf):
    df = _by_the_date_line(T.detections(spark, sf))
    centres = spark.range(6).select(F.col("id").alias("centre_id"), (F.col("id") * 4.0 + 9.0).alias("latitude"),
                                    F.when(F.col("id") % 2 == 0, 179.7).otherwise(-179.8).alias("longitude"))
    out = proximity.radius_matches(df, centres, 150.0, 5)
    return out.select("centre_id", "detection_id", "rank",
                      text.half_up(F.col("distance_km"), 6).alias("distance_km"))


@query
def radius_bulk(spark, sf):
    centres = T.forests(spark, sf).select(
        F.col("forest_id").alias("centre_id"), F.col("rings")[0][0]["y"].alias("latitude"),
        F.col("rings")[0][0]["x"].alias("longitude"))
    out = proximity.radius_matches(T.detections(spark, sf), centres, 60.0, 5)
    return out.select("centre_id", "detection_id", "rank",
                      text.half_up(F.col("distance_km"), 6).alias("distance_km"))


@query
def nearest_responders(spark, sf):
    out = proximity.nearest_responders(T.detections(spark, sf), T.responders(spark, sf), 2, 75.0)
    return out.select("detection_id", "responder_kind", "rank", "responder_id", "distance_km",
                      F.col("travel.minutes").alias("minutes"), "none_within_range")


# --- incidents --------------------------------------------------------------------


@query
def serving_guards(spark, sf):
    df = labelled(spark, sf)
    return incidents.score(df, rules.class_name(F.col("target_label")), F.lit(0.5)).select(
        "detection_id", "served_class", "guard_note", "served_priority", "served_state")


@query
def detection_ids(spark, sf):
    df = T.detections(spark, sf)
    return df.select("detection_id", incidents.detection_hash(df).alias("stable_id"))


@query
def incident_upsert(spark, sf):
    df = T.detections(spark, sf)
    stored = T.actions(spark, sf).select("detection_id")
    return incidents.new_rows(df, stored).select("detection_id", "frp")


def _moments(base):
    # totals instead of means: they have few decimals, so rounding cannot tip over
    mean = F.col("mean")
    return base.select(
        "area", "n", text.half_up(F.col("n") * mean, 2).alias("total"),
        text.half_up(F.col("n") * (F.col("variance") + mean * mean), 5).alias("squares"))


@query
def cell_baseline(spark, sf):
    out = incidents.cell_baseline(T.keyed(spark, sf), "area")
    return _moments(out)


@query
def baseline_merge(spark, sf):
    df = T.keyed(spark, sf)
    old = incidents.cell_baseline(df.where("month(acq_date) <= 6"), "area")
    new = incidents.cell_baseline(df.where("month(acq_date) > 6"), "area")
    out = incidents.merge_baselines(old, new, "area")
    return _moments(out)


@query
def recurrence_evidence(spark, sf):
    df = T.keyed(spark, sf)
    base = incidents.cell_baseline(df.where("month(acq_date) <= 3"))
    out = incidents.recurrence_evidence(df, base)
    return out.select("detection_id", "evidence_status", "detections_30d", "mean_frp_mw",
                      "evidence_z", "is_established")


def _incident_table(spark, sf):
    df = labelled(spark, sf)
    served = incidents.score(df, rules.class_name(F.col("target_label")), F.lit(0.5))
    return served.select(
        "detection_id", (F.col("detection_id") + 1).alias("incident_id"), "latitude", "longitude",
        "cell", "acq_date", "frp", "facility_name", "facility_type", "inside_industrial", "us",
        "timestamp_utc", F.col("served_priority").alias("priority"),
        F.col("served_state").alias("state"), F.col("served_class").alias("predicted_class"),
        F.lit("OPEN").alias("status"))


@query
def audit_fold(spark, sf):
    return incidents.fold_actions(_incident_table(spark, sf), T.actions(spark, sf)).select(
        "detection_id", "priority", "state", "status", "predicted_class", "operator_notes",
        "actions")


@query
def rejected_statuses(spark, sf):
    return incidents.rejected_statuses(T.actions(spark, sf)).select("seq", "new_class")


@query
def audit_append(spark, sf):
    return incidents.audit_rows(_incident_table(spark, sf), T.actions(spark, sf)).select(
        "seq", "incident_id", "detection_id", "action", "previous_class", "new_class")


def _audit(spark, sf):
    return T.actions(spark, sf).select(
        F.col("seq").alias("audit_id"), (F.col("detection_id") + 1 + F.when(
            F.col("seq") % 50 == 0, 1).otherwise(0)).alias("incident_id"), "detection_id",
        F.upper("action").alias("action"), F.col("at").alias("timestamp_utc"))


@query
def audit_remap(spark, sf):
    return incidents.remap_audit(_audit(spark, sf), _incident_table(spark, sf)) \
        .select("audit_id", "incident_id")


@query
def audit_copy(spark, sf):
    audit = _audit(spark, sf)
    return incidents.copy_audit(audit, audit.where("audit_id % 2 = 0")).select(
        "audit_id", "detection_id", "action")


@query
def quality_checks(spark, sf):
    return incidents.quality_checks(_incident_table(spark, sf), _audit(spark, sf))


@query
def dispatch_plan(spark, sf):
    return incidents.dispatch_plan(_incident_table(spark, sf)).select(
        "detection_id", "priority", "status", "reason", "channel", "sms_body")


# --- dossier ----------------------------------------------------------------------


def _weather(spark, sf):
    """A day of hourly readings for the place and day of every third source's detections."""
    df = T.detections(spark, sf).where("source_key % 3 <> 1")
    days = df.groupBy(text.half_up(F.col("latitude"), 3).alias("latitude"),
                      text.half_up(F.col("longitude"), 3).alias("longitude"),
                      F.col("acq_date").alias("day")).agg(F.min("detection_id").alias("k"))
    hours = F.sequence(F.lit(0), F.when(F.col("k") % 2 == 0, 23).otherwise(11))
    return days.select("latitude", "longitude", "day", F.transform(hours, lambda h: F.when(
        (h + F.col("k")) % 4 != 0, (h * 10 + F.col("k") % 7).cast("double"))).alias(
        "temperature_2m"), F.transform(hours, lambda h: (h + F.col("k") % 30).cast("double"))
        .alias("wind_speed_10m"))


@query
def weather_hour(spark, sf):
    return dossier.attach_weather(T.detections(spark, sf), _weather(spark, sf)).select(
        "detection_id", "temperature_2m", "wind_speed_10m", "weather_is_measured")


@query
def incident_figures(spark, sf):
    df = T.keyed(spark, sf)
    e = rules.emissions(F.col("frp"), F.col("facility_type"))
    box = geo.box_around(F.col("latitude"), F.col("longitude"), 1.0)
    return df.select(
        "detection_id", rules.frp_severity(F.col("frp")).alias("severity"),
        geo.hazard_km(F.col("frp")).alias("hazard_km"),
        geo.evacuation_km(F.col("frp")).alias("evacuation_km"),
        text.half_up(e["co2_kg_h"], 1).alias("co2"), text.half_up(e["so2_kg_h"], 1).alias("so2"),
        text.half_up(e["pm25_kg_h"], 1).alias("pm25"), box["west"].alias("west"),
        box["north"].alias("north"), geo.compass(F.col("frp")).alias("compass"))


@query
def projected_position(spark, sf):
    u = geo.utm(F.col("latitude"), F.col("longitude"))
    return T.detections(spark, sf).select(
        "detection_id", u["utm_zone"].alias("utm_zone"), u["hemisphere"].alias("hemisphere"),
        u["band"].alias("band"), u["easting_m"].alias("easting_m"),
        u["northing_m"].alias("northing_m"))


@query
def smoke_cone(spark, sf):
    ring = geo.smoke_cone(F.col("latitude"), F.col("longitude"), F.col("frp"),
                          F.pmod(F.col("frp") * 7.0, F.lit(360.0)), F.col("scan") * 10.0)
    return T.detections(spark, sf).select(
        "detection_id", F.size(ring).alias("vertices"), ring[1]["x"].alias("left_x"),
        ring[2]["y"].alias("tip_y"), ring[3]["x"].alias("right_x"))


@query
def latest_audit(spark, sf):
    out = dossier.latest_audit(T.actions(spark, sf), 10)
    return out.select("detection_id", F.size("audit").alias("n"),
                      F.array_join(F.transform("audit", lambda a: a["action"]), ",")
                      .alias("actions"))


@query
def incident_dossier(spark, sf):
    baselines = incidents.cell_baseline(T.keyed(spark, sf).where("month(acq_date) <= 3"))
    out = dossier.dossier(_incident_table(spark, sf), _weather(spark, sf), T.actions(spark, sf), baselines)
    return out.select("detection_id", "frp_severity", "hazard_km", "audit_rows", "weather_is_measured",
                      F.col("utm.utm_zone").alias("utm_zone"), "evidence_status", "detections_30d",
                      "mean_frp_mw")


# --- optical and thermal ----------------------------------------------------------


def _locations(spark, sf):
    df = T.detections(spark, sf).withColumn("recurrence_key", F.col("source_key"))
    return optical.locations(df)


def _scars(spark, sf):
    scenes = T.scenes(spark, sf).withColumnRenamed("site_id", "recurrence_key")
    return optical.burn_scars(_locations(spark, sf), scenes, F.lit("2024-01-10").cast("date"))


@query
def dnbr_windows(spark, sf):
    return _scars(spark, sf).select(
        "recurrence_key", text.half_up(F.col("nbr_pre"), 6).alias("nbr_pre"),
        text.half_up(F.col("nbr_post"), 6).alias("nbr_post"), "status")


@query
def dnbr_attach(spark, sf):
    df = T.detections(spark, sf).withColumn("recurrence_key", F.col("source_key"))
    return optical.attach_scars(df, _scars(spark, sf)).select("detection_id", "dnbr_status")


@query
def optical_coverage(spark, sf):
    out = reports.optical_coverage(_scars(spark, sf))
    return out.groupBy("status").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"),
                                     F.sum("unmeasured").alias("unmeasured"))


@query
def optical_points(spark, sf):
    return reports.optical_points(_scars(spark, sf).select("recurrence_key", "status"), 40)


@query
def dnbr_candidates(spark, sf):
    df = optical.candidates(history(spark, sf)).withColumn("recurrence_key", F.col("source_key"))
    locs = optical.locations(df)
    cache = locs.where("recurrence_key % 4 = 0").withColumn("status", F.lit("OK"))
    return optical.within_budget(optical.uncached(locs, cache), 50).select(
        "recurrence_key", F.col("event_date").cast("string").alias("event_date"), "peak_frp")


@query
def scene_documents(spark, sf):
    # scene rows packed as the nested JSON a statistics service answers with, then read back
    rows = T.scenes(spark, sf)
    stats = F.struct(F.struct(
        F.col("nbr_mean").alias("mean"), F.col("sample_count").alias("sampleCount"),
        F.col("no_data_count").alias("noDataCount"),
        F.create_map(F.lit("25.0"), F.col("nbr_mean")).alias("percentiles")).alias("stats"))
    band = F.when(F.col("site_id") % 2 == 0, "B0").otherwise("default")
    doc = F.to_json(F.array(F.struct(
        F.struct(F.concat(F.col("scene_date").cast("string"), F.lit("T00:00:00Z")).alias("from"))
        .alias("interval"),
        F.create_map(F.lit("nbr"), F.struct(F.create_map(band, stats).alias("bands")))
        .alias("outputs"))))
    out = documents.scenes(rows.select("site_id", doc.alias("doc")), "doc", ("site_id",))
    return out.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sample_count").alias("samples"),
        F.sum("no_data_count").alias("no_data"),
        F.max("scene_date").cast("string").alias("last_scene"),
        F.max("nbr_mean").alias("max_mean"), F.min("p25").alias("min_p25"),
        F.count_if(F.col("sample_count").isNull()).alias("without_statistics"))


@query
def burn_ratio(spark, sf):
    df = T.raw(spark, sf, "lineitem")
    value = physics.nbr(F.col("l_quantity"), F.col("l_discount") * 100.0,
                        F.col("l_linenumber") + 3)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("nbr"),
                     rules.burn_severity(value).alias("severity"),
                     rules.optical_verdict(value).alias("verdict"))


@query
def site_acquisitions(spark, sf):
    sites = T.sites(spark, sf).select(
        F.col("poly_id").alias("site_id"), F.col("rings")[0][0]["y"].alias("latitude"),
        F.col("rings")[0][0]["x"].alias("longitude"))
    pixels = skew.lookup_join(T.raw(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "site_id"), sites,
                              ["site_id"], "inner", spread=F.col("l_orderkey")).select(
        "site_id", (F.col("l_orderkey") % 30).alias("day"),
        (F.col("latitude") + (F.col("l_partkey") % 9) * 0.01).alias("latitude"), "longitude",
        (F.col("l_quantity") * 4 + 290.0).alias("f1"),
        (F.col("l_quantity") * 2 + 285.0).alias("s7"),
        (F.col("l_linenumber") % 3).alias("valid"))
    return optical.site_acquisitions(pixels, sites)


@query
def background_temperature(spark, sf):
    out = thermal.background_temperature(T.detections(spark, sf))
    return out.withColumn("background_k", text.half_up(F.col("background_k"), 6))


@query
def fire_temperature(spark, sf):
    return thermal.add_fire_temperature(T.detections(spark, sf)).select(
        "detection_id", "t_fire_k", "fire_area_m2", "combustion_regime", "t_fire_confidence")


@query
def planck_radiance(spark, sf):
    df = T.detections(spark, sf)
    return df.select("detection_id", text.half_up(
        physics.planck_radiance(3.74, F.col("bright_ti4")) / 1e3, 3).alias("radiance"))


# --- model ------------------------------------------------------------------------


def _trained(spark, sf):
    # the split reads its rows twice and the fit many times: each works on a written table
    corpus = written(labels.split(written(training.feature_frame(labelled(spark, sf)))))
    train, test = (corpus.where(F.col("split") == name).drop("split") for name in ("train", "test"))
    return training.fit_forest(train), train, test


@query
def model_metrics(spark, sf):
    model, _, test = _trained(spark, sf)
    return training.metrics(written(training.predict(model, test).select("target_label", "predicted", "probabilities")))


@query
def majority_baseline(spark, sf):
    # what a model has to beat: every test row called by the commonest class of the training rows
    corpus = labels.split(labelled(spark, sf))
    majority = F.lit(training.majority_class(corpus.where("split = 'train'")))
    counts = verified.confusion(corpus.where("split = 'test'"), F.col("target_label"), majority)
    out = verified.overall(verified.class_report(counts))
    return out.select(majority.alias("majority"), "n", *[
        text.half_up(F.col(c), 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query
def model_factors(spark, sf):
    model, train, test = _trained(spark, sf)
    alerts = test.where("inside_industrial = 1 AND frp >= 10")
    medians = training.training_medians(train, features.FEATURES)
    return training.occlusion_factors(model, alerts, medians).select(
        "detection_id", "rank", "feature", "contribution")


@query
def block_folds(spark, sf):
    folds = training.block_folds(T.detections(spark, sf), 5)
    return folds.groupBy("block", "fold").agg(F.count(F.lit(1)).alias("n"))


# --- text -------------------------------------------------------------------------


@query
def rationale_factors(spark, sf):
    df = T.detections(spark, sf)
    rationale = F.concat(
        F.lit("frp="), (F.col("detection_id") % 90 / 100.0).cast("string"),
        F.lit(" [3.5]; fac_brick_kiln=-0.25; odd_name = 0.5 [ x ]; no factor"))
    parsed = text.rationale_factors(rationale, 2)
    return df.select("detection_id", parsed[0]["feature"].alias("first"),
                     parsed[0]["contribution"].alias("contribution"),
                     parsed[1]["label"].alias("second_label"),
                     parsed[1]["direction"].alias("second_direction"))


@query
def normalised_text(spark, sf):
    df = T.raw(spark, sf, "customer")
    phone = F.concat(F.lit("+91-"), (F.col("c_custkey") * 7919 % 100000).cast("string"))
    raw = F.when(F.col("c_custkey") % 5 == 0, "nan").when(F.col("c_custkey") % 5 == 1, " None ") \
        .otherwise(F.col("c_name"))
    flag = F.when(F.col("c_custkey") % 3 == 0, "True").when(F.col("c_custkey") % 3 == 1, "1") \
        .otherwise("False")
    return df.select("c_custkey", text.norm_str(raw).alias("clean"),
                     text.norm_bool(flag).alias("flag"), text.mask_number(phone).alias("masked"),
                     text.number_or(F.col("c_name"), 7.0).alias("number"),
                     text.confidence_percent(F.col("c_mktsegment")).alias("confidence"),
                     text.timestamp_key(F.concat(F.lit("2024-01-02T03:04:"), F.lpad(
                         (F.col("c_custkey") % 60).cast("string"), 2, "0"))).alias("ts_key"))


@query
def percentiles_by_group(spark, sf):
    out = quantiles.exact_percentiles(T.raw(spark, sf, "lineitem"), F.col("l_extendedprice"),
                                      [0.1, 0.5, 0.9], ["p10", "p50", "p90"], ["l_returnflag"],
                                      1000.0)
    return out.select("l_returnflag", "n", *[text.half_up(F.col(c), 4).alias(c)
                                             for c in ("p10", "p50", "p90")])


# --- refreshed state and tables ---------------------------------------------------------


def _arrivals(spark, sf, batches):
    """Keyed detections and the batch each arrives with: in order but for up to two days of delay."""
    df = T.keyed(spark, sf)
    arrival = F.col("us") + (F.col("detection_id") % 5) * (13 * C.HOUR_US)
    seen = df.agg(F.min(arrival).alias("low"), F.max(arrival).alias("high")).first()
    if seen.low is None:
        return df.withColumn("_batch", F.lit(0))
    return df.withColumn("_batch", F.floor((arrival - seen.low) * batches / (seen.high - seen.low + 1)).cast("int"))


def _replayed(spark, sf, operator, batches=3):
    """The newest rows of a keyed stream over detections that land batch by batch."""
    root = f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    df = _arrivals(spark, sf, batches)
    for b in range(batches):
        df.where(F.col("_batch") == b).drop("_batch").write.mode("append").parquet(f"{root}/landing")
        stream = read_table(spark, f"{root}/landing", df.drop("_batch").schema)
        keyed.run_batch(operator(stream), root)
    return keyed.newest(spark, root)


@query
def stream_alert_state(spark, sf):
    return keyed.alert_rows(_replayed(spark, sf, keyed.history_stream)).select(
        "detection_id", "frp", "mu_frp", "var_frp", "z_frp", "frp_ratio", "burst_ratio", "state",
        "priority", "tag", "suppressed")


@query
def stream_neighbourhood(spark, sf):
    return _replayed(spark, sf, keyed.activity_stream).select("detection_id", "neighbourhood_active_keys")


def _refreshed(spark, sf, batches=3):
    """Incident and baseline tables after as many refreshes, each of which restates part of the one before."""
    root = f"{checkpoint_root(spark).rstrip('/')}/refresh-{uuid.uuid4().hex}"
    df = _arrivals(spark, sf, batches).select("detection_id", "frp", "area", "timestamp_utc", "_batch")
    sink = refreshed.Refresh(root, buckets=16)
    for b in [*range(batches), 0]:                        # the first one comes once more at the end
        sink(df.where((F.col("_batch") == b) | (F.col("_batch") == b - 1) & (F.col("detection_id") % 4 == 0)).drop("_batch"), b)
    return sink


@query
def refresh_incidents(spark, sf):
    return _refreshed(spark, sf).incidents_table.read(spark).select("detection_id", "frp")


@query
def refresh_baselines(spark, sf):
    return _moments(_refreshed(spark, sf).baselines_table.read(spark))


# --- events, audit and copies -------------------------------------------------------------


@query
def event_union(spark, sf):
    events = T.verified_events(spark, sf).withColumn("label", rules.class_name(F.col("label")))
    path = f"{checkpoint_root(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    # every third event comes from a file, some without a name, a citation, a radius or a known label
    third = F.col("seq") % 3 == 0
    as_text = events.where(third).select(
        F.when(F.col("seq") % 4 != 1, F.col("event_name")).alias("event_name"),
        *[F.col(c).cast("string").alias(c) for c in ("lat", "lon", "start_date", "end_date")],
        F.when(F.col("seq") % 7 == 1, "VOLCANO").otherwise(F.lower("label")).alias("label"),
        *[F.lit("").alias(c) for c in ("served_label", "confidence")],
        F.when(F.col("seq") % 5 != 1, "a report").alias("source"),
        F.when(F.col("seq") % 2 != 1, F.col("radius_km").cast("string")).alias("radius_km"), F.lit("").alias("notes"))
    as_text.write.option("header", True).csv(path)
    found, bad = documents.all_events(spark, events.where(~third), path)
    return found.select("event_name", "label", "radius_km", "origin", F.lit(None).cast("string").alias("reason"),
                        (F.col("seq") > events.where(~third).agg(F.max("seq")).scalar()).alias("after_seeds")) \
        .unionByName(bad.select(F.trim("event_name").alias("event_name"), "reason"), allowMissingColumns=True)


@query
def dispatch_audit(spark, sf):
    alerts = _incident_table(spark, sf)
    return incidents.dispatch_audit(incidents.dispatch_plan(alerts), alerts)


@query
def audit_log(spark, sf):
    return incidents.audit_log(T.actions(spark, sf)).select("seq", "detection_id", F.upper("action").alias("action"))


@query
def baseline_copy(spark, sf):
    base = incidents.cell_baseline(T.keyed(spark, sf), "area")
    stored = base.where("area % 2 = 0")
    copied = incidents.copy_rows(base.unionByName(base), stored, "area")
    whole = stored.unionByName(copied)
    return _moments(whole.unionByName(incidents.copy_rows(base, whole, "area")))


@query
def hex_codes(spark, sf):
    # each step reads the one before, so that a cell is worked out once
    df = T.detections(spark, sf).select("detection_id", hexgrid.hex_cell("latitude", "longitude", 8).alias("cell"))
    df = df.withColumn("area", hexgrid.hex_parent("cell", 6))
    return df.select("detection_id", "cell", "area", hexgrid.hex_parent("area", 4).alias("map_cell"),
                     hexgrid.resolution_of("cell").alias("resolution"), F.element_at(hexgrid.hex_neighbours("cell"), 3).alias("north_west"))
