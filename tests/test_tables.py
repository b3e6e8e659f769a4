"""Sources, reports, labels, incidents, streaming and training on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import incidents, labels, quantiles, recurrence, reports, skew
from emberline.plans import pipeline, tables, training
from emberline.sources import documents, firms, landuse, sinks
from emberline.streaming import recurrence as stream

SF = "/root/testdata/sf0.001"
HEADER = ",".join(firms.CSV_COLUMNS)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- sources ----------------------------------------------------------------------


def test_csv_scan_rejects_error_payloads(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + "\n22.400,70.050,330,0.4,0.4,2026-01-02,0512,N,VIIRS,n,2.0NRT,300,5.5,D"
        "\nbad,70.050,330,0.4,0.4,2026-01-02,0512,N,VIIRS,n,2.0NRT,300,5.5,D\n")
    (tmp_path / "b.csv").write_text("Invalid MAP_KEY.\n")
    good, bad = firms.read_csv(spark, str(tmp_path))
    row = good.first()
    assert good.count() == 1 and row.confidence == "n" and row.timestamp_utc.hour == 5
    assert [r.reason for r in bad.collect()] == ["Invalid MAP_KEY."]


def test_empty_feed_keeps_its_schema(spark):
    assert firms.empty(spark).schema == firms.typed(
        spark.createDataFrame([("1",) * 14], firms.RAW_SCHEMA)).schema


def test_restated_windows_collapse(spark):
    df = firms.typed(spark.createDataFrame(
        [("22.4", "70.0", "", "", "", "2026-01-02", "512", "N", "VIIRS", "60", "2", "", "3", "D")],
        firms.RAW_SCHEMA))
    assert pipeline.ingest([df, df, df]).count() == 1


def test_shrink_guard(spark, tmp_path):
    assert sinks.shrink_reason(100_001, 10_000) and not sinks.shrink_reason(100_001, 10_001)
    assert sinks.shrink_reason(99_999, 1) is None
    df = tables.detections(spark, SF)
    path = str(tmp_path / "corpus")
    span = pipeline.publish(df, path).first()
    assert span.days > 300 and not span.too_short
    assert spark.read.parquet(path).count() == df.count()
    assert sinks.first_existing(spark, [str(tmp_path / "none"), path]) == path
    assert sinks.largest_corpus(spark, [path]) == path


def test_scene_band_key_does_not_matter(spark):
    doc = ('[{"interval":{"from":"2026-01-02T00:00:00Z"},"outputs":{"nbr":{"bands":{"%s":{"stats":'
           '{"mean":0.5,"sampleCount":10,"noDataCount":2,"percentiles":{"25":0.1}}}}}}}]')
    df = spark.createDataFrame([(doc % "B0",), (doc % "odd",), ("[]",)], "d string")
    rows = documents.scenes(df, "d", ()).collect()
    assert [(r.nbr_mean, r.sample_count, r.p25) for r in rows] == [(0.5, 10, 0.1)] * 2


# --- labels and sampling ----------------------------------------------------------


def test_thresholds_follow_open_ground(spark):
    low = spark.range(20000).select((F.col("id") / 20000 * 4.9 + 0.1).alias("frp"),
                                    F.lit(False).alias("inside_industrial"))
    hot = spark.range(10000).select(F.lit(500.0).alias("frp"),
                                    F.lit(True).alias("inside_industrial"))
    a = labels.frp_thresholds(low).first()
    assert a.basis == "PERCENTILE_LOCAL" and a == labels.frp_thresholds(low.union(hot)).first()
    assert labels.frp_thresholds(low.limit(3)).first().basis == "ABSOLUTE_FALLBACK"


def test_exact_percentiles(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(-50, 50), 1) for _ in range(997)] + [3.3] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.exact_percentiles(df, F.col("v"), [0.0, 0.37, 1.0], ["a", "b", "c"]).first()
    ordered, place = sorted(values), 0.37 * (len(values) - 1)
    low = math.floor(place)
    want = ordered[low] + (ordered[low + 1] - ordered[low]) * (place - low)
    assert (got.a, got.b, got.c) == pytest.approx((ordered[0], want, ordered[-1]))


def test_balance_keeps_the_rare_class_and_months(spark):
    sizes = {2: 6000, 3: 3000, 0: 1000, 1: 10}
    parts = [spark.range(n).select(
        (F.col("id") * 10 + k).alias("detection_id"), F.lit(k).alias("target_label"),
        F.date_add(F.lit("2026-01-15").cast("date"), (F.col("id") % 300).cast("int"))
        .alias("acq_date")) for k, n in sizes.items()]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    out = labels.balance(df, 50)
    counts = {r.target_label: r.n for r in labels.class_counts(out).collect()}
    assert counts[1] == 10 and max(counts.values()) / 10 <= 55
    months = out.where("target_label = 2").select(F.month("acq_date")).distinct().count()
    assert months == df.where("target_label = 2").select(F.month("acq_date")).distinct().count()


def test_prior_correction_sums_to_one(spark):
    p = spark.range(1).select(labels.apply_prior(
        F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)),
        F.array(F.lit(2.0), F.lit(1.0), F.lit(0.1))).alias("p")).first().p
    assert sum(p) == pytest.approx(1.0) and p[0] > p[2]


# --- skew helpers -----------------------------------------------------------------


def test_salted_join_and_topk(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(
        F.col("id") % 50).alias("k"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", "left")
    salted = skew.lookup_join(left, right, ["k"], spread=F.col("id"), max_rows=1, min_hot=500)
    assert same(plain.select("id", "v"), salted.select("id", "v"))
    top = skew.top_k(left, ["k"], [F.desc("id")], 2, F.col("id"))
    assert top.groupBy("k").count().where("count > 2").isEmpty()
    assert top.where("k = 0 AND rank = 1").first().id == 2997


def test_hot_key_list_is_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert skew.hot_keys(df, ["k"], 100) is None
    assert skew.hot_keys(df, ["k"], 99).count() == 10


# --- reports and incidents --------------------------------------------------------


def test_one_emergency_outranks_a_crowd(spark):
    rows = [(22.34, 69.87, 1.0, "SUPPRESSED", "PERSISTENT_BASELINE", True)] * 50 \
        + [(10.0, 75.0, 20.0, "P0_EMERGENCY", "ACCIDENTAL_FIRE", False)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, frp double, "
                               "priority string, state string, suppressed boolean")
    first = reports.cell_report(df, 6).first()
    assert (first.top_priority, first.detections) == ("P0_EMERGENCY", 1)
    assert reports.cell_report(df, -5).first().zoom == 9
    assert reports.cell_report(df, 99, min_detections=2).count() == 1


def test_register_keeps_equal_names_apart(spark):
    df = spark.range(40).select(
        F.col("id").alias("detection_id"), F.lit("MONITORING").alias("state"),
        F.lit(10.0).alias("frp"), F.lit(22.0).alias("latitude"), F.lit(70.0).alias("longitude"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 20).cast("int"))
        .alias("acq_date"), F.lit("Unnamed Industrial Site").alias("facility_name"),
        F.when(F.col("id") < 20, "way/1").otherwise("way/2").alias("osm_id"),
        F.lit("general_industrial").alias("facility_type")).withColumn(
        "timestamp_utc", F.col("acq_date").cast("timestamp"))
    got = reports.facility_register(df).collect()
    assert len(got) == 2 and {r.regime for r in got} == {"CONTINUOUS"}
    assert got[0].estimated_fre_gj == pytest.approx(20 * 10 * 12 * 3.6)
    solar = df.withColumn("facility_type", F.lit("renewable_non_thermal"))
    assert reports.facility_register(solar).isEmpty()
    with pytest.raises(KeyError):
        reports.facility_register(df.drop("frp"))


def test_upserts_and_copies_are_idempotent(spark):
    df = tables.detections(spark, SF)
    assert incidents.new_rows(df, df).isEmpty()
    audit = spark.createDataFrame(
        [(1, "a", "CONFIRM", "2026-01-02 00:00:00"), (2, "a", "CONFIRM", "2026-01-02T00:00:00"),
         (3, "b", "NOTE", "2026-01-02 00:00:00.5")],
        "audit_id long, detection_id string, action string, timestamp_utc string")
    first = incidents.copy_audit(audit, audit.limit(0))
    assert first.count() == 2 and incidents.copy_audit(audit, first).isEmpty()


def test_dispatch_plan_skips_planned_alerts(spark):
    df = spark.createDataFrame(
        [(1, 1, "P0_EMERGENCY"), (2, 2, "SUPPRESSED"), (3, 3, "ODD"), (4, 1, "P0_EMERGENCY")],
        "detection_id long, incident_id long, priority string").select(
        "*", F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(3.0).alias("frp"),
        F.lit("2026-01-01").alias("acq_date"), F.lit("X").alias("state"),
        F.lit(None).cast("string").alias("facility_name"))
    plan = incidents.dispatch_plan(df)
    assert sorted(r.channel for r in plan.collect()) == ["email", "router", "router", "sms",
                                                         "webhook"]
    assert incidents.dispatch_plan(df, plan).isEmpty()


# --- pipeline, streaming, training ------------------------------------------------


def test_batch_pipeline(spark):
    out = pipeline.run(tables.detections(spark, SF), tables.sites(spark, SF),
                       tables.forests(spark, SF))
    assert out.count() == tables.detections(spark, SF).count()
    labelled = pipeline.label(out)
    assert labelled.where("target_label IS NULL").isEmpty()


def test_micro_batches_equal_one_batch(spark, tmp_path):
    df = tables.keyed(spark, SF).orderBy("us").limit(400).repartition(1).sortWithinPartitions("us")
    rows = df.persist()
    landing = str(tmp_path / "in")
    cut = [r.us for r in rows.orderBy("us").select("us").collect()]
    low, high = cut[150], cut[300]
    parts = [rows.where(F.col("us") < low), rows.where((F.col("us") >= low) & (F.col("us") < high)),
             rows.where(F.col("us") >= cut[280])]          # the last one restates twenty rows
    sink = stream.RecurrenceSink(str(tmp_path / "out"), keys=("detection_id",))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(landing)
        source = stream.read_table(spark, landing, rows.schema)
        stream.start(source, sink, str(tmp_path / "ckpt")).awaitTermination(300)
    got = stream.latest(spark, str(tmp_path / "out"))
    want = recurrence.evaluate(rows)
    columns = ["detection_id", "n_30d", "mu_frp", "n_24h", "neighbourhood_active_keys",
               "onset_lag_days", "source_age_days", "state"]
    assert same(got.select(*columns), want.select(*columns))
    status = stream.refresh_status(spark, str(tmp_path / "out")).first()
    assert status.rows == 400 and status.last_success_us == cut[-1]
    rows.unpersist()


def test_late_rows_are_listed_and_scored(spark, tmp_path):
    rows = tables.keyed(spark, SF)
    newest = rows.agg(F.max("us")).first()[0]
    sink = stream.RecurrenceSink(str(tmp_path / "out"))
    sink(rows.where(F.col("us") >= newest - 20 * 86_400_000_000), 0)
    sink(rows.where(F.col("us") < newest - 300 * 86_400_000_000), 1)
    late = spark.read.parquet(str(tmp_path / "out/late")).where("batch_id = 1")
    assert late.count() > 0
    history = spark.read.parquet(str(tmp_path / "out/history"))
    assert history.where("batch_id = 1").count() == late.count()
    whole = recurrence.evaluate(history.drop("batch_id"))
    columns = ["detection_id", "n_30d", "state", "priority", "neighbourhood_active_keys"]
    assert same(stream.latest(spark, str(tmp_path / "out")).select(*columns), whole.select(*columns))


def test_training_round(spark):
    scored = recurrence.evaluate(tables.keyed(spark, SF)).persist()
    corpus = labels.training_corpus(scored).persist()
    cfg = training.ModelConfig(trees=5)
    parts = labels.split(corpus)
    train = training.feature_frame(parts.where("split = 'train'")).persist()
    test = training.feature_frame(parts.where("split = 'test'")).persist()
    model = training.fit_forest(train, cfg=cfg)
    out = training.predict(model, test, prior=[1.0, 1.0, 1.0, 1.0])
    row = out.first()
    assert sum(row.probabilities) == pytest.approx(1.0)
    score = training.metrics(out).first()
    assert 0.5 < score.accuracy <= 1.0 and score.log_loss > 0
    medians = training.training_medians(train, training.features.FEATURES)
    factors = training.occlusion_factors(model, test.limit(5), medians)
    assert factors.groupBy("detection_id").count().where("count <> 4").isEmpty()
    served = training.score_detections(model, corpus)
    assert served.where("served_class IS NULL").isEmpty()
    folds = training.block_folds(corpus, 3)
    assert folds.groupBy("block").agg(F.countDistinct("fold").alias("f")).where("f > 1").isEmpty()
    audit = training.ablation(train, test, cfg).first()
    assert audit.dropped == 14
    bundle = training.metrics_bundle(training.metrics(out), labels.frp_thresholds(corpus), "r1",
                                     F.lit("2026-01-01"), "rule labels")
    assert training.model_provenance(bundle, spark).first().rule_version == "v8"
    assert training.model_provenance(None, spark).first().status == "NO_METRICS"


def test_feed_with_nan_and_two_clocks(spark):
    raw = spark.createDataFrame(
        [("10", "70", "2024-01-02", "0130", "N", "nan"), ("10", "70", "2024-01-02", "130", "N", "5"),
         ("nan", "70", "2024-01-02", "130", "N", "5")],
        "latitude string, longitude string, acq_date string, acq_time string, satellite string, frp string")
    typed = firms.typed(raw.withColumn("brightness", F.lit("300.5")))
    assert typed.count() == 2 and typed.where("frp IS NULL").count() == 1
    assert firms.dedupe(typed).count() == 1
    assert dict(typed.dtypes)["brightness"] == "double"


def test_land_cover_without_a_hinted_column(spark):
    df = spark.createDataFrame([(1, "steel works"), (2, "meadow")], "id int, text_a string")
    assert [r.id for r in landuse.land_cover(df).collect()] == [1]


def test_model_queries_fit_the_production_forest(spark):
    from emberline.plans import catalog

    model, _, _ = catalog._trained(spark, SF)
    assert model.stages[-1].getNumTrees == training.ModelConfig().trees == 250


def test_a_forest_is_fitted_on_a_written_table(spark, monkeypatch):
    from emberline.plans import catalog

    monkeypatch.setattr(training, "fit_forest", lambda train: None)
    for df in catalog._trained(spark, SF)[1:]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan and not any(step in plan for step in ("Window", "Join", "Exchange"))


def test_a_forest_does_not_depend_on_the_order_of_rows(spark):
    rows = spark.range(400).selectExpr("id AS detection_id", "double(id % 7) AS a", "double(id * 37 % 101) AS b", "int(id % 3) AS target_label")
    cfg = training.ModelConfig(trees=3)
    one, other = (training.fit_forest(df, ("a", "b"), cfg).stages[-1] for df in (rows.coalesce(1), rows.orderBy(F.desc("b")).repartition(5)))
    assert one.toDebugString.split("\n", 1)[1] == other.toDebugString.split("\n", 1)[1]


def test_factors_score_only_what_a_median_changes(spark):
    rows = spark.range(60).selectExpr("id AS detection_id", "double(id % 3) AS a", "double(id % 2) AS b", "double(5) AS c", "int(id % 3) AS target_label")
    names, medians = ("a", "b", "c"), [1.0, 0.0, 5.0]
    model = training.fit_forest(rows, names, training.ModelConfig(trees=5))
    scored = []

    class Watched:
        def transform(self, df):
            scored.append(df)
            return model.transform(df)

    found = training.occlusion_factors(Watched(), rows.drop("target_label"), medians, names, 3).collect()
    assert scored[1].count() == 40 + 30                   # a differs from its median in 40 rows, b in 30, c in none
    whole = {r.detection_id: r.probability for r in model.transform(rows).collect()}
    assert len(found) == 180 and {r.contribution for r in found if r.feature == "c"} == {0.0}
    for r in found:
        was = rows.where(F.col("detection_id") == r.detection_id) if r.detection_id in (0, 7) else None
        if was is not None:
            p = whole[r.detection_id]
            cls = int(p.argmax())
            q = model.transform(was.withColumn(r.feature, F.lit(medians[names.index(r.feature)]))).first().probability
            assert abs(r.contribution - (p[cls] - q[cls])) < 1e-4


def test_events_from_file_follow_the_seeds(spark, tmp_path):
    from emberline.sources import documents
    seeds = spark.createDataFrame([(7, "Seed", 10.0, 70.0, "2024-01-01", "2024-01-02", 2.0, "ACCIDENTAL_FIRE")],
                                  "seq long, event_name string, lat double, lon double, start_date string, end_date string, "
                                  "radius_km double, label string") \
        .withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    alone, none = documents.all_events(spark, seeds, str(tmp_path / "missing.csv"))
    assert alone.count() == 1 and none.isEmpty()
    (tmp_path / "events.csv").write_text(
        "event_name,lat,lon,start_date,end_date,label,served_label,confidence,source,radius_km,notes\n"
        "B,1,2,2024-01-01,2024-01-03,accidental_fire,,,paper,,\nA,1,2,2024-01-01,2024-01-03,ACCIDENTAL_FIRE,,,paper,4,\n"
        ",1,2,2024-01-01,2024-01-03,ACCIDENTAL_FIRE,,,paper,4,\nC,99,2,2024-01-01,2024-01-03,ACCIDENTAL_FIRE,,,paper,4,\n")
    found, bad = documents.all_events(spark, seeds, str(tmp_path / "events.csv"))
    assert sorted((r.seq, r.event_name, r.radius_km, r.origin) for r in found.collect()) == [
        (7, "Seed", 2.0, "seed"), (8, "A", 4.0, "file"), (9, "B", 3.0, "file")]
    assert [tuple(r) for r in bad.collect()] == [("C", "bad coordinates")]


def test_an_empty_training_table_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.training_table(spark, str(tmp_path / "none"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        sinks.training_table(spark, str(tmp_path / "empty"))
