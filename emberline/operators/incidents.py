"""Incident table upkeep: inserts, baselines, analyst actions, audit, dispatch plan, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import rules
from emberline.functions.text import alert_sms, half_up, timestamp_key
from emberline.operators import skew
from emberline.operators.reports import exact_sum


def detection_hash(df: DataFrame) -> Column:
    """Identity of a detection that does not depend on its row position."""
    return F.md5(F.concat_ws(
        "|", F.col("satellite"), F.format_string("%.4f", F.col("latitude")),
        F.format_string("%.4f", F.col("longitude")),
        F.unix_micros("timestamp_utc").cast("string")))


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "detection_id") -> DataFrame:
    """Rows whose id is not stored yet."""
    return incoming.join(stored.select(key), key, "left_anti")


def cell_baseline(df: DataFrame, cell: str = "cell", since: Column | None = None) -> DataFrame:
    """Count, mean and population variance of FRP per cell, optionally since an instant."""
    rows = df if since is None else df.where(F.col("timestamp_utc") >= since)
    return rows.groupBy(cell).agg(
        F.count("frp").alias("n"),
        (exact_sum(F.col("frp")) / F.count("frp")).alias("mean"), F.var_pop("frp").alias("variance"),
        F.max("timestamp_utc").alias("last_updated"))


def merge_baselines(old: DataFrame, new: DataFrame, cell: str = "cell") -> DataFrame:
    """Pooled moments of two baselines; one-sided cells pass through."""
    both = old.unionByName(new)
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    second = F.sum(F.col("n") * (F.col("variance") + F.col("mean") * F.col("mean"))) / n
    return both.groupBy(cell).agg(
        n.alias("n"), mean.alias("mean"),
        F.greatest(second - mean * mean, F.lit(0.0)).alias("variance"),
        F.max("last_updated").alias("last_updated"))


def recurrence_evidence(incidents: DataFrame, baselines: DataFrame) -> DataFrame:
    """What a cell normally does, beside the incident; no baseline is said, not invented."""
    joined = skew.lookup_join(
        incidents, baselines.select("cell", F.col("n").alias("detections_30d"), "mean", "variance"),
        ["cell"], spread=F.col("detection_id"))
    sigma = F.sqrt(F.greatest("variance", F.lit(0.0)))
    return joined.select(
        *incidents.columns,
        F.when(F.col("detections_30d").isNull(), "NO_BASELINE").otherwise("OK")
        .alias("evidence_status"),
        "detections_30d", half_up(F.col("mean"), 2).alias("mean_frp_mw"),
        half_up(sigma, 2).alias("sigma_frp_mw"),
        F.when(sigma > 1e-6, half_up((F.col("frp") - F.col("mean")) / sigma, 2))
        .alias("evidence_z"),
        (F.col("detections_30d") >= C.PERSISTENCE_MIN).alias("is_established"))


def fold_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Final status, priority, state and class after all analyst actions, in time order.

    Every field is decided by the last action that sets it, and a confirmation lifts P2 to P0
    only if it comes after the last action that set the priority. Last-by-order aggregates
    combine map-side, so an incident with very many actions costs no more than others.
    Actions: at, seq, detection_id, action, new_class, operator_notes.
    """
    kind = F.upper(F.trim("action"))
    named = (kind == "RECLASSIFY") & F.col("new_class").isNotNull()
    order = F.struct("at", "seq")
    status = F.when(kind.isin("CONFIRM", "DISPATCH"), "DISPATCHED") \
        .when(kind == "FALSE_POSITIVE", "MUTED_ROUTINE") \
        .when(kind == "RECLASSIFY", F.when(named, "ACKNOWLEDGED")) \
        .when(kind == "STATUS", F.when(F.upper("new_class").isin(*C.STATUSES),
                                       F.upper("new_class"))) \
        .otherwise("ACKNOWLEDGED")
    state = F.when(kind == "CONFIRM", "CONFIRMED_DISPATCH") \
        .when(kind == "DISPATCH", "EMERGENCY_DISPATCHED") \
        .when(kind == "FALSE_POSITIVE", "SUPPRESSED_FALSE_ALARM") \
        .when(named, F.when(F.col("new_class") == "ACCIDENTAL_FIRE", "UNCONTAINED_EMERGENCY")
              .when(F.col("new_class") == "PERSISTENT_BASELINE", "PERSISTENT_BASELINE")
              .otherwise("TRANSIENT_SUSPICION"))
    priority = F.when(kind == "FALSE_POSITIVE", "NON_ALERT").when(
        named, F.when(F.col("new_class") == "ACCIDENTAL_FIRE", "P0_EMERGENCY")
        .when(F.col("new_class") == "PERSISTENT_BASELINE", "P2_ADVISORY").otherwise("NON_ALERT"))
    notes = F.nullif(F.trim("operator_notes"), F.lit(""))

    def last(value):
        return F.max_by(value, F.when(value.isNotNull(), order))

    folded = actions.groupBy("detection_id").agg(
        F.count(F.lit(1)).alias("actions"), last(status).alias("_status"),
        last(state).alias("_state"), last(priority).alias("_priority"),
        last(F.when(named, F.col("new_class"))).alias("_class"), last(notes).alias("_notes"),
        F.max(F.when(priority.isNotNull(), order)).alias("_set_at"),
        F.max(F.when(kind == "CONFIRM", order)).alias("_confirmed_at"))
    # one row per incident on both sides
    joined = incidents.join(folded, "detection_id", "left")
    base = F.coalesce("_priority", "priority")
    lifted = F.col("_confirmed_at").isNotNull() & (
        F.col("_set_at").isNull() | (F.col("_confirmed_at") > F.col("_set_at")))
    changed = {
        "priority": F.when((base == "P2_ADVISORY") & lifted, "P0_EMERGENCY").otherwise(base),
        "state": F.coalesce("_state", "state"), "status": F.coalesce("_status", "status"),
        "predicted_class": F.coalesce("_class", "predicted_class"),
        "operator_notes": F.col("_notes"), "actions": F.coalesce("actions", F.lit(0))}
    keep = [c for c in incidents.columns if c not in changed]
    return joined.select(*keep, *[v.alias(k) for k, v in changed.items()])


def rejected_statuses(actions: DataFrame) -> DataFrame:
    """Status updates outside the allowed set."""
    return actions.where((F.upper(F.trim("action")) == "STATUS") & ~F.coalesce(
        F.upper("new_class").isin(*C.STATUSES), F.lit(False)))


def audit_rows(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Append-only audit entries; an action on an unknown detection keeps a NULL incident."""
    known = incidents.select("detection_id", "incident_id", "predicted_class")
    return actions.join(known, "detection_id", "left").select(
        "at", "seq", "incident_id", "detection_id", F.upper(F.trim("action")).alias("action"),
        F.col("predicted_class").alias("previous_class"),
        F.coalesce("new_class", "predicted_class").alias("new_class"), "operator_notes")


def remap_audit(audit: DataFrame, incidents: DataFrame) -> DataFrame:
    """Point audit rows at the incident with their detection id, else at nothing."""
    target = incidents.select("detection_id", F.col("incident_id").alias("_new"))
    return audit.join(target, "detection_id", "left") \
        .withColumn("incident_id", F.col("_new")).drop("_new")


def copy_audit(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows not stored yet by (detection, action, normalised time): running twice adds nothing."""
    def keyed(df):
        return df.withColumn("_ts", timestamp_key(F.col("timestamp_utc")))

    keys = ["detection_id", "action", "_ts"]
    once = skew.first_per_key(keyed(incoming), keys, [F.col("audit_id")])
    return once.join(keyed(stored).select(*keys), keys, "left_anti").drop("_ts")


def quality_checks(incidents: DataFrame, audit: DataFrame) -> DataFrame:
    """Duplicate audit entries, entries tied to another detection, incidents without a place."""
    dup = audit.groupBy("detection_id", "action", "timestamp_utc") \
        .agg((F.count(F.lit(1)) - 1).alias("extra")) \
        .agg(F.lit("duplicate_audit").alias("check_name"),
             F.coalesce(F.sum("extra"), F.lit(0)).alias("n"))
    crossed = audit.join(
        incidents.select("incident_id", F.col("detection_id").alias("_d")), "incident_id") \
        .agg(F.lit("audit_of_other_detection").alias("check_name"),
             F.count_if(F.col("detection_id") != F.col("_d")).alias("n"))
    lost = incidents.agg(
        F.lit("no_coordinates").alias("check_name"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("n"))
    return dup.unionByName(crossed).unionByName(lost)


def score(df: DataFrame, predicted: Column, confidence: Column) -> DataFrame:
    """Served class, note, priority and state; an unscored row is NOT_ASSESSED."""
    domain = rules.in_season_domain(F.col("latitude"), F.col("longitude"))
    guard = rules.serving_guard(predicted, F.coalesce("facility_type", F.lit("")), domain,
                                F.col("in_forest"))
    out = df.withColumn("_g", F.when(predicted.isNotNull(), guard))
    served = F.col("_g.served_class")
    out = out.withColumns({
        "model_class": predicted, "served_class": F.coalesce(served, F.lit("NOT_ASSESSED")),
        "guard_note": F.col("_g.note"), "class_confidence": confidence,
        "_r": rules.served_routing(served, F.col("inside_industrial"))})
    return out.withColumns({"served_priority": F.col("_r.priority"),
                            "served_state": F.col("_r.state")}).drop("_g", "_r")


DISPATCH_KEYS = ("incident_id", "latitude", "longitude", "acq_date")


def dispatch_plan(alerts: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """One row per alert and channel to notify, or one refusal with its reason.

    Planned means planned: nothing here marks an incident as dispatched.
    """
    once = skew.first_per_key(alerts, DISPATCH_KEYS, [F.col("detection_id")])
    if planned is not None:
        once = once.join(planned.select(*DISPATCH_KEYS).distinct(), list(DISPATCH_KEYS),
                         "left_anti")
    priority = F.upper(F.coalesce("priority", F.lit("NON_ALERT")))
    routes = F.lit(None).cast("array<string>")
    for name, channels in C.PRIORITY_ROUTING.items():
        listed = F.array(*[F.lit(c) for c in channels]) if channels \
            else F.array().cast("array<string>")
        routes = F.when(priority == name, listed).otherwise(routes)
    status = F.when(routes.isNull() | (F.size(routes) == 0), "REFUSED_PRIORITY") \
        .otherwise("PLANNED")
    reason = F.when(routes.isNull(), "unknown priority").when(
        F.size(routes) == 0, "suppressed by design")
    channels = F.when(F.size(routes) > 0, routes).otherwise(F.array(F.lit("router")))
    return once.select(
        *DISPATCH_KEYS, "detection_id", priority.alias("priority"), status.alias("status"),
        reason.alias("reason"), F.explode(channels).alias("channel"),
        alert_sms(priority, F.col("state"), F.col("latitude"), F.col("longitude"),
                  F.col("frp"), F.col("facility_name")).alias("sms_body"))


def dispatch_audit(plan: DataFrame, incidents: DataFrame) -> DataFrame:
    """One audit row per dispatched or refused alert: channels with their status, class as it was.

    A plan delivers nothing, so the incident's status stays what it is.
    """
    lines = plan.groupBy("incident_id", "detection_id").agg(F.array_join(F.array_sort(F.collect_set(
        F.concat_ws("=", "channel", "status"))), "; ").alias("operator_notes"))
    known = incidents.select("incident_id", "status")
    return lines.join(known, "incident_id", "left").select(
        "incident_id", "detection_id", F.lit("DISPATCH").alias("action"), F.col("status").alias("previous_class"),
        F.col("status").alias("new_class"), "operator_notes")


def audit_log(audit: DataFrame, limit: int = 100) -> DataFrame:
    """The newest rows over all detections, latest first."""
    return audit.orderBy(F.desc("at"), F.desc("seq")).limit(limit)


def copy_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, each key once: copying the outcome again adds nothing."""
    others = [F.col(c) for c in incoming.columns if c != key]
    return new_rows(skew.first_per_key(incoming, [key], [F.struct(*others)]), stored, key)
