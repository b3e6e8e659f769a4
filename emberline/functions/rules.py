"""Decision rules as single CASE expressions: alert state, weak label, guards, ladders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import half_up

# --- alert state machine ----------------------------------------------------------


def z_score(frp: Column, mu: Column, var: Column) -> Column:
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    return F.when(std > 1e-4, (frp - mu) / std).otherwise(F.lit(0.0))


def frp_ratio(frp: Column, mu: Column) -> Column:
    return F.when(mu > 1e-4, frp / mu).otherwise(F.lit(1.0))


def _decision(state, priority, tag, suppressed, rationale) -> Column:
    priority = priority if isinstance(priority, Column) else F.lit(priority)
    return F.struct(F.lit(state).alias("state"), priority.alias("priority"),
                    F.lit(tag).alias("tag"), F.lit(suppressed).alias("suppressed"),
                    rationale.alias("rationale"))


def alert_decision(n: Column, frp: Column, mu: Column, var: Column, inside: Column) -> Column:
    """struct(state, priority, tag, suppressed, rationale) from a source's prior history."""
    z, ratio = z_score(frp, mu, var), frp_ratio(frp, mu)
    fmt = F.format_string
    persistent, fresh = n >= C.PERSISTENCE_MIN, n < C.LOW_RECURRENCE_MAX
    hot = frp >= C.EMERGENCY_FRP
    return F.when(persistent & ((z > C.SURGE_Z) | (frp > C.SURGE_RATIO * mu)), _decision(
        "ESCALATED_FLAREUP", "P1_ALERT", "escalated_flareup", False,
        fmt("Surge at an established source: N_30=%d, FRP=%.1f MW against mean %.1f MW "
            "(Z=%.2f, ratio=%.2f).", n, frp, mu, z, ratio))) \
        .when(persistent & (z <= C.ROUTINE_Z), _decision(
            "PERSISTENT_BASELINE", "SUPPRESSED", "flare_or_kiln", True,
            fmt("Routine emission of an established source: N_30=%d, Z=%.2f.", n, z))) \
        .when(persistent, _decision(
            "MONITORING", "P2_ADVISORY", "moderate_flare_elevation", False,
            fmt("Established source moderately elevated: N_30=%d, Z=%.2f.", n, z))) \
        .when(fresh & inside & hot, _decision(
            "ACCIDENTAL_FIRE", "P0_EMERGENCY", "accidental_industrial_fire", False,
            fmt("New strong source inside an industrial site: N_30=%d, FRP=%.1f MW.", n, frp))) \
        .when(fresh & inside, _decision(
            "MONITORING", "P2_ADVISORY", "low_frp_industrial_anomaly", False,
            fmt("New weak source inside an industrial site: N_30=%d, FRP=%.1f MW.", n, frp))) \
        .when(fresh, _decision(
            "TRANSIENT_SUSPICION", "NON_ALERT", "background_agri_burn", True,
            fmt("Outside mapped sites with little history: N_30=%d; not classified.", n))) \
        .otherwise(_decision(
            "MONITORING", F.when(inside & hot, F.lit("P1_ALERT")).otherwise("P2_ADVISORY"),
            "developing_cluster", False,
            fmt("Developing source: N_30=%d, FRP=%.1f MW.", n, frp)))


# --- weak labels ------------------------------------------------------------------


def in_season_domain(lat: Column, lon: Column) -> Column:
    """Region whose burn calendar is calibrated; missing coordinates count as inside."""
    ok = lat.between(*C.SEASON_LAT) & lon.between(*C.SEASON_LON)
    missing = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)
    return F.when(missing, F.lit(True)).otherwise(ok)


def is_burst(n30: Column, n24: Column, ratio: Column) -> Column:
    return (n30 >= C.BURST_MIN_N30) & (n24 >= C.BURST_MIN_N24) & (ratio > C.BURST_RATIO)


def weak_label(*, facility_type: Column, inside: Column, frp: Column, n30: Column, z: Column,
               onset: Column, n24: Column, burst_ratio: Column, neighbours: Column,
               in_forest: Column, month: Column, in_domain: Column,
               thresholds: dict[str, Column]) -> Column:
    """Rule v8: recurrence is consulted before energy; first match wins."""
    burst = is_burst(n30, n24, burst_ratio)
    established = n30 >= C.PERSISTENCE_MIN
    late = onset > C.ONSET_LAG_ACCIDENT_DAYS
    surge_inside = F.lit(False) if C.INSIDE_SURGE_Z == float("inf") else z > C.INSIDE_SURGE_Z
    forest_floor = thresholds["artifact_floor_forest"]
    floor = F.when(in_forest & (forest_floor > 0), forest_floor) \
        .when(month.isin(*C.HARVEST_MONTHS), thresholds["artifact_floor_harvest"]) \
        .otherwise(thresholds["artifact_floor"])
    bar = F.when(in_domain, C.UNMAPPED_ACCIDENT_FRP).otherwise(C.UNMAPPED_ACCIDENT_FRP_ABROAD)
    fresh = n30 < C.LOW_RECURRENCE_MAX
    return F.when(F.lower(F.trim(facility_type)) == C.NON_COMBUSTION_TYPE, 3) \
        .when(inside & established & (late | surge_inside), 1) \
        .when(inside & burst, 1) \
        .when(inside & established, 0) \
        .when(inside & fresh & (frp >= C.EMERGENCY_FRP), 1) \
        .when(inside, 3) \
        .when(established & ((z > C.OUTSIDE_SURGE_Z)
                             | (late & (neighbours <= C.QUIET_NEIGHBOURS_MAX)) | burst), 1) \
        .when(established, 0) \
        .when(fresh & (frp >= bar), 1) \
        .when(~in_domain, 3) \
        .when(frp < floor, 3) \
        .otherwise(2).cast("int")


def class_name(label: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in C.CLASS_NAMES]), label)


def serving_guard(predicted: Column, facility_type: Column, in_domain: Column,
                  in_forest: Column) -> Column:
    """struct(served_class, note): land use, then calendar domain, then forest cover."""
    transient, burn = C.CLASS_NAMES[3], C.CLASS_NAMES[2]
    solar = F.lower(F.trim(facility_type)) == C.NON_COMBUSTION_TYPE

    def out(cls, note):
        return F.struct(cls.alias("served_class"), note.alias("note"))

    none = F.lit(None).cast("string")
    return F.when(solar & (predicted != transient),
                  out(F.lit(transient), F.lit("non-combustion land use"))) \
        .when(solar, out(predicted, none)) \
        .when((predicted == burn) & ~in_domain,
              out(F.lit(transient), F.lit("outside the calibrated burn calendar"))) \
        .when((predicted == burn) & in_forest,
              out(F.lit(C.FOREST_CLASS), F.lit("inside mapped forest"))) \
        .otherwise(out(predicted, none))


def served_routing(served: Column, inside: Column) -> Column:
    """struct(priority, state) shown for a served class."""
    def out(priority, state):
        priority = priority if isinstance(priority, Column) else F.lit(priority)
        return F.struct(priority.alias("priority"), F.lit(state).alias("state"))

    return F.when(served == "ACCIDENTAL_FIRE", out(
        F.when(inside, F.lit("P0_EMERGENCY")).otherwise("P1_ALERT"), "UNCONTAINED_EMERGENCY")) \
        .when(served == "PERSISTENT_BASELINE", out(
            F.when(inside, F.lit("P2_ADVISORY")).otherwise("NON_ALERT"), "PERSISTENT_BASELINE")) \
        .when(served == C.FOREST_CLASS, out("P2_ADVISORY", "FOREST_FIRE")) \
        .otherwise(out("NON_ALERT", "TRANSIENT_SUSPICION"))


# --- ladders ----------------------------------------------------------------------


def priority_rank(priority: Column) -> Column:
    """0 for the most urgent; names outside the list rank last."""
    out = F.lit(len(C.PRIORITY_ORDER))
    for i, name in enumerate(C.PRIORITY_ORDER):
        out = F.when(priority == name, i).otherwise(out)
    return out.cast("int")


def priority_name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(p) for p in C.PRIORITY_ORDER]), rank),
                      F.lit("UNKNOWN"))


def combustion_regime(temp_k: Column) -> Column:
    return F.when(temp_k.isNull() | F.isnan(temp_k), "UNKNOWN") \
        .when(temp_k < C.BIOMASS_MAX_K, "BIOMASS") \
        .when(temp_k < C.FLARE_MIN_K, "INTERMEDIATE").otherwise("HIGH_TEMP_COMBUSTION")


def burn_severity(dnbr: Column) -> Column:
    return F.when(dnbr.isNull() | F.isnan(dnbr), "UNKNOWN").when(dnbr < -0.10, "REGROWTH") \
        .when(dnbr < 0.10, "UNBURNED").when(dnbr < 0.27, "LOW_SEVERITY") \
        .when(dnbr < 0.44, "MODERATE_LOW").when(dnbr < 0.66, "MODERATE_HIGH") \
        .otherwise("HIGH_SEVERITY")


def optical_verdict(dnbr: Column) -> Column:
    return F.when(dnbr.isNull() | F.isnan(dnbr), "UNMEASURED").when(dnbr <= -0.10, "REGROWTH") \
        .when(dnbr < 0.10, "CONTAINED").when(dnbr < 0.27, "AMBIGUOUS").otherwise("REFUTED")


def frp_severity(frp: Column) -> Column:
    return F.when(frp >= 200, "CRITICAL").when(frp >= 75, "HIGH") \
        .when(frp >= 25, "MODERATE").otherwise("LOW")


def frp_bin(frp: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in zip(C.FRP_BINS, C.FRP_BINS[1:], C.FRP_BIN_LABELS):
        out = F.when((frp >= low) & ((frp < high) if high < math.inf else F.lit(True)), label).otherwise(out)
    return out


def freshness(age_hours: Column, replay: Column | bool = False) -> Column:
    """How old the newest detection is; REPLAY where ingestion is held back on purpose."""
    held = replay if isinstance(replay, Column) else F.lit(replay)
    return F.when(held, "REPLAY").when(age_hours < 6, "LIVE").when(age_hours <= 48, "RECENT").otherwise("STALE")


def dnbr_candidate(inside: Column, frp: Column, n30: Column) -> Column:
    return (inside | (frp >= C.EMERGENCY_FRP)) & (n30 < C.PERSISTENCE_MIN)


def emissions(frp: Column, facility_type: Column) -> Column:
    """struct(co2, so2, nox, pm25 in kg/h, basis) by facility keyword family."""
    text = F.lower(F.coalesce(facility_type, F.lit("non_industrial")))
    power = F.greatest(frp, F.lit(0.1))

    def row(factors):
        rates = [half_up(f * F.pow(power, F.lit(k)), 2).alias(name) for f, k, name in zip(
            factors, C.EMISSION_EXPONENTS, ("co2_kg_h", "so2_kg_h", "nox_kg_h", "pm25_kg_h"))]
        return F.struct(*rates, F.lit(C.EMISSIONS_BASIS).alias("estimate_basis"))

    out = None
    for words, factors in C.EMISSION_FACTORS:
        test = text.rlike(words)
        out = F.when(test, row(factors)) if out is None else out.when(test, row(factors))
    return out.otherwise(row(C.EMISSION_DEFAULT))
