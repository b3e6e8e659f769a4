"""The same answers in plain SQL over the whole tables, for the checking engine."""

from __future__ import annotations

from emberline import constants as C
from emberline.functions import hexgrid
from emberline.plans import tables as T

W, D = C.WINDOW_DAYS * C.DAY_US, C.DAY_US
US = "epoch_us(ts)"


def _p(view: dict[str, str], **extra: str) -> str:
    out = ", ".join(T.projections(view, US, "VARCHAR"))
    for key, value in extra.items():
        out = out.replace("{" + key + "}", value)
    return out


def hu(x: str, d: int) -> str:
    return f"(floor(({x}) * 1e{d} + 5e-1) / 1e{d})"


def cell(zoom: int, lat: str = "latitude", lon: str = "longitude") -> str:
    n = 2 ** zoom
    return (f"({zoom << 50} + CAST(floor(({lon} + 180e0) / 360e0 * {n}e0) AS BIGINT) * {1 << 25} "
            f"+ CAST(floor(({lat} + 90e0) / 180e0 * {n}e0) AS BIGINT))")


def parent(c: str, own: int, zoom: int) -> str:
    k = 2 ** (own - zoom)
    return (f"({zoom << 50} + ((({c} // {1 << 25}) % {1 << 25}) // {k}) * {1 << 25} "
            f"+ ({c} % {1 << 25}) // {k})")


FRP_SUM = "CAST(sum(CAST(frp AS DECIMAL(18, 4))) AS DOUBLE)"
DET = f"""det0 AS (SELECT {_p(T.DETECTIONS)} FROM events),
det AS (SELECT *, make_timestamp(us) AS t, CAST(make_timestamp(us) AS DATE) AS acq_date,
  hour(make_timestamp(us)) AS hh, month(make_timestamp(us)) AS mm,
  CASE WHEN hour(make_timestamp(us)) BETWEEN 1 AND 12 THEN 'D' ELSE 'N' END AS daynight
  FROM det0)"""
SITE = f"""site AS (SELECT {_p(T.SITES)} FROM supplier),
poly AS (SELECT * FROM site UNION ALL
  SELECT * REPLACE (poly_id + 1000000 AS poly_id, 0 AS shape) FROM site WHERE poly_id % 10 = 0)"""


def _edge_rows() -> str:
    rows = []
    for shape, rings in T.SHAPES.items():
        for ring in rings:
            rows += [f"({shape}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, "
                     f"{b[1]!r}::DOUBLE)" for a, b in zip(ring, ring[1:])]
    return ", ".join(rows)


def _pairs(points: str, edges: str, group: str) -> str:
    """Crossing parity and squared distance of every point and polygon."""
    return f"""(SELECT id, {group}, (sum(CASE WHEN (y1 > y) <> (y2 > y)
      AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
      OR min(d2) <= 1e-24) AS covered, min(d2) AS d2
  FROM (SELECT *, (x - x1 - tt * (x2 - x1)) * (x - x1 - tt * (x2 - x1))
      + (y - y1 - tt * (y2 - y1)) * (y - y1 - tt * (y2 - y1)) AS d2
    FROM (SELECT *, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))
        / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0e0), 1e0) AS tt
      FROM {points} CROSS JOIN {edges}))
  GROUP BY id, {group})"""


PAIRS = f"""shp(shape, dx1, dy1, dx2, dy2) AS (VALUES {_edge_rows()}),
edge AS (SELECT poly_id, cx + dx1 AS x1, cy + dy1 AS y1, cx + dx2 AS x2, cy + dy2 AS y2
  FROM poly JOIN shp USING (shape)),
pt AS (SELECT detection_id AS id, longitude AS x, latitude AS y FROM det),
pd AS {_pairs('pt', 'edge', 'poly_id')},
rad AS (SELECT detection_id AS id, (1500e0 + least(greatest(scan, 375e-3), 6e0) * 1e3 / 2e0)
  / 111320e0 AS r FROM det),
mat AS (SELECT d.detection_id,
  min(CASE WHEN covered THEN poly_id END) AS exact_id,
  min(CASE WHEN d2 <= r * r THEN poly_id END) AS near_id,
  min(CASE WHEN covered THEN 0e0 ELSE sqrt(d2) END) AS deg
  FROM det d JOIN pd ON pd.id = d.detection_id JOIN rad ON rad.id = d.detection_id GROUP BY 1),
mat2 AS (SELECT detection_id, coalesce(exact_id, near_id) AS poly_id,
  CASE WHEN exact_id IS NOT NULL THEN true WHEN near_id IS NOT NULL THEN false END AS is_exact,
  CASE WHEN deg <= 1e0 THEN {hu('deg * 11132e-2::DOUBLE', 2)} ELSE 999e0 END AS nearest_km
  FROM mat)"""
PIP = f"WITH {DET}, {SITE}, {PAIRS}"


def _words(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TEXT = ("lower(concat_ws(' ', coalesce(name, ''), coalesce(landuse, ''), coalesce(man_made, ''), "
         "coalesce(other_tags, ''), coalesce(industrial, '')))")
_SOLAR = (f"({_words('txt', C.NON_COMBUSTION_WORDS)} AND NOT "
          f"{_words('txt', C.COMBUSTION_EXEMPT_WORDS)})")
_KIND = "CASE WHEN " + _SOLAR + " THEN 'renewable_non_thermal' " + " ".join(
    f"WHEN {_words('txt', w)} THEN '{k}'" for k, w in C.FACILITY_WORDS.items()) \
    + " ELSE 'general_industrial' END"
KINDS = f"""kinds AS (SELECT *, {_SOLAR} AS non_combustion, {_KIND} AS facility_type
  FROM (SELECT *, {_TEXT} AS txt FROM poly))"""

KEYED = f"""{DET},
keyed0 AS (SELECT *, {_p(T.KEYED)}, {cell(17)} AS cell, {cell(13)} AS area, {cell(15)} AS cell8
  FROM det),
keyed AS (SELECT *, CASE WHEN inside_industrial THEN concat('fac:', CAST(poly_id AS VARCHAR))
  ELSE concat('hex:', CAST(cell8 AS VARCHAR)) END AS recurrence_key,
  CAST(floor(frp * 1e4 + 5e-1) AS BIGINT) AS q FROM keyed0)"""


def _before(agg: str, span: int) -> str:
    """An aggregate over the trailing window in (us, detection_id) order, current row left out."""
    return (f"(coalesce({agg} OVER (PARTITION BY recurrence_key ORDER BY us RANGE BETWEEN {span} "
            f"PRECEDING AND 1 PRECEDING), 0) + coalesce({agg} OVER (PARTITION BY recurrence_key, "
            "us ORDER BY detection_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))")


HIST = f"""{KEYED},
h0 AS (SELECT *, {_before('count(*)', W)} AS n, {_before('sum(q)', W)} AS s1,
  {_before('sum(CAST(q AS HUGEINT) * q)', W)} AS s2, {_before('count(*)', D)} + 1 AS n24,
  min(us) OVER (PARTITION BY recurrence_key) AS first_us, min(us) OVER () AS start_us FROM keyed),
h1 AS (SELECT *, min(CASE WHEN n >= 8 THEN us END) OVER (PARTITION BY recurrence_key
  ORDER BY us, detection_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_us FROM h0),
h2 AS (SELECT *, CAST(n AS BIGINT) AS n_30d, CAST(n24 AS BIGINT) AS n_24h,
  CASE WHEN n > 0 THEN CAST(s1 AS DOUBLE) / n / 1e4 ELSE frp END AS mu_raw,
  CASE WHEN n > 0 THEN CAST(s2 AS DOUBLE) / n / 1e8 - (CAST(s1 AS DOUBLE) / n / 1e4)
    * (CAST(s1 AS DOUBLE) / n / 1e4) END AS v,
  CAST(us - first_us AS DOUBLE) / 864e8 AS source_age_days,
  CASE WHEN p_us IS NOT NULL THEN CAST(p_us - start_us AS DOUBLE) / 864e8 ELSE -1e0 END
    AS onset_lag_days,
  CASE WHEN n + 1 - n24 > 0 THEN CAST(n24 AS DOUBLE) / (CAST(n + 1 - n24 AS DOUBLE) / 29e0)
    ELSE 0e0 END AS burst_raw FROM h1),
hist AS (SELECT *, CASE WHEN n_30d > 1 THEN greatest(v, 0e0) ELSE 1e0 END AS var_raw FROM h2)"""
NEAR = f"""nb AS (SELECT a.detection_id, count(DISTINCT b.recurrence_key) AS neighbours
  FROM keyed a LEFT JOIN keyed b ON a.area = b.area AND b.recurrence_key <> a.recurrence_key
    AND b.us >= a.us - {W} AND (b.us < a.us OR (b.us = a.us AND b.detection_id < a.detection_id))
  GROUP BY 1)"""
_SCORED = f"""sc0 AS (SELECT *, CASE WHEN sqrt(var_raw) > 1e-4 THEN (frp - mu_raw) / sqrt(var_raw)
    ELSE 0e0 END AS z, CASE WHEN mu_raw > 1e-4 THEN frp / mu_raw ELSE 1e0 END AS ratio FROM hist),
sc1 AS (SELECT *, CASE WHEN n_30d >= 8 AND (z > 3 OR frp > 3 * mu_raw) THEN 1
  WHEN n_30d >= 8 AND z <= 25e-1 THEN 2 WHEN n_30d >= 8 THEN 3
  WHEN n_30d < 3 AND inside_industrial AND frp >= 10 THEN 4
  WHEN n_30d < 3 AND inside_industrial THEN 5 WHEN n_30d < 3 THEN 6
  WHEN inside_industrial AND frp >= 10 THEN 7 ELSE 8 END AS br FROM sc0),
scored AS (SELECT * REPLACE ({hu('frp', 2)} AS frp), {hu('mu_raw', 2)} AS mu_frp,
  {hu('var_raw', 2)} AS var_frp, {hu('z', 2)} AS z_frp, {hu('ratio', 2)} AS frp_ratio,
  {hu('burst_raw', 3)} AS burst_ratio,
  ['ESCALATED_FLAREUP', 'PERSISTENT_BASELINE', 'MONITORING', 'ACCIDENTAL_FIRE', 'MONITORING',
   'TRANSIENT_SUSPICION', 'MONITORING', 'MONITORING'][br] AS state,
  ['P1_ALERT', 'SUPPRESSED', 'P2_ADVISORY', 'P0_EMERGENCY', 'P2_ADVISORY', 'NON_ALERT',
   'P1_ALERT', 'P2_ADVISORY'][br] AS priority,
  ['escalated_flareup', 'flare_or_kiln', 'moderate_flare_elevation', 'accidental_industrial_fire',
   'low_frp_industrial_anomaly', 'background_agri_burn', 'developing_cluster',
   'developing_cluster'][br] AS tag,
  br IN (2, 6) AS suppressed FROM sc1),
ranked AS (SELECT *, CASE priority WHEN 'P0_EMERGENCY' THEN 0 WHEN 'P1_ALERT' THEN 1
  WHEN 'P2_ADVISORY' THEN 2 WHEN 'NON_ALERT' THEN 3 ELSE 4 END AS rk FROM scored)"""
SCORED = f"WITH {HIST}, {_SCORED}"
_GATES = """gates0 AS (SELECT quantile_cont(CAST(frp AS DOUBLE), 6e-1) AS persistent_gate,
  quantile_cont(CAST(frp AS DOUBLE), 35e-2) AS artifact_floor,
  quantile_cont(CAST(frp AS DOUBLE), 15e-2) AS artifact_floor_harvest,
  quantile_cont(CAST(frp AS DOUBLE), 5e-2) AS artifact_floor_forest, count(*) AS n_samples
  FROM keyed WHERE frp > 0 AND NOT inside_industrial),
gates AS (SELECT CASE WHEN n_samples >= 1000 THEN persistent_gate ELSE 5e0 END AS persistent_gate,
  CASE WHEN n_samples >= 1000 THEN artifact_floor ELSE 3e0 END AS artifact_floor,
  CASE WHEN n_samples >= 1000 THEN artifact_floor_harvest ELSE 15e-1 END AS artifact_floor_harvest,
  CASE WHEN n_samples >= 1000 THEN artifact_floor_forest ELSE 0e0 END AS artifact_floor_forest,
  CASE WHEN n_samples >= 1000 THEN 'PERCENTILE_LOCAL' ELSE 'ABSOLUTE_FALLBACK' END AS basis,
  CASE WHEN n_samples >= 1000 THEN n_samples ELSE 0 END AS n_samples FROM gates0)"""
_DOMAIN = "(latitude BETWEEN 6 AND 37.5 AND longitude BETWEEN 68 AND 97.5)"


def _label(n30, z, onset, n24, burst, nb, floor, floor_h, floor_f) -> str:
    b = f"({n30} >= 8 AND {n24} >= 6 AND {burst} > 5)"
    return f"""CASE WHEN facility_type = 'renewable_non_thermal' THEN 3
  WHEN inside_industrial AND {n30} >= 8 AND {onset} > 45 THEN 1
  WHEN inside_industrial AND {b} THEN 1 WHEN inside_industrial AND {n30} >= 8 THEN 0
  WHEN inside_industrial AND {n30} < 3 AND frp >= 10 THEN 1 WHEN inside_industrial THEN 3
  WHEN {n30} >= 8 AND ({z} > 3 OR ({onset} > 45 AND {nb} <= 12) OR {b}) THEN 1
  WHEN {n30} >= 8 THEN 0
  WHEN {n30} < 3 AND frp >= CASE WHEN {_DOMAIN} THEN 25 ELSE 10 END THEN 1
  WHEN NOT {_DOMAIN} THEN 3
  WHEN frp < CASE WHEN in_forest AND {floor_f} > 0 THEN {floor_f}
    WHEN mm IN (2, 3, 4, 5, 10, 11) THEN {floor_h} ELSE {floor} END THEN 3 ELSE 2 END"""


LAB = f"""{HIST}, {_SCORED}, {NEAR}, {_GATES}, lab AS (SELECT scored.*, neighbours,
  {_label('n_30d', 'z_frp', 'onset_lag_days', 'n_24h', 'burst_ratio', 'neighbours', 'artifact_floor',
          'artifact_floor_harvest', 'artifact_floor_forest')} AS target_label
  FROM scored JOIN nb ON nb.detection_id = scored.detection_id, gates)"""
CLASS = ("['PERSISTENT_BASELINE', 'ACCIDENTAL_FIRE', 'AGRICULTURAL_BURN', 'TRANSIENT_HOTSPOT']"
         "[{} + 1]")
_BAL = """bal0 AS (SELECT *, md5(concat(CAST(detection_id AS VARCHAR), ':42')) AS hsh,
  count(*) OVER (PARTITION BY target_label) AS nc, count(*) OVER (PARTITION BY target_label, mm)
  AS ns FROM lab),
bal1 AS (SELECT *, row_number() OVER (PARTITION BY target_label, mm ORDER BY hsh, detection_id)
  AS rn, 2 * (SELECT min(nc) FROM bal0) AS cap FROM bal0),
bal AS (SELECT * FROM bal1 WHERE nc <= cap
  OR rn <= greatest(1, round_even(ns * (CAST(cap AS DOUBLE) / nc), 0)))"""
EV = f"""ev AS (SELECT seq, event_name, lat, lon, radius_km, label,
  DATE '2024-01-01' + CAST(start_day AS INT) AS d0,
  DATE '2024-01-01' + CAST(start_day + span_days AS INT) AS d1
  FROM (SELECT {_p(T.EVENTS)} FROM supplier))"""
_KM = "111.32::DOUBLE"
_SPLIT = """r AS (SELECT detection_id, target_label,
  row_number() OVER (PARTITION BY target_label ORDER BY md5(concat(CAST(detection_id AS VARCHAR), ':42:split')),
    detection_id) AS r, count(*) OVER (PARTITION BY target_label) AS n FROM lab),
parts AS (SELECT detection_id, target_label, CASE WHEN r <= floor(n * 7e-1::DOUBLE + 5e-1) THEN 'train'
  WHEN r <= floor(n * 85e-2::DOUBLE + 5e-1) THEN 'validation' ELSE 'test' END AS split FROM r)"""
TAG = f"""{LAB}, {EV},
tg AS (SELECT detection_id, event_name, label, row_number() OVER (PARTITION BY detection_id
  ORDER BY radius_km, seq DESC) AS rn FROM lab, ev WHERE t >= d0 AND t < d1 + INTERVAL 1 DAY
  AND sqrt(pow((longitude - lon) * {_KM} * cos(radians(lat)), 2)
    + pow((latitude - lat) * {_KM}, 2)) <= radius_km),
tag AS (SELECT lab.*, tg.event_name, tg.label AS event_label FROM lab
  LEFT JOIN tg ON tg.detection_id = lab.detection_id AND tg.rn = 1)"""
RSP = f"resp AS (SELECT {_p(T.RESPONDERS)} FROM customer)"


def hav(a: str, b: str, c: str, d: str, r: float) -> str:
    return (f"(2e0 * {r!r}::DOUBLE * asin(sqrt(least(pow(sin((radians({c}) - radians({a})) / 2e0)"
            f", 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - "
            f"radians({b})) / 2e0), 2), 1e0))))")


_SERVED = f"""CASE WHEN facility_type = 'renewable_non_thermal' THEN 'TRANSIENT_HOTSPOT'
  WHEN cls = 'AGRICULTURAL_BURN' AND NOT {_DOMAIN} THEN 'TRANSIENT_HOTSPOT'
  WHEN cls = 'AGRICULTURAL_BURN' AND in_forest THEN 'FOREST_FIRE' ELSE cls END"""
_SERVE = f"""sv0 AS (SELECT *, {CLASS.format('target_label')} AS cls FROM {{src}}),
sv1 AS (SELECT *, {_SERVED} AS served_class, CASE
  WHEN facility_type = 'renewable_non_thermal' AND cls <> 'TRANSIENT_HOTSPOT'
    THEN 'non-combustion land use' WHEN facility_type = 'renewable_non_thermal' THEN NULL
  WHEN cls = 'AGRICULTURAL_BURN' AND NOT {_DOMAIN} THEN 'outside the calibrated burn calendar'
  WHEN cls = 'AGRICULTURAL_BURN' AND in_forest THEN 'inside mapped forest' END AS guard_note
  FROM sv0),
sv AS (SELECT *, CASE served_class WHEN 'ACCIDENTAL_FIRE' THEN CASE WHEN inside_industrial THEN
    'P0_EMERGENCY' ELSE 'P1_ALERT' END WHEN 'PERSISTENT_BASELINE' THEN CASE WHEN inside_industrial
    THEN 'P2_ADVISORY' ELSE 'NON_ALERT' END WHEN 'FOREST_FIRE' THEN 'P2_ADVISORY'
    ELSE 'NON_ALERT' END AS served_priority,
  CASE served_class WHEN 'ACCIDENTAL_FIRE' THEN 'UNCONTAINED_EMERGENCY' WHEN 'PERSISTENT_BASELINE'
    THEN 'PERSISTENT_BASELINE' WHEN 'FOREST_FIRE' THEN 'FOREST_FIRE'
    ELSE 'TRANSIENT_SUSPICION' END AS served_state FROM sv1)"""
INC = f"{LAB}, {_SERVE.format(src='lab')}"
ACT = f"act AS (SELECT o_orderdate AS ats, {_p(T.ACTIONS)} FROM orders)"
AUD = """aud AS (SELECT seq AS audit_id, detection_id + 1 + CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END
  AS incident_id, detection_id, upper(action) AS action, ats FROM act)"""
SCN = f"scn AS (SELECT {_p(T.SCENES, day=T.SCENE_DAY['duck'])} FROM lineitem)"
LOC = """loc AS (SELECT source_key AS k, CAST(min(t) AS DATE) AS event_date FROM det GROUP BY 1)"""
_OK = ("(sample_count > 0 AND (sample_count - no_data_count) / CAST(sample_count AS DOUBLE) "
       ">= 2e-1 AND nbr_mean IS NOT NULL)")
SCAR = f"""{DET}, {SCN}, {LOC},
leg AS (SELECT k, event_date,
  count(*) FILTER (g BETWEEN -45 AND -1) AS a0, count(*) FILTER (g BETWEEN 1 AND 30) AS b0,
  count(sample_count) FILTER (g BETWEEN -45 AND -1) AS a1,
  count(sample_count) FILTER (g BETWEEN 1 AND 30) AS b1,
  avg(nbr_mean) FILTER (g BETWEEN -45 AND -1 AND ok) AS nbr_pre,
  avg(nbr_mean) FILTER (g BETWEEN 1 AND 30 AND ok) AS nbr_post
  FROM (SELECT k, event_date, s.*, scene_date - event_date AS g, coalesce({_OK}, false) AS ok
    FROM loc JOIN scn s ON s.site_id = k) GROUP BY 1, 2),
scar AS (SELECT loc.k, nbr_pre, nbr_post, CASE
  WHEN DATE '2024-01-10' - loc.event_date < 7 THEN 'AWAITING_POST_SCENE'
  WHEN nbr_pre IS NULL THEN CASE WHEN coalesce(a0, 0) = 0 THEN 'NO_SCENES_IN_WINDOW'
    WHEN a1 = 0 THEN 'PARSE_MISMATCH' ELSE 'NO_CLEAR_SCENE' END
  WHEN nbr_post IS NULL THEN CASE WHEN coalesce(b0, 0) = 0 THEN 'NO_SCENES_IN_WINDOW'
    WHEN b1 = 0 THEN 'PARSE_MISMATCH' ELSE 'NO_CLEAR_SCENE' END ELSE 'OK' END AS status
  FROM loc LEFT JOIN leg ON leg.k = loc.k)"""
FEED = f"feed AS (SELECT {_p(T.FEED, day=T.FEED_DAY['duck'], clock=T.FEED_CLOCK)} FROM events)"
_CLOCK = ("(CASE WHEN regexp_full_match(replace(acq_time, '.0', ''), '[0-9]{1,4}') "
          "THEN lpad(replace(acq_time, '.0', ''), 4, '0') ELSE replace(acq_time, '.0', '') END)")
TYPED = f"""{FEED}, typed AS (SELECT ingest_id, TRY_CAST(latitude AS DOUBLE) AS latitude,
  TRY_CAST(longitude AS DOUBLE) AS longitude, TRY_CAST(frp AS DOUBLE) AS frp, satellite, acq_date,
  {_CLOCK} AS acq_time, epoch_us(try_strptime(concat(acq_date, ' ', {_CLOCK}), '%Y-%m-%d %H%M')) AS us
  FROM feed WHERE TRY_CAST(latitude AS DOUBLE) IS NOT NULL)"""
LC = f"lc AS (SELECT {_p(T.LAND_COVER)} FROM part)"
_LCT = "lower(concat_ws(' ', lulc_class, site_desc, fclass))"
COVER = f"""{LC}, cover AS (SELECT cover_id, coalesce(lulc_class, site_desc) AS site_name,
  CASE WHEN regexp_matches(tx, 'mining|quarry') THEN 'mining' WHEN contains(tx, 'kiln') THEN
  'brick_kiln' WHEN contains(tx, 'power') THEN 'power_thermal' WHEN contains(tx, 'refin') THEN
  'petrochemical_refinery' WHEN regexp_matches(tx, 'steel|smelter') THEN 'steel_metallurgy'
  ELSE 'general_industrial' END AS facility_type, 'LULC' AS source
  FROM (SELECT *, {_LCT} AS tx FROM lc) WHERE regexp_matches(tx, '{C.LAND_USE_REGEX}'))"""
MF = f"mf AS (SELECT {_p(T.MAP_FEATURES)} FROM part)"
_IND = ("(coalesce(landuse = 'industrial', false) OR coalesce(man_made = 'works', false) OR "
        "coalesce(contains(other_tags, '\"industrial\"'), false))")


def _tag(key: str, value: str) -> str:
    return f"coalesce(contains(other_tags, '\"{key}\"=>\"{value}\"'), false)"


ARCH = f"""{DET},
arows AS (SELECT CASE WHEN instrument = 'MODIS' THEN 'MODIS_NRT' ELSE concat('VIIRS_', CASE satellite
  WHEN 'N' THEN 'SNPP' WHEN 'N20' THEN 'NOAA20' ELSE 'NOAA21' END, '_NRT') END AS sensor, acq_date
  FROM det),
aspan AS (SELECT sensor, min(acq_date) AS s, max(acq_date) AS e FROM arows GROUP BY 1),
awin AS (SELECT sensor, s, e, s + CAST(unnest(range(0, CAST(e - s AS BIGINT) + 1, 5)) AS INT) AS w
  FROM aspan),
aland AS (SELECT a.sensor, s + CAST((acq_date - s) // 5 * 5 AS INT) AS w,
  count(*) FILTER (day(acq_date) > 2) AS rows FROM arows a JOIN aspan USING (sensor) GROUP BY 1, 2),
arch AS (SELECT awin.sensor, awin.w, least(awin.w + 4, e) AS we,
  CASE WHEN awin.w BETWEEN s + 200 AND e THEN awin.sensor WHEN awin.w BETWEEN s + 20 AND s + 200
    THEN replace(awin.sensor, '_NRT', '_SP') END AS data_id, coalesce(aland.rows, 0) AS rows,
  CASE WHEN NOT (awin.w BETWEEN s + 20 AND e) THEN 'SKIPPED' WHEN aland.rows IS NULL
    THEN 'REQUEST_FAILED' WHEN aland.rows = 0 THEN 'EMPTY' ELSE 'OK' END AS status
  FROM awin LEFT JOIN aland ON aland.sensor = awin.sensor AND aland.w = awin.w)"""
_SCORES = """{sides} SELECT {grp} cls, sum(a) AS support, sum(c) AS called, sum(tp) AS tp FROM (
  SELECT {grp} CAST(event_label AS VARCHAR) AS cls, 1 AS a, 0 AS c,
    CASE WHEN event_label = target_label THEN 1 ELSE 0 END AS tp FROM tag WHERE event_name IS NOT NULL
  UNION ALL SELECT {grp} CAST(target_label AS VARCHAR), 0, 1, 0 FROM tag
    WHERE event_name IS NOT NULL) GROUP BY ALL"""
_PRF = f"""rep AS (SELECT *, CASE WHEN called > 0 THEN tp / CAST(called AS DOUBLE) ELSE 0e0 END AS
  p, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0e0 END AS r,
  2e0 * tp / (called + support) AS f FROM prf)"""
_EMIT = "CASE " + " ".join(
    f"WHEN regexp_matches(facility_type, '{w}') THEN {{{i}}}" for i, (w, _) in enumerate(
        C.EMISSION_FACTORS)) + f" ELSE {{{len(C.EMISSION_FACTORS)}}} END"


def _emit(slot: int) -> str:
    values = [f[slot] for _, f in C.EMISSION_FACTORS] + [C.EMISSION_DEFAULT[slot]]
    factor = _EMIT.format(*[f"{v!r}::DOUBLE" for v in values])
    rate = hu(f"({factor}) * pow(greatest(frp, 1e-1), {C.EMISSION_EXPONENTS[slot]!r}::DOUBLE)", 2)
    return hu(rate, 1)


_COMPASS = "[" + ", ".join(f"'{c}'" for c in C.COMPASS) + "]"
_PLUME = "least(greatest(2e-2 + sqrt(greatest(frp, 1e0)) * 8e-3, 3e-2), 2e-1)"
_HAZ = hu(f"{_PLUME} * {_KM}", 1)

_FLAT = 1 / 298.257223563
_E2 = 2 * _FLAT - _FLAT * _FLAT

ORACLES: dict[str, str] = {
    # ingest
    "ingest_typed": f"WITH {TYPED} SELECT ingest_id, latitude, longitude, frp, satellite, us "
                    "FROM typed",
    "ingest_dedupe": f"""WITH {TYPED}, b AS (SELECT *, 0 AS feed_rank FROM typed
  WHERE satellite = 'N20' UNION ALL SELECT *, 1 FROM typed),
r AS (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq_date, acq_time, satellite
  ORDER BY feed_rank, ingest_id) AS rn FROM b)
SELECT ingest_id, feed_rank, satellite, acq_time FROM r WHERE rn = 1""",
    "archive_windows": f"""WITH {ARCH} SELECT sensor, CAST(w AS VARCHAR) AS window_start,
  CAST(we AS VARCHAR) AS window_end, data_id, rows, status FROM arch""",
    "archive_tally": f"""WITH {ARCH} SELECT sensor, count(*) FILTER (status = 'OK') AS ok,
  count(*) FILTER (status = 'EMPTY') AS "empty", count(*) FILTER (status = 'REQUEST_FAILED')
    AS request_failed, count(*) FILTER (status = 'SKIPPED') AS skipped,
  CAST(sum(rows) AS BIGINT) AS rows, CASE
    WHEN count(*) FILTER (status <> 'SKIPPED') = 0 THEN NULL
    WHEN count(*) FILTER (status IN ('OK', 'EMPTY')) = 0 THEN 'EVERY_REQUEST_FAILED'
    WHEN count(*) FILTER (status IN ('OK', 'REQUEST_FAILED')) = 0 THEN 'EVERY_WINDOW_EMPTY' END
    AS alarm FROM arch GROUP BY 1""",
    "corpus_span": f"WITH {DET} SELECT count(DISTINCT acq_date) AS days, "
                   "count(DISTINCT acq_date) < 30 AS too_short FROM det",
    "land_cover_sites": f"WITH {COVER} SELECT * FROM cover",
    "landuse_fusion": f"""WITH {COVER}, {MF}
SELECT osm_id, name, landuse, CAST(NULL AS VARCHAR) AS facility_type,
  CAST(NULL AS VARCHAR) AS source FROM mf WHERE {_IND}
UNION ALL SELECT NULL, site_name, NULL, facility_type, source FROM cover
UNION ALL SELECT NULL, site_desc, NULL, NULL, 'shapefile' FROM lc WHERE fclass = 'industrial'""",
    "map_feature_filters": f"""WITH {MF} SELECT osm_id, {_IND} AS industrial,
  (coalesce(landuse = 'forest', false) OR coalesce("natural" = 'wood', false)
   OR {_tag('landuse', 'forest')} OR {_tag('natural', 'wood')}) AS forest,
  ({_tag('amenity', 'fire_station')} OR {_tag('emergency', 'fire_station')}
   OR {_tag('amenity', 'hospital')} OR {_tag('amenity', 'police')}) AS responder_point,
  (coalesce(amenity IN ('fire_station', 'hospital', 'police'), false)
   OR {_tag('amenity', 'fire_station')} OR {_tag('emergency', 'fire_station')})
   AS responder_polygon,
  CASE amenity WHEN 'fire_station' THEN 'FIRE' WHEN 'hospital' THEN 'HOSPITAL' WHEN 'police' THEN
   'POLICE' ELSE CASE WHEN contains(coalesce(other_tags, ''), '"fire_station"') THEN 'FIRE'
   WHEN contains(coalesce(other_tags, ''), '"hospital"') THEN 'HOSPITAL'
   WHEN contains(coalesce(other_tags, ''), '"police"') THEN 'POLICE' ELSE 'UNKNOWN' END END AS kind,
  CASE WHEN contains(other_tags, '"ref"=>"7"') THEN '7' END AS ref_tag FROM mf""",
    "map_assembly": f"""WITH {SITE}, {PAIRS.split('edge AS')[0].rstrip().rstrip(',')},
rings(shape, r, n, mx) AS (VALUES {", ".join(
        f"({s}, {i}, {len(r) - 1}, {max(p[0] for p in r[:-1])!r}::DOUBLE)"
        for s, rs in T.SHAPES.items() for i, r in enumerate(rs))})
SELECT concat('way/', CAST(poly_id AS VARCHAR), '/', CAST(r AS VARCHAR)) AS osm_id, 'industrial' AS landuse,
  0 AS missing_nodes, n AS n_edges, {hu('cx + mx', 6)} AS max_x FROM poly JOIN rings USING (shape)
  WHERE poly_id % 3 = 0
UNION ALL SELECT concat('relation/', CAST(poly_id AS VARCHAR)), CASE WHEN poly_id % 4 > 1 THEN 'industrial' END, 0, n,
  {hu('cx + mx', 6)} FROM poly JOIN rings USING (shape) WHERE r = 0 AND poly_id % 4 > 0""",
    "responder_layer": f"""WITH {SITE}, {MF}, {PAIRS.split('pt AS')[0].rstrip().rstrip(',')},
mid AS (SELECT poly_id, (min(y1) + max(y1)) / 2e0 AS y FROM edge GROUP BY 1),
hit AS (SELECT poly_id, y, (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS x FROM edge JOIN mid USING (poly_id)
  WHERE (y1 > y) <> (y2 > y)),
run AS (SELECT poly_id, y, x, row_number() OVER w AS i, lead(x) OVER w - x AS wide FROM hit
  WINDOW w AS (PARTITION BY poly_id ORDER BY x)),
best AS (SELECT poly_id, x + wide / 2e0 AS x, y FROM run WHERE i % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY poly_id ORDER BY wide DESC, x DESC) = 1),
pnt AS (SELECT osm_id, latitude, longitude, CASE amenity WHEN 'fire_station' THEN 'FIRE'
  WHEN 'hospital' THEN 'HOSPITAL' WHEN 'police' THEN 'POLICE'
  ELSE CASE WHEN contains(coalesce(other_tags, ''), '"fire_station"') THEN 'FIRE'
   WHEN contains(coalesce(other_tags, ''), '"hospital"') THEN 'HOSPITAL'
   WHEN contains(coalesce(other_tags, ''), '"police"') THEN 'POLICE' END END AS kind FROM mf
  WHERE {_tag('amenity', 'fire_station')} OR {_tag('emergency', 'fire_station')}
   OR {_tag('amenity', 'hospital')} OR {_tag('amenity', 'police')})
SELECT osm_id, kind AS responder_kind, 'points' AS source_layer, {hu('latitude', 6)} AS latitude,
  {hu('longitude', 6)} AS longitude FROM pnt WHERE kind IS NOT NULL
UNION ALL SELECT concat('poly/', CAST(poly_id AS VARCHAR)), 'HOSPITAL', 'multipolygons', {hu('y', 6)}, {hu('x', 6)}
  FROM best""",
    "hub_boxes": f"""WITH pl AS (SELECT o_orderkey, 8e0 + ((o_orderkey * 7919) % 2600) / 1e2 AS latitude,
  69e0 + ((o_orderkey * 6101) % 2700) / 1e2 AS longitude FROM orders), hub(hub_name, s, w, n, e) AS (VALUES {", ".join(
        f"('{k}', {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE, {b[2]!r}::DOUBLE, {b[3]!r}::DOUBLE)"
        for k, b in C.HUB_BOXES.items())})
SELECT o_orderkey, hub_name FROM pl JOIN hub ON latitude BETWEEN s AND n
  AND longitude BETWEEN w AND e""",
    "cited_events_check": """SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 5 = 1 THEN 'no citation'
  WHEN s_suppkey % 11 = 1 THEN 'bad dates' WHEN s_suppkey % 7 = 1 THEN 'unknown label' END AS reason
  FROM supplier""",
    # spatial
    "polygon_match": f"{PIP} SELECT detection_id, poly_id, is_exact FROM mat2",
    "nearest_polygon": f"{PIP} SELECT detection_id, nearest_km FROM mat2",
    "industrial_join": f"""{PIP}, {KINDS} SELECT detection_id, m.poly_id, osm_id,
  (m.poly_id IS NOT NULL AND NOT coalesce(non_combustion, false)) AS inside_industrial,
  (coalesce(is_exact, false) AND NOT coalesce(non_combustion, false)) AS is_exact_match,
  CASE WHEN m.poly_id IS NOT NULL THEN name END AS facility_name,
  coalesce(facility_type, 'non_industrial') AS facility_type,
  CASE WHEN m.poly_id IS NOT NULL THEN 0e0 ELSE nearest_km END AS dist_to_industrial_km
  FROM mat2 m LEFT JOIN kinds k ON k.poly_id = m.poly_id""",
    "facility_types": f"WITH {SITE}, {KINDS} SELECT poly_id, facility_type, non_combustion "
                      "FROM kinds",
    "forest_flag": f"""WITH {DET}, fo AS (SELECT {_p(T.FORESTS)} FROM supplier),
ring(dx1, dy1, dx2, dy2) AS (VALUES {", ".join(
        f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)"
        for a, b in zip(T.FOREST_RING, T.FOREST_RING[1:]))}),
fe AS (SELECT forest_id, cx + dx1 AS x1, cy + dy1 AS y1, cx + dx2 AS x2, cy + dy2 AS y2
  FROM fo, ring), pt AS (SELECT detection_id AS id, longitude AS x, latitude AS y FROM det),
fp AS {_pairs('pt', 'fe', 'forest_id')}
SELECT id AS detection_id, bool_or(covered) AS in_forest FROM fp GROUP BY 1""",
    "cell_codes": f"""WITH {DET}, c AS (SELECT *, {cell(17)} AS cell FROM det)
SELECT detection_id, cell, {parent('cell', 17, 13)} AS area, {parent('cell', 17, 10)} AS map_cell,
  17 AS zoom, concat('89', lpad(lower(to_hex(CAST(round_even((latitude + 90) / {0.0015!r}::DOUBLE,
  0) AS BIGINT))), 6, '0'), lpad(lower(to_hex(CAST(round_even((longitude + 180) /
  {0.0015!r}::DOUBLE, 0) AS BIGINT))), 6, '0'), 'ffff') AS legacy_bin,
  concat(CAST(CAST(floor(latitude / 5e0) AS BIGINT) AS VARCHAR), '_',
    CAST(CAST(floor(longitude / 5e0) AS BIGINT) AS VARCHAR)) AS block, 3.23::DOUBLE AS edge_km
  FROM c""",
    # recurrence
    "recurrence_stats": f"WITH {HIST} SELECT detection_id, recurrence_key, n_30d, mu_raw, var_raw "
                        "FROM hist",
    "source_timing": f"WITH {HIST} SELECT detection_id, source_age_days, onset_lag_days FROM hist",
    "burst": f"WITH {HIST} SELECT detection_id, n_24h, burst_raw FROM hist",
    "neighbourhood": f"WITH {KEYED}, {NEAR} SELECT detection_id, neighbours AS "
                     "neighbourhood_active_keys FROM nb",
    "alert_state": f"""{SCORED} SELECT detection_id, frp, mu_frp, var_frp, z_frp, frp_ratio,
  burst_ratio, state, priority, tag, suppressed FROM scored""",
    # labels
    "frp_thresholds": f"""WITH {KEYED}, {_GATES} SELECT persistent_gate, artifact_floor,
  artifact_floor_harvest, artifact_floor_forest, basis, n_samples FROM gates""",
    "weak_label": f"WITH {LAB} SELECT detection_id, target_label FROM lab",
    "class_counts": f"WITH {LAB} SELECT target_label, count(*) AS n FROM lab GROUP BY 1",
    "label_shares": f"""WITH {LAB} SELECT target_label, count(*) AS n,
  count(*) FILTER (NOT inside_industrial) AS unmapped,
  count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM lab
  WHERE longitude BETWEEN 70 AND 90 AND latitude BETWEEN 10 AND 30 GROUP BY 1""",
    "balance_sample": f"WITH {LAB}, {_BAL} SELECT detection_id, target_label FROM bal",
    "stratified_split": f"""WITH {LAB}, {_SPLIT} SELECT detection_id, target_label, split FROM parts""",
    "majority_baseline": f"""WITH {LAB}, {_SPLIT}, m AS (SELECT target_label AS m FROM parts WHERE split = 'train'
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
c AS (SELECT target_label AS cls, count(*) AS support FROM parts WHERE split = 'test' GROUP BY 1),
n AS (SELECT sum(support) AS n FROM c),
k AS (SELECT cls, support FROM c UNION ALL SELECT m, 0 FROM m WHERE m NOT IN (SELECT cls FROM c)),
f AS (SELECT support, cls = m AS hit, CASE WHEN cls = m THEN 2e0 * support / (support + n) ELSE 0e0 END AS f1
  FROM k, m, n)
SELECT max(m) AS majority, CAST(max(n) AS BIGINT) AS n,
  {hu('sum(CASE WHEN hit THEN support ELSE 0 END) / CAST(max(n) AS DOUBLE)', 6)} AS accuracy,
  {hu('avg(f1)', 6)} AS macro_f1, {hu('sum(f1 * support) / CAST(max(n) AS DOUBLE)', 6)} AS weighted_f1
  FROM f, m, n""",
    "prior_factors": f"""WITH {LAB}, {_BAL}, a AS (SELECT target_label, count(*) /
  CAST((SELECT count(*) FROM lab) AS DOUBLE) AS true_share FROM lab GROUP BY 1),
b AS (SELECT target_label, count(*) / CAST((SELECT count(*) FROM bal) AS DOUBLE) AS sampled_share
  FROM bal GROUP BY 1)
SELECT target_label, true_share, sampled_share, true_share / sampled_share AS factor
  FROM a JOIN b USING (target_label)""",
    "features_projection": f"""WITH {KEYED} SELECT detection_id, bright_ti4 - bright_ti5 AS temp_diff,
  frp / (scan * track) AS frp_density, bright_ti4 / (bright_ti5 + 1e-4) AS ti4_ratio,
  CASE confidence WHEN 'l' THEN 20e0 WHEN 'n' THEN 60e0 WHEN 'h' THEN 90e0 WHEN '85' THEN 85e0
    ELSE 50e0 END AS detection_confidence, 0 AS dnbr_available,
  CAST(inside_industrial AS INT) AS inside_industrial, 100e0 AS dist_to_industrial_km,
  CAST(daynight = 'N' AS INT) AS is_night, hh AS hour_utc, mm AS month,
  CAST(mm IN (2, 3, 4, 5, 10, 11) AS INT) AS is_harvest_season,
  CAST(facility_type = 'brick_kiln' AS INT) AS fac_brick_kiln,
  CAST(facility_type = 'non_industrial' AS INT) AS fac_non_industrial FROM keyed""",
    # reports
    "hex_rollup": f"""{SCORED}, c AS (SELECT *, {parent('cell', 17, 10)} AS mc FROM ranked),
dp AS (SELECT mc, arg_max(priority, n * 10 - rk) AS p FROM (SELECT mc, priority, rk, count(*) AS n
  FROM c GROUP BY 1, 2, 3) GROUP BY 1),
ds AS (SELECT mc, arg_max(state, n * 10 + so) AS s FROM (SELECT mc, state, count(*) AS n,
  CASE state WHEN 'ACCIDENTAL_FIRE' THEN 5 WHEN 'ESCALATED_FLAREUP' THEN 4 WHEN 'MONITORING' THEN 3
  WHEN 'PERSISTENT_BASELINE' THEN 2 ELSE 1 END AS so FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT c.mc AS cell, count(*) AS detections, count(DISTINCT acq_date) AS days_observed,
  {hu('max(frp)', 2)} AS frp_max_mw, {hu('median(CAST(frp AS DOUBLE))', 2)} AS frp_median_mw,
  {hu(FRP_SUM, 1)} AS frp_total_mw, count(*) FILTER (rk = 0) AS p0,
  count(*) FILTER (rk = 1) AS p1, count(*) FILTER (suppressed) AS suppressed, min(rk) AS top_rank,
  ['P0_EMERGENCY', 'P1_ALERT', 'P2_ADVISORY', 'NON_ALERT', 'SUPPRESSED'][min(rk) + 1]
    AS top_priority, any_value(p) AS dominant_priority, any_value(s) AS dominant_state
  FROM c JOIN dp ON dp.mc = c.mc JOIN ds ON ds.mc = c.mc GROUP BY 1""",
    "hex_filtered": f"""{SCORED} SELECT {parent('cell', 17, 9)} AS cell, count(*) AS detections,
  ['P0_EMERGENCY', 'P1_ALERT', 'P2_ADVISORY', 'NON_ALERT', 'SUPPRESSED'][min(rk) + 1]
    AS top_priority, {hu(FRP_SUM, 1)} AS frp_total_mw FROM ranked
  WHERE longitude BETWEEN 70 AND 92 AND latitude BETWEEN 10 AND 31
    AND state IN ('MONITORING', 'ACCIDENTAL_FIRE') GROUP BY 1 HAVING count(*) >= 2
  ORDER BY min(rk), count(*) DESC, 1 LIMIT 50""",
    "hex_summary": f"""{SCORED}, c AS (SELECT {parent('cell', 17, 10)} AS mc, count(*) AS n
  FROM ranked GROUP BY 1)
SELECT 4 AS resolution, 'quad_plate_carree' AS grid, 22.61::DOUBLE AS approx_cell_edge_km,
  CAST(sum(n) AS BIGINT) AS detections_aggregated, CAST(sum(n) AS BIGINT) AS detections_in_corpus,
  least(count(*), 40) AS cells_returned, count(*) > 40 AS truncated,
  {hu('sum(n) / CAST(least(count(*), 40) AS DOUBLE)', 1)} AS compression_ratio FROM c""",
    "register": f"""{SCORED}, r AS (SELECT *, CASE WHEN facility_name IS NOT NULL THEN
    concat('name:', facility_name) ELSE concat('key:', recurrence_key) END AS register_key,
  coalesce(facility_name, 'unmapped source') AS disp FROM scored
  WHERE state IN ('PERSISTENT_BASELINE', 'MONITORING')
    AND facility_type <> 'renewable_non_thermal'),
sp AS (SELECT greatest(max(acq_date) - min(acq_date), 1) AS span_days FROM r)
SELECT register_key, arg_min(disp, us) AS facility_name, arg_min(facility_type, us)
  AS facility_type, median(latitude) AS latitude, median(longitude) AS longitude,
  count(*) AS detections, count(DISTINCT acq_date) AS days_observed, span_days,
  {hu('count(DISTINCT acq_date) / CAST(span_days AS DOUBLE)', 4)} AS observation_ratio,
  CASE WHEN count(DISTINCT acq_date) / CAST(span_days AS DOUBLE) >= 3e-1 THEN 'CONTINUOUS'
    ELSE 'INTERMITTENT' END AS regime, {hu('median(CAST(frp AS DOUBLE))', 2)} AS frp_median_mw,
  {hu('max(frp)', 2)} AS frp_max_mw, {hu(FRP_SUM, 1)} AS frp_total_mw,
  {hu(FRP_SUM + ' * 12e0 * 36e-1', 1)} AS estimated_fre_gj,
  count(*) FILTER (suppressed) AS suppressed_from_dispatch
  FROM r, sp GROUP BY register_key, span_days HAVING count(*) >= 5""",
    "register_summary": f"""{SCORED}, r AS (SELECT *, CASE WHEN facility_name IS NOT NULL THEN
    concat('name:', facility_name) ELSE concat('key:', recurrence_key) END AS k FROM scored
  WHERE state IN ('PERSISTENT_BASELINE', 'MONITORING')
    AND facility_type <> 'renewable_non_thermal'),
sp AS (SELECT greatest(max(acq_date) - min(acq_date), 1) AS span_days, count(*) AS n FROM r),
e AS (SELECT k, count(DISTINCT acq_date) / CAST(any_value(span_days) AS DOUBLE) AS ratio FROM r, sp
  GROUP BY k HAVING count(*) >= 5 ORDER BY {hu(FRP_SUM, 1)} DESC, k LIMIT 25)
SELECT count(*) AS sites_listed, count(*) FILTER (ratio >= 3e-1) AS sites_continuous,
  (SELECT n FROM sp) AS routine_detections, 'OK' AS status FROM e""",
    "kpi": f"""{SCORED} SELECT count(*) AS total_detections, count(*) FILTER (rk = 0)
  AS p0_emergencies, count(*) FILTER (rk = 1) AS p1_alerts, count(*) FILTER (rk = 2)
  AS p2_advisories, count(*) FILTER (rk > 1) AS suppressed,
  {hu('count(*) FILTER (rk > 1) / CAST(count(*) AS DOUBLE) * 1e2', 2)} AS fatigue_reduction_pct,
  count(*) FILTER (inside_industrial) AS industrial_incidents FROM ranked""",
    "chart_bins": f"""{SCORED}, x AS (SELECT CASE WHEN frp < 10 THEN '0-10 MW' WHEN frp < 25 THEN
  '10-25 MW' WHEN frp < 50 THEN '25-50 MW' WHEN frp < 100 THEN '50-100 MW' WHEN frp < 250 THEN
  '100-250 MW' ELSE '250+ MW' END AS frp_bin, facility_type, priority, state FROM scored)
SELECT 'frp_bin' AS dimension, frp_bin AS value, count(*) AS n FROM x GROUP BY 2
UNION ALL SELECT 'facility_type', facility_type, count(*) FROM x GROUP BY 2
UNION ALL SELECT 'priority', priority, count(*) FROM x GROUP BY 2
UNION ALL SELECT 'state', state, count(*) FROM x GROUP BY 2""",
    "hottest": f"""{SCORED} SELECT detection_id, coalesce(facility_name, 'Unnamed Site')
  AS facility_name, frp, priority FROM scored ORDER BY frp DESC, detection_id LIMIT 10""",
    "active_incidents": f"""{SCORED} SELECT detection_id, frp, us FROM scored
  WHERE priority = 'P1_ALERT' AND inside_industrial ORDER BY frp DESC, us DESC, detection_id
  LIMIT 200""",
    "freshness": f"""WITH {DET}, a AS (SELECT (epoch_us(TIMESTAMP '2024-12-27 00:00:00') - max(us))
  / 36e8 AS h FROM det) SELECT {hu('h', 3)} AS age_hours, CASE WHEN h < 6 THEN 'LIVE'
  WHEN h <= 48 THEN 'RECENT' ELSE 'STALE' END AS badge FROM a""",
    "layer_summary": f"WITH {RSP} SELECT responder_kind, count(*) AS n FROM resp GROUP BY 1",
    "health": f"""WITH {SITE} SELECT 'detections' AS table_name, count(*) AS rows FROM events
UNION ALL SELECT 'polygons', count(*) FROM poly UNION ALL SELECT 'responders', count(*)
  FROM customer""",
    # verified events
    "verified_tag": f"WITH {TAG} SELECT detection_id, event_name, event_label FROM tag",
    "event_accuracy": f"""WITH {TAG} SELECT event_name, count(*) AS n,
  {hu('avg(CASE WHEN event_label = target_label THEN 1e0 ELSE 0e0 END)', 6)} AS accuracy,
  CASE WHEN count(*) < 20 THEN 'LOW_SUPPORT' ELSE 'OK' END AS support FROM tag
  WHERE event_name IS NOT NULL GROUP BY 1""",
    "event_register": f"""WITH {TAG}, {_SERVE.format(src='tag')},
a AS (SELECT event_name, count(*) AS n,
  {hu('avg(CASE WHEN ' + CLASS.format('event_label') + ' = served_class THEN 1e0 ELSE 0e0 END)', 6)} AS served_accuracy,
  {hu('avg(CASE WHEN event_label = target_label THEN 1e0 ELSE 0e0 END)', 6)} AS model_accuracy
  FROM sv WHERE event_name IS NOT NULL GROUP BY 1)
SELECT event_name, coalesce(n, 0) AS n, served_accuracy, model_accuracy, CASE WHEN n IS NULL THEN 'NOT_SCORED'
  WHEN n < 20 THEN 'LOW_SUPPORT' ELSE 'OK' END AS support
  FROM (SELECT DISTINCT event_name FROM ev) LEFT JOIN a USING (event_name)""",
    "counter_register": f"""WITH {TAG} SELECT seq, event_name, label, (SELECT count(*) FROM ev) AS verified_events
  FROM ev WHERE event_name NOT IN (SELECT event_name FROM tag WHERE event_name IS NOT NULL)""",
    "event_confusion": f"""WITH {TAG} SELECT CAST(event_label AS VARCHAR) AS truth,
  CAST(target_label AS VARCHAR) AS predicted, count(*) AS n FROM tag
  WHERE event_name IS NOT NULL GROUP BY 1, 2""",
    "class_report": f"""WITH {TAG}, prf AS ({_SCORES.format(sides='', grp='daynight,')}), {_PRF}
SELECT daynight, cls, CAST(support AS BIGINT) AS support, {hu('p', 6)} AS "precision",
  {hu('r', 6)} AS recall, {hu('f', 6)} AS f1 FROM rep""",
    "overall_scores": f"""WITH {TAG}, prf AS ({_SCORES.format(sides='', grp='')}), {_PRF}
SELECT CAST(sum(support) AS BIGINT) AS n, {hu('sum(tp) / CAST(sum(support) AS DOUBLE)', 6)}
  AS accuracy, {hu('avg(f)', 6)} AS macro_f1,
  {hu('sum(f * support) / CAST(sum(support) AS DOUBLE)', 6)} AS weighted_f1 FROM rep""",
    "first_corpus": f"""WITH {TAG}, k AS (SELECT *, (source_key + mm) % 3 AS corpus_rank FROM tag
  WHERE event_name IS NOT NULL), m AS (SELECT event_name, min(corpus_rank) AS corpus_rank FROM k
  GROUP BY 1) SELECT detection_id, event_name, corpus_rank FROM k
  SEMI JOIN m USING (event_name, corpus_rank)""",
    "served_accuracy": f"""WITH {TAG}, {_SERVE.format(src='tag')}
SELECT event_name, count(*) AS n, {hu('avg(CASE WHEN ' + CLASS.format('event_label')
                                      + ' = served_class THEN 1e0 ELSE 0e0 END)', 6)} AS accuracy,
  CASE WHEN count(*) < 20 THEN 'LOW_SUPPORT' ELSE 'OK' END AS support FROM sv
  WHERE event_name IS NOT NULL GROUP BY 1""",
    # proximity
    "radius_search": f"""WITH {DET}, k AS (SELECT detection_id,
  {hav('18e0', '80e0', 'latitude', 'longitude', 6371.0)} AS km FROM det)
SELECT detection_id, {hu('km', 6)} AS distance_km FROM k WHERE km <= 300
  ORDER BY km, detection_id LIMIT 100""",
    "date_line_search": f"""WITH {DET}, mv AS (SELECT detection_id, latitude,
  CASE WHEN longitude + 98e0 > 180 THEN longitude + 98e0 - 360e0 ELSE longitude + 98e0 END AS lon FROM det),
k AS (SELECT detection_id, {hav('18e0', '1799e-1::DOUBLE', 'latitude', 'lon', 6371.0)} AS km FROM mv)
SELECT detection_id, {hu('km', 6)} AS distance_km FROM k WHERE km <= 300""",
    "date_line_bulk": f"""WITH {DET}, mv AS (SELECT detection_id, latitude,
  CASE WHEN longitude + 98e0 > 180 THEN longitude + 98e0 - 360e0 ELSE longitude + 98e0 END AS lon FROM det),
c AS (SELECT i AS centre_id, i * 4e0 + 9e0 AS lat0,
  CASE WHEN i % 2 = 0 THEN 1797e-1::DOUBLE ELSE -1798e-1::DOUBLE END AS lon0 FROM range(6) t(i)),
k AS (SELECT centre_id, detection_id, {hav('lat0', 'lon0', 'latitude', 'lon', 6371.0)} AS km FROM c, mv),
r AS (SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY km, detection_id) AS rank FROM k WHERE km <= 150)
SELECT centre_id, detection_id, rank, {hu('km', 6)} AS distance_km FROM r WHERE rank <= 5""",
    "radius_bulk": f"""WITH {DET}, fo AS (SELECT {_p(T.FORESTS)} FROM supplier),
k AS (SELECT forest_id AS centre_id, detection_id, {hav(
        f'(cy + {T.FOREST_RING[0][1]!r}::DOUBLE)', f'(cx + {T.FOREST_RING[0][0]!r}::DOUBLE)',
        'latitude', 'longitude', 6371.0)} AS km FROM fo, det),
r AS (SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY km, detection_id) AS rank FROM k
  WHERE km <= 60)
SELECT centre_id, detection_id, rank, {hu('km', 6)} AS distance_km FROM r WHERE rank <= 5""",
    "nearest_responders": f"""WITH {DET}, {RSP},
k AS (SELECT detection_id, responder_kind, responder_id, {hav(
        'd.latitude', 'd.longitude', 'r.latitude', 'r.longitude', 6371.0088)} AS km
  FROM det d, resp r),
q AS (SELECT *, row_number() OVER (PARTITION BY detection_id, responder_kind
  ORDER BY km, responder_id) AS rank FROM k WHERE km <= 75),
kinds AS (SELECT unnest(['FIRE', 'HOSPITAL', 'POLICE']) AS responder_kind),
slot AS (SELECT detection_id, responder_kind, rank FROM det, kinds, (SELECT unnest([1, 2]) AS rank))
SELECT slot.detection_id, slot.responder_kind, slot.rank, responder_id,
  {hu('km', 3)} AS distance_km, {hu('km * 13e-1 / 4e1 * 6e1', 1)} AS minutes,
  km IS NULL AS none_within_range
FROM slot LEFT JOIN q ON q.detection_id = slot.detection_id
  AND q.responder_kind = slot.responder_kind AND q.rank = slot.rank
WHERE slot.rank = 1 OR km IS NOT NULL""",
    # incidents
    "serving_guards": f"""WITH {INC} SELECT detection_id, served_class, guard_note,
  served_priority, served_state FROM sv""",
    "detection_ids": f"""WITH {DET} SELECT detection_id, md5(concat_ws('|', satellite,
  printf('%.4f', latitude), printf('%.4f', longitude), CAST(us AS VARCHAR))) AS stable_id
  FROM det""",
    "incident_upsert": f"""WITH {DET}, {ACT} SELECT detection_id, frp FROM det
  WHERE detection_id NOT IN (SELECT detection_id FROM act)""",
    "cell_baseline": f"""WITH {KEYED} SELECT area, count(*) AS n, {hu('sum(frp)', 2)} AS total,
  {hu('sum(frp * frp)', 5)} AS squares FROM keyed GROUP BY 1""",
    "baseline_merge": f"""WITH {KEYED} SELECT area, count(*) AS n, {hu('sum(frp)', 2)} AS total,
  {hu('sum(frp * frp)', 5)} AS squares FROM keyed GROUP BY 1""",
    "recurrence_evidence": f"""WITH {KEYED}, b AS (SELECT cell, count(*) AS n, {FRP_SUM} / count(*) AS m,
  sqrt(var_pop(frp)) AS s FROM keyed WHERE mm <= 3 GROUP BY 1)
SELECT detection_id, CASE WHEN n IS NULL THEN 'NO_BASELINE' ELSE 'OK' END AS evidence_status,
  n AS detections_30d, {hu('m', 2)} AS mean_frp_mw, CASE WHEN s > 1e-6 THEN
  {hu('(frp - m) / s', 2)} END AS evidence_z, n >= 8 AS is_established
  FROM keyed LEFT JOIN b ON b.cell = keyed.cell""",
    "audit_fold": f"""WITH RECURSIVE {INC}, {ACT},
seqd AS (SELECT *, upper(trim(action)) AS k, row_number() OVER (PARTITION BY detection_id
  ORDER BY ats, seq) AS i FROM act),
fold AS (SELECT detection_id, CAST(0 AS BIGINT) AS i, served_priority AS p, served_state AS s,
  'OPEN' AS st, served_class AS c, CAST(NULL AS VARCHAR) AS notes FROM sv
UNION ALL SELECT f.detection_id, a.i,
  CASE WHEN k = 'CONFIRM' AND p = 'P2_ADVISORY' THEN 'P0_EMERGENCY'
    WHEN k = 'RECLASSIFY' AND new_class IS NOT NULL THEN CASE new_class WHEN 'ACCIDENTAL_FIRE' THEN
      'P0_EMERGENCY' WHEN 'PERSISTENT_BASELINE' THEN 'P2_ADVISORY' ELSE 'NON_ALERT' END
    WHEN k = 'FALSE_POSITIVE' THEN 'NON_ALERT' ELSE p END,
  CASE WHEN k = 'CONFIRM' THEN 'CONFIRMED_DISPATCH' WHEN k = 'DISPATCH' THEN 'EMERGENCY_DISPATCHED'
    WHEN k = 'FALSE_POSITIVE' THEN 'SUPPRESSED_FALSE_ALARM'
    WHEN k = 'RECLASSIFY' AND new_class IS NOT NULL THEN CASE new_class WHEN 'ACCIDENTAL_FIRE' THEN
      'UNCONTAINED_EMERGENCY' WHEN 'PERSISTENT_BASELINE' THEN 'PERSISTENT_BASELINE'
      ELSE 'TRANSIENT_SUSPICION' END ELSE s END,
  CASE WHEN k IN ('CONFIRM', 'DISPATCH') THEN 'DISPATCHED' WHEN k = 'FALSE_POSITIVE' THEN
      'MUTED_ROUTINE' WHEN k = 'RECLASSIFY' THEN CASE WHEN new_class IS NOT NULL THEN 'ACKNOWLEDGED'
      ELSE st END WHEN k = 'STATUS' THEN CASE WHEN upper(new_class) IN ('OPEN', 'ACKNOWLEDGED',
      'DISPATCHED', 'RESOLVED', 'MUTED_ROUTINE') THEN upper(new_class) ELSE st END
    ELSE 'ACKNOWLEDGED' END,
  CASE WHEN k = 'RECLASSIFY' AND new_class IS NOT NULL THEN new_class ELSE c END,
  CASE WHEN operator_notes <> '' THEN operator_notes ELSE notes END
  FROM fold f JOIN seqd a ON a.detection_id = f.detection_id AND a.i = f.i + 1)
SELECT detection_id, arg_max(p, i) AS priority, arg_max(s, i) AS state, arg_max(st, i) AS status,
  arg_max(c, i) AS predicted_class, max_by(notes, CASE WHEN notes IS NOT NULL THEN i END)
  AS operator_notes, max(i) AS actions FROM fold GROUP BY 1""",
    "rejected_statuses": f"""WITH {ACT} SELECT seq, new_class FROM act WHERE action = 'STATUS'
  AND upper(new_class) NOT IN ('OPEN', 'ACKNOWLEDGED', 'DISPATCHED', 'RESOLVED',
  'MUTED_ROUTINE')""",
    "audit_append": f"""WITH {INC}, {ACT} SELECT seq, sv.detection_id + 1 AS incident_id,
  act.detection_id, upper(action) AS action, served_class AS previous_class,
  coalesce(new_class, served_class) AS new_class FROM act LEFT JOIN sv
  ON sv.detection_id = act.detection_id""",
    "audit_remap": f"""WITH {ACT}, {AUD} SELECT audit_id, e.event_id + 1 AS incident_id FROM aud
  LEFT JOIN events e ON e.event_id = aud.detection_id""",
    "audit_copy": f"""WITH {ACT}, {AUD}, o AS (SELECT *, row_number() OVER (PARTITION BY
  detection_id, action, ats ORDER BY audit_id) AS rn FROM aud)
SELECT audit_id, detection_id, action FROM o WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM aud s
  WHERE s.audit_id % 2 = 0 AND s.detection_id = o.detection_id AND s.action = o.action
  AND s.ats = o.ats)""",
    "quality_checks": f"""WITH {ACT}, {AUD} SELECT 'duplicate_audit' AS check_name,
  (SELECT count(*) FROM aud) - (SELECT count(*) FROM (SELECT DISTINCT detection_id, action, ats
  FROM aud)) AS n
UNION ALL SELECT 'audit_of_other_detection', count(*) FROM aud JOIN events e
  ON e.event_id + 1 = aud.incident_id WHERE e.event_id <> aud.detection_id
UNION ALL SELECT 'no_coordinates', 0""",
    "dispatch_plan": f"""WITH {INC}, r AS (SELECT *, CASE served_priority WHEN 'P0_EMERGENCY' THEN
  ['sms', 'email', 'webhook'] WHEN 'P1_ALERT' THEN ['email', 'webhook'] WHEN 'P2_ADVISORY' THEN
  ['webhook'] ELSE ['router'] END AS ch, concat(served_priority, ' ', served_state, ' ',
  printf('%.4f', latitude), ',', printf('%.4f', longitude), ' ', CAST(round_even(frp, 0) AS BIGINT), 'MW ',
  coalesce(facility_name, 'unmapped'), ' -unverified sat detection') AS sms_body FROM sv)
SELECT detection_id, served_priority AS priority, CASE WHEN ch[1] = 'router' THEN
  'REFUSED_PRIORITY' ELSE 'PLANNED' END AS status, CASE WHEN ch[1] = 'router' THEN
  'suppressed by design' END AS reason, unnest(ch) AS channel, sms_body FROM r""",
    # dossier
    "incident_dossier": f"""WITH {INC}, {ACT}, wk AS (SELECT {hu('latitude', 3)} AS a, {hu('longitude', 3)} AS b,
  acq_date AS d FROM det WHERE source_key % 3 <> 1 GROUP BY 1, 2, 3),
bl AS (SELECT cell, count(*) AS n, {FRP_SUM} / count(*) AS m FROM keyed WHERE mm <= 3 GROUP BY 1),
au AS (SELECT detection_id, least(10, count(*)) AS na FROM act GROUP BY 1)
SELECT sv.detection_id, CASE WHEN frp >= 200 THEN 'CRITICAL' WHEN frp >= 75 THEN 'HIGH'
  WHEN frp >= 25 THEN 'MODERATE' ELSE 'LOW' END AS frp_severity, {_HAZ} AS hazard_km,
  coalesce(na, 0) AS audit_rows, wk.d IS NOT NULL AS weather_is_measured,
  CAST(floor((longitude + 180e0) / 6e0) AS BIGINT) + 1 AS utm_zone,
  CASE WHEN bl.n IS NULL THEN 'NO_BASELINE' ELSE 'OK' END AS evidence_status, bl.n AS detections_30d,
  {hu('bl.m', 2)} AS mean_frp_mw
  FROM sv LEFT JOIN bl ON bl.cell = sv.cell LEFT JOIN au ON au.detection_id = sv.detection_id
  LEFT JOIN wk ON wk.a = {hu('latitude', 3)} AND wk.b = {hu('longitude', 3)} AND wk.d = sv.acq_date""",
    "weather_hour": f"""WITH {DET}, k AS (SELECT {hu('latitude', 3)} AS a, {hu('longitude', 3)} AS b,
  acq_date, min(detection_id) AS k FROM det WHERE source_key % 3 <> 1 GROUP BY 1, 2, 3),
x AS (SELECT detection_id, k, least(hh, CASE WHEN k % 2 = 0 THEN 23 ELSE 11 END) AS i FROM det
  LEFT JOIN k ON k.a = {hu('latitude', 3)} AND k.b = {hu('longitude', 3)}
  AND k.acq_date = det.acq_date)
SELECT detection_id, CASE WHEN (i + k) % 4 <> 0 THEN CAST(i * 10 + k % 7 AS DOUBLE)
  WHEN k % 4 <> 0 THEN CAST(k % 7 AS DOUBLE) ELSE CAST(10 + k % 7 AS DOUBLE) END AS temperature_2m,
  CAST(i + k % 30 AS DOUBLE) AS wind_speed_10m, k IS NOT NULL AS weather_is_measured FROM x
  WHERE k IS NOT NULL
UNION ALL SELECT detection_id, NULL, NULL, false FROM x WHERE k IS NULL""",
    "incident_figures": f"""WITH {KEYED} SELECT detection_id, CASE WHEN frp >= 200 THEN 'CRITICAL'
  WHEN frp >= 75 THEN 'HIGH' WHEN frp >= 25 THEN 'MODERATE' ELSE 'LOW' END AS severity,
  {_HAZ} AS hazard_km, greatest(5e-1, {hu(_HAZ + ' * 35e-2', 1)}) AS evacuation_km,
  {_emit(0)} AS co2, {_emit(1)} AS so2, {_emit(3)} AS pm25,
  {hu(f'longitude - 1e0 / ({_KM} * cos(radians(latitude)))', 6)} AS west,
  {hu(f'latitude + 1e0 / {_KM}', 6)} AS north,
  {_COMPASS}[CAST(floor((frp + 1125e-2) / 225e-1) AS BIGINT) % 16 + 1] AS compass FROM keyed""",
    "projected_position": f"""WITH {DET}, z AS (SELECT detection_id, latitude,
  CAST(floor((longitude + 180e0) / 6e0) AS BIGINT) + 1 AS zone, radians(latitude) AS phi,
  radians(longitude) AS lam, {_E2!r}::DOUBLE AS e2, {_E2 / (1 - _E2)!r}::DOUBLE AS ep FROM det),
u AS (SELECT *, 6378137e0 / sqrt(1e0 - e2 * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t,
  ep * pow(cos(phi), 2) AS c, cos(phi) * (lam - radians(CAST(zone * 6 - 183 AS DOUBLE))) AS q,
  6378137e0 * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * phi
    - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi)
    + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi)
    - 35 * pow(e2, 3) / 3072 * sin(6 * phi)) AS m FROM z)
SELECT detection_id, zone AS utm_zone, 'N' AS hemisphere,
  substr('{C.UTM_BANDS}', CAST(floor((latitude + 80e0) / 8e0) AS BIGINT) + 1, 1) AS band,
  {hu("5e5 + 9996e-4 * n * (q + (1 - t + c) * pow(q, 3) / 6 + (5 - 18 * t + t * t + 72 * c"
      " - 58 * ep) * pow(q, 5) / 120)", 1)} AS easting_m,
  {hu("9996e-4 * (m + n * tan(phi) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * pow(q, 4) / 24"
      " + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(q, 6) / 720))", 1)} AS northing_m
  FROM u""",
    "smoke_cone": f"""WITH {DET}, c AS (SELECT *, {_PLUME} AS len,
  radians((frp * 7e0) % 360e0 + 180e0) AS br,
  radians(greatest(12e0, 26e0 - scan * 1e1 * 4e-1)) AS ha FROM det)
SELECT detection_id, 5 AS vertices, {hu('longitude + len * sin(br - ha)', 5)} AS left_x,
  {hu('latitude + len * 115e-2 * cos(br)', 5)} AS tip_y,
  {hu('longitude + len * sin(br + ha)', 5)} AS right_x FROM c""",
    "latest_audit": f"""WITH {ACT}, r AS (SELECT *, row_number() OVER (PARTITION BY detection_id
  ORDER BY ats DESC, seq DESC) AS rn FROM act)
SELECT detection_id, count(*) AS n, string_agg(action, ',' ORDER BY rn) AS actions FROM r
  WHERE rn <= 10 GROUP BY 1""",
    # optical and thermal
    "dnbr_windows": f"""WITH {SCAR} SELECT k AS recurrence_key,
  CASE WHEN status <> 'AWAITING_POST_SCENE' THEN {hu('nbr_pre', 6)} END AS nbr_pre,
  CASE WHEN status <> 'AWAITING_POST_SCENE' THEN {hu('nbr_post', 6)} END AS nbr_post, status
  FROM scar""",
    "dnbr_attach": f"""WITH {SCAR} SELECT detection_id, status AS dnbr_status FROM det
  JOIN scar ON scar.k = source_key""",
    "optical_coverage": f"""WITH {SCAR} SELECT status, count(*) AS n,
  count(*) FILTER (status = 'OK') AS measured, count(*) FILTER (status <> 'OK') AS unmeasured
  FROM scar GROUP BY 1""",
    "optical_points": f"""WITH {SCAR} SELECT k AS recurrence_key, status,
  (SELECT count(*) FROM scar) > 40 AS truncated FROM scar ORDER BY k LIMIT 40""",
    "dnbr_candidates": f"""WITH {HIST}, c AS (SELECT * FROM hist WHERE (inside_industrial
  OR frp >= 10) AND n_30d < 8)
SELECT source_key AS recurrence_key, CAST(CAST(min(t) AS DATE) AS VARCHAR) AS event_date,
  max(frp) AS peak_frp FROM c WHERE source_key % 4 <> 0 GROUP BY 1
  ORDER BY peak_frp DESC, 1 LIMIT 50""",
    "scene_documents": f"""WITH {SCN} SELECT site_id, count(*) AS n,
  CAST(sum(sample_count) AS BIGINT) AS samples, CAST(sum(no_data_count) AS BIGINT) AS no_data,
  CAST(max(scene_date) AS VARCHAR) AS last_scene, max(nbr_mean) AS max_mean,
  min(nbr_mean) AS min_p25, count(*) FILTER (sample_count IS NULL) AS without_statistics
  FROM scn GROUP BY 1""",
    "burn_ratio": """WITH v AS (SELECT *, CASE WHEN l_linenumber + 3 NOT IN (0, 1, 3, 8, 9, 10, 11)
  THEN CASE WHEN l_quantity + l_discount * 1e2 = 0 THEN 0e0 ELSE (l_quantity - l_discount * 1e2)
  / (l_quantity + l_discount * 1e2) END END AS nbr FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, nbr, CASE WHEN nbr IS NULL THEN 'UNKNOWN'
  WHEN nbr < -1e-1 THEN 'REGROWTH' WHEN nbr < 1e-1 THEN 'UNBURNED' WHEN nbr < 27e-2 THEN
  'LOW_SEVERITY' WHEN nbr < 44e-2 THEN 'MODERATE_LOW' WHEN nbr < 66e-2 THEN 'MODERATE_HIGH'
  ELSE 'HIGH_SEVERITY' END AS severity, CASE WHEN nbr IS NULL THEN 'UNMEASURED' WHEN nbr <= -1e-1
  THEN 'REGROWTH' WHEN nbr < 1e-1 THEN 'CONTAINED' WHEN nbr < 27e-2 THEN 'AMBIGUOUS'
  ELSE 'REFUTED' END AS verdict FROM v""",
    "site_acquisitions": f"""WITH px AS (SELECT l_suppkey AS site_id, l_orderkey % 30 AS day,
  (l_partkey % 9) * 1e-2 * 6371.0088::DOUBLE * pi() / 180e0 AS km, l_quantity * 4 + 290e0 AS f1,
  l_quantity * 2 + 285e0 AS s7 FROM lineitem WHERE l_linenumber % 3 > 0),
fire AS (SELECT site_id, day, max(f1) AS f1, max(s7) AS s7, count(*) AS samples FROM px
  WHERE km <= 15e-1 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY f1 DESC, day DESC) AS rn FROM fire),
g AS (SELECT site_id, day, quantile_cont(f1, 25e-2) AS background_k FROM px
  WHERE km BETWEEN 5 AND 15 GROUP BY 1, 2)
SELECT b.site_id, b.day, f1, s7, samples, background_k, f1 - s7 AS saturation_gap_k,
  f1 - background_k AS excess_k, CASE WHEN background_k IS NULL THEN 'NO_SCENE' ELSE 'OK' END
  AS status FROM b LEFT JOIN g ON g.site_id = b.site_id AND g.day = b.day WHERE rn = 1""",
    "background_temperature": f"""WITH {DET} SELECT instrument, mm AS month, daynight, count(*) AS n,
  {hu('least(greatest(quantile_cont(CAST(bright_ti5 AS DOUBLE), 1e-1), 250e0), 330e0)', 6)}
  AS background_k FROM det GROUP BY 1, 2, 3""",
    "planck_radiance": f"""WITH {DET} SELECT detection_id, {hu(
        '2e0 * 6.62607015e-34 * pow(2.99792458e8, 2) / pow(3.74e-6, 5) / (exp(6.62607015e-34 * '
        '2.99792458e8 / 1.380649e-23 / 3.74e-6 / bright_ti4) - 1e0) / 1e3', 3)} AS radiance
  FROM det""",
    # text
    "rationale_factors": f"""WITH {DET}, v AS (SELECT detection_id, (detection_id % 90) / 1e2 AS m
  FROM det) SELECT detection_id, CASE WHEN m >= 5e-1 THEN 'frp' ELSE 'odd_name' END AS "first",
  greatest(m, 5e-1) AS contribution, CASE WHEN m >= 5e-1 THEN 'Odd Name' WHEN m >= 25e-2
  THEN 'Frp' ELSE 'Fac Brick Kiln' END AS second_label,
  CASE WHEN m >= 25e-2 THEN 'toward' ELSE 'against' END AS second_direction FROM v""",
    "normalised_text": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 THEN c_name END AS clean,
  c_custkey % 3 < 2 AS flag, CASE WHEN c_custkey * 7919 % 100000 < 10 THEN '...' ELSE
  concat('...', right(concat('91', CAST(c_custkey * 7919 % 100000 AS VARCHAR)), 4)) END AS masked, 7e0 AS number, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 90e0
  ELSE 50e0 END AS confidence, concat('2024-01-02 03:04:', lpad(CAST(c_custkey % 60 AS VARCHAR), 2,
  '0'), '.000000') AS ts_key FROM customer""",
    "percentiles_by_group": f"""SELECT l_returnflag, count(*) AS n,
  {hu('quantile_cont(l_extendedprice, 1e-1)', 4)} AS p10,
  {hu('quantile_cont(l_extendedprice, 5e-1)', 4)} AS p50,
  {hu('quantile_cont(l_extendedprice, 9e-1)', 4)} AS p90 FROM lineitem GROUP BY 1""",
}
ORACLES["crowded_tiles"] = f"""SELECT CASE WHEN detection_id % 5 <> 0 THEN detection_id % 10 END AS k, in_forest,
  count(*) AS n FROM ({ORACLES["forest_flag"]}) GROUP BY 1, 2"""
ORACLES["stream_alert_state"] = ORACLES["alert_state"]
ORACLES["stream_neighbourhood"] = ORACLES["neighbourhood"]
ORACLES["refresh_incidents"] = f"WITH {DET} SELECT detection_id, frp FROM det"
ORACLES["refresh_baselines"] = ORACLES["baseline_merge"]
ORACLES["event_union"] = """WITH e AS (SELECT s_suppkey AS seq, s_name AS name, 2e0 + (s_suppkey % 4) * 9e0 AS radius,
  CASE s_nationkey % 4 WHEN 0 THEN 'PERSISTENT_BASELINE' WHEN 1 THEN 'ACCIDENTAL_FIRE' WHEN 2 THEN 'AGRICULTURAL_BURN'
  ELSE 'TRANSIENT_HOTSPOT' END AS label FROM supplier),
f AS (SELECT *, CASE WHEN seq % 5 = 1 THEN 'no citation' WHEN seq % 7 = 1 THEN 'unknown label' END AS reason FROM e
  WHERE seq % 3 = 0 AND seq % 4 <> 1)
SELECT name AS event_name, label, radius AS radius_km, 'seed' AS origin, CAST(NULL AS VARCHAR) AS reason, false AS after_seeds
  FROM e WHERE seq % 3 <> 0
UNION ALL SELECT name, CASE WHEN reason IS NULL THEN label END, CASE WHEN reason IS NULL THEN CASE WHEN seq % 2 = 1 THEN 3e0
  ELSE radius END END, CASE WHEN reason IS NULL THEN 'file' END, reason, CASE WHEN reason IS NULL THEN true END FROM f"""
ORACLES["dispatch_audit"] = f"""SELECT detection_id + 1 AS incident_id, detection_id, 'DISPATCH' AS action, 'OPEN' AS previous_class,
  'OPEN' AS new_class, string_agg(concat(channel, '=', status), '; ' ORDER BY channel) AS operator_notes
  FROM ({ORACLES["dispatch_plan"]}) GROUP BY detection_id"""
ORACLES["audit_log"] = f"""WITH {ACT} SELECT seq, detection_id, upper(action) AS action FROM act
  ORDER BY ats DESC, seq DESC LIMIT 100"""
ORACLES["baseline_copy"] = ORACLES["cell_baseline"]


def _hexes(source: str, name: str, resolution: int) -> str:
    """Rows (id, cell, wq, wr) of places x, y on the plane, by cells of a resolution."""
    edge = repr(float(hexgrid.EDGES[resolution])) + "::DOUBLE"
    third, low = f"{hexgrid.ROOT3 / 3.0!r}::DOUBLE", f"{2.0 / 3.0!r}::DOUBLE"
    return f"""{name}f AS (SELECT id, (x * {third} - y / 3e0) / {edge} AS q, (y * {low}) / {edge} AS r FROM {source}),
{name}n AS (SELECT id, floor(q + 5e-1) AS a, floor(r + 5e-1) AS b, floor(-q - r + 5e-1) AS c, abs(floor(q + 5e-1) - q) AS da,
  abs(floor(r + 5e-1) - r) AS db, abs(floor(-q - r + 5e-1) - (-q - r)) AS dc FROM {name}f),
{name}w AS (SELECT id, CAST(CASE WHEN da > db AND da > dc THEN -b - c ELSE a END AS BIGINT) AS wq,
  CAST(CASE WHEN NOT (da > db AND da > dc) AND db > dc THEN -a - c ELSE b END AS BIGINT) AS wr FROM {name}n),
{name} AS (SELECT id, wq, wr, {resolution << 56} + (wq + {1 << 27}) * {1 << 28} + wr + {1 << 27} AS cell,
  (wq + wr / 2e0) * {hexgrid.ROOT3!r}::DOUBLE * {edge} AS x, wr * 15e-1 * {edge} AS y FROM {name}w)"""


ORACLES["hex_codes"] = f"""WITH {DET}, place AS (SELECT detection_id AS id,
  longitude * {hexgrid.RADIANS!r}::DOUBLE * {hexgrid.EARTH_KM!r}::DOUBLE AS x,
  sin(latitude * {hexgrid.RADIANS!r}::DOUBLE) * {hexgrid.EARTH_KM!r}::DOUBLE AS y FROM det),
{_hexes("place", "h8", 8)}, {_hexes("h8", "h6", 6)}, {_hexes("h6", "h4", 4)}
SELECT id AS detection_id, h8.cell, h6.cell AS area, h4.cell AS map_cell, 8 AS resolution,
  h8.cell - {1 << 28} + 1 AS north_west FROM h8 JOIN h6 USING (id) JOIN h4 USING (id)"""
