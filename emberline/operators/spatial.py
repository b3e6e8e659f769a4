"""Detections against polygon layers: containment, buffer, nearest distance, forest cover."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions import facility, geo
from emberline.functions.text import half_up, number_or
from emberline.operators import skew
from emberline.operators import tiles as T
from emberline.session import checkpoint_root

SITE_COLUMNS = ("osm_id", "name", "landuse", "man_made", "industrial", "other_tags",
                "facility_type")


@dataclass(frozen=True)
class JoinConfig:
    buffer_m: float = C.BUFFER_METERS
    adaptive: bool = True
    nearest: bool = True
    rounds: tuple[float, ...] = C.NEAREST_ROUNDS_DEG
    tile_deg: float = 0.1
    per_part: int = T.ITEMS_PER_PART
    max_broadcast: int = T.BROADCAST_MAX_BYTES


def with_edges(polygons: DataFrame) -> DataFrame:
    """Edges and bounding box of the ``rings`` column; polygons without edges are dropped."""
    edged = polygons.withColumn("edges", geo.ring_edges("rings")).drop("rings") \
        .where("size(edges) > 0")
    return edged.selectExpr(
        "*", "array_min(edges.x1) AS minx", "array_max(edges.x1) AS maxx",
        "array_min(edges.y1) AS miny", "array_max(edges.y1) AS maxy")


def polygon_spec(polygons: DataFrame, id_col: str, size: float, reach: float,
                 attrs: Sequence[str] = ()) -> T.LayerSpec:
    """Tile index usable for containment and for distances up to ``reach`` degrees.

    A tile keeps only the edges of a polygon that matter there: those crossing the tile's
    latitude band to its right (containment) and those within reach (distance).
    """
    df = polygons if "edges" in polygons.columns else with_edges(skew.ensure_parallel(polygons, id_col))
    slack = reach + 1e-9
    x0, y0, x1, y1 = (f"({t} * {size!r}D)" for t in ("_tx", "_ty", "(_tx + 1)", "(_ty + 1)"))
    right = f"greatest(e.x1, e.x2) >= {x0} - "
    band = (f"greatest(e.y1, e.y2) >= {y0} - {{0}} AND least(e.y1, e.y2) <= {y1} + {{0}} "
            f"AND {right}{{0}}")
    matters = (f"({band.format('1e-9D')}) OR ({band.format(f'{slack!r}D')} "
               f"AND least(e.x1, e.x2) <= {x1} + {slack!r}D)")
    fields = "".join(f", '{a}', {a}" for a in attrs)
    item = F.expr(f"named_struct('poly_id', {id_col}, 'minx', minx, 'miny', miny, 'maxx', maxx, "
                  f"'maxy', maxy, 'edges', filter(edges, e -> {matters}), "
                  f"'attrs', named_struct('matched', 1{fields}))")
    bounds = (F.col("minx") - slack, F.col("miny") - slack,
              F.col("maxx") + slack, F.col("maxy") + slack)
    return T.LayerSpec(df, bounds, item, size, F.size("edges") * 56 + 200)


def polygon_layer(polygons: DataFrame, id_col: str, size: float, reach: float,
                  attrs: Sequence[str] = (), per_part: int = T.ITEMS_PER_PART) -> T.TileLayer:
    return T.build_layers([polygon_spec(polygons, id_col, size, reach, attrs)], per_part)[0]


#: A crowded tile is halved until a polygon spans about so many tiles.
TILES_ACROSS = 8


def covering_layer(polygons: DataFrame, id_col: str, size: float, per_part: int = T.ITEMS_PER_PART) -> T.TileLayer:
    """Tile index for the question whether any polygon covers a place; an item is struct(i), NULL where all are covered.

    A tile inside one polygon has its answer, so it keeps that alone, however many others reach it. Where
    tiles are crowded all of them are halved, as more of them then lie inside a polygon.
    """
    checkpoint_root(polygons.sparkSession)
    edged = with_edges(skew.ensure_parallel(polygons, id_col))
    tiles = polygon_spec(edged, id_col, size, 0.0).spread().groupBy("_tx", "_ty").count()
    most = tiles.agg(F.max("count")).first()[0] or 0
    if most > per_part:
        wide = edged.agg(F.avg(F.greatest(F.expr("maxx - minx"), F.expr("maxy - miny")))).first()[0]
        useful = math.floor(math.log2(size * TILES_ACROSS / wide) + 1e-6) if wide > 0 else 0
        size = size / 2 ** max(min(math.ceil(math.log(most / per_part, 4)), useful), 0)
    spec = polygon_spec(edged, id_col, size, 0.0)
    x0, y0, x1, y1 = (f"({t} * {size!r}D)" for t in ("_tx", "_ty", "(_tx + 1)", "(_ty + 1)"))
    passes = (f"greatest(e.x1, e.x2) >= {x0} - 1e-9D AND least(e.x1, e.x2) <= {x1} + 1e-9D "
              f"AND greatest(e.y1, e.y2) >= {y0} - 1e-9D AND least(e.y1, e.y2) <= {y1} + 1e-9D")
    middle = geo.covers("edges", f"({x0} + {size / 2!r}D)", f"({y0} + {size / 2!r}D)")
    located = spec.spread(spec.item.alias("_item"), F.expr(f"NOT exists(edges, e -> {passes}) AND {middle}").alias("_inside"))
    inside = located.where("_inside").select("_tx", "_ty").distinct().checkpoint()
    partly = located.where("NOT _inside AND size(_item.edges) > 0").drop("_inside").join(inside, ["_tx", "_ty"], "left_anti")
    nothing = F.lit(None).cast(partly.schema["_item"].dataType)
    rows = partly.select("_tx", "_ty", F.struct(F.col("_item").alias("i")).alias("_item")).unionByName(
        inside.select("_tx", "_ty", F.struct(nothing.alias("i")).alias("_item"))).checkpoint()
    return T.packed_layer(rows, size, F.coalesce(F.size("_item.i.edges"), F.lit(0)) * 56 + 100, per_part)


X, Y = "longitude", "latitude"


def _covered(p: str = "p") -> str:
    return f"({geo.in_box(p, X, Y, '1e-12D')} AND {geo.covers(p + '.edges', X, Y)})"


def buffer_degrees(df: DataFrame, cfg: JoinConfig) -> Column:
    """Match radius: the fixed buffer plus half a pixel when adaptive."""
    if not cfg.adaptive:
        return F.lit(cfg.buffer_m / (C.KM_PER_DEGREE * 1000.0))
    scan = number_or(F.col("scan"), 0.375) if "scan" in df.columns else F.lit(0.375)
    pixel = F.least(F.greatest(scan, F.lit(0.375)), F.lit(6.0))
    return (cfg.buffer_m + pixel * 1000.0 / 2.0) / (C.KM_PER_DEGREE * 1000.0)


def polygon_match(df: DataFrame, polygons: DataFrame, cfg: JoinConfig = JoinConfig(),
                  id_col: str = "detection_id", attrs: Sequence[str] | None = None) -> DataFrame:
    """Left join to the lowest-id polygon that covers a detection, else lies within its buffer.

    Adds ``hit`` = struct(rank 0 exact / 1 buffer, poly_id, attrs), NULL when unmatched.
    """
    names = [c for c in SITE_COLUMNS if c in polygons.columns] if attrs is None else list(attrs)
    max_reach = (cfg.buffer_m + (3000.0 if cfg.adaptive else 0.0)) / (C.KM_PER_DEGREE * 1000.0)
    layer = polygon_layer(polygons, "poly_id", cfg.tile_deg, max_reach, names, cfg.per_part)
    near = (f"({geo.in_box('p', X, Y, '_radius')} AND exists(p.edges, e -> "
            f"{geo.squared_edge_distance(X, Y)} <= _radius * _radius))")

    def hit(items):
        def answer(rank, test):
            return (f"transform(slice(filter({items}, p -> {test}), 1, 1), p -> named_struct("
                    f"'rank', {rank}, 'poly_id', p.poly_id, 'attrs', p.attrs))")

        return F.expr(f"coalesce(get({answer(0, _covered())}, 0), get({answer(1, near)}, 0))")

    found = T.lookup(df.withColumn("_radius", buffer_degrees(df, cfg)), layer, hit,
                     max_broadcast=cfg.max_broadcast, inputs=(Y, X, "_radius"))
    return found.drop("_radius")


def nearest_km(df: DataFrame, polygons: DataFrame, cfg: JoinConfig = JoinConfig(),
               id_col: str = "detection_id", needed: Column | None = None,
               name: str = "nearest_km") -> DataFrame:
    """Distance to the nearest polygon within the last round's reach, 999 beyond it.

    Each round looks a little further; an answer within a round's reach is final.
    """
    wanted = F.lit(True) if needed is None else needed
    edged = with_edges(skew.ensure_parallel(polygons.select("poly_id", "rings"), "poly_id"))
    layers = T.build_layers([polygon_spec(edged, "poly_id", r, r) for r in cfg.rounds],
                            cfg.per_part)
    rounds = [(r, layer) for r, layer in zip(cfg.rounds, layers) if not layer.empty]

    def within(items: str, reach: float) -> Column:
        # polygons whose box is no closer than the best so far are skipped
        box = geo.squared_box_distance("p", X, Y)
        closest = geo.min_squared_distance("p.edges", X, Y)
        best = (f"sqrt(aggregate({items}, {reach * reach * 1.0000001!r}D, (best, p) -> "
                f"CASE WHEN {box} > best THEN best WHEN {_covered()} THEN 0D "
                f"ELSE least(best, {closest}) END))")
        return F.expr(f"transform(array({best}), d -> CASE WHEN d <= {reach!r}D THEN d END)[0]")

    # the layers of one pass are on the driver together: their sum is bounded
    if all(r.max_parts <= 1 for _, r in rounds) and sum(r.n_bytes for _, r in rounds) <= cfg.max_broadcast:
        out = _nearest_in_place(df, rounds, within, wanted)
    else:
        out = _nearest_by_rounds(df, rounds, within, wanted, cfg)
    km = F.when(F.col("_deg").isNotNull(), half_up(F.col("_deg") * C.KM_PER_DEGREE, 2)) \
        .otherwise(F.lit(C.NO_POLYGON_KM))
    return out.withColumn(name, km).drop("_deg")


def _nearest_in_place(df, rounds, within, wanted):
    """All rounds as broadcast lookups of one pass; coalesce stops at the first answer."""
    keys, out = {}, df
    for i, (reach, _) in enumerate(rounds):
        keys[f"_tx{i}"], keys[f"_ty{i}"] = T.tile_of(F.col(Y), F.col(X), reach)
    out = df.withColumns(keys)
    for i, (_, layer) in enumerate(rounds):
        side = layer.tiles.select(F.col("_tx").alias(f"_tx{i}"), F.col("_ty").alias(f"_ty{i}"),
                                  F.col("items").alias(f"_items{i}"))
        out = out.join(F.broadcast(side), [f"_tx{i}", f"_ty{i}"], "left")
    tries = [within(f"_items{i}", float(reach)) for i, (reach, _) in enumerate(rounds)]
    found = F.coalesce(*tries) if tries else F.lit(None).cast("double")
    return out.select(*df.columns, F.when(wanted, found).alias("_deg"))


def _nearest_by_rounds(df, rounds, within, wanted, cfg):
    """One lookup per round for large or crowded layers, over the different places alone.

    A distance depends on the place only, so what travels and is kept from round to round is (x, y),
    once for each place that is still open; the rows themselves meet the distances once, at the end.
    """
    checkpoint_root(df.sparkSession)
    open_ = df.where(F.coalesce(wanted, F.lit(False))).select(X, Y).where(
        F.col(X).isNotNull() & F.col(Y).isNotNull()).distinct()
    settled = []
    for reach, layer in rounds:
        seen = T.lookup(open_, layer, lambda items, r=float(reach): within(items, r), name="_deg",
                        max_broadcast=cfg.max_broadcast, inputs=(Y, X)).checkpoint()
        settled.append(seen.where("_deg IS NOT NULL"))
        open_ = seen.where("_deg IS NULL").drop("_deg")
    if not settled:
        return df.withColumn("_deg", F.lit(None).cast("double"))
    places = functools.reduce(DataFrame.unionByName, settled).withColumnsRenamed({X: "_px", Y: "_py"})
    out = skew.match_join(df, places, [X, Y], ["_px", "_py"])
    return out.select(*df.columns, F.when(wanted, F.col("_deg")).alias("_deg"))


def join_industrial(df: DataFrame, polygons: DataFrame, cfg: JoinConfig = JoinConfig(),
                    id_col: str = "detection_id") -> DataFrame:
    """Detections with site attributes, containment flags, distance and facility type."""
    names = [c for c in SITE_COLUMNS if c in polygons.columns]
    matched = polygon_match(df, polygons, cfg, id_col, names)
    inside = F.col("hit").isNotNull()
    base = matched.select(
        *df.columns, F.col("hit.poly_id").alias("poly_id"), inside.alias("inside_industrial"),
        (inside & (F.col("hit.rank") == 0)).alias("is_exact_match"),
        *[F.col(f"hit.attrs.{c}").alias(f"_site_{c}") for c in names])
    if cfg.nearest:
        base = nearest_km(base, polygons, cfg, id_col, ~F.col("inside_industrial"), "_km")
    else:
        base = base.withColumn("_km", F.lit(C.NO_POLYGON_KM))
    cols = {c: F.col(f"_site_{c}") for c in names}
    kind = facility.facility_type(F.col("inside_industrial"), cols, cols.get("facility_type"))
    name = F.when(F.col("inside_industrial"),
                  F.coalesce(cols.get("name", F.lit(None)), F.lit("Unnamed Industrial Site")))
    typed = base.withColumns({
        "facility_type": kind,
        "facility_name": name,
        "osm_id": cols.get("osm_id", F.lit(None).cast("string")),
        "dist_to_industrial_km": F.when(F.col("inside_industrial"), 0.0)
        .otherwise(F.col("_km"))})
    return withdraw_non_combustion(
        typed.drop("_km", *[f"_site_{c}" for c in names]))


def withdraw_non_combustion(df: DataFrame) -> DataFrame:
    """Solar and wind sites stop counting as industrial; type and distance stay."""
    solar = F.col("facility_type") == C.NON_COMBUSTION_TYPE
    return df.withColumns({
        c: F.when(solar, F.lit(False)).otherwise(F.col(c))
        for c in ("inside_industrial", "is_exact_match")})


def forest_flag(df: DataFrame, forests: DataFrame | None, id_col: str = "detection_id",
                forest_id: str = "forest_id", tile_deg: float = 0.1,
                per_part: int = T.ITEMS_PER_PART,
                max_broadcast: int = T.BROADCAST_MAX_BYTES) -> DataFrame:
    """Boolean ``in_forest``; false everywhere when there is no layer."""
    if forests is None:
        return df.withColumn("in_forest", F.lit(False))
    layer = covering_layer(forests, forest_id, tile_deg, per_part)

    def hit(items):
        return F.expr(f"CASE WHEN exists({items}, p -> p.i IS NULL OR {_covered('p.i')}) THEN true END")

    found = T.lookup(df, layer, hit, name="in_forest", merge=F.max,
                     max_broadcast=max_broadcast, inputs=(Y, X))
    return found.withColumn("in_forest", F.coalesce("in_forest", F.lit(False)))


def in_boxes(df: DataFrame, boxes: dict[str, tuple[float, float, float, float]] = C.HUB_BOXES,
             name: str = "hub_name") -> DataFrame:
    """Rows inside named (south, west, north, east) boxes, one output row per containing box."""
    lat, lon = F.col("latitude"), F.col("longitude")
    tests = [F.when(lat.between(s, n) & lon.between(w, e), F.lit(hub))
             for hub, (s, w, n, e) in boxes.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*tests))))
