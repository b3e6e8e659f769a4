"""Land-use features landed as tables: tag filters, ring assembly, responders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import facility, geo
from emberline.functions.text import column_or, hstore_map
from emberline.operators import skew


def industrial_features(df: DataFrame) -> DataFrame:
    return df.where(facility.industrial_feature(
        column_or(df, "landuse"), column_or(df, "man_made"), column_or(df, "other_tags")))


def forest_features(df: DataFrame) -> DataFrame:
    return df.where(facility.forest_feature(
        column_or(df, "landuse"), column_or(df, "natural"), column_or(df, "other_tags")))


def responders(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Both responder layers as points; polygons give an interior point. Neither may be missing."""
    if points is None or polygons is None:
        raise ValueError("both responder layers are required")
    amenity_p, tags_p = column_or(points, "amenity"), column_or(points, "other_tags")
    amenity_m, tags_m = column_or(polygons, "amenity"), column_or(polygons, "other_tags")
    inner = geo.interior_point("rings")
    near = points.where(facility.responder_feature(amenity_p, tags_p, "points")).select(
        "osm_id", F.col("name").alias("responder_name"), "latitude", "longitude",
        facility.responder_kind(amenity_p, tags_p).alias("responder_kind"),
        F.lit("points").alias("source_layer"))
    built = polygons.where(facility.responder_feature(amenity_m, tags_m, "multipolygons")).select(
        "osm_id", F.col("name").alias("responder_name"), inner["y"].alias("latitude"),
        inner["x"].alias("longitude"),
        facility.responder_kind(amenity_m, tags_m).alias("responder_kind"),
        F.lit("multipolygons").alias("source_layer"))
    return near.unionByName(built).where("responder_kind <> 'UNKNOWN'")


def _closed(points: Column) -> Column:
    first, last = F.get(points, 0), F.element_at(points, -1)
    return ((F.size(points) >= 4) & (first["x"] == last["x"]) & (first["y"] == last["y"]))


def way_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertex ring of every way; ways with missing nodes are flagged instead of silently bent.

    Ways (way_id, node_ids, ...) unfold to one row per vertex and meet the nodes on their id. A
    way is bounded (the format allows 2,000 vertices), so gathering it again is safe.
    """
    refs = ways.select("way_id", F.posexplode("node_ids").alias("pos", "node_id"))
    placed = skew.lookup_join(refs, nodes.select("node_id", "lon", "lat"), ["node_id"],
                              spread=F.struct("way_id", "pos"))
    rings = placed.groupBy("way_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(
            F.col("lon").isNotNull(), F.struct("pos", "lon", "lat")))),
            lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y"))).alias("ring"),
        F.count_if(F.col("lon").isNull()).alias("missing_nodes"))
    return rings.withColumn("closed", _closed(F.col("ring")))


def assemble(ways: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Polygons from closed tagged ways and from the outer ways of area relations.

    A relation is an area if its type says multipolygon or it is tagged as land use or industry;
    of its members (type, role, ref; without a type all are ways) only ways count.
    """
    rings = way_rings(ways, nodes).where("closed")
    tagged = ways.where(F.size("tags") > 0).select("way_id", "tags").join(rings, "way_id").select(
        F.concat(F.lit("way/"), F.col("way_id")).alias("osm_id"), "tags",
        F.array("ring").alias("rings"), "missing_nodes")
    def tagged_as(name):
        return F.try_element_at("tags", F.lit(name))

    area = F.coalesce(tagged_as("type") == "multipolygon", F.lit(False)) \
        | F.map_contains_key("tags", "landuse") | F.map_contains_key("tags", "industrial")
    members = relations.where(area).select("relation_id", "tags", F.posexplode("members").alias("pos", "m"))
    if "type" in members.schema["m"].dataType.names:
        members = members.where("m.type = 'way'")
    members = members.where(F.coalesce("m.role", F.lit("")).isin("outer", ""))
    parts = members.select("relation_id", "tags", "pos", F.col("m.ref").alias("way_id")) \
        .join(rings, "way_id")
    # a relation lists its members itself, which bounds the gathered rings
    shaped = parts.groupBy("relation_id").agg(
        F.first("tags").alias("tags"), F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "ring"))), lambda p: p["ring"])
        .alias("rings"), F.sum("missing_nodes").alias("missing_nodes"))
    multi = shaped.select(F.concat(F.lit("relation/"), F.col("relation_id")).alias("osm_id"),
                          "tags", "rings", "missing_nodes")
    return tagged.unionByName(multi)


def with_tag_columns(df: DataFrame, names: tuple[str, ...] = (
        "name", "landuse", "man_made", "industrial")) -> DataFrame:
    """Lift tags out of the map, or out of key/value text when there is no map."""
    source = F.col("tags") if "tags" in df.columns else hstore_map("other_tags")
    return df.withColumns({n: F.try_element_at(source, F.lit(n)) for n in names
                           if n not in df.columns})
