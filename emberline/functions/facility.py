"""Land-use text rules: facility type, non-combustion sites, responder kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import any_word, hstore_has, norm_bool, norm_str

TEXT_COLUMNS = ("name", "landuse", "man_made", "other_tags", "industrial")


def site_text(cols: dict[str, Column]) -> Column:
    parts = [F.coalesce(norm_str(cols[c]), F.lit("")) for c in TEXT_COLUMNS if c in cols]
    return F.lower(F.concat_ws(" ", *parts))


def non_combustion(text: Column) -> Column:
    """Solar and wind land use, unless it concentrates heat."""
    return any_word(text, C.NON_COMBUSTION_WORDS) & ~any_word(text, C.COMBUSTION_EXEMPT_WORDS)


def facility_type(inside: Column, cols: dict[str, Column], preset: Column | None = None) -> Column:
    """Ordered keyword cascade over the site text; first family that matches wins."""
    text = site_text(cols)
    kind = F.lower(F.coalesce(norm_str(preset), F.lit(""))) if preset is not None else F.lit("")
    out = F.when(~norm_bool(inside), F.lit("non_industrial")) \
        .when(non_combustion(text), F.lit(C.NON_COMBUSTION_TYPE)) \
        .when(kind.isin("mining", "quarry"), F.lit("mining")) \
        .when(kind.isin(*C.PRESET_TYPES), kind)
    searched = F.concat_ws(" ", text, kind)
    for family, words in C.FACILITY_WORDS.items():
        out = out.when(any_word(searched, words), F.lit(family))
    return out.otherwise(F.lit("general_industrial"))


def responder_kind(amenity: Column, other_tags: Column) -> Column:
    """Kind from the amenity value, else the first known tag in the tag text."""
    out = F.lit(None).cast("string")
    for tag, kind in reversed(C.RESPONDER_KINDS.items()):
        out = F.when(F.coalesce(other_tags, F.lit("")).contains(f'"{tag}"'), kind).otherwise(out)
    for tag, kind in reversed(C.RESPONDER_KINDS.items()):
        out = F.when(amenity == tag, kind).otherwise(out)
    return F.coalesce(out, F.lit("UNKNOWN"))


def industrial_feature(landuse: Column, man_made: Column, other_tags: Column) -> Column:
    return (F.coalesce(landuse == "industrial", F.lit(False))
            | F.coalesce(man_made == "works", F.lit(False))
            | hstore_has(other_tags, "industrial"))


def forest_feature(landuse: Column, natural: Column, other_tags: Column) -> Column:
    """Managed and natural tree cover; scrub is left out on purpose."""
    return (F.coalesce(landuse == "forest", F.lit(False))
            | F.coalesce(natural == "wood", F.lit(False))
            | hstore_has(other_tags, "landuse", "forest")
            | hstore_has(other_tags, "natural", "wood"))


def responder_feature(amenity: Column, other_tags: Column, layer: str) -> Column:
    """Point and polygon layers carry the amenity tag in different places."""
    fire = (hstore_has(other_tags, "amenity", "fire_station")
            | hstore_has(other_tags, "emergency", "fire_station"))
    if layer == "multipolygons":
        return F.coalesce(amenity.isin(*C.RESPONDER_KINDS), F.lit(False)) | fire
    return (fire | hstore_has(other_tags, "amenity", "hospital")
            | hstore_has(other_tags, "amenity", "police"))
