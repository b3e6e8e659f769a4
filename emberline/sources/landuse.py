"""Attribute-driven land-use layers and their fusion with map features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import norm_str


def industrial_landuse(df: DataFrame) -> DataFrame:
    """Rows a land-use extract classes as industrial."""
    return df.where(F.col("fclass") == "industrial")


def land_cover(df: DataFrame, source: str = "LULC") -> DataFrame:
    """Rows whose description-like columns mention industry or mining, with derived columns.

    Where no column is named like a description, all text columns are read.
    """
    words = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    described = [c for c in words if any(h in c.lower() for h in C.LAND_USE_COLUMN_HINTS)] or words
    if not described:
        raise ValueError("a land-cover layer needs a text column")
    text = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in described]
    keep = reduce(lambda a, b: a | b, [t.rlike(C.LAND_USE_REGEX) for t in text])
    joined = F.concat_ws(" ", *text)
    named = [c for c in described if "name" in c.lower()]
    name = F.coalesce(*[norm_str(c) for c in named + [c for c in described if c not in named]])
    kind = F.when(joined.rlike("mining|quarry"), "mining") \
        .when(joined.contains("kiln"), "brick_kiln").when(joined.contains("power"), "power_thermal") \
        .when(joined.contains("refin"), "petrochemical_refinery") \
        .when(joined.rlike("steel|smelter"), "steel_metallurgy").otherwise("general_industrial")
    return df.where(keep).withColumns({"site_name": name, "facility_type": kind,
                                       "source": F.lit(source)})


def fuse(*layers: DataFrame) -> DataFrame:
    """One reference layer; columns a layer lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
