"""Hierarchical quad cells in plate carree, kept as LONG codes with a zoom tag.

code = zoom * 2^50 + x * 2^25 + y; a parent is a right shift of x and of y.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import as_col

_TAG, _AXIS = 50, 25
GRID_NAME = "quad_plate_carree"


def quad_cell(lat: Column | str, lon: Column | str, zoom: int) -> Column:
    """Cell code at a zoom; NULL for missing coordinates."""
    lat, lon = as_col(lat), as_col(lon)
    n = float(2 ** zoom)
    top = F.lit(2 ** zoom - 1)
    x = F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), top).cast("long")
    y = F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * n), F.lit(0)), top).cast("long")
    usable = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(usable, F.lit(zoom << _TAG) + x * F.lit(1 << _AXIS) + y)


def cell_at(lat: Column | str, lon: Column | str, resolution: int) -> Column:
    """Cell code for a named resolution (9 display, 8 recurrence, 6 neighbourhood)."""
    return quad_cell(lat, lon, C.ZOOM_BY_RESOLUTION[resolution])


def cell_zoom(cell: Column | str) -> Column:
    return F.shiftrightunsigned(as_col(cell), _TAG).cast("int")


def cell_parent(cell: Column | str, zoom: int) -> Column:
    """Ancestor at a coarser zoom; a cell that is already coarser passes through."""
    cell = as_col(cell)
    own = F.shiftrightunsigned(cell, _TAG)
    axis = F.lit((1 << _AXIS) - 1)
    steps = (own - F.lit(zoom)).cast("int")
    x = F.call_function("shiftright", F.shiftrightunsigned(cell, _AXIS).bitwiseAND(axis), steps)
    y = F.call_function("shiftright", cell.bitwiseAND(axis), steps)
    valid = (own >= 1) & (own <= 24)
    return F.when(~valid, F.lit(None).cast("long")) \
        .when(steps <= 0, cell) \
        .otherwise(F.lit(zoom << _TAG) + x * F.lit(1 << _AXIS) + y)


def roll_up(cell: Column | str, resolution: int) -> Column:
    clamped = min(max(resolution, C.MIN_MAP_RESOLUTION), C.MAX_MAP_RESOLUTION)
    return cell_parent(cell, C.ZOOM_BY_RESOLUTION[clamped])


def legacy_bin(lat: Column | str, lon: Column | str, resolution: int = 9) -> Column:
    """Plain latitude/longitude bins written as text, for comparison with old outputs."""
    step = max(0.0015 * (10 - min(resolution, 10)), 0.0001)
    lat_bin = F.abs(F.bround((as_col(lat) + 90.0) / step)).cast("long")
    lon_bin = F.abs(F.bround((as_col(lon) + 180.0) / step)).cast("long")
    return F.concat(F.lit("89"), F.lower(F.lpad(F.hex(lat_bin), 6, "0")),
                    F.lower(F.lpad(F.hex(lon_bin), 6, "0")), F.lit("ffff"))


def edge_km(resolution: Column | int) -> Column:
    table = F.create_map(*[F.lit(v) for kv in C.EDGE_KM.items() for v in kv])
    key = F.lit(resolution) if isinstance(resolution, int) else resolution
    return F.try_element_at(table, key)


def block_id(lat: Column | str, lon: Column | str, degrees: float = 5.0) -> Column:
    """Square block label used to keep neighbours on one side of a split."""
    return F.concat_ws("_", F.floor(as_col(lat) / degrees).cast("string"),
                       F.floor(as_col(lon) / degrees).cast("string"))
