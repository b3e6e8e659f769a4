"""Hexagon cells on an equal-area plane, kept as LONG codes with a resolution tag.

Places are projected to a cylinder that keeps areas (x along the equator, y = sine of the latitude,
both in km), so every cell of a resolution covers the same ground. Cells have a point to the north;
axial coordinates q, r count them: code = resolution * 2^56 + (q + 2^27) * 2^28 + (r + 2^27). Cells
end at the date line. A parent is the coarser cell that holds a cell's centre.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import constants as C
from emberline.functions.text import as_col

_TAG, _AXIS, _HALF = 56, 28, 1 << 27
RADIANS, ROOT3 = math.pi / 180.0, math.sqrt(3.0)
EARTH_KM = C.EARTH_KM_RESPONDERS
#: Edge of a cell in km by resolution.
EDGES = {**C.EDGE_KM, 9: 0.174}
#: Axial steps to the six neighbours, counter-clockwise from the east.
STEPS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _code(x: Column, y: Column, resolution: int) -> Column:
    """Cell of a place on the plane: fractional coordinates, rounded so that they still sum to zero."""
    edge = float(EDGES[resolution])

    def near(p):
        sums = {"a": p["q"], "b": p["r"], "c": -p["q"] - p["r"]}
        return F.struct(*[F.floor(v + 0.5).alias(n) for n, v in sums.items()],
                        *[F.abs(F.floor(v + 0.5) - v).alias(f"d{n}") for n, v in sums.items()])

    def whole(w):
        first = (w["da"] > w["db"]) & (w["da"] > w["dc"])
        q = F.when(first, -w["b"] - w["c"]).otherwise(w["a"])
        r = F.when(~first & (w["db"] > w["dc"]), -w["a"] - w["c"]).otherwise(w["b"])
        return pack(q, r, resolution)

    place = F.struct(((x * (ROOT3 / 3.0) - y / 3.0) / edge).alias("q"), ((y * (2.0 / 3.0)) / edge).alias("r"))
    return _let(place, lambda p: _let(near(p), whole))


def pack(q: Column, r: Column, resolution: int) -> Column:
    return F.lit(resolution << _TAG) + (q.cast("long") + _HALF) * F.lit(1 << _AXIS) + r.cast("long") + _HALF


def hex_cell(lat: Column | str, lon: Column | str, resolution: int = 9) -> Column:
    """Cell code of a place; NULL for missing coordinates and latitudes beyond the poles."""
    lat, lon = as_col(lat), as_col(lon)
    x, y = lon * RADIANS * EARTH_KM, F.sin(lat * RADIANS) * EARTH_KM
    usable = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    place = F.struct(x.alias("x"), y.alias("y"))
    return F.when(usable, _let(place, lambda p: _code(p["x"], p["y"], resolution)))


def resolution_of(cell: Column | str) -> Column:
    return F.shiftrightunsigned(as_col(cell), _TAG).cast("int")


def axial(cell: Column | str) -> tuple[Column, Column]:
    cell, low = as_col(cell), F.lit((1 << _AXIS) - 1)
    return F.shiftrightunsigned(cell, _AXIS).bitwiseAND(low) - _HALF, cell.bitwiseAND(low) - _HALF


def centre_km(cell: Column | str) -> tuple[Column, Column]:
    """Centre of a cell on the plane."""
    edge = F.try_element_at(F.create_map(*[F.lit(v) for k, e in EDGES.items() for v in (k, float(e))]), resolution_of(cell))
    q, r = axial(cell)
    return (q + r / 2.0) * ROOT3 * edge, r * 1.5 * edge


def hex_centre(cell: Column | str) -> Column:
    """Centre of a cell as (latitude, longitude)."""
    x, y = centre_km(cell)
    sine = F.least(F.greatest(y / EARTH_KM, F.lit(-1.0)), F.lit(1.0))
    return F.struct((F.asin(sine) / RADIANS).alias("latitude"), (x / EARTH_KM / RADIANS).alias("longitude"))


def hex_parent(cell: Column | str, resolution: int) -> Column:
    """Coarser cell that holds the centre; a cell as coarse or coarser passes through."""
    def coarser(c):
        x, y = centre_km(c)
        centre = F.struct(x.alias("x"), y.alias("y"))
        return F.when(resolution_of(c) <= resolution, c).otherwise(_let(centre, lambda p: _code(p["x"], p["y"], resolution)))

    return _let(as_col(cell), coarser)


def hex_neighbours(cell: Column | str) -> Column:
    """The six cells that share an edge with a cell, counter-clockwise from the east."""
    return _let(as_col(cell), lambda c: F.array(*[c + dq * (1 << _AXIS) + dr for dq, dr in STEPS]))
