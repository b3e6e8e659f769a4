"""Tile index of a reference layer and row-wise lookups against it.

Items (polygons, facilities, event windows) are copied to every tile they can affect and packed
into arrays of bounded length. A detection has exactly one tile, so a lookup is one equi-join and
an expression over a short array: no pair table, no de-duplication shuffle. Tiles with more items
than one array holds are split into parts; only detections in such tiles are folded afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators import skew

BROADCAST_MAX_BYTES = 64 << 20
ITEMS_PER_PART = 64


@dataclass(frozen=True)
class TileLayer:
    tiles: DataFrame          # _tx, _ty, part, parts, items
    size: float
    n_bytes: int
    max_parts: int
    n_tiles: int = 0

    @property
    def empty(self) -> bool:
        return self.max_parts == 0


def tile_of(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lon / size).cast("int"), F.floor(lat / size).cast("int")


@dataclass(frozen=True)
class LayerSpec:
    """What to index: items, their bounds (west, south, east, north), payload and tile size.

    ``item`` may use the tile columns _tx and _ty, e.g. to keep only the edges near a tile.
    Arrays are sorted, so the leading field of ``item`` decides which item comes first.
    """

    items: DataFrame
    bounds: tuple[Column, Column, Column, Column]
    item: Column
    size: float
    item_bytes: Column | int = 64

    def spans(self) -> tuple[Column, Column]:
        """Tile columns and rows the bounds touch; bounds beyond 180 degrees go on at the other side."""
        west, south, east, north = self.bounds

        def column(lon):
            return F.floor(lon / self.size).cast("int")

        def wrapped(lon):
            return lon - 360.0 * F.floor((lon + 180.0) / 360.0)

        crosses = (west < -180.0) | (east > 180.0)
        around = east - west >= 360.0
        first, last = column(F.lit(-180.0)), column(F.lit(180.0))
        across = F.when(~crosses, F.sequence(column(west), column(east))) \
            .when(around, F.sequence(first, last)) \
            .otherwise(F.array_distinct(F.concat(F.sequence(column(wrapped(west)), last),
                                                 F.sequence(first, column(wrapped(east))))))
        return across, F.sequence(F.floor(south / self.size).cast("int"),
                                  F.floor(north / self.size).cast("int"))

    def spread(self, *columns: Column | str) -> DataFrame:
        across, down = self.spans()
        return (self.items.withColumn("_tx", F.explode(across))
                .withColumn("_ty", F.explode(down)).select("_tx", "_ty", *columns))


def build_layers(specs: list[LayerSpec], per_part: int = ITEMS_PER_PART) -> list[TileLayer]:
    """Index one frame of items by several specs.

    One job measures bytes and crowding of every spec: an item unfolds to its tiles of all specs
    at once, and only counts per tile are kept.
    """
    def reach(i, spec):
        across, down = spec.spans()
        weight = F.lit(spec.item_bytes) if isinstance(spec.item_bytes, int) else spec.item_bytes
        return F.struct(F.lit(i).alias("_i"), across.alias("x"), down.alias("y"),
                        weight.cast("long").alias("_b"))

    if any(spec.items is not specs[0].items for spec in specs):
        raise ValueError("specs must share their items")
    counts = (specs[0].items
              .select(F.explode(F.array(*[reach(i, s) for i, s in enumerate(specs)])).alias("r"))
              .select("r._i", "r._b", "r.y", F.explode("r.x").alias("_tx"))
              .select("_i", "_b", "_tx", F.explode("y").alias("_ty"))
              .groupBy("_i", "_tx", "_ty")
              .agg(F.ceil(F.count(F.lit(1)) / F.lit(per_part)).cast("int").alias("parts"),
                   F.sum("_b").alias("_b")))
    stats = {r["_i"]: r for r in counts.groupBy("_i").agg(
        F.sum("_b").alias("b"), F.max("parts").alias("p"), F.count(F.lit(1)).alias("t")).collect()}
    layers = []
    for i, spec in enumerate(specs):
        parts = stats[i].p if i in stats else 0
        tiles = _packed(spec.spread(spec.item.alias("_item")), counts.where(F.col("_i") == i), parts)
        layers.append(TileLayer(tiles, spec.size, int(stats[i].b) if i in stats else 0, parts, stats[i].t if i in stats else 0))
    return layers


def _packed(located: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """Items by tile as arrays; counts say into how many parts a tile splits, parts is the most of them."""
    if parts <= 1:
        parted = located.withColumns({"parts": F.lit(1), "part": F.lit(0)})
    else:
        parted = located.join(counts.select("_tx", "_ty", "parts"), ["_tx", "_ty"]) \
            .withColumn("part", F.pmod(F.xxhash64("_item"), F.col("parts")).cast("int"))
    return parted.groupBy("_tx", "_ty", "part", "parts").agg(F.sort_array(F.collect_list("_item")).alias("items"))


def packed_layer(located: DataFrame, size: float, item_bytes: Column, per_part: int = ITEMS_PER_PART) -> TileLayer:
    """Layer of rows (_tx, _ty, _item) that are already at their tiles."""
    counts = located.groupBy("_tx", "_ty").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(per_part)).cast("int").alias("parts"), F.sum(item_bytes.cast("long")).alias("_b"))
    s = counts.agg(F.sum("_b").alias("b"), F.max("parts").alias("p"), F.count(F.lit(1)).alias("t")).first()
    return TileLayer(_packed(located, counts, s.p or 0), size, s.b or 0, s.p or 0, s.t)


def build_layer(*args, per_part: int = ITEMS_PER_PART, **kwargs) -> TileLayer:
    return build_layers([LayerSpec(*args, **kwargs)], per_part)[0]


def _attach(points: DataFrame, tiles: DataFrame, how: str, small: bool,
            salts: int = 32) -> DataFrame:
    """Equi-join on the tile: broadcast a proven-small layer, else shuffle with hot tiles salted.

    Item arrays are larger than Spark reckons them, so a layer not proven small says that it is to be merged.
    """
    keys = ["_tx", "_ty"]
    if small:
        return points.join(F.broadcast(tiles), keys, how)
    hot = skew.hot_keys(points, keys)
    if hot is None:
        return points.join(tiles.hint("merge"), keys, how)
    left = skew.tag_hot(points, hot, keys).withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*points.columns), F.lit(salts)))
        .otherwise(0).cast("int"))
    right = skew.tag_hot(tiles, hot, keys).withColumn("_salt", F.explode(
        F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
        .otherwise(F.array(F.lit(0)))))
    return left.drop("_hot").join(right.drop("_hot").hint("merge"), keys + ["_salt"], how).drop("_salt")


def lookup(points: DataFrame, layer: TileLayer, hit: Callable[[str], Column],
           lat: str = "latitude", lon: str = "longitude", name: str = "hit",
           merge: Callable[[Column], Column] = F.min,
           refine: Callable[[Column], Column] | None = None,
           max_broadcast: int = BROADCAST_MAX_BYTES, inputs: Sequence[str] | None = None) -> DataFrame:
    """Add ``name`` = ``hit("items")`` for the item array of each point's tile.

    ``refine`` may reduce a part's answer in a step of its own, so that an answer it reads several
    times is computed once. ``merge`` folds the answers of a tile's parts into one (an aggregate that
    ignores NULL). ``inputs`` are the columns an answer depends on, all by default: in crowded tiles
    each different set of them is asked once and only that travels to the parts; the rows meet the
    folded answers afterwards. Every point comes back once, whatever its id and however crowded its tile.
    """
    tx, ty = tile_of(F.col(lat), F.col(lon), layer.size)
    columns = points.columns

    def step(df):
        return df if refine is None else df.withColumn(name, refine(F.col(name)))

    located = points.withColumns({"_tx": tx, "_ty": ty})
    small = layer.n_bytes <= max_broadcast
    if layer.max_parts <= 1:
        joined = _attach(located, layer.tiles.drop("part", "parts"), "left", small)
        return step(joined.select(*columns, hit("items").alias(name)))
    # one row per tile, without the array where the tile has several parts
    dense = layer.tiles.where("parts > 1").drop("parts")
    present = layer.tiles.groupBy("_tx", "_ty").agg(
        F.max("parts").alias("parts"),
        F.max(F.when(F.col("parts") == 1, F.col("items"))).alias("items"))
    found = _attach(located, present, "left", small)
    crowded = F.coalesce(F.col("parts"), F.lit(1)) > 1
    direct = step(found.where(~crowded).select(*columns, hit("items").alias(name)))
    asked = list(columns if inputs is None else inputs)
    keys = [f"_k{i}" for i in range(len(asked))]
    waiting = found.where(crowded).select("_tx", "_ty", *columns)
    each = waiting.select("_tx", "_ty", *asked).distinct()
    answers = step(_attach(each, dense, "inner", small).select(*asked, hit("items").alias(name))) \
        .groupBy(*asked).agg(merge(F.col(name)).alias(name)).withColumnsRenamed(dict(zip(asked, keys, strict=True)))
    folded = skew.match_join(waiting, answers, asked, keys, null_safe=inputs is None).select(*columns, name)
    return direct.unionByName(folded)


def first_match(items: Column | str, test: Callable[[Column], Column]) -> Column:
    """The first item passing a test, NULL when none does."""
    return F.get(F.filter(items, test), 0)
