"""Keys of a quadtree (zoom, x, y), tiles of web maps, and layouts of paths, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 32
#: Fixed value: half the side of the web map's square in metres.
HALF = 20037508.342789244


def side(zoom: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), zoom.cast("int"))


def valid(zoom: Column, x: Column, y: Column) -> Column:
    return zoom.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < side(zoom)) & (y < side(zoom))


def parent(zoom: Column, x: Column, y: Column) -> tuple[Column, ...]:
    inner = zoom > 0
    return F.when(inner, zoom - 1), F.when(inner, F.shiftright(x, 1)), F.when(inner, F.shiftright(y, 1))


def children(zoom: Column, x: Column, y: Column) -> Column:
    """Array of the four children."""
    return F.array(*[F.struct((zoom + 1).alias("zoom"), (2 * x + i).alias("x"), (2 * y + j).alias("y")) for j in (0, 1) for i in (0, 1)])


def flip(zoom: Column, y: Column) -> Column:
    """The row counted from the other side."""
    return side(zoom) - y - 1


def tile_bounds(zoom: Column, x: Column, y: Column) -> list[Column]:
    """Web Mercator low x, low y, high x, high y; rows are counted from the south."""
    size = F.lit(2 * HALF) / side(zoom)
    return [x * size - HALF, y * size - HALF, (x + 1) * size - HALF, (y + 1) * size - HALF]


def tile_of(zoom: Column, mx: Column, my: Column) -> tuple[Column, Column]:
    size = F.lit(2 * HALF) / side(zoom)
    return F.floor((mx + HALF) / size).cast("long"), F.floor((my + HALF) / size).cast("long")


def url_of(template: str, zoom: Column, x: Column, y: Column, *, tms: bool = False) -> Column:
    """A template with {zoom}, {x}, {y} filled in."""
    url = F.lit(template)
    for name, c in (("{zoom}", zoom), ("{x}", x), ("{y}", flip(zoom, y) if tms else y)):
        url = F.replace(url, F.lit(name), c.cast("string"))
    return url


def flat_path(level: Column, index: Column) -> Column:
    return F.concat_ws("-", level.cast("string"), index.cast("string"))


def parse_flat(path: Column) -> tuple[Column, Column]:
    """Level and index of a flat path, null if it isn't one."""
    good = path.rlike("^[0-9]+-[0-9]+$")
    return F.when(good, F.split(path, "-")[0].try_cast("long")), F.when(good, F.split(path, "-")[1].try_cast("long"))


def nested_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def parse_nested(path: Column, n: int) -> list[Column]:
    good = path.rlike("^[0-9]+" + "/[0-9]+" * (n - 1) + "$")
    return [F.when(good, F.split(path, "/")[i].try_cast("long")) for i in range(n)]


def smallest_tile(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, deepest: int = 24) -> Column:
    """The deepest tile (zoom, x, y) that holds both corners of Web Mercator bounds."""
    def place(z: Column) -> Column:
        low, high = tile_of(z, lo_x, lo_y), tile_of(z, hi_x, hi_y)
        return F.struct(z.alias("zoom"), low[0].alias("x"), low[1].alias("y"), ((low[0] == high[0]) & (low[1] == high[1])).alias("whole"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(deepest)), place), lambda t: t["whole"])
    return F.array_max(F.transform(found, lambda t: F.struct(t["zoom"].cast("long").alias("zoom"), t["x"].alias("x"), t["y"].alias("y"))))
