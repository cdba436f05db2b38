"""Keys of an octree: level and Morton index (63 bits at most), as Column functions.

Bit b of x, y, z is bit 3b, 3b+1, 3b+2 of the index. A space is a cube from `low` of side `extent`.

encode() and decode() are plain bit arithmetic and lookups, so that they stay in generated code; they refer to their
argument many times. Store an index before filtering on what is decoded from it, or Catalyst copies its definition into every use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 21
# Masks that spread 21 bits to every third bit, by the shift that comes before each.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


@dataclass(frozen=True)
class Space:
    low: float
    extent: float


#: Fixed value: the earth's cube, 1.1 times a polar radius each way, in metres.
EARTH = Space(-7022840.0, 14045680.0)


def long(c: Column) -> Column:
    return c.cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once. Bit tricks refer to their argument 32 times; where one's argument is
    another's result, this keeps the expression small."""
    return F.transform(F.array(value), use)[0]


# Seven bits, spread: looked up, as a method that names its argument 32 times is too large for the JVM to compile.
_SPREAD_7 = "array(" + ", ".join(f"{sum((v >> b & 1) << 3 * b for b in range(7))}L" for v in range(128)) + ")"


def _spread(v: Column) -> Column:
    table, v = F.expr(_SPREAD_7), long(v)
    low, mid, high = (F.get(table, F.shiftright(v, k).bitwiseAND(F.lit(127).cast("long")).cast("int")) for k in (0, 7, 14))
    return low.bitwiseOR(F.shiftleft(mid, 21)).bitwiseOR(F.shiftleft(high, 42))


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0x1FFFFF], strict=True):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def encode(x: Column, y: Column, z: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def decode(index: Column) -> tuple[Column, Column, Column]:
    return _gather(long(index)), _gather(F.shiftright(index, 1)), _gather(F.shiftright(index, 2))


def cells_on(level: Column) -> Column:
    """Cells along an axis."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def last_on(level: Column) -> Column:
    """The last index of a level: as many ones as its keys have bits."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - 3 * level).cast("int"))
    return F.when(level > 0, ones).otherwise(F.lit(0).cast("long"))


def valid(level: Column, index: Column) -> Column:
    return level.between(0, MAX_LEVEL) & (index >= 0) & (F.call_function("shiftright", index, (3 * level).cast("int")) == 0) | (level == MAX_LEVEL) & (index >= 0)


def up(index: Column, levels: Column) -> Column:
    return F.call_function("shiftright", index, (levels * 3).cast("int"))


def down(index: Column, levels: Column) -> Column:
    return F.call_function("shiftleft", index, (levels * 3).cast("int"))


def parent(level: Column, index: Column) -> tuple[Column, Column]:
    return F.when(level > 0, level - 1), F.when(level > 0, F.shiftright(index, 3))


def child(index: Column, i: Column) -> Column:
    return F.shiftleft(index, 3).bitwiseOR(long(i))


def ancestor(level: Column, index: Column, on: Column) -> Column:
    """Index of the ancestor on a level, null below the key's own."""
    return F.when((on <= level) & (on >= 0), up(index, level - on))


def descendants(level: Column, index: Column, on: Column) -> tuple[Column, Column]:
    """First and last index of the contiguous range of descendants on a level."""
    first = down(index, on - level)
    return F.when(on >= level, first), F.when(on >= level, first.bitwiseOR(last_on(on - level)))


def is_ancestor(level: Column, index: Column, of_level: Column, of_index: Column, include_self: bool = False) -> Column:
    """Whether the first key is an ancestor of the second; itself too if include_self is set, at every level."""
    above = of_level >= level if include_self else of_level > level
    return above & (F.call_function("shiftright", of_index, (F.greatest(of_level - level, F.lit(0)) * 3).cast("int")) == index)


def neighbours(level: Column, index: Column, offsets: list[tuple[int, int, int]] | None = None) -> Column:
    """Array of the indices of the neighbours at the given offsets (default: all 26, x outermost), without those outside
    the grid of the level."""
    if offsets is None:
        offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    steps = F.array(*[F.array(*[F.lit(k).cast("long") for k in o]) for o in offsets])
    n = cells_on(level)

    def around(at: Column) -> Column:
        def near(o: Column) -> Column:
            return F.array(*[at[k] + o[k] for k in range(3)])

        inside = F.filter(F.transform(steps, near), lambda p: F.forall(p, lambda c: (c >= 0) & (c < n)))
        return F.transform(inside, lambda p: encode(p[0], p[1], p[2]))

    return let(F.array(*decode(index)), around)


def neighbour(level: Column, index: Column, dx: int, dy: int, dz: int) -> Column:
    """Index of a neighbour, null outside the grid of the level."""
    return F.try_element_at(neighbours(level, index, [(dx, dy, dz)]), F.lit(1))


def following(level: Column, index: Column) -> Column:
    return F.when(index < last_on(level), F.try_add(index, F.lit(1).cast("long")))


def preceding(index: Column) -> Column:
    return F.when(index > 0, index - 1)


def key_text(level: Column, index: Column) -> Column:
    x, y, z = decode(index)
    return F.format_string("Id(level=%d, coords=(%d, %d, %d), index=%d)", long(level), x, y, z, index)


def cell_size(space: Space, level: Column) -> Column:
    return F.lit(space.extent) / cells_on(level)


def cell_bounds(space: Space, level: Column, index: Column) -> list[Column]:
    """Low and high x, y, z of a cell."""
    size = cell_size(space, level)
    at = decode(index)
    return [space.low + c * size for c in at] + [space.low + (c + 1) * size for c in at]


def contains(space: Space, *point: Column) -> Column:
    """Half open: the low face is inside, the high face isn't."""
    inside = F.lit(True)
    for p in point:
        inside = inside & (p >= space.low) & (p < space.low + space.extent)
    return inside


def coordinate(space: Space, level: Column, p: Column) -> Column:
    return long(F.floor((p - space.low) / cell_size(space, level)))


def cell_of(space: Space, level: Column, x: Column, y: Column, z: Column) -> Column:
    """Index of the cell that holds a point, null outside the space."""
    return F.when(contains(space, x, y, z), encode(*[coordinate(space, level, p) for p in (x, y, z)]))


def _odd(level: Column) -> Column:
    return level % 2 == 1


def shifted_cell_of(space: Space, level: Column, x: Column, y: Column, z: Column) -> Column:
    """cell_of() on the grid whose odd levels lie half a cell lower; the last cell takes what is beyond it."""
    def at(p: Column) -> Column:
        q = (p - space.low) / cell_size(space, level) + F.when(_odd(level), 0.5).otherwise(0.0)
        return F.least(long(F.floor(q)), cells_on(level) - 1)

    return F.when(contains(space, x, y, z), encode(at(x), at(y), at(z)))


def shifted_bounds(space: Space, level: Column, index: Column) -> list[Column]:
    """Bounds on the shifted grid; border cells are clipped at the low faces and extended to the high ones."""
    size, half = cell_size(space, level), cell_size(space, level) / 2
    lows, highs = [], []
    for c in decode(index):
        low, high = space.low + c * size, space.low + (c + 1) * size
        lows.append(F.when(_odd(level) & (c > 0), low - half).otherwise(low))
        highs.append(F.when(_odd(level) & (c < cells_on(level) - 1), high - half).otherwise(high))
    return lows + highs


def standard_to_shifted(level: Column, index: Column) -> Column:
    """Array of the shifted cells that meet a standard cell: c and c+1 on each axis of an odd level."""
    return _spans(level, [(c, F.when(_odd(level), F.least(c + 1, cells_on(level) - 1)).otherwise(c)) for c in decode(index)])


def shifted_to_standard(level: Column, index: Column) -> Column:
    """Array of the standard cells that meet a shifted cell: c-1 and c on each axis of an odd level."""
    return _spans(level, [(F.when(_odd(level), F.greatest(c - 1, F.lit(0))).otherwise(c), c) for c in decode(index)])


def _spans(level: Column, spans: list[tuple[Column, Column]]) -> Column:
    """Indices of all cells of a box of coordinates, both ends included."""
    x, y, z = (F.sequence(long(a), long(b)) for a, b in spans)
    return F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(z, lambda k: encode(i, j, k))))))


def rectangle(level: Column, begin: Column, end: Column) -> Column:
    """Indices of the keys between two keys of a level, both ends included; z goes fastest."""
    return let(begin, lambda b: let(end, lambda e: _spans(level, list(zip(decode(b), decode(e), strict=True)))))


def box_cover(space: Space, level: Column, low: list[Column], high: list[Column], *, clip: bool = False) -> Column:
    """Array of the cells of a level that a box meets. The box is first shrunk by a 1024th of a cell on each side; it has
    no cells if a corner is outside the space, unless `clip` cuts it to the space."""
    margin = cell_size(space, level) / 1024
    low, high = [p + margin for p in low], [p - margin for p in high]
    if clip:
        top = space.low + space.extent - margin
        low, high = [F.greatest(p, F.lit(space.low)) for p in low], [F.least(p, top) for p in high]
    spans = [(coordinate(space, level, a), coordinate(space, level, b)) for a, b in zip(low, high, strict=True)]
    some = F.lit(True)
    for a, b in spans:
        some = some & (a <= b)
    return F.when(contains(space, *low) & contains(space, *high) & some, _spans(level, spans)).otherwise(F.array().cast("array<long>"))


def enclosing_level(space: Space, low: list[Column], high: list[Column], deepest: int = MAX_LEVEL) -> Column:
    """The finest level on which one cell holds both corners of a box, null outside the space."""
    levels = F.sequence(F.lit(0), F.lit(deepest))
    same = F.filter(levels, lambda l: cell_of(space, l, *low) == cell_of(space, l, *high))
    return F.array_max(same)


def morton_ranges(space: Space, level: int, low: tuple, high: tuple, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of indices on `level` that cover a box, for pushing down: an octant that the box covers, or that would
    exceed `most` ranges, is taken whole. A driver-side helper; rows still need the exact test."""
    out: list[tuple[int, int]] = []
    work = [(0, 0)]
    while work:
        nxt = []
        for at, index in work:
            size = space.extent / 2**at
            c = [sum((index >> (3 * b + d) & 1) << b for b in range(at)) for d in range(3)]
            lo = [space.low + k * size for k in c]
            if any(l >= h or l + size <= m for l, h, m in zip(lo, high, low, strict=True)):
                continue
            whole = all(m <= l and l + size <= h for l, h, m in zip(lo, high, low, strict=True))
            if whole or at == level or len(out) + len(nxt) + len(work) > most:
                out.append((index << 3 * (level - at), ((index + 1) << 3 * (level - at)) - 1))
            else:
                nxt += [(at + 1, index << 3 | i) for i in range(8)]
        work = nxt
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def in_ranges(index: Column, ranges: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for a, b in ranges:
        found = found | index.between(a, b)
    return found


def shifted_bounds_with_children(space: Space, level: Column, index: Column) -> list[Column]:
    """Bounds of a shifted cell and of its first and last child, which may lie half a cell beyond it."""
    own = shifted_bounds(space, level, index)
    first, last = (shifted_bounds(space, level + 1, child(index, F.lit(i))) for i in (0, 7))
    return [F.least(a, b) for a, b in zip(own[:3], first[:3], strict=True)] + [F.greatest(a, b) for a, b in zip(own[3:], last[3:], strict=True)]


def shifted_box_cover(space: Space, level: Column, low: list[Column], high: list[Column]) -> Column:
    """box_cover() on the shifted grid, for boxes inside the space."""
    margin = cell_size(space, level) / 1024

    def at(p: Column) -> Column:
        q = (p - space.low) / cell_size(space, level) + F.when(_odd(level), 0.5).otherwise(0.0)
        return F.least(long(F.floor(q)), cells_on(level) - 1)

    low, high = [p + margin for p in low], [p - margin for p in high]
    some = F.lit(True)
    for a, b in zip(low, high, strict=True):
        some = some & (a <= b)
    spans = [(at(a), at(b)) for a, b in zip(low, high, strict=True)]
    return F.when(contains(space, *low) & contains(space, *high) & some, _spans(level, spans)).otherwise(F.array().cast("array<long>"))
