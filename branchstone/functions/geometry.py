"""Geometries: EWKT in, EWKB out, bounds for pushdown, and the checks that a column of geometries must pass.

A geometry is one atomic value. Its column is a struct with plain bounds, so that a box filter is four comparisons that
reach the Parquet scan; the text is parsed once, in Arrow batches, when it enters."""

from __future__ import annotations

import math
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.definition import DIMENSIONS, GEOMETRY_TYPES

TYPE = "srid int, gtype string, zm int, is_empty boolean, finite boolean, valid boolean, xmin double, ymin double, xmax double, ymax double, ewkb binary"
CODES = {name: k + 1 for k, name in enumerate(GEOMETRY_TYPES)}
#: Levels of parentheses around a coordinate.
DEPTH = {"Point": 1, "LineString": 1, "Polygon": 2, "MultiPoint": 1, "MultiLineString": 2, "MultiPolygon": 3}
HEAD = re.compile(r"\ASRID=([0-9]+);\s*([A-Za-z]+?)\s*(ZM|Z|M)?\s*(EMPTY|\(.*\))\s*\Z", re.IGNORECASE | re.DOTALL)
TOKEN = re.compile(r"[(),]|[^\s(),]+")
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?)"
NUMERAL = re.compile(rf"\A{NUMBER}\Z", re.IGNORECASE)
POINT = re.compile(rf"\ASRID=([0-9]+);\s*POINT\s*(ZM|Z|M)?\s*\(\s*({NUMBER}(?:\s+{NUMBER}){{1,3}})\s*\)\s*\Z", re.IGNORECASE)
LARGEST_SRID = (1 << 31) - 1
Z_FLAG, M_FLAG, SRID_FLAG = 0x80000000, 0x40000000, 0x20000000


class GeometryError(ValueError):
    """Text that is no geometry."""


def _nested(text: str):
    """Lists of lists of coordinate tuples from what stands in parentheses."""
    stack, now = [], []
    words: list[str] = []

    def point() -> None:
        if words:
            if not all(map(NUMERAL.match, words)):
                raise GeometryError("not a number")
            now.append(tuple(map(float, words)))
            words.clear()

    for token in TOKEN.findall(text):
        if token == "(":
            stack.append(now)
            now = []
        elif token == ")":
            point()
            if not stack:
                raise GeometryError("unbalanced")
            stack[-1].append(now)
            now = stack.pop()
        elif token == ",":
            point()
        elif token.upper() == "EMPTY":
            now.append([])
        else:
            words.append(token)
    if stack or words or len(now) != 1:
        raise GeometryError("unbalanced")
    return now[0]


def _depth(x) -> int:
    return 1 + max(map(_depth, x), default=0) if isinstance(x, list) else 0


def points(x) -> Iterator[tuple[float, ...]]:
    if isinstance(x, tuple):
        yield x
    else:
        for y in x:
            yield from points(y)


def parse(text: str) -> dict:
    """srid, gtype, zm and coordinates of EWKT with an explicit SRID."""
    if point := POINT.match(text):  # most geometries are points, which need no nesting
        every = [tuple(map(float, point[3].split()))]
        return _typed(point[1], "Point", point[2], every, every)
    match = HEAD.match(text)
    kind = next((g for g in GEOMETRY_TYPES if match and g.upper() == match[2].upper()), None)
    if kind is None:
        raise GeometryError("not EWKT")
    coordinates = [] if match[4].upper() == "EMPTY" else _nested(match[4])
    if kind == "MultiPoint":  # both ((1 2), (3 4)) and (1 2, 3 4)
        coordinates = [p[0] if isinstance(p, list) and p else p for p in coordinates]
    every = list(points(coordinates))
    if coordinates and every and _depth(coordinates) != DEPTH[kind]:
        raise GeometryError("misplaced coordinates")
    return _typed(match[1], kind, match[3], coordinates, every)


def _typed(srid: str, kind: str, named: str | None, coordinates: list, every: list[tuple]) -> dict:
    flags, sizes = (named or "").upper(), {len(p) for p in every}
    if len(sizes) > 1 or (kind == "Point" and len(every) > 1):
        raise GeometryError("mixed or misplaced coordinates")
    size = sizes.pop() if sizes else 2 + len(flags)
    if not flags:
        flags = {2: "", 3: "Z", 4: "ZM"}.get(size, "?")
    if size != 2 + len(flags):
        raise GeometryError("wrong number of ordinates")
    if int(srid) > LARGEST_SRID:
        raise GeometryError("srid is out of bounds")
    return {"srid": int(srid), "gtype": kind, "zm": DIMENSIONS["XY" + flags], "coordinates": coordinates, "points": every}


def ewkb(g: dict, big: bool = False) -> bytes:
    order = ">" if big else "<"
    flags = (Z_FLAG if g["zm"] & 2 else 0) | (M_FLAG if g["zm"] & 1 else 0)
    size = 2 + bool(g["zm"] & 2) + bool(g["zm"] & 1)

    def number(n: int) -> bytes:
        return struct.pack(order + "I", n)

    def run(ps: list) -> bytes:
        return number(len(ps)) + b"".join(struct.pack(f"{order}{size}d", *p) for p in ps)

    def body(kind: str, c: list) -> bytes:
        if kind == "Point":
            return struct.pack(f"{order}{size}d", *(c[0] if c else [math.nan] * size))
        if kind == "LineString":
            return run(c)
        if kind == "Polygon":
            return number(len(c)) + b"".join(map(run, c))
        part = kind.removeprefix("Multi")
        items = [[p] if p else [] for p in c] if part == "Point" else c
        return number(len(items)) + b"".join(head(part, 0) + body(part, x) for x in items)

    def head(kind: str, more: int) -> bytes:
        return struct.pack("B", 0 if big else 1) + number(CODES[kind] | flags | more)

    return head(g["gtype"], SRID_FLAG) + number(g["srid"]) + body(g["gtype"], g["coordinates"])


def from_ewkb(data: bytes) -> dict:
    """What parse gives, from EWKB in either byte order."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise GeometryError("cut off")
        at += size
        return struct.unpack(form, data[at - size : at])

    def body(outer: str | None) -> tuple[str, int, int, list]:
        (order,) = take("B")
        if order > 1:
            raise GeometryError("no byte order")
        end = "<" if order else ">"
        (code,) = take(end + "I")
        kind = next((k for k, c in CODES.items() if c == code & 0xFF), None)
        if kind is None or (outer is not None and outer != f"Multi{kind}"):
            raise GeometryError("unknown type")
        zm = 2 * bool(code & Z_FLAG) + bool(code & M_FLAG)
        srid = take(end + "I")[0] if code & SRID_FLAG else 0
        size = 2 + bool(zm & 2) + (zm & 1)
        number = lambda: take(end + "I")[0]
        run = lambda: [take(f"{end}{size}d") for _ in range(number())]
        if kind == "Point":
            (p,) = (take(f"{end}{size}d"),)
            return kind, srid, zm, [] if all(map(math.isnan, p)) else [p]
        if kind == "LineString":
            return kind, srid, zm, run()
        if kind == "Polygon":
            return kind, srid, zm, [run() for _ in range(number())]
        parts = [body(kind)[3] for _ in range(number())]
        return kind, srid, zm, [p[0] if p else [] for p in parts] if kind == "MultiPoint" else parts

    kind, srid, zm, coordinates = body(None)
    if at != len(data):
        raise GeometryError("more than a geometry")
    return {"srid": srid, "gtype": kind, "zm": zm, "coordinates": coordinates, "points": list(points(coordinates))}


def make_point(*ordinates: float, srid: int, measured: bool = False) -> dict:
    """A point of two to four ordinates; the third is M if `measured`, else Z."""
    if not 2 <= len(ordinates) <= 4:
        raise GeometryError("wrong number of ordinates")
    every = [tuple(map(float, ordinates))]
    return {"srid": srid, "gtype": "Point", "zm": {2: 0, 3: 1 if measured else 2, 4: 3}[len(ordinates)], "coordinates": every, "points": every}


def _turn(a, b, c) -> int:
    """1 if c lies to the left of a -> b, -1 to the right, 0 on the line: exact, by fractions where floats cannot tell."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    found = left - right
    if abs(found) <= 1e-15 * (abs(left) + abs(right)) or not math.isfinite(found):
        (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p) for p in (a, b, c))
        found = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (found > 0) - (found < 0)


def _between(a, b, c) -> bool:
    return min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])


def _meeting(a, b, c, d) -> set | None:
    """The ends in which two segments touch; None if they cross inside both or run along one another."""
    turns = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if turns[0] == turns[1] == 0:
        shared = {p for p in (c, d) if _between(a, b, p)} | {p for p in (a, b) if _between(c, d, p)}
        return shared if len(shared) < 2 else None
    if turns[0] * turns[1] < 0 and turns[2] * turns[3] < 0:
        return None
    ends = ((turns[0], a, b, c), (turns[1], a, b, d), (turns[2], c, d, a), (turns[3], c, d, b))
    return {r for t, p, q, r in ends if t == 0 and _between(p, q, r)}


def _pairs(segments: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of segments whose boxes meet."""
    box = np.array([(min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])) for a, b in segments])
    order = np.argsort(box[:, 0], kind="stable")
    box = box[order]
    stops = np.searchsorted(box[:, 0], box[:, 2], "right")
    for i, stop in enumerate(stops.tolist()):
        near = np.flatnonzero((box[i + 1 : stop, 1] <= box[i, 3]) & (box[i + 1 : stop, 3] >= box[i, 1])) + i + 1
        for j in near.tolist():
            yield int(order[i]), int(order[j])


def _inside(p, loop) -> bool:
    """Whether a point that is not on a loop lies within it."""
    odd = False
    for a, b in zip(loop, [*loop[1:], loop[0]], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]):
            odd ^= (_turn(a, b, p) > 0) == (b[1] > a[1])
    return odd


def _area(loop) -> Fraction:
    x, y = [Fraction(p[0]) for p in loop], [Fraction(p[1]) for p in loop]
    return sum(x[k - 1] * y[k] - x[k] * y[k - 1] for k in range(len(loop)))


def _noded(rings: list[list]) -> list[list] | None:
    """The rings, without their closing points, with a vertex wherever one touches itself or another; None if any two
    segments cross or run along one another."""
    segments, place = [], []
    for k, r in enumerate(rings):
        for i, a in enumerate(r):
            segments.append((a, r[(i + 1) % len(r)]))
            place.append((k, i))
    more = defaultdict(set)
    for i, j in _pairs(segments):
        found = _meeting(*segments[i], *segments[j])
        if found is None:
            return None
        for s in (i, j):
            more[place[s]] |= found - set(segments[s])
    out = []
    for k, r in enumerate(rings):
        out.append([])
        for i, a in enumerate(r):
            out[-1] += [a, *sorted(more[k, i], key=lambda p, a=a: abs(p[0] - a[0]) + abs(p[1] - a[1]))]
    return out


def _loops(ring: list) -> list[list]:
    """A ring taken apart where it touches itself, into loops that do not."""
    out, path, at = [], [], {}
    for p in [*ring, ring[0]]:
        if p in at:
            loop = path[at[p] :]
            out.append(loop)
            for q in loop[1:]:
                del at[q]
            del path[at[p] + 1 :]
        else:
            at[p] = len(path)
            path.append(p)
    return out


def _within(loop: list, other: list) -> bool | None:
    """Whether a loop lies in another, which it meets in vertices at most; None if it is on both sides."""
    edges = zip(loop, [*loop[1:], loop[0]], strict=True)
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in edges]
    sides = {_inside(m, other) for m in (middles if set(loop) & set(other) else middles[:1])}
    return sides.pop() if len(sides) == 1 else None


def _area_valid(polygons: list[list[list]]) -> bool:
    """Whether polygons (rings of points) are valid, each and together. A ring may touch itself where that makes a hole.

    Rings are taken apart into loops that meet in vertices at most. A polygon is valid if one loop, of its outer ring,
    holds all others and none of these holds another, and if its interior is in one piece: loops and the points in which
    they touch, taken as a graph, have no cycle."""
    rings, of = [], []
    for k, polygon in enumerate(polygons):
        for n, ring in enumerate(polygon):
            r = [p[:2] for p in ring]
            if len(r) < 4 or r[0] != r[-1]:
                return False
            r = [p for i, p in enumerate(r[:-1]) if p != r[i - 1 if i else -2]]
            if len(set(r)) < 3:
                return False
            rings.append(r)
            of.append((k, n))
    noded = _noded(rings)
    if noded is None:
        return False
    areas = []
    for k in range(len(polygons)):
        loops, ring_of = [], []
        for ring, (owner, n) in zip(noded, of, strict=True):
            if owner == k:
                parts = _loops(ring)
                if any(len(x) < 3 for x in parts):
                    return False
                loops += parts
                ring_of += [n] * len(parts)
        depth, turned = [0] * len(loops), [_area(x) > 0 for x in loops]
        for i, a in enumerate(loops):
            for j, b in enumerate(loops):
                if i == j:
                    continue
                side = _within(a, b)
                if side is None:
                    return False
                depth[i] += side
                # a ring that touches itself turns back into a loop inside and goes on into one beside it; else it crosses
                if ring_of[i] == ring_of[j] and set(a) & set(b) and (side or (i < j and not _within(b, a))) and (turned[i] == turned[j]) == side:
                    return False
        outer = [i for i, d in enumerate(depth) if d == 0]
        if len(outer) != 1 or ring_of[outer[0]] != 0 or any(d > 1 for d in depth):
            return False
        at, root = defaultdict(list), {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, loop in enumerate(loops):
            for p in loop:
                at[p].append(i)
        for p, those in at.items():
            for i in those if len(those) > 1 else ():
                a, b = find(("loop", i)), find(p)
                if a == b:
                    return False
                root[a] = b
        areas.append((loops[outer[0]], [x for i, x in enumerate(loops) if i != outer[0]]))
    for i, (shell, _) in enumerate(areas):
        for j, (other, holes) in enumerate(areas):
            if i == j:
                continue
            edges = zip(shell, [*shell[1:], shell[0]], strict=True)
            if any(_inside(m, other) and not any(_inside(m, h) for h in holes) for m in (((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in edges)):
                return False
    return True


def valid(g: dict) -> bool:
    """Whether a finite geometry is valid; empty ones are. A ring may touch itself where that makes a hole."""
    kind, c = g["gtype"], g["coordinates"]
    if not c or kind in ("Point", "MultiPoint"):
        return True
    if kind in ("LineString", "MultiLineString"):
        return all(len({p[:2] for p in line}) > 1 for line in (c if kind.startswith("Multi") else [c]) if line)
    return _area_valid([p for p in (c if kind.startswith("Multi") else [c]) if p])


def described(text: str | None) -> dict | None:
    """The struct of TYPE for EWKT; None for what is none."""
    if text is None:
        return None
    try:
        g = parse(text)
    except GeometryError:
        return None
    every = g["points"]
    finite = all(math.isfinite(v) for p in every for v in p)
    xs, ys = [p[0] for p in every], [p[1] for p in every]
    bounds = (min(xs), min(ys), max(xs), max(ys)) if every and finite else (None,) * 4
    return dict(zip(("xmin", "ymin", "xmax", "ymax"), bounds, strict=True)) | {
        "srid": g["srid"], "gtype": g["gtype"], "zm": g["zm"], "is_empty": not every, "finite": finite, "valid": finite and valid(g), "ewkb": ewkb(g),
    }


NAMES = [part.split()[0] for part in TYPE.split(", ")]


def _points_only(texts: list[str | None]) -> pd.DataFrame | None:
    """The structs of texts that are all points of the same dimensions, made at once; None if they are not."""
    found = [POINT.match(t) if t is not None else None for t in texts]
    flags = {(m[2] or "").upper() for m in found if m}
    if not all(found) or len(flags) != 1 or not texts:
        return None
    try:
        ordinates = np.array([m[3].split() for m in found], dtype=np.float64)
        srid = np.array([m[1] for m in found], dtype=np.int64)
    except ValueError:
        return None
    named, size = flags.pop(), ordinates.shape[1]
    named = named or {2: "", 3: "Z", 4: "ZM"}[size]
    if size != 2 + len(named) or srid.max() > LARGEST_SRID:
        return None
    code = CODES["Point"] | SRID_FLAG | (Z_FLAG if "Z" in named else 0) | (M_FLAG if "M" in named else 0)
    rows = np.zeros(len(texts), np.dtype([("order", "u1"), ("code", "<u4"), ("srid", "<u4"), ("at", "<f8", (size,))]))
    rows["order"], rows["code"], rows["srid"], rows["at"] = 1, code, srid, ordinates
    raw, width = rows.tobytes(), rows.dtype.itemsize
    finite = np.isfinite(ordinates).all(axis=1)
    x, y = (np.where(finite, ordinates[:, k], np.nan) for k in (0, 1))
    bound = lambda v: pd.Series(v).astype("Float64") if not finite.all() else pd.Series(v)
    return pd.DataFrame({
        "srid": srid.astype(np.int32), "gtype": "Point", "zm": np.int32(DIMENSIONS["XY" + named]), "is_empty": False, "finite": finite, "valid": finite,
        "xmin": bound(x), "ymin": bound(y), "xmax": bound(x), "ymax": bound(y), "ewkb": [raw[k : k + width] for k in range(0, len(raw), width)],
    })


def _from_ewkt(texts: pd.Series) -> pd.DataFrame:
    every = [t if isinstance(t, str) else None for t in texts]
    if (found := _points_only(every)) is not None:
        return found
    rows = [described(t) or dict.fromkeys(NAMES) for t in every]
    return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in NAMES})


def ordinates(geom: Column) -> Column:
    """array<struct<x, y, z, m>> of all points of a geometry struct in order; z and m are null where there are none."""

    def run(rows: pd.Series) -> pd.Series:
        out = []
        for data in rows:
            g = from_ewkb(bytes(data)) if data is not None else None
            found = [] if g is None else [(p[0], p[1], p[2] if g["zm"] & 2 else None, p[-1] if g["zm"] & 1 else None) for p in g["points"]]
            out.append(None if g is None else [dict(zip("xyzm", p, strict=True)) for p in found])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<x double, y double, z double, m double>>")(geom["ewkb"])


def dump_points(df, geom: str, keep: list[str]):
    """(keep, path, x, y, z, m): a row for each point of each geometry, path from 1."""
    return df.select(*keep, F.posexplode(ordinates(F.col(geom))).alias("path", "p")).select(*keep, (F.col("path") + 1).alias("path"), "p.x", "p.y", "p.z", "p.m")


def ordinate(geom: Column, name: str) -> Column:
    """x, y, z or m of a point; null for what has none."""
    return F.when(geom["gtype"] == "Point", F.get(ordinates(geom), F.lit(0))[name])


def point(x: Column, y: Column, srid: int, *more: Column, measured: bool = False) -> Column:
    """The geometry struct of a point of ordinates."""
    named = {0: "", 1: "M" if measured else "Z", 2: "ZM"}[len(more)]
    parts = [F.lit(f"SRID={srid};POINT{named}("), x.cast("double").cast("string")]
    for c in (y, *more):
        parts += [F.lit(" "), c.cast("double").cast("string")]
    return from_ewkt(F.concat(*parts, F.lit(")")))


def from_ewkt(text: Column) -> Column:
    """The geometry struct of a text; null where the text is null or no EWKT."""
    return F.pandas_udf(_from_ewkt, TYPE)(text)


def in_box(geom: str, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether bounds overlap a box, edges included: four comparisons that Parquet's statistics answer."""
    return (F.col(f"{geom}.xmin") <= xmax) & (F.col(f"{geom}.xmax") >= xmin) & (F.col(f"{geom}.ymin") <= ymax) & (F.col(f"{geom}.ymax") >= ymin)


def geometry_checks(geometry: dict, name: str = "geom") -> list[tuple[str, Column]]:
    """(name, predicate) of a geometry column under its definition; true or false, never null."""
    g = F.col(name)
    found = [] if geometry["nullable"] else [("not_null:geom", g.isNotNull())]
    rules = {
        "type": g["gtype"] == geometry["type"],
        "srid": g["srid"] == geometry["srid"],
        "dimensions": g["zm"] == DIMENSIONS[geometry["dimensions"]],
        "finite": g["finite"],
        "valid": g["valid"],
    }
    if not geometry["allow_empty"]:
        rules["empty"] = ~g["is_empty"]
    return found + [(f"geometry:{k}", F.when(g.isNull(), True).otherwise(F.coalesce(v, F.lit(False)))) for k, v in rules.items()]


def geometry_faults(geometry: dict | None, shape: dict[str, Any] | None) -> Iterator[str]:
    """The same checks on a geometry in hand: the names of those that it fails, in their order."""
    if geometry is None:
        return
    if shape is None:
        if not geometry["nullable"]:
            yield "not_null:geom"
        return
    wanted = {"type": ("gtype", geometry["type"]), "srid": ("srid", geometry["srid"]), "dimensions": ("zm", DIMENSIONS[geometry["dimensions"]]), "finite": ("finite", True), "valid": ("valid", True)}
    if not geometry["allow_empty"]:
        wanted["empty"] = ("is_empty", False)
    yield from (f"geometry:{k}" for k, (name, value) in wanted.items() if shape[name] != value)
