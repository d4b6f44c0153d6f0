import random
import struct

import pytest

from branchstone.functions.geometry import GeometryError, described, dump_points, ewkb, from_ewkb, geometry_checks, geometry_faults, in_box, make_point, ordinate, parse, point

GOOD = {
    "SRID=4326;POINT(1 2)": ("Point", 0), "SRID=2230;POINT Z(1 2 3)": ("Point", 2), "SRID=4326;POINT M (1 2 3)": ("Point", 1), "SRID=4326;POINTZM(1 2 3 4)": ("Point", 3), "SRID=4326;POINT(1 2 3)": ("Point", 2),
    "SRID=4326;POINT EMPTY": ("Point", 0), "SRID=4326;LINESTRING(0 0,1 1)": ("LineString", 0), "SRID=4326;POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))": ("Polygon", 0),
    "SRID=4326;MULTIPOINT((1 2),(3 4))": ("MultiPoint", 0), "SRID=4326;MULTIPOINT(1 2,3 4)": ("MultiPoint", 0), "SRID=4326;MULTILINESTRING((0 0,1 1),(2 2,3 3))": ("MultiLineString", 0), "SRID=4326;MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((2 2,3 2,3 3,2 2)))": ("MultiPolygon", 0),
}


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    d = described(text)
    assert (d["gtype"], d["zm"]) == GOOD[text] and d["valid"] and d["finite"] and d["is_empty"] == ("EMPTY" in text)


INVALID = ["POLYGON((0 0,1 1,1 0,0 1,0 0))", "POLYGON((0 0,1 0,1 1))", "POLYGON((0 0,4 0,4 4,0 4,0 0),(5 5,6 5,6 6,5 5))", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 1),(2 1.5,2.5 1.5,2.5 2,2 1.5))", "LINESTRING(1 1,1 1)", "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((1 1,2 1,2 2,1 1)))", "POINT(NaN 1)", "POINT(Infinity 1)"]


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    assert not described(f"SRID=4326;{text}")["valid"]


@pytest.mark.parametrize("text", ["POINT(1 2)", "SRID=4326;POINT(1)", "SRID=4326;POINT Z(1 2)", "SRID=4326;POINT((1 2))", "SRID=4326;POINT(1 2,3 4)", "SRID=4326;CIRCLE(1 2)", "SRID=4326;POLYGON(0 0,1 1)", "SRID=4326;LINESTRING(0 0,1 1 1)", "SRID=4326;POINT(a b)", "SRID=x;POINT(1 2)", "SRID=4326;POINT(1 2"])
def test_not_geometries(text):
    with pytest.raises(GeometryError):
        parse(text)
    assert described(text) is None


def test_bytes():
    assert ewkb(parse("SRID=4326;POINT(1 2)")) == struct.pack("<BIIdd", 1, 0x20000001, 4326, 1, 2)
    assert ewkb(parse("SRID=4326;POINT Z(1 2 3)"), big=True) == struct.pack(">BIIddd", 0, 0xA0000001, 4326, 1, 2, 3)
    assert ewkb(parse("SRID=1;MULTIPOINT((1 2))")) == struct.pack("<BIII", 1, 0x20000004, 1, 1) + struct.pack("<BIdd", 1, 1, 1, 2)


def test_columns(spark):
    from pyspark.sql import functions as F

    from branchstone.functions.geometry import from_ewkt

    rows = [(k, t) for k, t in enumerate([*GOOD, *[f"SRID=4326;{t}" for t in INVALID], "nothing", None, "SRID=0;POINT(1 2)"])]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("geom", from_ewkt(F.col("t")))
    got = {r.k: r.geom for r in df.collect()}
    assert all((got[k].asDict() if got[k].ewkb is not None else None) == (described(t) and {**described(t), "ewkb": bytearray(described(t)["ewkb"])}) for k, t in rows)
    policy = {"type": "Point", "srid": 4326, "dimensions": "XY", "nullable": True, "allow_empty": False, "require_valid": True}
    ok = [r.k for r in df.where(" ".join(["t is not null"])).where(F.col("geom.ewkb").isNotNull()).select("k", *[c.alias(n) for n, c in geometry_checks(policy)]).collect() if all(tuple(r)[1:])]
    assert ok == [0]
    assert [r.k for r in df.where(in_box("geom", 2, 2, 9, 9)).select("k").collect()] == [k for k, t in rows if (d := described(t)) and d["xmax"] is not None and d["xmax"] >= 2 and d["ymax"] >= 2]


def test_read_back():
    for text in GOOD:
        for big in (False, True):
            g = parse(text)
            assert from_ewkb(ewkb(g, big)) == g
    assert make_point(1, 2, 3, srid=4326) == parse("SRID=4326;POINT Z(1 2 3)") and make_point(1, 2, 3, srid=1, measured=True) == parse("SRID=1;POINT M(1 2 3)")
    raw = ewkb(parse("SRID=4326;POLYGON((0 0,4 0,4 4,0 0))"))
    for bad in (raw[:-1], raw + b"x", b"\x02" + raw[1:], b""):
        with pytest.raises(GeometryError):
            from_ewkb(bad)
    for bad in ("SRID=4326;POINT(1_0 2)", "SRID=99999999999;POINT(1 2)", "SRID=1;LINESTRING(0x1 2,3 4)"):
        assert described(bad) is None


def test_accessors(spark):
    from pyspark.sql import functions as F

    from branchstone.functions.geometry import from_ewkt

    rows = [(0, "SRID=4326;POINT ZM(1 2 3 4)"), (1, "SRID=4326;POINT M(1 2 3)"), (2, "SRID=4326;LINESTRING Z(0 0 1,2 3 4)"), (3, None), (4, "SRID=4326;POINT EMPTY")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("geom", from_ewkt(F.col("t")))
    got = {r.k: tuple(r)[1:] for r in df.where("t is not null").select("k", *[ordinate(F.col("geom"), c).alias(c) for c in "xyzm"]).collect()}
    assert got == {0: (1, 2, 3, 4), 1: (1, 2, None, 3), 2: (None,) * 4, 4: (None,) * 4}
    assert sorted(tuple(r) for r in dump_points(df.where("k = 2"), "geom", ["k"]).collect()) == [(2, 1, 0, 0, 1, None), (2, 2, 2, 3, 4, None)]
    made = spark.range(3).select(point(F.col("id"), F.col("id") / 4, 3857, F.lit(1e-9)).alias("g")).collect()
    assert [bytes(r.g.ewkb) for r in made] == [ewkb(make_point(k, k / 4, 1e-9, srid=3857)) for k in range(3)]


def test_points_at_once_are_as_one_by_one(spark):
    from pyspark.sql import functions as F

    from branchstone.functions.geometry import from_ewkt

    for form, extra in (("POINT(%r %r)", ""), ("POINT ZM(%r %r 1e300 -0.5)", ""), ("POINT(%r %r)", "SRID=1;POINT EMPTY")):
        draw = random.Random(form + extra)
        texts = [f"SRID={draw.randint(1, 9999)};" + form % (draw.uniform(-1e3, 1e3), draw.choice([draw.random(), float("nan"), float("inf")])) for _ in range(200)] + [extra] * bool(extra)
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).withColumn("geom", from_ewkt(F.col("t")))
        for r in df.collect():
            want = described(r.t)
            assert {**r.geom.asDict(), "ewkb": bytes(r.geom.ewkb)} == want, r.t


def test_checks_in_hand(spark):
    policy = {"type": "Point", "srid": 4326, "dimensions": "XY", "nullable": False, "allow_empty": False, "require_valid": True}
    assert list(geometry_faults(policy, None)) == ["not_null:geom"] and list(geometry_faults(None, None)) == []
    assert list(geometry_faults(policy, described("SRID=1;POINT Z EMPTY"))) == ["geometry:srid", "geometry:dimensions", "geometry:empty"]
    assert list(geometry_faults(policy, described("SRID=4326;POINT(1 2)"))) == []


TOUCHING = {
    "POLYGON((0 0,2 2,4 0,4 4,2 2,0 4,0 0))": False, "POLYGON((0 0,4 0,2 2,4 4,0 4,2 2,0 0))": False, "POLYGON((0 0,6 0,3 3,6 6,0 6,3 3,0 0))": False, "POLYGON((0 0,10 0,10 10,0 10,0 0),(0 5,5 0,10 5,5 10,0 5))": False,
    "POLYGON((0 0,4 0,4 4,0 4,0 0,1 2,2 1,0 0))": True, "POLYGON((0 0,10 0,10 10,0 10,0 0),(0 5,5 4,5 6,0 5))": True, "POLYGON((0 0,10 0,10 10,0 10,0 0),(1 1,5 5,1 5,1 1),(5 5,9 9,9 5,5 5))": True, "POLYGON((0 0,10 0,10 10,0 10,0 0),(0 5,5 4,5 6,0 5),(5 4,10 5,5 6,5 4))": False,
    "MULTIPOLYGON(((0 0,2 0,2 2,0 0)),((2 2,4 2,4 4,2 2)))": True, "MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0)),((2 0,4 0,4 2,2 2,2 0)))": False, "MULTIPOLYGON(((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1)),((2 2,3 2,3 3,2 2)))": True,
}


def test_touching_rings():
    for text, ok in TOUCHING.items():
        assert described(f"SRID=4326;{text}")["valid"] is ok, text


def test_validity_against_the_jvms_topology_suite(spark):
    """Random polygons on a small grid, where rings touch, cross and run along one another all the time."""
    jvm = spark.sparkContext._jvm
    reader = jvm.org.locationtech.jts.io.WKTReader()
    draw, seen = random.Random(77), {True: 0, False: 0}

    def oracle(text):
        op = jvm.org.locationtech.jts.operation.valid.IsValidOp(reader.read(text))
        op.setSelfTouchingRingFormingHoleValid(True)
        return op.isValid()

    def ring(low, high, n):
        p = [(draw.randint(low, high), draw.randint(low, high)) for _ in range(n)]
        if draw.random() < 0.7:  # by angle about the middle, so that many do not cross
            import math

            p.sort(key=lambda q: math.atan2(q[1] - (low + high) / 2 - 0.1, q[0] - (low + high) / 2 - 0.2))
        return "(" + ",".join(f"{x} {y}" for x, y in [*p, p[0]]) + ")"

    for k in range(2500):
        if k % 3 == 0:
            text = f"POLYGON({ring(0, 4, draw.randint(3, 8))})"
        elif k % 3 == 1:
            text = "POLYGON((0 0,6 0,6 6,0 6,0 0)" + "".join("," + ring(0, 6, draw.randint(3, 5)) for _ in range(draw.randint(1, 3))) + ")"
        else:
            text = "MULTIPOLYGON(" + ",".join(f"({ring(a, a + 4, draw.randint(3, 5))})" for a in draw.choice([(0, 4), (0, 3), (0, 4, 8)])) + ")"
        try:
            want = oracle(text)
        except Exception:  # rings that the suite does not read
            continue
        assert described(f"SRID=4326;{text}")["valid"] == want, (text, want)
        seen[want] += 1
    assert min(seen.values()) > 150
