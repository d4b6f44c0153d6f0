from pyspark.sql import functions as F

from branchstone.functions.typed import gate, gate_rows
from branchstone.operators import checks, identity, measure
from branchstone.plans.definition import DefinitionError, Field
from branchstone.queries import SAMPLES


def test_gate_agrees_with_literals(spark):
    for kind, texts in SAMPLES.items():
        field = {"name": "x", "type": kind, "nullable": True, "precision": 12, "scale": 2}
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        got = {r.k: (r.ok, r.value) for r in df.select("k", gate(F.col("t"), field)["ok"].alias("ok"), gate(F.col("t"), field)["value"].cast("string").alias("value")).collect()}
        for k, t in enumerate(texts):
            try:
                Field.of({"name": "x", **field}).value(int(t) if kind == "int32" and t and t.lstrip("-").isdigit() and str(int(t)) == t else t)
                ok = True
            except DefinitionError:
                ok = False
            assert got[k][0] == ok, (kind, t)
            assert (got[k][1] is not None) == (ok and t is not None)


def test_gate_rows(spark):
    definition = {"fields": [{"name": "a", "type": "int32", "nullable": False}, {"name": "b", "type": "string", "nullable": True, "max_length": 2}]}
    df = spark.createDataFrame([("1", "é😀", 7), ("x", "abc", 8), (None, None, 9)], "a string, b string, other int")
    got = [tuple(r) for r in gate_rows(df, definition).orderBy("other").collect()]
    assert got == [(7, 1, "é😀", []), (8, None, None, ["a", "b"]), (9, None, None, ["a"])]
    assert "Python" not in gate_rows(df, definition)._jdf.queryExecution().executedPlan().toString()


def test_checks(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None), (4, 1)], "id int, p int")
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.id for r in checks.orphans(child, "p", parent, "k").collect()] == [2]
    assert [tuple(r) for r in checks.duplicates(child, ["p"]).collect()] == [(1, 2)]
    assert [r.k for r in checks.referenced(parent, "k", child, "p").collect()] == [1]
    assert (checks.bounded_count(child, 2), checks.bounded_count(child, 9)) == (3, 4)


def test_allocation_follows_positions(spark):
    batch = spark.range(0, 20000).selectExpr("id as fid", "40000 - 2 * id as position").repartition(5)
    known = spark.range(0, 20000, 3).selectExpr("id as fid", "id as object_id")
    got = identity.allocate(batch, known, "fid", "position", 100).orderBy("object_id").collect()
    want = [f for f in range(19999, -1, -1) if f % 3]
    assert [r.fid for r in got] == want and [r.object_id for r in got] == list(range(101, 101 + len(want)))


def test_measures(spark):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, "é"), ("c", None, "x")], "fid string, n int, s string")
    one = measure.measure(df, "fid", "h").first()
    again = measure.measure(df.repartition(3).select("s", "fid", "n"), "fid", "h").first()
    assert one == again and one.row_count == 3
    assert one.row_bytes == sum(len(t.encode()) for t in ('{"fid":"b","n":"1","s":null}', '{"fid":"a","n":"2","s":"é"}', '{"fid":"c","n":null,"s":"x"}'))
    assert measure.measure(df.where("n = 1"), "fid", "h").first().rows_sha256 != one.rows_sha256
    assert measure.measure(df, "fid", "g").first().rows_sha256 != one.rows_sha256
    assert measure.measure(df.where("false"), "fid", "h").first().rows_sha256 == measure.empty_digest("h")
    tree = measure.measure_tree(df, "fid", "h", digits=1).first()
    assert (tree.row_count, tree.row_bytes) == (3, one.row_bytes) and tree == measure.measure_tree(df.repartition(2), "fid", "h", digits=1).first()
    assert measure.same(measure.measure(df, "fid", "h"), measure.measure(df, "fid", "h")).first().intact
