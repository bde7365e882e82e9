"""Equality of JSON values against Python's own JSON with sorted keys."""

import json
import random

from pyspark.sql import functions as F

from mullion.functions.json_values import canonical_json, is_json, same_json, with_repeated_keys
from mullion.plans.json_values import ORACLES, QUERIES
from tests.compare import both


def plain(text):
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    return json.dumps(value, sort_keys=True)


def is_valid(x):
    try:
        json.loads(x)
    except ValueError:
        return False
    return True


def made(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    space = " " * rng.randrange(2)
    if kind < 6:
        return rng.choice(["1", "1.0", "1.00", "10e-1", "-0", "0", "-0.0", "1e400", "Infinity", "-Infinity", "NaN", "12345678901234567890123", "true", "false", "null", '"1"', '"i1"', '"\\u0061"', '"a"', '"\\"x\\": 1"', '"{1: 2}"', '"\\\\"', '"é😀"', '"\\n"', '""'])
    if kind == 6:
        return f"[{space}{','.join(made(rng, depth - 1) for _ in range(rng.randrange(4)))}{space}]"
    parts = [f'"{rng.choice("abc1")}"{space}:{space}{made(rng, depth - 1)}' for _ in range(rng.randrange(4))]
    return "{" + ",".join(parts) + space + "}"


BAD = ["", " ", "{1: 2}", "{NaN: 1}", '{"a" 1}', "[1,]", "01", "1.", "-", "--1", "1 2", "tru", "truefalse", '"a', 'a"', "[1", "[1}", "'a'", ".5", "1e", "{-1.5e3 : 2}", '"a"1', "true1", "[1 2]", "+1", '1,"k":2', '1,"e":1,"v":2', "1}", '1},"e":1}', '1,"e":1}', "1, 2", "1]", "Infinity1", "Nan"]


def test_equals_pythons_json(spark):
    own = with_repeated_keys(spark)
    rng = random.Random(3)
    texts = [*BAD, *(made(rng, 3) for _ in range(400))]
    got = own.createDataFrame([(x,) for x in texts], "x string").select("x", canonical_json(F.col("x")).alias("c"), is_json(F.col("x")).alias("ok")).collect()
    assert [r.x for r in got] == texts
    assert [r.ok for r in got] == [is_valid(x) for x in texts]
    ours, theirs = {}, {}
    for x, c, _ in got:
        ours.setdefault(c, set()).add(x)
        theirs.setdefault(plain(x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_nulls_long_texts_and_repeated_keys(spark):
    long = json.dumps({"k": ["x\\" * 50_000, *range(20_000)], "a": 1})
    turned = json.dumps(dict(reversed(json.loads(long).items())), indent=1)
    rows = [(None, "1"), ("1", None), (long, turned), (long, turned.replace("19999", "19998")), ('{"a":1,"a":2}', '{"a":2}')]
    same = [r.s for r in with_repeated_keys(spark).createDataFrame(rows, "l string, r string").select(same_json(F.col("l"), F.col("r")).alias("s")).collect()]
    assert same == [None, None, True, False, True]
    assert [r.s for r in spark.createDataFrame(rows[4:], "l string, r string").select(same_json(F.col("l"), F.col("r")).alias("s")).collect()] == [False]


def test_query_stays_out_of_python(spark):
    plan = QUERIES["q_json_same"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_query_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.001", QUERIES["q_json_same"], ORACLES["q_json_same"])
    assert ours == theirs and {r[3] for r in ours} == {True, False}
