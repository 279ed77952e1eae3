"""Hand-computed values of three cells: seasonal, constant, and with a missing month."""

import pytest
from pyspark.sql import functions as F

from meridia.operators import bioclim, statistics
from meridia.plans.layout import from_cube, to_cube
from meridia.plans.series import Long, Wide, n_periods

A = {
    "tmin": [1, 2, 4, 7, 11, 15, 17, 16, 13, 9, 5, 2],
    "tmax": [8, 10, 13, 17, 21, 26, 29, 28, 24, 18, 12, 9],
    "prcp": [80, 70, 60, 40, 30, 10, 5, 10, 25, 50, 75, 90],
    "srad": [100, 130, 170, 210, 250, 280, 290, 260, 210, 160, 110, 90],
    "mois": [80, 75, 65, 50, 35, 20, 15, 20, 30, 50, 70, 85],
}
B = {"tmin": [10] * 12, "tmax": [10] * 12, "prcp": [0] * 12, "srad": [200] * 12, "mois": [50] * 12}
CIRCULAR = {
    1: 13.208333, 2: 9.416667, 3: 33.630952, 4: 670.975658, 5: 29, 6: 1, 7: 28, 8: 6.166667, 9: 21.833333, 10: 21.833333, 11: 5.333333, 12: 545, 13: 90, 14: 5, 15: 64.051306,
    16: 245, 17: 25, 18: 25, 19: 240, 20: 188.333333, 21: 290, 22: 90, 23: 37.942267, 24: 100, 25: 276.666667, 26: 276.666667, 27: 106.666667, 28: 49.583333, 29: 85, 30: 15,
    31: 2526.750818, 32: 80, 33: 18.333333, 34: 18.333333, 35: 80,
}
OPEN = CIRCULAR | {8: 9.166667, 11: 6.333333, 16: 215, 17: 25, 18: 25, 19: 210, 24: 120, 27: 133.333333, 32: 73.333333, 35: 73.333333}
CONSTANT = {b: 0 for b in (2, 3, 4, 7, 12, 13, 14, 15, 16, 17, 18, 19, 23, 31)} | {b: 10 for b in (1, 5, 6, 8, 9, 10, 11)} | {b: 200 for b in (20, 21, 22, 24, 25, 26, 27)} | {b: 50 for b in (28, 29, 30, 32, 33, 34, 35)}


def cube(spark, *cells):
    names = list(A)
    rows = [(i, *[[None if x is None else float(x) for x in c[v]] for v in names]) for i, c in enumerate(cells, 1)]
    return spark.createDataFrame(rows, "cell long, " + ", ".join(f"{v} array<double>" for v in names))


def wide(spark, *cells):
    return from_cube(cube(spark, *cells), list(A), 12)


def check(row, expected):
    for b, v in expected.items():
        assert row[f"bio{b:02d}"] == pytest.approx(v, abs=1e-5), b


@pytest.mark.parametrize("arrays", [False, True])
def test_goldens(spark, monkeypatch, arrays):
    if arrays:
        monkeypatch.setattr(bioclim, "MAX_WIDE", 0)
    df = cube(spark, A, B) if arrays else wide(spark, A, B)
    a, b = bioclim.derive(df).orderBy("cell").collect()
    check(a, CIRCULAR)
    check(b, CONSTANT)
    check(bioclim.derive(df, circular=False).orderBy("cell").first(), OPEN)


C = A | {"prcp": [*A["prcp"][:3], None, *A["prcp"][4:]]}


@pytest.mark.parametrize("arrays", [False, True])
def test_missing_month(spark, arrays):
    df = cube(spark, C) if arrays else wide(spark, C)

    def of(policy):
        s = Long("prcp", 12, policy) if arrays else Wide([f"prcp_{i:02d}" for i in range(1, 13)], policy)
        w = s.periods(3, True, "sum")
        w = w if arrays else f"array({', '.join(w)})"
        return df.selectExpr(f"{s.sum()} AS sum", f"{s.mean()} AS mean", f"{s.sd(f'({s.mean()})')} AS sd", f"{w} AS w").first()

    skip, strict = of("skip"), of("strict")
    assert (skip["sum"], skip["mean"], skip["sd"]) == (505, pytest.approx(45.909091, abs=1e-5), pytest.approx(31.130225, abs=1e-5))
    assert skip["w"] == [210, 130, 90, 40, 45, 25, 40, 85, 150, 215, 245, 240]
    assert (strict["sum"], strict["mean"], strict["sd"]) == (None, None, None)
    assert strict["w"] == [210, None, None, None, 45, 25, 40, 85, 150, 215, 245, 240]


def test_spread_and_cv(spark):
    df = wide(spark, A)
    one = lambda **k: statistics.derive(df, "prcp", stats=["stdev"], **k).first()["var_stdev"]
    assert one() == pytest.approx(29.730481, abs=1e-5) and one(ddof=0) == pytest.approx(28.464769, abs=1e-5)
    low = spark.createDataFrame([(1, -5.0, -3.0, 0.0, 2.0)], "cell long, prcp_01 double, prcp_02 double, prcp_03 double, prcp_04 double")
    assert bioclim.derive(low, 4, [15]).first()["bio15"] == 0
    assert statistics.derive(low, "prcp", 4, ["cv_cli"]).first()["var_cv"] == pytest.approx(-621.825270, abs=1e-5)


def test_index_outside_is_null(spark):
    df = wide(spark, A, A, A, A, A).withColumn("warmest_unit", F.expr("case cell when 1 then 7 when 2 then 0 when 3 then 13 when 4 then -1 end"))
    got = [r["bio05"] for r in bioclim.derive(df, bios=[5]).orderBy("cell").collect()]
    assert got == [29, None, None, None, None]


def test_requirements(spark):
    df = wide(spark, A)
    only = lambda *vs: df.select("cell", *[c for c in df.columns if c.split("_")[0] in vs])
    with pytest.raises(ValueError, match="missing input: prcp"):
        bioclim.derive(only("tmin", "tmax"), bios=[8])
    with pytest.raises(ValueError, match="between 1 and 35"):
        bioclim.derive(df, bios=[36])
    assert bioclim.derive(only("tmax"), bios=[5]).columns == ["cell", "bio05"]
    tavg = only("tmin").select("cell", *[F.col(f"tmin_{i:02d}").alias(f"tavg_{i:02d}") for i in range(1, 13)])
    assert bioclim.derive(tavg, bios=[11, 1, 4, 10]).columns == ["cell", "bio01", "bio04", "bio10", "bio11"]
    assert bioclim.derive(only("srad").withColumn("wettest_period", F.lit(11)), bios=[24]).first()["bio24"] == 100
    assert bioclim.needs([3]) == {"tmin", "tmax"} and bioclim.closure([3]) == {2, 3, 5, 6, 7}
    for bad in (0, 13):
        with pytest.raises(ValueError):
            n_periods(12, bad, True)
    with pytest.raises(ValueError, match="unknown stats"):
        statistics.derive(df, "prcp", stats=["mode"])
    with pytest.raises(ValueError, match="unknown inter_stats"):
        statistics.derive(df, "prcp", inter_stats=["mode"])
    with pytest.raises(ValueError, match="no statistic"):
        statistics.derive(df, "prcp", stats=None)


def test_properties(spark):
    shift = {v: x[5:] + x[:5] for v, x in A.items()}
    a, b = bioclim.derive(wide(spark, A, shift)).drop("cell").collect()
    assert [pytest.approx(x) for x in a] == list(b)
    assert a["bio07"] == a["bio05"] - a["bio06"] and a["bio17"] <= a["bio18"] <= a["bio16"] and a["bio11"] <= a["bio08"] <= a["bio10"]
    own = bioclim.derive(wide(spark, A).withColumn("wettest_period", F.lit(11)).withColumn("coldest_period", F.lit(12))).drop("cell").first()
    assert own == a


def test_nan_is_missing_and_arrays_are_checked(spark):
    nan = A | {"prcp": [float("nan"), *A["prcp"][1:]]}
    assert bioclim.derive(wide(spark, nan), bios=[12]).first()["bio12"] == 465
    short = A | {"prcp": A["prcp"][:11]}
    with pytest.raises(Exception, match="must hold 12 units"):
        wide(spark, short).collect()
    back = to_cube(wide(spark, A), list(A), 12).first()
    assert back["prcp"] == A["prcp"]


def test_plan_is_one_shuffle(spark, data):
    from meridia.workloads import c12

    plan = bioclim.derive(c12(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    narrow = bioclim.derive(c12(spark, data, ["prcp"]), bios=[12])._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in narrow and "l_extendedprice" not in narrow


@pytest.mark.parametrize("arrays", [False, True])
def test_ties_up_to_rounding_take_the_first_period(spark, monkeypatch, arrays):
    """0.3 + 0.2 + 0.1 is less than 0.2 + 0.1 + 0.3 in doubles; large magnitudes elsewhere must not make ties."""
    tie, inf = [0.3, 0.2, 0.1, 0.3, 0.0, 0.0, 0.0, 0.0], float("inf")
    inter = [tie, [-x for x in tie], [1e15, 5.01, 5.0, 5.0, 5.0, 5.0, 5.02, 5.0], [1.0, 1.0, 1.0, -inf, 1.0, 1.0, 1.0, 1.0], [None, 2.0, None, None, 1e-9, 0.0, None, 1.0]]
    df = spark.createDataFrame([(i, [float(u) for u in range(1, 9)], x) for i, x in enumerate(inter, 1)], "cell long, own array<double>, rank array<double>")
    if arrays:
        monkeypatch.setattr(statistics, "MAX_WIDE", 0)
    else:
        df = from_cube(df, ["own", "rank"], 8)

    def of(policy):
        got = statistics.derive(df, "own", 8, None, inter_variable="rank", inter_stats=statistics.INTER_STATS, circular=False, na_policy=policy)
        return [tuple(r)[1:] for r in got.orderBy("cell").collect()]

    assert of("skip") == [(2, 6), (6, 2), (2, 4), (2, 3), (2, 4)]
    assert of("strict") == [(2, 6), (6, 2), (2, 4), (2, 3), (None, None)]


def test_ties_of_event_totals(spark, tmp_path):
    from meridia.workloads import QUERIES

    rows = [(0, 0.1), (0, 0.2), (1, 0.2), (2, 0.1), (3, 0.0), (4, 0.3)]  # 0.6 in the hours 0 to 3 and in the hours 1 to 4
    for turn in (1, -1):
        made = spark.createDataFrame(rows[::turn], "h int, value double").selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) AS ts", "7L AS user_id", "value")
        made.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        row = QUERIES["stat_events_skip"](spark, str(tmp_path)).first()
        assert row["level_inter_high"] == pytest.approx(0.1125, abs=1e-9)
