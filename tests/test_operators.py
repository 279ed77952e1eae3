import pytest
from pyspark.sql import functions as F

from meridia.functions.names import catalogue
from meridia.operators import temporal, validate
from meridia.operators.region import GridSpec, contains, fill_grid, mask_polygon, translate
from meridia.plans.layout import to_wide
from meridia.sources.layers import read_layers, write_layers
from meridia.streaming import climatology as stream

GRID = GridSpec(10, 10, 0, 10, 0, 10)


def layers(spark, n):
    """Layer l of cell c holds (l - 1) * 100 + c."""
    return spark.range(1, 101).withColumnRenamed("id", "cell").select("cell", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("layer")).withColumn("value", ((F.col("layer") - 1) * 100 + F.col("cell")).cast("double"))


def test_average_and_sum(spark):
    index = [i // 3 + 1 for i in range(12)]
    avg = temporal.average(layers(spark, 12), index, n_layers=12)
    assert avg.columns == ["cell", "avg_unit_01", "avg_unit_02", "avg_unit_03", "avg_unit_04"]
    total = temporal.total(layers(spark, 12), index, n_layers=12, prefix="s")
    for r in avg.join(total, "cell").collect():
        for g in range(1, 5):
            assert r[f"avg_unit_{g:02d}"] == (3 * g - 2) * 100 + r["cell"]
            assert r[f"s_{g:02d}"] == 3 * r[f"avg_unit_{g:02d}"]
    with pytest.raises(ValueError, match="Length of 'index'"):
        temporal.average(layers(spark, 12), index[:5], n_layers=12)


def test_roll(spark):
    rows = temporal.roll(layers(spark, 36), 2, n_layers=36).collect()
    assert len(rows) == 100 * 12 * 2
    assert all(r["value"] == ((r["start"] - 1) * 12 + r["unit"] - 1) * 100 + r["cell"] + 600 for r in rows)
    cols = temporal.roll_layers(temporal.roll(layers(spark, 36), 2, n_layers=36), 2, n_layers=36).columns
    assert "output_w1-2_u01" in cols and len(cols) == 25
    assert temporal.roll_name(temporal.DEFAULT_NAME, "output", 1, 1, list(range(1, 21)), 20, 12) == "output_w01-20_u01"
    assert temporal.roll_name("run_{prefix}_window_{start_window}_month_{idx_unit}", "test_run", 1, 1, [1, 2], 2, 12) == "run_test_run_window_1_month_01"
    for kwargs, text in (({}, "'window_size' is required"), ({"window_size": 4, "n_layers": 36}, "cannot be larger than total cycles"), ({"window_size": 2, "n_layers": 35}, "is not divisible by frequency")):
        with pytest.raises(ValueError, match=text):
            temporal.roll(layers(spark, 36), **({"n_layers": 36} | kwargs))
    whole = temporal.roll(layers(spark, 36), 3, n_layers=36).groupBy("unit").agg(F.sum("value").alias("a"))
    plain = temporal.average(layers(spark, 36), [i % 12 + 1 for i in range(36)], n_layers=36)
    assert {r["unit"]: r["a"] for r in whole.collect()} == {u: plain.agg(F.sum(f"avg_unit_{u:02d}")).first()[0] for u in range(1, 13)}


def test_region(spark):
    cells = GRID.cells(spark)
    square = [(2.0, 2.0), (5.0, 2.0), (5.0, 5.0), (2.0, 5.0)]
    got = {r["cell"] for r in mask_polygon(cells, GRID, square).collect()}
    assert got == {(10 - y - 1) * 10 + x + 1 for x in (2, 3, 4) for y in (2, 3, 4)}
    hole = [(3.0, 3.0), (4.0, 3.0), (4.0, 4.0), (3.0, 4.0)]
    assert mask_polygon(cells, GRID, [square, hole]).count() == 8
    assert mask_polygon(cells, GRID, [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]).count() == 100
    with pytest.raises(ValueError, match="does not overlap with the input rasters"):
        mask_polygon(cells, GRID, [(100.0, 100.0), (101.0, 100.0), (101.0, 101.0)])
    with pytest.raises(TypeError):
        mask_polygon(cells, GRID, [(0.0, 0.0), (1.0, 1.0)])
    with pytest.raises(ValueError, match="reproject"):
        mask_polygon(cells, GRID, square, crs="EPSG:3857")
    assert spark.range(1).select(contains(square, F.lit(3.0), F.lit(3.0)), contains(square, F.lit(6.0), F.lit(3.0))).first() == (True, False)
    filled = fill_grid(cells.where("cell < 4").withColumn("v", F.lit(1.0)), GRID)
    assert filled.count() == 100 and filled.where("v is null").count() == 97
    t = cells.select("cell", translate(F.col("cell"), GRID, GridSpec(3, 4, 0, 4, 0, 3), 2, 3).alias("t")).where("t is not null").collect()
    assert {r["cell"]: r["t"] for r in t} == {(r + 2) * 10 + c + 4: r * 4 + c + 1 for r in range(3) for c in range(4)}


def test_validate(spark):
    assert validate.geometry_report({"a": GRID, "b": GRID, "c": GridSpec(10, 5, 0, 10, 0, 10)}) == {"c": ["ncols"]}
    rows = [(1, 1.0, 1.0, 1.0, 1.0), (2, None, None, 1.0, 1.0), (3, None, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "cell long, x_01 double, x_02 double, y_01 double, y_02 double")
    assert [tuple(r) for r in validate.missing_codes(df, ["x", "y"], 2).orderBy("cell").collect()] == [(1, 2, 2, 0), (2, 0, 2, 2), (3, 1, 1, 0)]
    assert tuple(validate.missing_report(df, ["x", "y"], 2).first()) == (3, 2, 1, False)
    a, b = spark.range(3).selectExpr("id as cell", "1 as unit"), spark.range(1, 4).selectExpr("id as cell", "1 as unit")
    assert {tuple(r) for r in validate.key_differences(a, b).collect()} == {(0, 1, "first"), (3, 1, "second")}


def test_files(spark, tmp_path):
    paths = []
    for i in (1, 2):
        spark.createDataFrame([(1, float(i)), (2, None)], "cell long, value double").write.parquet(f"{tmp_path}/l{i}")
        paths.append(f"{tmp_path}/l{i}")
    long = read_layers(spark, paths, 2)
    with pytest.raises(ValueError, match="one file per layer"):
        read_layers(spark, paths, 3)
    wide = to_wide(long, ["value"], 2)
    assert {tuple(r) for r in wide.collect()} == {(1, 1.0, 2.0), (2, None, None)}
    write_layers(wide, f"{tmp_path}/out", by_layer=True)
    with pytest.raises(FileExistsError, match="Output files already exist"):
        write_layers(wide, f"{tmp_path}/out", by_layer=True)
    assert len(write_layers(wide, f"{tmp_path}/out", by_layer=True, overwrite=True)) == 2
    assert spark.read.parquet(f"{tmp_path}/out/value_02").count() == 2


def test_catalogue(spark):
    rows = {r["variable"]: r for r in catalogue(spark).collect()}
    assert len(rows) == 35 and rows["bio03"]["computed_from"] == "bio02,bio05,bio06,bio07" and rows["bio24"]["inputs"] == "prcp,srad"
    with pytest.raises(ValueError):
        catalogue(spark, [0])


def test_streaming_equals_batch(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    unit, value = F.hour("ts") + 1, F.col("value")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data)
    q = stream.keep(stream.climatology(rows, unit, value, cell="user_id"), "climatology").start()
    try:
        q.processAllAvailable()
        got = {tuple(r)[:3] for r in spark.table("climatology").collect()}
    finally:
        q.stop()
    batch = stream.climatology(spark.read.parquet(f"{data}/events.parquet"), unit, value, cell="user_id")
    assert got == {tuple(r)[:3] for r in batch.collect()}
