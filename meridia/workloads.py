"""Queries over the star-schema tables, each with its SQL.

Cells and units come from facts: C12 is supplier by month of shipping, SER nation by month of
seven years (84 layers), EVT user by hour of the day. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import catalogue
from .operators import bioclim, region, statistics, temporal, validate
from .operators.region import GridSpec
from .plans.layout import VARIABLES, from_cube, to_cube, to_long, to_wide, unit_name
from .sources import layers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The years of shipping in the tables.
FIRST_YEAR, LAST_YEAR = 1995, 2001
LAYERS = (LAST_YEAR - FIRST_YEAR + 1) * 12
GRID_COLS = 10
#: Moves means that end in exactly half a unit of the last digit off the rounding edge, in both engines.
ASIDE = 1e-9


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"round(`{c}` + {ASIDE}, 6) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


# ---- cubes -----------------------------------------------------------------------------------

FACTS = {
    "prcp": ("sum({})", "l_quantity"),
    "tmin": ("min({}) / 1000", "l_extendedprice"),
    "tmax": ("max({}) / 1000", "l_extendedprice"),
    "tavg": ("avg({}) / 1000", "l_extendedprice"),
    "srad": ("avg({}) * 100", "l_discount"),
    "mois": ("avg({}) * 100", "l_tax"),
}
FACTS_SQL = """sum(l_quantity) AS prcp, min(l_extendedprice) / 1000 AS tmin, max(l_extendedprice) / 1000 AS tmax,
  avg(l_extendedprice) / 1000 AS tavg, avg(l_discount) * 100 AS srad, avg(l_tax) * 100 AS mois"""


def c12(spark: SparkSession, sf_dir: str, variables=VARIABLES) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.month("l_shipdate").alias("unit"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return to_wide(facts, {v: FACTS[v] for v in variables}, 12)


C12_SQL = f"SELECT l_suppkey AS cell, month(l_shipdate) AS unit, {FACTS_SQL} FROM lineitem GROUP BY 1, 2"


def ser(spark: SparkSession, sf_dir: str, variables=VARIABLES) -> DataFrame:
    """LONG: (cell, layer, variables) of nation by month."""
    lines = table(spark, sf_dir, "lineitem")
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell"))
    layer = ((F.year("l_shipdate") - FIRST_YEAR) * 12 + F.month("l_shipdate")).alias("layer")
    return lines.join(nations, lines["l_suppkey"] == nations["s_suppkey"]).groupBy("cell", layer).agg(*[F.expr(FACTS[v][0].format(FACTS[v][1])).alias(v) for v in variables])


SER_SQL = f"""SELECT s_nationkey AS cell, (year(l_shipdate) - {FIRST_YEAR}) * 12 + month(l_shipdate) AS layer, {FACTS_SQL}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""

EVT_FACTS = {"total": ("sum({})", "value"), "level": ("avg({})", "value")}


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), (F.hour("ts") + 1).alias("unit"), "value")
    return to_wide(rows, EVT_FACTS, 24)


EVT_SQL = "SELECT user_id AS cell, hour(ts) + 1 AS unit, sum(value) AS total, avg(value) AS level FROM events GROUP BY 1, 2"


# ---- SQL of the operators ----------------------------------------------------------------------


def grid_sql(source: str, n: int, variables) -> str:
    """Common table expressions src, cells and grid (a row for each cell and unit)."""
    cols = ", ".join(f"s.{v}" for v in variables)
    return f"""src AS ({source}), cells AS (SELECT DISTINCT cell FROM src),
grid AS (SELECT c.cell, u.unit, {cols} FROM cells c CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS unit) u LEFT JOIN src s ON s.cell = c.cell AND s.unit = u.unit)"""


def window_sql(n: int, length: int, circular: bool, policy: str, stats: dict[str, str], name: str = "win") -> str:
    k = n if circular else n - length + 1
    near = f"(g.unit - s.p + {n}) % {n} < {length}" if circular else f"g.unit BETWEEN s.p AND s.p + {length - 1}"
    full = (lambda v: f"CASE WHEN count(g.{v}) = {length} THEN sum(g.{v}) END") if policy == "strict" else (lambda v: f"sum(g.{v})")
    cols = ", ".join(f"{full(v)}{f' / {length}' if stat == 'mean' else ''} AS w_{v}" for v, stat in stats.items())
    return f"{name} AS (SELECT g.cell, s.p, {cols} FROM grid g JOIN (SELECT unnest(range(1, {k + 1})) AS p) s ON {near} GROUP BY 1, 2)"


def agg_sql(fold: str, v: str, n: int, policy: str) -> str:
    return f"CASE WHEN count({v}) = {n} THEN {fold}({v}) END" if policy == "strict" else f"{fold}({v})"


def bioclim_sql(source: str, bios=range(1, 36), n: int = 12, length: int = 3, circular: bool = True, policy: str = "skip", static: dict[str, str] | None = None) -> str:
    static = static or {}
    fold = lambda f, v: agg_sql(f, v, n, policy)
    unit = lambda index, f, v: f"max(CASE WHEN unit = {static[index]} THEN {v} END)" if index in static else fold(f, v)
    k = n if circular else n - length + 1
    ends = ", ".join(f"{agg_sql(side, f'w_{v}', k, policy)} AS {side}_{v}" for v in ("prcp", "tavg", "mois") for side in ("max", "min"))
    index = lambda name, v, side: f"max({static[name]})" if name in static else f"min(CASE WHEN w.w_{v} = e.{side}_{v} THEN w.p END)"
    picks = {name: index(name, v, side) for name, (v, side) in bioclim.PICKS.items()}
    idx = ", ".join(f"{sql.replace('cell', 'w.cell') if name in static else sql} AS {name}" for name, sql in picks.items())
    chosen = {b: (r.var, r.pick) for b, r in bioclim.RULES.items() if r.kind == "period"}
    per = ", ".join(f"max(CASE WHEN w.p = i.{pick} THEN w.w_{v} END) AS bio{b:02d}" for b, (v, pick) in chosen.items())
    cv = lambda v: f"CASE WHEN sd_{v} IS NULL THEN NULL WHEN 1 + m_{v} <= 0 THEN 0 ELSE 100 * sd_{v} / (1 + m_{v}) END"
    final = {
        1: "m_tavg", 2: "m_range", 4: "100 * sd_tavg", 5: "b5", 6: "b6", 7: "b5 - b6", 3: "CASE WHEN b5 - b6 = 0 THEN 0 ELSE 100 * m_range / (b5 - b6) END",
        12: "s_prcp", 13: "b13", 14: "b14", 15: cv("prcp"), 20: "m_srad", 21: "b21", 22: "b22", 23: cv("srad"), 28: "m_mois", 29: "b29", 30: "b30", 31: "100 * sd_mois",
    }
    out = ", ".join(f"round({final.get(b, f'bio{b:02d}')} + {ASIDE}, 6) AS bio{b:02d}" for b in sorted(bios))
    return f"""WITH {grid_sql(source, n, VARIABLES)},
{window_sql(n, length, circular, policy, bioclim.PERIOD_STAT)},
ends AS (SELECT cell, {ends} FROM win GROUP BY 1),
idx AS (SELECT w.cell, {idx} FROM win w JOIN ends e ON w.cell = e.cell GROUP BY 1),
per AS (SELECT w.cell, {per} FROM win w JOIN idx i ON w.cell = i.cell GROUP BY 1),
agg AS (SELECT cell, {fold('avg', 'tavg')} AS m_tavg, {fold('stddev_samp', 'tavg')} AS sd_tavg, {fold('avg', '(tmax - tmin)')} AS m_range,
  {unit('warmest_unit', 'max', 'tmax')} AS b5, {unit('coldest_unit', 'min', 'tmin')} AS b6, {fold('sum', 'prcp')} AS s_prcp,
  {unit('wettest_unit', 'max', 'prcp')} AS b13, {unit('driest_unit', 'min', 'prcp')} AS b14, {fold('avg', 'prcp')} AS m_prcp, {fold('stddev_samp', 'prcp')} AS sd_prcp,
  {fold('avg', 'srad')} AS m_srad, {fold('stddev_samp', 'srad')} AS sd_srad, {unit('high_rad_unit', 'max', 'srad')} AS b21, {unit('low_rad_unit', 'min', 'srad')} AS b22,
  {fold('avg', 'mois')} AS m_mois, {fold('stddev_samp', 'mois')} AS sd_mois, {unit('high_mois_unit', 'max', 'mois')} AS b29, {unit('low_mois_unit', 'min', 'mois')} AS b30
  FROM grid GROUP BY 1)
SELECT agg.cell, {out} FROM agg JOIN per ON agg.cell = per.cell"""


def bio_query(name: str, bios=range(1, 36), static: dict[str, str] | None = None, **how) -> None:
    bios = list(bios)

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        need = bioclim.needs(bios, static or ()) & set(VARIABLES)
        cube = c12(spark, sf_dir, [v for v in VARIABLES if v in need])
        cube = cube.withColumns({i: F.expr(e).cast("int") for i, e in (static or {}).items()})
        args = {"period_length": how.get("length", 3), "circular": how.get("circular", True), "na_policy": how.get("policy", "skip")}
        return rounded(bioclim.derive(cube, 12, bios, **args))

    register(name, build, bioclim_sql(C12_SQL, bios, static=static, **how))


for _b in range(1, 36):
    bio_query(f"bio{_b:02d}", [_b])
bio_query("bioclim_all")
bio_query("bioclim_19", range(1, 20))
bio_query("bioclim_noncircular", circular=False)
for _l in (1, 2, 6):
    bio_query(f"bioclim_period_{_l}", length=_l)
bio_query("bioclim_noncircular_period_4", length=4, circular=False)
_ODD = "(cell % 14)"  # 0 and 13 are out of range
for _family, _names in {
    "unit_temperature": ("warmest_unit", "coldest_unit"),
    "unit_precipitation": ("wettest_unit", "driest_unit"),
    "unit_radiation": ("high_rad_unit", "low_rad_unit"),
    "unit_moisture": ("high_mois_unit", "low_mois_unit"),
    "period_temperature": ("warmest_period", "coldest_period"),
    "period_precipitation": ("wettest_period", "driest_period"),
    "period_moisture": ("high_mois_period", "low_mois_period"),
}.items():
    bio_query(f"static_{_family}", static={n: _ODD if j else "(cell % 12 + 1)" for j, n in enumerate(_names)})
bio_query("static_all", static={n: "(cell % 12 + 1)" for n in bioclim.INDICES})


# ---- cubes with gaps: both policies --------------------------------------------------------------

_GAP = "(cell + unit) % 7 = 0 OR (cell % 11 = 0 AND unit < 11)"
GAPS_SQL = f"SELECT cell, unit, {', '.join(f'CASE WHEN NOT ({_GAP}) THEN {v} END AS {v}' for v in FACTS)} FROM ({C12_SQL})"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 in which some values are missing: of single units, and of most units of some cells."""
    cube = c12(spark, sf_dir)
    value = lambda v, i: F.when(~F.expr(_GAP.replace("unit", str(i))), F.col(unit_name(v, i, 12)))
    return cube.select("cell", *[value(v, i).alias(unit_name(v, i, 12)) for v in VARIABLES for i in range(1, 13)])


for _p in ("skip", "strict"):
    register(f"bioclim_gaps_{_p}", lambda s, d, p=_p: rounded(bioclim.derive(gaps(s, d), 12, na_policy=p)), bioclim_sql(GAPS_SQL, policy=_p))


# ---- statistics ------------------------------------------------------------------------------------


def stats_sql(source: str, v: str, n: int, stats, prefix: str, inter: str | None = None, inter_stats=(), length: int = 3, stat: str = "mean", circular: bool = True, policy: str = "skip", static: dict[str, str] | None = None, ddof: int = 1) -> str:
    static = static or {}
    fold = lambda f: agg_sql(f, v, n, policy)
    m, sd = fold("avg"), fold("stddev_samp")
    plain = {"mean": m, "sum": fold("sum"), "stdev": sd if ddof else fold("stddev_pop"), "cv": f"CASE WHEN {sd} IS NULL THEN NULL WHEN 1 + {m} = 0 THEN 0 ELSE 100 * {sd} / (1 + {m}) END"}
    for s in ("max", "min"):
        plain[s] = f"max(CASE WHEN unit = {static[f'{s}_unit']} THEN {v} END)" if f"{s}_unit" in static else fold(s)
    rank = inter or v
    k = n if circular else n - length + 1
    picks = {"max_inter": static.get("max_interactive") or f"min(CASE WHEN w.w_{rank} = e.hi THEN w.p END)", "min_inter": static.get("min_interactive") or f"min(CASE WHEN w.w_{rank} = e.lo THEN w.p END)"}
    own = {s: f"max(CASE WHEN w.p = {static[s].replace('cell', 'w.cell')} THEN w.w_{v} END)" if s in static else agg_sql(s[:3], f"w.w_{v}", k, policy) for s in ("max_period", "min_period")}
    over = {v: stat} | {rank: stat}
    names = {"cv_cli": "cv"}
    cols = [f"{plain[names.get(s, s)]} AS x_{names.get(s, s)}" for s in stats if s not in own]
    pcols = [f"{own[s]} AS x_{s}" for s in stats if s in own] + [f"max(CASE WHEN w.p = i.{s} THEN w.w_{v} END) AS x_{s}" for s in inter_stats]
    suffix = {"max_inter": "inter_high", "min_inter": "inter_low", "cv_cli": "cv"}
    order = [s for s in (*statistics.STATS, *statistics.INTER_STATS) if s in stats or s in inter_stats]
    out = ", ".join(f"round(x_{names.get(s, s)} + {ASIDE}, 6) AS {prefix}_{suffix.get(s, s)}" for s in order)
    group = lambda sql: f"max({sql.replace('cell', 'w.cell')})" if sql in static.values() else sql
    return f"""WITH {grid_sql(source, n, list(dict.fromkeys([v, rank])))}, {window_sql(n, length, circular, policy, over)},
ends AS (SELECT cell, {agg_sql('max', f'w_{rank}', k, policy)} AS hi, {agg_sql('min', f'w_{rank}', k, policy)} AS lo FROM win GROUP BY 1),
idx AS (SELECT w.cell, {', '.join(f'{group(sql)} AS {s}' for s, sql in picks.items())} FROM win w JOIN ends e ON w.cell = e.cell GROUP BY 1),
per AS (SELECT w.cell, {', '.join(['count(*) AS n', *pcols])} FROM win w JOIN idx i ON w.cell = i.cell GROUP BY 1),
agg AS (SELECT cell, {', '.join(['count(*) AS n', *cols])} FROM grid GROUP BY 1)
SELECT agg.cell, {out} FROM agg JOIN per ON agg.cell = per.cell"""


def stat_query(name: str, cube, source: str, v: str, n: int, stats=(), static: dict[str, str] | None = None, inter: str | None = None, inter_stats=(), **how) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = cube(spark, sf_dir).withColumns({f"ix_{i}": F.expr(e).cast("int") for i, e in (static or {}).items()})
        return rounded(
            statistics.derive(
                df, v, n, stats, inter_variable=inter, inter_stats=inter_stats, prefix=v, indices={i: f"ix_{i}" for i in static or {}},
                period_length=how.get("length", 3), period_stat=how.get("stat", "mean"), circular=how.get("circular", True), na_policy=how.get("policy", "skip"), ddof=how.get("ddof", 1),
            )
        )

    register(name, build, stats_sql(source, v, n, list(stats), v, inter, list(inter_stats), static=static, **how))


for _s in statistics.STATS:
    stat_query(f"stat_{_s}", c12, C12_SQL, "prcp", 12, [_s])
for _s in statistics.INTER_STATS:
    stat_query(f"stat_{_s}", c12, C12_SQL, "prcp", 12, inter="tavg", inter_stats=[_s])
stat_query("stat_population_sd", c12, C12_SQL, "srad", 12, ["stdev"], ddof=0)
stat_query("stat_period_sum", c12, C12_SQL, "prcp", 12, ["max_period", "min_period"], stat="sum", length=4, circular=False)
stat_query("stat_static", c12, C12_SQL, "prcp", 12, ["max", "min", "max_period", "min_period"], {"max_unit": _ODD, "min_unit": "(cell % 12 + 1)", "max_period": "(cell % 12 + 1)", "min_period": _ODD})
stat_query("stat_static_interactive", c12, C12_SQL, "prcp", 12, static={"max_interactive": "(cell % 12 + 1)", "min_interactive": _ODD}, inter_stats=list(statistics.INTER_STATS))
for _p in ("skip", "strict"):
    stat_query(f"stat_events_{_p}", evt, EVT_SQL, "level", 24, list(statistics.STATS), inter="total", inter_stats=list(statistics.INTER_STATS), length=4, policy=_p)


# ---- groups of layers and rolling windows --------------------------------------------------------------

MONTHS = [i % 12 + 1 for i in range(LAYERS)]
QUARTERS = [i % 12 // 3 + 1 for i in range(LAYERS)]
YEARS = [FIRST_YEAR + i // 12 for i in range(LAYERS)]


def grouped_sql(index: list[int], fold: str, prefix: str, policy: str = "skip") -> str:
    cols = []
    for g in sorted(set(index)):
        mine = [i + 1 for i, x in enumerate(index) if x == g]
        value = f"CASE WHEN layer IN ({', '.join(map(str, mine))}) THEN prcp END"
        total = f"CASE WHEN count({value}) = {len(mine)} THEN {fold}({value}) END" if policy == "strict" else f"{fold}({value})"
        cols.append(f"round({total} + {ASIDE}, 6) AS {prefix}_{g:02d}")
    return f"WITH src AS ({SER_SQL}) SELECT cell, {', '.join(cols)} FROM src GROUP BY 1"


for _n, _index in (("month", MONTHS), ("quarter", QUARTERS), ("year", YEARS)):
    register(f"average_by_{_n}", lambda s, d, x=_index: rounded(temporal.average(ser(s, d, ["prcp"]), x, n_layers=LAYERS, value="prcp")), grouped_sql(_index, "avg", "avg_unit"))
    register(f"sum_by_{_n}", lambda s, d, x=_index: rounded(temporal.total(ser(s, d, ["prcp"]), x, n_layers=LAYERS, value="prcp")), grouped_sql(_index, "sum", "sum_unit"))
register("average_by_month_strict", lambda s, d: rounded(temporal.average(ser(s, d, ["prcp"]), MONTHS, n_layers=LAYERS, value="prcp", prefix="normal", na_policy="strict")), grouped_sql(MONTHS, "avg", "normal", "strict"))

ROLL_FOLDS = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "stdev": "stddev_samp", "median": "median"}


def roll_sql(window: int, step: int, fun: str, policy: str = "skip") -> str:
    cycles = LAYERS // 12
    value = f"{ROLL_FOLDS[fun]}(s.prcp)"
    if policy == "strict":
        value = f"CASE WHEN count(s.prcp) = {window} THEN {value} END"
    return f"""WITH src AS ({SER_SQL}), keys AS (SELECT DISTINCT cell, (layer - 1) % 12 + 1 AS unit FROM src),
starts AS (SELECT unnest(range(1, {cycles - window + 2}, {step})) AS start)
SELECT k.cell, CAST(k.unit AS INTEGER) AS unit, CAST(t.start AS INTEGER) AS start, CAST(t.start + {window - 1} AS INTEGER) AS "end", round({value} + {ASIDE}, 6) AS value
FROM keys k CROSS JOIN starts t LEFT JOIN src s ON s.cell = k.cell AND (s.layer - 1) % 12 + 1 = k.unit AND (s.layer - 1) // 12 + 1 BETWEEN t.start AND t.start + {window - 1}
GROUP BY 1, 2, 3, 4"""


def roll_query(name: str, window: int, step: int, fun: str, policy: str = "skip") -> None:
    register(name, lambda s, d: rounded(temporal.roll(ser(s, d, ["prcp"]), window, n_layers=LAYERS, step=step, fun=fun, na_policy=policy, value="prcp")), roll_sql(window, step, fun, policy))


for _f in ROLL_FOLDS:
    roll_query(f"roll_{_f}", 3, 1, _f)
roll_query("roll_mean_step_2", 2, 2, "mean")
roll_query("roll_mean_all_cycles", LAYERS // 12, 1, "mean")
roll_query("roll_mean_strict", 3, 1, "mean", "strict")


def _roll_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = temporal.roll(ser(spark, sf_dir, ["prcp"]), 5, n_layers=LAYERS, value="prcp")
    return rounded(temporal.roll_layers(rolled, 5, n_layers=LAYERS))


_NAMED = ", ".join(f"max(CASE WHEN start = {s} AND unit = {u} THEN value END) AS \"output_w{s}-{s + 4}_u{u:02d}\"" for s in range(1, LAYERS // 12 - 3) for u in range(1, 13))
register("roll_layers", _roll_layers, f"SELECT cell, {_NAMED} FROM ({roll_sql(5, 1, 'mean')}) GROUP BY 1")


# ---- regions, layouts, validation ------------------------------------------------------------------------


def grid_of(spark: SparkSession, sf_dir: str) -> GridSpec:
    """Suppliers as cells of a grid of GRID_COLS columns; the number of rows is read from the table."""
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    rows = -(-last // GRID_COLS)
    return GridSpec(rows, GRID_COLS, 0.0, float(GRID_COLS), 0.0, float(rows))


_TRIANGLE = [(1.0, 0.2), (9.3, 3.4), (2.1, 9.7)]


def _polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = grid_of(spark, sf_dir)
    return rounded(bioclim.derive(region.mask_polygon(c12(spark, sf_dir, ["prcp"]), grid, _TRIANGLE), 12, [12, 13, 16]))


def _inside_sql(x: str, y: str) -> str:
    ring = _TRIANGLE
    terms = [f"CASE WHEN (({y} < {y1}) <> ({y} < {y2})) AND {x} < {x1} + ({y} - {y1}) * ({(x2 - x1) / (y2 - y1)}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2]
    return f"({' + '.join(terms)}) % 2 = 1"


register(
    "mask_polygon",
    _polygon,
    f"""WITH g AS (SELECT ceil(max(s_suppkey) / {GRID_COLS}.0) AS nrows FROM supplier), r AS ({bioclim_sql(C12_SQL, [12, 13, 16])}),
p AS (SELECT r.*, (r.cell - 1) % {GRID_COLS} + 0.5 AS x, nrows - floor((r.cell - 1) / {GRID_COLS}.0) - 0.5 AS y FROM r, g)
SELECT cell, bio12, bio13, bio16 FROM p WHERE {_inside_sql('x', 'y')}""",
)


def _attribute_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    europe = table(spark, sf_dir, "region").where("r_name = 'EUROPE'").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    cells = table(spark, sf_dir, "supplier").join(europe, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("cell"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.month("l_shipdate").alias("unit"), "l_quantity")
    return rounded(bioclim.derive(to_wide(region.mask_cells(lines, cells), {"prcp": FACTS["prcp"]}, 12), 12, [12, 15, 17]))


register(
    "mask_attribute",
    _attribute_mask,
    f"""SELECT r.* FROM ({bioclim_sql(C12_SQL, [12, 15, 17])}) r WHERE r.cell IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""",
)


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = grid_of(spark, sf_dir)
    larger = GridSpec(grid.nrows + 3, GRID_COLS, 0.0, float(GRID_COLS), 0.0, grid.ymax + 3)
    return rounded(region.fill_grid(bioclim.derive(c12(spark, sf_dir, ["prcp"]), 12, [12]), larger))


register("fill_grid", _filled, f"""WITH r AS ({bioclim_sql(C12_SQL, [12])}), g AS (SELECT unnest(range(1, CAST((ceil(max(s_suppkey) / {GRID_COLS}.0) + 3) * {GRID_COLS} AS BIGINT) + 1)) AS cell FROM supplier)
SELECT g.cell, r.bio12 FROM g LEFT JOIN r ON g.cell = r.cell""")


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = grid_of(spark, sf_dir)
    crop = GridSpec(5, 6, 0.0, 6.0, 0.0, 5.0)
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"))
    return cells.select("cell", region.translate(F.col("cell"), grid, crop, 2, 3).alias("cropped"))


register("translate_cells", _translated, f"""WITH p AS (SELECT s_suppkey AS cell, (s_suppkey - 1) // {GRID_COLS} + 1 - 2 AS r, (s_suppkey - 1) % {GRID_COLS} + 1 - 3 AS c FROM supplier)
SELECT cell, CASE WHEN r BETWEEN 1 AND 5 AND c BETWEEN 1 AND 6 THEN (r - 1) * 6 + c END AS cropped FROM p""")

register("bionames", lambda s, d: catalogue(s).select("variable", "name"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in bioclim.names().items()) + ") AS t(variable, name)")
register(
    "check_missing",
    lambda s, d: validate.missing_codes(gaps(s, d), ["tmin", "prcp"], 12),
    f"""WITH {grid_sql(GAPS_SQL, 12, VARIABLES)}, c AS (SELECT cell, count(tmin) AS a, count(prcp) AS b FROM grid GROUP BY 1),
k AS (SELECT cell, CASE WHEN a = 0 THEN 0 WHEN a = 12 THEN 2 ELSE 1 END AS code_tmin, CASE WHEN b = 0 THEN 0 WHEN b = 12 THEN 2 ELSE 1 END AS code_prcp FROM c)
SELECT *, greatest(code_tmin, code_prcp) - least(code_tmin, code_prcp) AS mismatch FROM k""",
)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = c12(spark, sf_dir, ["tmin"])
    return validate.missing_report(whole.join(gaps(spark, sf_dir).select("cell", *[unit_name("prcp", i, 12) for i in range(1, 13)]), "cell", "left"), ["tmin", "prcp"], 12)


register(
    "check_report",
    _mixed,
    f"""WITH a AS (SELECT cell, count(tmin) AS n FROM ({C12_SQL}) GROUP BY 1), b AS (SELECT cell, count(prcp) AS n FROM ({GAPS_SQL}) GROUP BY 1),
k AS (SELECT a.cell, CASE WHEN a.n = 0 THEN 0 WHEN a.n = 12 THEN 2 ELSE 1 END AS x, CASE WHEN coalesce(b.n, 0) = 0 THEN 0 WHEN b.n = 12 THEN 2 ELSE 1 END AS y FROM a LEFT JOIN b ON a.cell = b.cell)
SELECT count(*) AS cells, CAST(sum(abs(x - y)) AS BIGINT) AS mismatch_sum, CAST(sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS BIGINT) AS mismatched_cells, sum(abs(x - y)) = 0 AS is_valid FROM k""",
)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.key_differences(to_long(c12(spark, sf_dir, ["prcp"]), ["prcp"], 12), to_long(gaps(spark, sf_dir), ["prcp"], 12).where("prcp IS NOT NULL"))


register("check_keys", _keys, f"""WITH {grid_sql(C12_SQL, 12, VARIABLES)} SELECT cell, CAST(unit AS INTEGER) AS unit, 'first' AS only_in FROM grid g WHERE NOT EXISTS (SELECT 1 FROM ({GAPS_SQL}) b WHERE b.cell = g.cell AND b.unit = g.unit AND b.prcp IS NOT NULL)""")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = to_cube(c12(spark, sf_dir), list(VARIABLES), 12)
    return rounded(to_long(from_cube(cube, list(VARIABLES), 12), list(VARIABLES), 12))


register("layout_round_trip", _round_trip, f"""WITH {grid_sql(C12_SQL, 12, VARIABLES)} SELECT cell, CAST(unit AS INTEGER) AS unit, {', '.join(f'round({v} + {ASIDE}, 6) AS {v}' for v in VARIABLES)} FROM grid""")


# ---- derived and attached inputs, long series, sources and sinks ------------------------------------------


def _derived_tavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bioclim.derive(c12(spark, sf_dir, ["tmin", "tmax", "prcp"]), 12, range(1, 20)))


register("bioclim_derived_tavg", _derived_tavg, bioclim_sql(f"SELECT cell, unit, prcp, tmin, tmax, (tmin + tmax) / 2 AS tavg, srad, mois FROM ({C12_SQL})", range(1, 20)))


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index layers as tables of their own; some cells have no index."""
    layer = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") % 14).alias("value"))
    tables = {"warmest_unit": layer, "coldest_period": layer.where("cell <= 60"), "wettest_period": layer.withColumn("value", F.col("cell") % 12 + 1)}
    return rounded(bioclim.derive(bioclim.attach_indices(c12(spark, sf_dir), tables), 12, range(1, 20)))


register("static_attached", _attached, bioclim_sql(C12_SQL, range(1, 20), static={"warmest_unit": _ODD, "coldest_period": "(CASE WHEN cell <= 60 THEN cell % 14 END)", "wettest_period": "(cell % 12 + 1)"}))


def _long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of all layers as arrays; missing values come as NaN."""
    wide = to_wide(ser(spark, sf_dir).withColumnRenamed("layer", "unit"), list(VARIABLES), LAYERS)
    cube = to_cube(wide, list(VARIABLES), LAYERS).selectExpr("cell", *[f"transform({v}, x -> coalesce(x, double('NaN'))) AS {v}" for v in VARIABLES])
    return rounded(bioclim.derive(cube, LAYERS))


register("bioclim_long_series", _long_series, bioclim_sql(SER_SQL.replace("AS layer", "AS unit"), n=LAYERS))


def _reference_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bioclim.derive(region.drop_missing(gaps(spark, sf_dir), unit_name("prcp", 1, 12)), 12, [1, 12, 16]))


register("drop_missing", _reference_layer, f"""SELECT r.* FROM ({bioclim_sql(GAPS_SQL, [1, 12, 16])}) r WHERE r.cell IN (SELECT cell FROM ({GAPS_SQL}) WHERE unit = 1 AND prcp IS NOT NULL)""")


def _layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as one file set per month and read again, a path per unit."""
    folder = layers.work_folder(spark)
    to_long(c12(spark, sf_dir, ["prcp"]), ["prcp"], 12).withColumnRenamed("prcp", "value").write.partitionBy("unit").parquet(folder)
    long = layers.read_layers(spark, [f"{folder}/unit={i}" for i in range(1, 13)], 12)
    return rounded(bioclim.derive(to_wide(long.withColumnRenamed("value", "prcp"), ["prcp"], 12), 12, [12, 13, 14, 15, 16, 17]))


register("read_layers", _layer_files, bioclim_sql(C12_SQL, [12, 13, 14, 15, 16, 17]))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as one file set per variable behind the guard (a second write is refused), and joined again."""
    folder, bios = layers.work_folder(spark), [12, 15, 17]
    result = bioclim.derive(c12(spark, sf_dir, ["prcp"]), 12, bios)
    paths = layers.write_layers(result, folder, by_layer=True)
    try:
        layers.write_layers(result, folder, by_layer=True)
    except FileExistsError:
        first, *rest = (spark.read.parquet(p) for p in paths)
        return rounded(reduce(lambda a, b: a.join(b, "cell"), rest, first))
    raise AssertionError("files were overwritten")


register("write_layers", _written, bioclim_sql(C12_SQL, [12, 15, 17]))


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = grid_of(spark, sf_dir)
    others = {"same": grid, "finer": GridSpec(grid.nrows * 2, grid.ncols, grid.xmin, grid.xmax, grid.ymin, grid.ymax), "moved": GridSpec(grid.nrows, grid.ncols, 1.0, grid.xmax + 1, grid.ymin, grid.ymax, "EPSG:3857")}
    rows = [(name, p) for name, ps in validate.geometry_report({"reference": grid, **others}).items() for p in ps]
    return spark.createDataFrame(rows, "input string, differs string")


register("check_geometry", _geometry, "SELECT * FROM (VALUES ('finer', 'nrows'), ('moved', 'xmin'), ('moved', 'xmax'), ('moved', 'crs')) AS t(input, differs)")


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mask refuses: regions beside the grid, in another reference system, or no polygons at all."""
    grid, cells, rows = grid_of(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")), []
    for name, ring, crs in (("inside", _TRIANGLE, None), ("beside", [(-9.0, -9.0), (-8.0, -9.0), (-8.0, -8.0)], None), ("other", _TRIANGLE, "EPSG:3857"), ("line", _TRIANGLE[:2], None)):
        try:
            region.mask_polygon(cells, grid, ring, crs=crs)
            rows.append((name, None))
        except (ValueError, TypeError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "region string, refused string")


register("check_region", _refusals, "SELECT * FROM (VALUES ('inside', NULL), ('beside', 'ValueError'), ('other', 'ValueError'), ('line', 'TypeError')) AS t(region, refused)")


# ---- the flagship: climatology, then the 35 variables ------------------------------------------------------


def climatology_bioclim(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = ser(spark, sf_dir).withColumn("unit", (F.col("layer") - 1) % 12 + 1)
    normals = to_wide(series, {v: ("avg({})", v) for v in VARIABLES}, 12)
    return rounded(bioclim.derive(normals, 12))


_NORMALS = f"SELECT cell, CAST((layer - 1) % 12 + 1 AS BIGINT) AS unit, {', '.join(f'avg({v}) AS {v}' for v in VARIABLES)} FROM ({SER_SQL}) GROUP BY 1, 2"
register("flagship_climatology_bioclim", climatology_bioclim, bioclim_sql(_NORMALS))
