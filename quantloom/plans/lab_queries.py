"""The research lab on the given tables: a panel of 50 assets from the quotes, evidence bands from the same lines, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lab
from ..operators import pointintime as pit
from ..sources.adapters import QUOTES_SQL, load, quotes

BANDS = "exchange news event_calendar onchain tokenomics options alternative macro".split()
GLOBAL = ("macro", "alternative")
COMPILED, THIN = ["mom5", "macro_tilt", "alt_tilt", "cascade_p", "ac", "wmi"], ["mom5"]

PANEL_SQL = f"""(WITH c AS (SELECT symbol AS asset, ts AS day, arg_max(price, id) AS close, sum(size) AS size FROM ({QUOTES_SQL}) q GROUP BY ALL),
 l AS (SELECT *, lag(close) OVER w AS p1, lag(close, 3) OVER w AS p3, lag(close, 6) OVER w AS p6, lag(size) OVER w AS s1, date_diff('day', DATE '1990-01-01', day::DATE) AS n FROM c WINDOW w AS (PARTITION BY asset ORDER BY day)),
 t AS (SELECT asset, day, (close - p1) / (close + p1) / 10 AS ret, sign(p1 - p6)::DOUBLE AS mom5, (n * 7 % 3 - 1)::DOUBLE AS macro_tilt, (n // 3 % 3 - 1)::DOUBLE AS alt_tilt, ['trend', 'range', 'crisis'][(floor(p1)::BIGINT + asset) % 3 + 1] AS regime,
  (floor(p1)::BIGINT % 100) / 100 AS cascade_p, (floor(p3)::BIGINT % 50) / 100 AS wmi, 0.2 + (floor(p3)::BIGINT % 997) / 2000 AS ac, (floor(p6)::BIGINT % 60) / 100 AS c, n % 13 = 0 AS outage, least(s1, 50) / 50 AS strength FROM l WHERE p6 IS NOT NULL)
 SELECT *, CASE WHEN regime = 'crisis' AND cascade_p >= 0.6 THEN -1 WHEN regime = 'trend' AND mom5 > 0 AND cascade_p < 0.45 AND macro_tilt >= 0 THEN 1 WHEN regime = 'range' AND macro_tilt > 0 AND alt_tilt > 0 AND mom5 >= 0 THEN 1
  WHEN mom5 > 0 AND macro_tilt < 0 AND alt_tilt < 0 THEN 0 WHEN mom5 <> 0 THEN mom5 ELSE sign(macro_tilt + alt_tilt) END::DOUBLE AS signal FROM t)"""
_CUT = "(SELECT list_sort(list(day))[len(list(day)) // 2 + 1] FROM (SELECT DISTINCT day FROM panel))"


def panel(spark, d):
    """(asset, day, ret, and what the rules read) from each asset's last quote of a day."""
    q = quotes(spark, d)
    c = q.groupBy(F.col("symbol").alias("asset"), F.col("ts").alias("day")).agg(F.max_by("price", "id").alias("close"), F.sum("size").alias("size"))
    w = W.partitionBy("asset").orderBy("day")
    lag = lambda c, k: F.lag(c, k).over(w)
    rows = c.select("asset", "day", "close", lag("close", 1).alias("p1"), lag("close", 3).alias("p3"), lag("close", 6).alias("p6"), lag("size", 1).alias("s1"), F.datediff(F.to_date("day"), F.lit("1990-01-01").cast("date")).alias("n"))
    whole = lambda c: F.floor(c).cast("long")
    t = rows.where("p6 IS NOT NULL").select(
        "asset", "day", ((F.col("close") - F.col("p1")) / (F.col("close") + F.col("p1")) / 10).alias("ret"), F.signum(F.col("p1") - F.col("p6")).alias("mom5"), (F.col("n") * 7 % 3 - 1).cast("double").alias("macro_tilt"),
        (F.floor(F.col("n") / 3) % 3 - 1).cast("double").alias("alt_tilt"), F.element_at(F.array(F.lit("trend"), F.lit("range"), F.lit("crisis")), ((whole("p1") + F.col("asset")) % 3 + 1).cast("int")).alias("regime"),
        (whole("p1") % 100 / 100).alias("cascade_p"), (whole("p3") % 50 / 100).alias("wmi"), (0.2 + whole("p3") % 997 / 2000).alias("ac"), (whole("p6") % 60 / 100).alias("c"), (F.col("n") % 13 == 0).alias("outage"), (F.least("s1", F.lit(50.0)) / 50).alias("strength"),
    )
    return t.withColumn("signal", lab.directional_signal(*(F.col(c) for c in ("regime", "cascade_p", "mom5", "macro_tilt", "alt_tilt"))))


def _pnl(position: str) -> str:
    return f"avg(({position}) * ret)"


_POSITIONS = {
    "always_long": "1", "mom_always": "CASE WHEN mom5 = 0 THEN 1 ELSE mom5 END", "thick_ungated": "signal", "simple_outage": "CASE WHEN outage THEN 0 ELSE signal END", "simple_casc": "CASE WHEN cascade_p >= casc_only_thr THEN 0 ELSE signal END",
    "wmi": "CASE WHEN wmi < 0.2 THEN 0 ELSE signal END", "ac": "CASE WHEN ac < ac_thr OR c < c_thr THEN 0 ELSE signal END",
}
_STATS = """avg(pnl) * 365 AS ann_return, (stddev_samp(pnl) + 1e-12) * sqrt(365) AS ann_vol, avg(pnl) / (stddev_samp(pnl) + 1e-12) * sqrt(365) AS sharpe, (1 / avg(1 / greatest(1 + pnl, 1e-8)) - 1) * 365 AS ce, sum(aside) / sum(n) AS abstain_rate, count(*) AS n_days"""
_GRID_SQL = f"""panel AS {PANEL_SQL}, first_half AS (SELECT * FROM panel WHERE day < {_CUT}),
 points AS (SELECT 'ac_' || i || '_' || j AS point, i * 3 + j AS place, a AS ac_thr, c AS c_thr, NULL::DOUBLE AS casc_only_thr FROM (SELECT unnest([0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55])::DOUBLE AS a, unnest(range(7)) AS i) CROSS JOIN (SELECT unnest([0.25, 0.35, 0.45])::DOUBLE AS c, unnest(range(3)) AS j)
  UNION ALL SELECT 'casc_' || k, 21 + k, NULL, NULL, t FROM (SELECT unnest([0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90])::DOUBLE AS t, unnest(range(8)) AS k)),
 curves AS (SELECT point, day, avg(pos * ret) AS pnl, count(*) AS n, count(*) FILTER (pos = 0) AS aside FROM (SELECT point, day, ret, CASE WHEN coalesce(ac < ac_thr OR c < c_thr, cascade_p >= casc_only_thr) THEN 0 ELSE signal END AS pos FROM first_half CROSS JOIN points) GROUP BY ALL),
 stats AS (SELECT place, point, {_STATS}, any_value(ac_thr) AS ac_thr, any_value(c_thr) AS c_thr, any_value(casc_only_thr) AS casc_only_thr FROM curves JOIN points USING (point) GROUP BY ALL),
 judged AS (SELECT *, abstain_rate BETWEEN 0.05 AND CASE WHEN place < 21 THEN 0.55 ELSE 0.5 END AS admitted FROM stats),
 graded AS (SELECT *, admitted AND row_number() OVER (PARTITION BY place < 21 ORDER BY CASE WHEN admitted THEN CASE WHEN place < 21 THEN sharpe ELSE ce END END DESC NULLS LAST, place) = 1 AS chosen FROM judged)"""
_FROZEN = f"WITH {_GRID_SQL}, frozen AS (SELECT coalesce(max(ac_thr) FILTER (chosen), 0.35) AS ac_thr, coalesce(max(c_thr) FILTER (chosen), 0.30) AS c_thr, coalesce(max(casc_only_thr) FILTER (chosen), 0.70) AS casc_only_thr FROM graded), later AS (SELECT * FROM panel CROSS JOIN frozen WHERE day >= {_CUT})"
_POLICY_CURVES = " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS point, day, {_pnl(p)} AS pnl, count(*) AS n, count(*) FILTER (({p}) = 0) AS aside FROM later GROUP BY day" for i, (n, p) in enumerate(_POSITIONS.items()))
STATS = "ann_return ann_vol sharpe:5 ce abstain_rate"

_CHANCE = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_CURVES = " UNION ALL ".join(f"SELECT day, '{n}' AS strategy, {_pnl(p)} AS pnl FROM (SELECT *, 0.4 AS ac_thr, 0.35 AS c_thr, 0.55 AS casc_only_thr FROM panel) GROUP BY day" for n, p in _POSITIONS.items())
REALITY_SQL = f"""WITH panel AS {PANEL_SQL}, curves AS ({_CURVES}), days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS place FROM (SELECT DISTINCT day FROM curves)), k AS (SELECT count(*) AS n FROM days),
 used AS (SELECT place, strategy, 1 / greatest(1 + pnl, 1e-8) AS u FROM curves JOIN days USING (day)),
 steps AS (SELECT draw, place AS s, place // 5 AS block, place % 5 AS step, n FROM days CROSS JOIN k CROSS JOIN (SELECT unnest(range(199)) AS draw)),
 drawn AS (SELECT draw, ({_CHANCE.format("'20260803:' || draw || ':' || block")} % n + step) % n AS place FROM steps),
 ces AS (SELECT draw, strategy, (1 / avg(u) - 1) * 365 AS ce FROM drawn JOIN used USING (place) GROUP BY ALL), real AS (SELECT strategy, (1 / avg(u) - 1) * 365 AS ce FROM used GROUP BY ALL),
 deltas AS (SELECT strategy, ce - (SELECT ce FROM real WHERE strategy = 'always_long') AS delta FROM real WHERE strategy <> 'always_long'),
 highest AS (SELECT draw, max(c.ce - b.ce - delta) AS m FROM ces c JOIN ces b USING (draw) JOIN deltas d ON d.strategy = c.strategy WHERE b.strategy = 'always_long' GROUP BY draw)
 SELECT strategy, delta, strategy = (SELECT arg_max(strategy, delta) FROM deltas) AS best, (SELECT max(delta) FROM deltas) AS max_delta, (SELECT (count(*) FILTER (m >= (SELECT max(delta) FROM deltas)) + 1) / (count(*) + 1) FROM highest) AS p_value, n AS n_days FROM deltas CROSS JOIN k"""

# The bands' weights and seconds of freshness, in the order of BANDS.
_WEIGHTS, _FRESH_DAYS = (0.30, 0.15, 0.10, 0.15, 0.10, 0.10, 0.05, 0.05), (2, 3, 14, 3, 7, 3, 7, 5)
_EVIDENCE = f"""SELECT {BANDS}[(l_orderkey + l_linenumber) % 8 + 1] AS band, l_partkey % 50 AS symbol, l_shipdate AS observed, l_shipdate + to_days(((l_orderkey + l_linenumber) % 10)::INT) AS available FROM lineitem"""
_MOMENTS = "SELECT DISTINCT o_custkey % 50 AS symbol, o_orderdate AS moment FROM orders"
READY_SQL = f"""(WITH e AS ({_EVIDENCE}), m AS ({_MOMENTS}), g AS (SELECT band, CASE WHEN band IN {GLOBAL} THEN NULL ELSE symbol END AS symbol, available FROM e),
 asked AS (SELECT m.symbol, m.moment, b.band, CASE WHEN b.band IN {GLOBAL} THEN NULL ELSE m.symbol END AS of FROM m CROSS JOIN (SELECT unnest({BANDS}) AS band) b),
 s AS (SELECT a.symbol, a.moment, a.band, epoch_us(a.moment - g.available) / 1000000 / 86400 AS age FROM asked a ASOF LEFT JOIN (SELECT DISTINCT band, coalesce(symbol, -1) AS of, available FROM g) g ON g.band = a.band AND g.of = coalesce(a.of, -1) AND g.available <= a.moment),
 f AS (SELECT s.symbol, s.moment, s.band, CASE WHEN age <= fresh THEN 'ready' WHEN age <= 3 * fresh THEN 'limited' ELSE 'missing' END AS status, w FROM s JOIN (SELECT unnest({BANDS}) AS band, unnest({list(_FRESH_DAYS)}) AS fresh, unnest({list(_WEIGHTS)})::DOUBLE AS w) USING (band))
 SELECT symbol, moment, {', '.join(f"max(status) FILTER (band = '{b}') AS st_{b}" for b in BANDS)}, sum(w * CASE status WHEN 'ready' THEN 1 WHEN 'limited' THEN 0.5 ELSE 0 END) AS readiness_score,
  count(*) FILTER (status = 'ready')::INT AS n_ready, count(*) FILTER (status = 'limited')::INT AS n_limited FROM f GROUP BY ALL)"""


def _world_sql(source: str, keys: str) -> str:
    """World factors of rows (keys, band, status) where each band counts as its status says."""
    share = "CASE status WHEN 'ready' THEN 1.0 WHEN 'limited' THEN 0.5 ELSE 0.0 END"
    return f"""SELECT *, round(b_hier * least(1, u) * CASE WHEN b_hier >= 0.55 AND limited / 16 < 0.15 THEN 1 WHEN b_hier >= 0.35 THEN 0.7 ELSE 0.4 END, 4) AS wmi FROM (
 SELECT {keys}, 0.25 * avg({share}) + 0.35 * avg({share}) FILTER (band <> 'alternative') + 0.4 * sum(w * {share}) AS b_hier, (count(*) FILTER (status = 'ready') + 0.7 * count(*) FILTER (status = 'limited')) / 8 AS u,
  exp(-2 * count(*) FILTER (status = 'limited') / 16) * greatest(0, 1 - 0.5 * (1 - count(*) FILTER (status = 'ready') / 8)) AS h, count(*) FILTER (status = 'limited') AS limited
 FROM {source} JOIN (SELECT unnest({BANDS}) AS band, unnest({list(_WEIGHTS)})::DOUBLE AS w) USING (band) GROUP BY ALL)"""


_LONG = f"(SELECT symbol, moment, replace(name, 'st_', '') AS band, status FROM (UNPIVOT (SELECT symbol, moment, {', '.join(f'st_{b}' for b in BANDS)} FROM {READY_SQL} r) ON {', '.join(f'st_{b}' for b in BANDS)} INTO NAME name VALUE status))"
WORLD_SQL = _world_sql(f"{_LONG} l", "symbol, moment")


def evidence(spark, d):
    """(band, symbol, observed, available, id): each line tells of a band of its part's symbol, some days after the fact; two bands tell of all."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    band = F.element_at(F.array(*(F.lit(b) for b in BANDS)), (k % 8 + 1).cast("int"))
    seen = load(spark, d, "lineitem").withColumn("band", band)
    late = F.timestamp_add("DAY", (k % 10).cast("int"), F.col("l_shipdate"))
    return seen.select("band", F.when(~F.col("band").isin(*GLOBAL), F.col("l_partkey") % 50).alias("symbol"), F.col("l_shipdate").alias("observed"), late.alias("available"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("value"))


def scaled_round(x: Column, digits: int) -> Column:
    """A double rounded as the SQL's engine does: scaled, rounded to a whole number, scaled back. Spark rounds the shortest decimal instead, so that
    ties such as 0.5103125, which is stored a little below, go the other way."""
    return F.round(x * 10.0**digits) / 10.0**digits


def readiness(spark, d):
    moments = load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderdate").alias("at")).distinct()
    return pit.band_readiness(moments, evidence(spark, d), "id")


def register(query) -> None:
    @query(f"""WITH v AS (SELECT symbol, observed, available, l_extendedprice AS value, id FROM (SELECT l_partkey % 50 AS symbol, l_shipdate AS observed, l_shipdate + to_days(((l_orderkey + l_linenumber) % 10)::INT) AS available, l_extendedprice, l_orderkey * 8 + l_linenumber AS id FROM lineitem)),
 o AS (SELECT o_orderkey, o_custkey % 50 AS symbol, o_orderdate AS moment FROM orders), x AS (SELECT o_orderkey, arg_max(value, struct_pack(a := observed, b := available, c := id)) AS value, max(observed) AS observed FROM o JOIN v ON v.symbol = o.symbol AND available <= moment AND available > moment - INTERVAL 400 DAYS GROUP BY ALL)
 SELECT o.o_orderkey, o.symbol, coalesce(date_diff('day', DATE '1990-01-01', observed::DATE), -1) AS observed_day, value FROM o LEFT JOIN x USING (o_orderkey)""")
    def known_vintages(spark, d):
        """The price of each order's symbol as it was known that day."""
        moments = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderdate").alias("at"))
        lines = load(spark, d, "lineitem")
        k = F.col("l_orderkey") + F.col("l_linenumber")
        vintages = lines.select((F.col("l_partkey") % 50).alias("symbol"), F.col("l_shipdate").alias("observed"), F.timestamp_add("DAY", (k % 10).cast("int"), F.col("l_shipdate")).alias("available"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
        found = pit.known_by(moments, vintages, ["symbol"], ["value"], "id")
        return found.select("o_orderkey", "symbol", F.coalesce(F.datediff(F.to_date("observed"), F.lit("1990-01-01").cast("date")), F.lit(-1)).cast("long").alias("observed_day"), "value")

    @query(f"SELECT * FROM {READY_SQL} r", "readiness_score:4")
    def band_readiness(spark, d):
        return readiness(spark, d).withColumnRenamed("at", "moment")

    @query(f"SELECT symbol, moment, b_hier, u, h, wmi FROM ({WORLD_SQL}) w", "b_hier u h wmi:3")
    def world_quality(spark, d):
        return pit.world(readiness(spark, d)).select("symbol", F.col("at").alias("moment"), "b_hier", "u", "h", "wmi")

    @query(f"SELECT symbol, id, CASE WHEN row_number() OVER w > 60 THEN quantile_cont(price, 0.2) OVER (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS threshold FROM ({QUOTES_SQL}) q WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)", "threshold")
    def expanding_quantiles(spark, d):
        q = quotes(spark, d).select("symbol", "ts", "id", "price")
        return pit.expanding_quantile(q, ["symbol"], ["ts", "id"], "price", 0.2, 60).select("symbol", "id", "threshold")

    @query(f"""WITH m AS (SELECT moment, round(avg(b_hier), 9) AS b FROM ({WORLD_SQL}) w GROUP BY moment), t AS (SELECT moment, b, CASE WHEN row_number() OVER w > 60 THEN quantile_cont(b, 0.2) OVER (ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS threshold FROM m WINDOW w AS (ORDER BY moment))
 SELECT moment, b, threshold, coalesce(b <= threshold, false)::INT AS scarce FROM t""", "b threshold")
    def scarce_days(spark, d):
        """Days whose mean breadth is in the lowest fifth of all days before."""
        market = pit.world(readiness(spark, d)).groupBy("at").agg(scaled_round(F.avg("b_hier"), 9).alias("b")).withColumn("market", F.lit(1))
        found = pit.expanding_quantile(market, ["market"], ["at"], "b", 0.2, 60)
        scarce = F.coalesce((F.col("b") <= F.col("threshold")).cast("int"), F.lit(0))
        return found.select(F.col("at").alias("moment"), *(scaled_round(F.col(c), 6).alias(c) for c in ("b", "threshold")), scarce.alias("scarce"))

    @query(f"WITH {_GRID_SQL} SELECT place::INT AS place, point, ann_return, ann_vol, sharpe, ce, abstain_rate, n_days, ac_thr, c_thr, casc_only_thr, admitted, chosen FROM graded", STATS)
    def lab_calibration(spark, d):
        p = panel(spark, d)
        return lab.grid_stats(p.where(F.col("day") < F.lit(lab.split_day(p))))

    @query(f"""{_FROZEN}, curves_later AS ({_POLICY_CURVES}), falls AS (SELECT point, min(wealth / peak - 1) AS max_dd FROM (SELECT *, max(wealth) OVER (PARTITION BY point ORDER BY day) AS peak FROM (SELECT point, day, exp(sum(ln(1 + pnl)) OVER (PARTITION BY point ORDER BY day)) AS wealth FROM curves_later)) GROUP BY point)
 SELECT place, point, {_STATS}, any_value(max_dd) AS max_dd FROM curves_later JOIN falls USING (point) GROUP BY ALL""", f"{STATS} max_dd")
    def lab_policies(spark, d):
        """Every policy on the second half, with the thresholds of the first."""
        p = panel(spark, d)
        cut = F.lit(lab.split_day(p))
        return lab.evaluate_policies(p.where(F.col("day") >= cut), lab.calibrate(p.where(F.col("day") < cut)))

    @query(f"""WITH panel AS {PANEL_SQL}, s AS (SELECT 'all' AS sample, * FROM panel UNION ALL SELECT 'no_outage', * FROM panel WHERE NOT outage), e AS (SELECT sample, quantile_cont(ac, [1/3, 2/3]) AS q, count(*) AS k FROM s GROUP BY sample)
 SELECT sample, CASE WHEN ac <= q[1] THEN 'low' WHEN ac <= q[2] THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n, avg(ac) AS mean_value, coalesce(avg(signal * ret) FILTER (signal <> 0), 0) AS signal_ic, coalesce(avg((sign(signal) = sign(ret))::INT) FILTER (signal <> 0), 0) AS hit_rate,
  coalesce(avg(signal * ret) FILTER (signal <> 0), 0) * 365 AS ann_active_ret, avg(outage::INT) AS outage_rate FROM s JOIN e USING (sample) WHERE k >= 50 GROUP BY ALL""", "mean_value signal_ic hit_rate ann_active_ret outage_rate")
    def signal_value_by_tercile(spark, d):
        return lab.conditional_signal_value(panel(spark, d))

    @query(REALITY_SQL, "delta max_delta p_value")
    def reality_check(spark, d):
        daily = lab.daily_curves(panel(spark, d), {p: lab.position(p, {"ac_thr": 0.4, "c_thr": 0.35, "casc_only_thr": 0.55}) for p in lab.POLICIES})
        return lab.reality_check(daily.unpivot("day", list(lab.POLICIES), "strategy", "pnl"), "always_long", draws=199)

    @query(f"""WITH panel AS {PANEL_SQL}, l AS {_LONG}, p AS (SELECT panel.* FROM panel JOIN (SELECT DISTINCT symbol, moment FROM l) k ON k.symbol = asset AND k.moment = day WHERE day >= {_CUT}), v AS (SELECT unnest(['(none)', {', '.join(f"'{b}'" for b in BANDS)}]) AS band_dropped, unnest(range(9)) AS place),
 w AS ({_world_sql("(SELECT band_dropped, symbol, moment, band, CASE WHEN band = band_dropped THEN 'missing' ELSE status END AS status FROM l CROSS JOIN v) x", "band_dropped, symbol, moment")}),
 a AS (SELECT v.place, w.band_dropped, day, ret, CASE WHEN exp((ln(greatest(b_hier, 1e-6)) + ln(greatest(u, 1e-6)) + ln(greatest(h, 1e-6)) + ln(greatest(strength, 1e-6)) + ln(greatest(c, 1e-6))) / 5) < 0.3 OR c < 0.25 THEN 0 ELSE signal END AS pos FROM p JOIN w ON w.symbol = asset AND w.moment = day JOIN v USING (band_dropped)),
 c AS (SELECT place, band_dropped, day, avg(pos * ret) AS pnl, count(*) AS n, count(*) FILTER (pos = 0) AS aside FROM a GROUP BY ALL), s AS (SELECT place, band_dropped, {_STATS} FROM c GROUP BY ALL)
 SELECT place::INT AS place, band_dropped, sharpe, ce, abstain_rate, ce - (SELECT ce FROM s WHERE place = 0) AS ce_change FROM s""", "sharpe:4 ce abstain_rate ce_change")
    def leave_one_band_out(spark, d):
        """The gated policy on the second half, with each band counted as missing in turn: nine points of one pass."""
        from ..functions.scores import weighted_geometric_mean

        p = panel(spark, d)
        rows = p.where(F.col("day") >= F.lit(lab.split_day(p))).join(readiness(spark, d).withColumnsRenamed({"symbol": "asset", "at": "day"}), ["asset", "day"])
        names = ["(none)", *BANDS]
        for i, band in enumerate(names):
            rows = pit.world(rows.drop("b_hier", "u", "h", "wmi"), band).withColumn(f"ac_{i}", F.expr(weighted_geometric_mean(["b_hier", "u", "h", "strength", "c"], [1.0] * 5)))
        points = {f"p{i}": F.when((F.col(f"ac_{i}") < 0.3) | (F.col("c") < 0.25), 0.0).otherwise(F.col("signal")) for i in range(len(names))}
        stats = lab.curve_stats(lab.daily_curves(rows, points), list(points))
        base = F.max(F.when(F.col("place") == 0, F.col("ce"))).over(W.partitionBy(F.lit(1)))  # nine rows
        label = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("place") + 1)
        return stats.select("place", label.alias("band_dropped"), "sharpe", "ce", "abstain_rate", (F.col("ce") - base).alias("ce_change"))

    @query(f"""WITH panel AS {PANEL_SQL}, m AS (SELECT day, avg(macro_tilt) AS m, avg(alt_tilt) AS a FROM panel GROUP BY day), g AS (SELECT m, a, row_number() OVER (ORDER BY {_CHANCE.format("'17:1:' || strftime(day, '%Y-%m-%d %H:%M:%S')")}, day) AS k FROM m), o AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM m)
 SELECT asset, day, m AS macro_tilt, a AS alt_tilt FROM panel JOIN o USING (day) JOIN g USING (k)""", "macro_tilt alt_tilt")
    def scrambled_tilts(spark, d):
        return lab.scramble_days(panel(spark, d), ["macro_tilt", "alt_tilt"]).select("asset", "day", "macro_tilt", "alt_tilt")

    @query(f"""WITH panel AS {PANEL_SQL}, o AS (SELECT day, row_number() OVER (ORDER BY {_CHANCE.format("'42:' || strftime(day, '%Y-%m-%d %H:%M:%S')")}, day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM panel))
 SELECT asset, day, (k <= greatest(1, round_even(n * 0.05, 0)))::INT AS planted_shock, CASE WHEN k <= greatest(1, round_even(n * 0.05, 0)) THEN 0 ELSE macro_tilt END AS macro_tilt FROM panel JOIN o USING (day)""")
    def planted_shocks(spark, d):
        return lab.plant_shocks(panel(spark, d), {"macro_tilt": F.lit(0.0)}).select("asset", "day", "planted_shock", "macro_tilt")

    @query()
    def compilation_bridge(spark, d):
        p = panel(spark, d)
        return lab.compilation_bridge(p, COMPILED, THIN, lab.split_day(p))

    @query(f"""WITH panel AS {PANEL_SQL}, later AS (SELECT *, lag(signal) OVER w AS s0, lag(CASE WHEN mom5 = 0 THEN 1 ELSE mom5 END) OVER w AS m0 FROM panel WHERE day >= {_CUT} WINDOW w AS (PARTITION BY asset ORDER BY day)),
 g AS (SELECT unnest([1, 1, 1, 2, 2, 2, 4, 4, 4, 6, 6, 6])::DOUBLE AS risk_aversion, unnest([0, 10, 25, 0, 10, 25, 0, 10, 25, 0, 10, 25])::DOUBLE AS cost_bps),
 c AS (SELECT risk_aversion, cost_bps, day, avg(signal * ret - cost_bps / 10000 * abs(signal - coalesce(s0, 0))) AS s, avg(CASE WHEN mom5 = 0 THEN 1 ELSE mom5 END * ret - cost_bps / 10000 * abs(CASE WHEN mom5 = 0 THEN 1 ELSE mom5 END - coalesce(m0, 0))) AS m FROM later CROSS JOIN g GROUP BY ALL)
 SELECT risk_aversion, cost_bps, CASE WHEN risk_aversion = 1 THEN exp(avg(ln(1 + s))) - 1 ELSE avg((1 + s) ** (1 - risk_aversion)) ** (1 / (1 - risk_aversion)) - 1 END * 365 AS mech_ce, CASE WHEN risk_aversion = 1 THEN exp(avg(ln(1 + m))) - 1 ELSE avg((1 + m) ** (1 - risk_aversion)) ** (1 / (1 - risk_aversion)) - 1 END * 365 AS mom_ce FROM c GROUP BY risk_aversion, cost_bps""", "mech_ce mom_ce")
    def risk_aversion_sensitivity(spark, d):
        from functools import reduce

        p = panel(spark, d)
        later = p.where(F.col("day") >= F.lit(lab.split_day(p)))
        out = []
        for cost in (0.0, 10.0, 25.0):
            daily = lab.daily_curves(later, {"mech": lab.position("thick_ungated"), "mom": lab.position("mom_always")}, cost)
            utilities = [F.avg(lab.utility(F.col(n), g)).alias(f"{n}_{int(g)}") for g in (1.0, 2.0, 4.0, 6.0) for n in ("mech", "mom")]
            rows = [F.struct(F.lit(g).alias("risk_aversion"), F.lit(cost).alias("cost_bps"), *(lab.certainty_equivalent(F.col(f"{n}_{int(g)}"), g).alias(f"{n}_ce") for n in ("mech", "mom"))) for g in (1.0, 2.0, 4.0, 6.0)]
            out.append(daily.agg(*utilities).select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
        return reduce(lambda a, b: a.unionByName(b), out)
