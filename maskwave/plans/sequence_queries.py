"""Queries over ordered samples: running statistics, gaps, interpolation, cycles, ranks, smoothers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import biomarkers as B
from ..operators import sequences as S
from ..operators import smoothing as D
from ..sources.cells import CELLS_SQL
from .registry import IDS, SEG, TRACES_SQL, P, cells, load, over_cycles, query, rounded, traces
from .signal_queries import BIOMARKER_SQL

_W = f"PARTITION BY {IDS} ORDER BY t_idx"
_OUT = [*SEG, "t_idx", "y"]


def _four(df):
    return df.withColumn("y", F.round("y", 4) + 0)




def _frame_median(first: str, last: str) -> str:
    return TRACES_SQL + f" SELECT {IDS}, t_idx, median(y) OVER ({_W} ROWS BETWEEN {first} AND {last}) AS y FROM tr"


@query("running_median_forward", TRACES_SQL + f" SELECT {IDS}, t_idx, CASE WHEN t_idx < 360 - 2 THEN median(y) OVER ({_W} ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) END AS y FROM tr")
def running_median_forward(spark, sf_dir):
    return S.kotliar_median(traces(spark, sf_dir), SEG, P.fs).select(*_OUT)


@query("running_median_centred", _frame_median("2 PRECEDING", "2 FOLLOWING"))
def running_median_centred(spark, sf_dir):
    return S.centred_median(traces(spark, sf_dir), SEG, 4).select(*_OUT)


@query("running_median_causal", _frame_median("4 PRECEDING", "CURRENT ROW"))
def running_median_causal(spark, sf_dir):
    return S.causal_median(traces(spark, sf_dir), SEG, 5).select(*_OUT)


@query("running_median_padded", TRACES_SQL + f""", e AS (SELECT {IDS}, first(y ORDER BY t_idx) AS a, first(y ORDER BY t_idx DESC) AS b FROM tr GROUP BY ALL),
p AS (SELECT {IDS}, t_idx, y FROM tr UNION ALL SELECT {IDS}, -i, a FROM e, range(1, 3) r(i) UNION ALL SELECT {IDS}, 359 + i, b FROM e, range(1, 3) r(i)),
q AS (SELECT {IDS}, t_idx, median(y) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM p)
SELECT {IDS}, CAST(t_idx AS INTEGER) AS t_idx, y FROM q WHERE t_idx BETWEEN 0 AND 359""")
def running_median_padded(spark, sf_dir):
    return S.padded_median(traces(spark, sf_dir), SEG, 5).select(*_OUT)


@query("moving_mean", TRACES_SQL + f" SELECT {IDS}, t_idx, CASE WHEN count(*) OVER w = count(y) OVER w THEN round(avg(y) OVER w, 6) END AS y FROM tr WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def moving_mean(spark, sf_dir):
    return rounded(S.moving_mean(traces(spark, sf_dir), SEG, 5).select(*_OUT), "y")


@query("hampel_filter", TRACES_SQL + f""", f AS (SELECT a.{IDS.replace(', ', ', a.')}, a.t_idx, a.y, median(b.y) AS med, count(b.y) AS n FROM tr a JOIN tr b
  ON a.subject_id = b.subject_id AND a.segment_label = b.segment_label AND b.t_idx BETWEEN a.t_idx - 5 AND a.t_idx + 5 GROUP BY ALL),
g AS (SELECT f.{IDS.replace(', ', ', f.')}, f.t_idx, f.y, f.med, f.n, 1.4826::DOUBLE * median(abs(b.y - f.med)) AS sigma FROM f JOIN tr b
  ON f.subject_id = b.subject_id AND f.segment_label = b.segment_label AND b.t_idx BETWEEN f.t_idx - 5 AND f.t_idx + 5 GROUP BY ALL)
SELECT {IDS}, t_idx, coalesce(n >= 3 AND sigma > 0 AND abs(y - med) > 3 * sigma, FALSE) AS outlier, CASE WHEN n >= 3 AND sigma > 0 AND abs(y - med) > 3 * sigma THEN med ELSE y END AS y FROM g""")
def hampel_filter(spark, sf_dir):
    return S.hampel(traces(spark, sf_dir), SEG).select(*SEG, "t_idx", "outlier", "y")


_NEAR = TRACES_SQL + f""", n AS (SELECT *, count(y) OVER (PARTITION BY {IDS}) AS n,
  last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, last_value(y IGNORE NULLS) OVER b AS py,
  first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS qt, first_value(y IGNORE NULLS) OVER a AS qy FROM tr
  WINDOW b AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {IDS}, t_idx, """
_LINE = "py + (qy - py) * (t - pt) / (qt - pt)"


@query("interpolate_hold", _NEAR + f"round(CASE WHEN y IS NOT NULL OR n < 2 THEN y WHEN pt IS NULL THEN qy WHEN qt IS NULL THEN py ELSE {_LINE} END, 6) AS y FROM n")
def interpolate_hold(spark, sf_dir):
    return rounded(S.interpolate(traces(spark, sf_dir), SEG).select(*_OUT), "y")


@query("interpolate_inner", _NEAR + f"round(CASE WHEN y IS NOT NULL OR n < 3 THEN y WHEN pt IS NULL OR qt IS NULL THEN NULL ELSE {_LINE} END, 6) AS y FROM n")
def interpolate_inner(spark, sf_dir):
    return rounded(S.interpolate(traces(spark, sf_dir), SEG, ends="null", least=3).select(*_OUT), "y")


@query("bridge_short_gaps", _NEAR + f"round(CASE WHEN y IS NOT NULL OR n < 2 THEN y WHEN qt - pt - 1 <= 2 THEN {_LINE} END, 6) AS y FROM n")
def bridge_short_gaps(spark, sf_dir):
    return rounded(S.interpolate(traces(spark, sf_dir), SEG, max_gap=2).select(*_OUT), "y")


@query("resample_grid", TRACES_SQL + f""", g AS (SELECT DISTINCT {IDS}, i * 2.5::DOUBLE AS t FROM tr, range(150) r(i)), v AS (SELECT {IDS}, t AS pt, y AS py FROM tr WHERE y IS NOT NULL),
a AS (SELECT g.{IDS.replace(', ', ', g.')}, g.t, v.pt, v.py FROM g ASOF LEFT JOIN v ON g.subject_id = v.subject_id AND g.segment_label = v.segment_label AND g.t >= v.pt),
b AS (SELECT a.*, v.pt AS qt, v.py AS qy FROM a ASOF LEFT JOIN v ON a.subject_id = v.subject_id AND a.segment_label = v.segment_label AND a.t <= v.pt)
SELECT {IDS}, t, round(CASE WHEN pt = qt THEN py ELSE {_LINE} END, 6) AS y FROM b""")
def resample_grid(spark, sf_dir):
    tr = traces(spark, sf_dir)
    grid = tr.select(*SEG).distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(149)), lambda i: i * 2.5)))
    return rounded(S.resample(tr, grid, SEG), "y")


@query("asof_forward", TRACES_SQL + f" SELECT {IDS}, first(y ORDER BY t_idx) AS y_at, min(t) AS t_at FROM tr WHERE t >= 69.5 GROUP BY ALL")
def asof_forward(spark, sf_dir):
    out = traces(spark, sf_dir).where("t >= 69.5").groupBy(*SEG)
    return out.agg(F.min_by("y", "t_idx").alias("y_at"), F.min("t").alias("t_at"))


@query("cycle_ranks", BIOMARKER_SQL + f"""SELECT {IDS}, cycle_index, round(dil_max - bd, 6) AS md,
  ['highest','middle','lowest','extra'][least(row_number() OVER (PARTITION BY {IDS} ORDER BY dil_max - bd DESC NULLS LAST, cycle_index), 4)] AS rank FROM one""")
def cycle_ranks(spark, sf_dir):
    table = B.biomarkers(traces(spark, sf_dir), P).select(*SEG, "cycle_index", F.col("dil_max_bc").alias("md"))
    return rounded(S.rank_cycles(table, SEG, "md"), "md")


_CUT = f"""SELECT {IDS}, t_idx, {{k}} AS cycle_index, t - {{fs}} AS t_rel, y - base AS y FROM (SELECT *, median(y) FILTER (t < {{fs}}) OVER (PARTITION BY {IDS}) AS base, count(y) OVER (PARTITION BY {IDS}) AS n
  FROM tr WHERE t >= {{fs}} - 10 AND t < {{fs}} + 70) WHERE base IS NOT NULL AND n >= 3"""


@query("cycle_cut", TRACES_SQL + f" SELECT {IDS}, t_idx, CAST(cycle_index AS INTEGER) AS cycle_index, t_rel, round(y, 6) AS y FROM ({over_cycles(_CUT)})")
def cycle_cut(spark, sf_dir):
    tr, out = traces(spark, sf_dir), None
    for c in P.cycles:
        part = S.cut_cycle(tr, c, SEG).select(*SEG, "t_idx", "cycle_index", "t_rel", "y")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "y")


@query("cycle_overlay", TRACES_SQL + f" SELECT segment_label, t_rel, round(avg(y), 6) AS mean, count(*) AS n, round(stddev_samp(y) / sqrt(count(*)), 6) AS sem FROM ({over_cycles(_CUT)}) GROUP BY ALL")
def cycle_overlay(spark, sf_dir):
    tr, out = traces(spark, sf_dir), None
    for c in P.cycles:
        part = S.cut_cycle(tr, c, SEG).select("segment_label", "t_rel", "y")
        out = part if out is None else out.unionByName(part)
    return rounded(S.overlay(out, ["segment_label"]), "mean", "sem")


_STACK = f"SELECT {IDS}, t_idx, {{k}} AS cycle_index, CAST(t - {{bs}} AS INTEGER) AS off, y, median(y) FILTER (t < {{be}}) OVER (PARTITION BY {IDS}) AS base FROM {{{{src}}}} WHERE t >= {{bs}} AND t < {{re}}"


def _stack(src: str) -> str:
    return over_cycles(_STACK).replace("{src}", src)


@query("cycle_template", TRACES_SQL + f", st AS ({_stack('tr')}) SELECT {IDS}, off AS \"offset\", median(y) AS y FROM st GROUP BY ALL")
def cycle_template(spark, sf_dir):
    return S.cycle_template(S.stack_cycles(traces(spark, sf_dir), P, SEG), SEG)


@query("kotliar_template", TRACES_SQL + f""", st AS ({_stack('tr')}),
te AS (SELECT {IDS}, off, median(CASE WHEN base <> 0 THEN 100 * ((y - base) / base) END) AS y FROM st GROUP BY ALL),
sm AS (SELECT {IDS}, off, CASE WHEN off < 98 THEN median(y) OVER (PARTITION BY {IDS} ORDER BY off ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) END AS y FROM te)
SELECT {IDS.replace('subject', 'tr.subject').replace('visit_id', 'tr.visit_id').replace('segment_label', 'tr.segment_label')}, tr.t_idx, round(sm.y, 6) AS y FROM tr LEFT JOIN st USING ({IDS}, t_idx) LEFT JOIN sm USING ({IDS}, off)""")
def kotliar_template(spark, sf_dir):
    return rounded(D.kotliar_template(traces(spark, sf_dir), P).select(*_OUT), "y")


@query("kotliar_smooth", TRACES_SQL + f""", pc AS (SELECT {IDS}, t_idx, 100 * ((y - b) / b) AS y FROM (SELECT *, median(y) FILTER (t < 20) OVER (PARTITION BY {IDS}) AS b FROM tr))
SELECT {IDS}, t_idx, round(CASE WHEN t_idx < 358 THEN median(y) OVER ({_W} ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) END, 6) AS y FROM pc""")
def kotliar_smooth(spark, sf_dir):
    return rounded(D.kotliar_smooth(traces(spark, sf_dir), P).select(*_OUT), "y")


_SMS = TRACES_SQL + f""", m AS (SELECT * EXCLUDE y, median(y) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM tr),
s AS (SELECT * EXCLUDE (y, b), 100 * ((y - b) / b) AS y FROM (SELECT *, median(y) FILTER (t < 20) OVER (PARTITION BY {IDS}) AS b FROM m))"""


@query("sms", _SMS + f" SELECT {IDS}, t_idx, round(y, 6) AS y FROM s")
def sms(spark, sf_dir):
    return rounded(D.sms(traces(spark, sf_dir), P).select(*_OUT), "y")


@query("sms_average", _SMS + f""", st AS ({_stack('s')}), te AS (SELECT {IDS}, off, median(y) AS v FROM st GROUP BY ALL)
SELECT {IDS.replace('subject', 's.subject').replace('visit_id', 's.visit_id').replace('segment_label', 's.segment_label')}, s.t_idx, round(te.v, 6) AS y FROM s LEFT JOIN st USING ({IDS}, t_idx) LEFT JOIN te USING ({IDS}, off)""")
def sms_average(spark, sf_dir):
    return rounded(D.sms_average(traces(spark, sf_dir), P).select(*_OUT), "y")


@query("autocorrelation", TRACES_SQL + f""", c AS (SELECT *, y - avg(y) OVER (PARTITION BY {IDS}) AS c FROM tr WHERE y IS NOT NULL), l AS (SELECT *, lag(c) OVER ({_W}) AS l FROM c)
SELECT {IDS}, round(avg(c * l) / avg(c * c), 6) AS ac1 FROM l GROUP BY ALL""")
def autocorrelation(spark, sf_dir):
    return rounded(S.autocorrelation(traces(spark, sf_dir), SEG), "ac1")


@query("differences", TRACES_SQL + f""" SELECT {IDS}, t_idx, round(y - lag(y) OVER ({_W}), 6) AS d, round(sum(y) OVER ({_W} ROWS UNBOUNDED PRECEDING), 6) AS cum, CAST((t_idx + 7) % 360 AS INTEGER) AS shifted FROM tr""")
def differences(spark, sf_dir):
    order = W.partitionBy(*SEG).orderBy("t_idx")
    tr = traces(spark, sf_dir).withColumns({"d": F.col("y") - F.lag("y").over(order), "cum": F.sum("y").over(order.rowsBetween(W.unboundedPreceding, 0)), "at": F.col("t_idx")})
    out = S.shift(tr, SEG, 7).select(*SEG, F.col("at").alias("t_idx"), "d", "cum", F.col("t_idx").alias("shifted"))
    return rounded(out, "d", "cum")


@query("dark_frames", TRACES_SQL + f" SELECT {IDS}, t_idx FROM tr WHERE NOT (t >= 50 AND t < 70 AND (t_idx - 50) % 2 <> 0 OR t >= 150 AND t < 170 AND (t_idx - 150) % 2 <> 0 OR t >= 250 AND t < 270 AND (t_idx - 250) % 2 <> 0)")
def dark_frames(spark, sf_dir):
    """Every second flicker frame stays, as at a camera rate of half the sampling rate."""
    return traces(spark, sf_dir).withColumn("keep", S.dark_frames(traces(spark, sf_dir), P, SEG, rate=0.5)).where("keep").select(*SEG, "t_idx")


@query("holm", """WITH p AS (SELECT l_suppkey % 7 AS family, l_partkey AS k, round(least(1, avg(l_discount) * avg(l_tax) * 10), 9) AS p FROM lineitem GROUP BY ALL)
SELECT family, k, p, round(least(max(s) OVER (PARTITION BY family ORDER BY p, k ROWS UNBOUNDED PRECEDING), 1), 9) AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, k) + 1) * p AS s FROM p)""")
def holm(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("family"), F.col("l_partkey").alias("k"))
    p = t.agg(F.round(F.least(F.lit(1.0), F.avg("l_discount") * F.avg("l_tax") * 10), 9).alias("p"))
    return S.holm(p, "p", ["family"]).withColumn("p_holm", F.round("p_holm", 9))


def _fit_sql(source: str, degree: int = 4) -> str:
    """Relations for a least-squares fit over ``source`` (ids, t_idx, u, y): orthogonal polynomials of u built one after the other, where y is there."""
    part, on = f"OVER (PARTITION BY {IDS})", "FILTER (y IS NOT NULL)"
    steps = [f"{source}_0 AS (SELECT *, 1.0::DOUBLE AS q0, count(y) {part} AS n FROM {source})"]
    for k in range(degree):
        mean = f"sum(u * q{k} * q{k}) {on} {part} / sum(q{k} * q{k}) {on} {part}"
        less = f" - sum(q{k} * q{k}) {on} {part} / sum(q{k - 1} * q{k - 1}) {on} {part} * q{k - 1}" if k else ""
        steps.append(f"{source}_{k + 1} AS (SELECT *, (u - {mean}) * q{k}{less} AS q{k + 1} FROM {source}_{k})")
    value = " + ".join(f"sum(y * q{k}) {on} {part} / sum(q{k} * q{k}) {on} {part} * q{k}" for k in range(degree + 1))
    return ", ".join([*steps, f"{source}_fit AS (SELECT {IDS}, t_idx, CASE WHEN n > {degree} THEN {value} END AS y FROM {source}_{degree})"])


def _scaled_sql(base: str, where: str) -> str:
    """Percent of the median over ``base``, and time scaled to -1 .. 1 over the rows of ``where``."""
    return f"""SELECT {IDS}, t_idx, 100 * ((y - b) / b) AS y, 2 * (t - min(t) OVER (PARTITION BY {IDS})) / (max(t) OVER (PARTITION BY {IDS}) - min(t) OVER (PARTITION BY {IDS})) - 1 AS u
    FROM (SELECT *, median(y) FILTER ({base}) OVER (PARTITION BY {IDS}) AS b FROM tr) WHERE {where}"""


@query("polynomial_global", TRACES_SQL + f", g AS ({_scaled_sql('t < 20', 'TRUE')}), {_fit_sql('g')} SELECT {IDS}, t_idx, round(y, 4) + 0 AS y FROM g_fit")
def polynomial_global(spark, sf_dir):
    return _four(D.polynomial(traces(spark, sf_dir), P).select(*_OUT))


def _cycle_fits_sql() -> str:
    parts = [f"c{c.index} AS ({_scaled_sql(f't >= {c.flicker.start - 30} AND t < {c.flicker.start - 5}', f't >= {c.baseline.start} AND t < {c.recovery.end}')}), {_fit_sql(f'c{c.index}')}" for c in P.cycles]
    both = " UNION ALL ".join(f"SELECT * FROM c{c.index}_fit" for c in P.cycles)
    return f"{', '.join(parts)}, f AS ({both})"


@query("polynomial_per_cycle", TRACES_SQL + f", {_cycle_fits_sql()} SELECT {IDS}, t_idx, round(f.y, 4) + 0 AS y FROM (SELECT {IDS}, t_idx FROM tr) LEFT JOIN f USING ({IDS}, t_idx)")
def polynomial_per_cycle(spark, sf_dir):
    return _four(D.polynomial(traces(spark, sf_dir), P, per_cycle=True).select(*_OUT))


@query("joint_loci", CELLS_SQL + """, v AS (SELECT *, vessel_type AS grp, (CASE segment_label WHEN 'A1' THEN 0 WHEN 'A2' THEN 1 WHEN 'V3' THEN 0 ELSE 1 END) * 5 + locus AS g FROM cells)
SELECT subject_id, visit_id, vessel_type, t_idx, count(*) AS n_loci, CAST(max(g) AS INTEGER) AS last_locus, median(x) AS y FROM v GROUP BY ALL""")
def joint_loci(spark, sf_dir):
    """Segments of one recording and vessel side by side on their common time grid, with loci numbered through."""
    from ..operators.denoise import joint

    out = joint(cells(spark, sf_dir)).groupBy("subject_id", "visit_id", "vessel_type", "t_idx")
    return out.agg(F.count("*").alias("n_loci"), F.max("joint_locus").cast("int").alias("last_locus"), F.median("x").alias("y"))
