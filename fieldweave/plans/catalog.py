"""Registered queries over the test tables, with the SQL they are held against.

SQL is exact up to the Gram matrix; eigenpairs are compared where two blocks (or two snapshots) give a closed form, and
only in phase-free quantities.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import block_share, hamming, tidy
from ..operators import blocks, emulation, fields, lookup, modal, pod, reductions, weights
from ..streaming import spod as streaming
from . import samples
from .params import SpodParams

STD = SpodParams(n_dft=64, time_step=1.0, overlap=50.0)
TWO = SpodParams(n_dft=360, time_step=1.0)
SMOKE = SpodParams(n_dft=24, time_step=6.0, overlap=50.0)
HOURS = 720
#: The bin and mode in which two-block coefficients are compared.
BIN = 10

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _out(df: DataFrame, digits: int = 6, **kinds) -> DataFrame:
    """Doubles rounded; other columns cast as named."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        cols.append((tidy(c, digits) if kind == "double" else c.cast(kinds.get(name, kind))).alias(name))
    return df.select(*cols)


def _off_ties(df: DataFrame) -> DataFrame:
    """Means of cents over powers of two end in an exact 5; both sides add a little before rounding."""
    return df.withColumn("mu", F.col("mu") + F.lit(1.3e-8))


# --- SQL building blocks ----------------------------------------------------------------------------------------

_CASE_EVENT = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(samples.EVENT_TYPES)) + " END"


def _events(hours: int = 1, two: bool = False) -> str:
    nt, nv = 720 // hours, 2 if two else 1
    return f"""WITH sums AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // {hours} AS t, {_CASE_EVENT} AS x, sum(value) AS s, count(*)::DOUBLE AS c
  FROM events GROUP BY 1, 2),
field AS (SELECT a.t::BIGINT AS t, b.x::BIGINT AS x, c.v::INTEGER AS v, coalesce(CASE WHEN c.v = 0 THEN s.s ELSE s.c END, 0.0)::DOUBLE AS val
  FROM range({nt}) a(t) CROSS JOIN range(5) b(x) CROSS JOIN range({nv}) c(v) LEFT JOIN sums s ON s.t = a.t AND s.x = b.x)"""


def _daily() -> str:
    case = "CASE l_returnflag || l_linestatus " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(samples.FLAGS)) + " END"
    return f"""WITH sums AS (SELECT date_diff('day', TIMESTAMP '1995-01-02 00:00:00', l_shipdate) AS t, {case} AS x, sum(l_quantity) AS s0, sum(l_extendedprice) AS s1, sum(l_discount) AS s2, sum(l_tax) AS s3
  FROM lineitem GROUP BY 1, 2),
field AS (SELECT a.t::BIGINT AS t, b.x::BIGINT AS x, c.v::INTEGER AS v, coalesce(CASE c.v WHEN 0 THEN s.s0 WHEN 1 THEN s.s1 WHEN 2 THEN s.s2 ELSE s.s3 END, 0.0)::DOUBLE AS val
  FROM range({samples.DAYS}) a(t) CROSS JOIN range(6) b(x) CROSS JOIN range(4) c(v) LEFT JOIN sums s ON s.t = a.t AND s.x = b.x)"""


def _embedded() -> str:
    return """WITH field AS (SELECT vec_id AS t, (i - 1)::BIGINT AS x, 0::INTEGER AS v, embedding[i]::DOUBLE AS val
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


_MU = ", mu AS (SELECT x, v, avg(val) AS mu FROM field GROUP BY x, v)"


def _w(n: str, size: int) -> str:
    return f"(0.54 - 0.46 * cos(2 * pi() * {n} / {size - 1}.0))"


def _tapered(p: SpodParams, mean: str = "longtime", variance: bool = False) -> str:
    nb = p.n_blocks(HOURS)
    sql = f"{_MU}, raw AS (SELECT r.b::INTEGER AS b, (t - r.b * {p.step})::INTEGER AS n, x, v, val FROM field JOIN range({nb}) r(b) ON t >= r.b * {p.step} AND t < r.b * {p.step} + {p.n_dft})"
    sql += ", bm AS (SELECT b, x, v, avg(val) AS mu FROM raw GROUP BY b, x, v)"
    if mean == "longtime":
        sql += ", cen AS (SELECT b, n, x, v, val - mu AS val FROM raw JOIN mu USING (x, v))"
    elif mean == "blockwise":
        sql += ", cen AS (SELECT b, n, x, v, val - mu AS val FROM raw JOIN bm USING (b, x, v))"
    else:
        sql += ", cen AS (SELECT * FROM raw)"
    sql += ", bv AS (SELECT b, x, v, CASE WHEN var_samp(val) < 8.881784197001252e-16 THEN 1.0 ELSE var_samp(val) END AS s2 FROM cen GROUP BY b, x, v)"
    over = "val / s2" if variance else "val"
    return sql + f", tap AS (SELECT b, n, x, v, {over} * {_w('n', p.n_dft)} AS val FROM cen JOIN bv USING (b, x, v))"


def _qhat(p: SpodParams) -> str:
    angle = f"2 * pi() * ((f * n) % {p.n_dft}) / {p.n_dft}"
    return f", qhat AS (SELECT f::INTEGER AS f, b, x, v, sum(val * cos({angle})) * {p.gain!r} / {p.n_dft} AS re, -sum(val * sin({angle})) * {p.gain!r} / {p.n_dft} AS im FROM tap CROSS JOIN range({p.n_freq}) r(f) GROUP BY 1, 2, 3, 4)"


def _gram(p: SpodParams) -> str:
    nb = p.n_blocks(HOURS)
    return f", gram AS (SELECT a.f, a.b AS b1, c.b AS b2, sum(a.re * c.re + a.im * c.im) / {nb} AS re, sum(a.re * c.im - a.im * c.re) / {nb} AS im FROM qhat a JOIN qhat c ON a.f = c.f AND a.x = c.x AND a.v = c.v AND a.b <= c.b GROUP BY 1, 2, 3)"


def _closed(p: SpodParams = TWO) -> str:
    """Eigenpairs of the 2 x 2 matrices and the modes they give."""
    return f"""{_events()}{_tapered(p)}{_qhat(p)}{_gram(p)},
g AS (SELECT f, sum(CASE WHEN b1 = 0 AND b2 = 0 THEN re END) AS a, sum(CASE WHEN b1 = 1 THEN re END) AS d, sum(CASE WHEN b1 = 0 AND b2 = 1 THEN re END) AS br, sum(CASE WHEN b1 = 0 AND b2 = 1 THEN im END) AS bi FROM gram GROUP BY f),
e AS (SELECT f, m::INTEGER AS m, a, br, bi, (a + d + (1 - 2 * m) * sqrt((a - d) * (a - d) + 4 * (br * br + bi * bi))) / 2 AS lam FROM g CROSS JOIN range(2) r(m)),
vec AS (SELECT f, m, lam, br, bi, lam - a AS c, br * br + bi * bi + (lam - a) * (lam - a) AS n2 FROM e),
phi AS (SELECT f, m, p.x, p.v, (p.re * br - p.im * bi + q.re * c) / sqrt(2 * lam * n2) AS re, (p.re * bi + p.im * br + q.im * c) / sqrt(2 * lam * n2) AS im
  FROM vec JOIN qhat p USING (f) JOIN qhat q USING (f) WHERE p.b = 0 AND q.b = 1 AND p.x = q.x AND p.v = q.v)"""


def _r(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0"


# --- Spark building blocks --------------------------------------------------------------------------------------


def _std(s: SparkSession, d: str, p: SpodParams = STD):
    f = samples.events(s, d)
    return f, blocks.spectra(f, p, HOURS)


def _two(s: SparkSession, d: str):
    """(field, weights, spectra, eigenpairs, modes) of the two-block set."""
    f = samples.events(s, d)
    w = weights.uniform(s, 5)
    q = blocks.spectra(f, TWO, HOURS).persist()
    pairs = modal.eigen(modal.gram(q, w, 2), 2).persist()
    return f, w, q, pairs, modal.modes(q, pairs, 2)


def _one_mode(s: SparkSession, d: str):
    f, w, _, _, phi = _two(s, d)
    return f, w, modal.numbered(phi, BIN, BIN, 1).persist(), reductions.longtime_mean(f)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, freq, power): mean over blocks of the summed squared transforms of the 6-hourly event field."""
    f = samples.events(spark, sf_dir, hours=6)
    q = blocks.spectra(f, SMOKE, 120)
    power = q.groupBy("f").agg((F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / SMOKE.n_blocks(120)).alias("power"))
    return blocks.frequency_axis(spark, SMOKE).join(power, "f").orderBy("f")


# --- fields ----------------------------------------------------------------------------------------------------

_FIELD = f"SELECT t, x, v, {_r('val')} AS val FROM field"
_register("field_events_hourly", f"{_events()} {_FIELD}")(lambda s, d: _out(samples.events(s, d)))
_register("field_events_6h", f"{_events(6)} {_FIELD}")(lambda s, d: _out(samples.events(s, d, hours=6)))
_register("field_events_2v", f"{_events(1, True)} {_FIELD}")(lambda s, d: _out(samples.events(s, d, two=True)))
_register("field_lineitem_daily", f"{_daily()} SELECT t, x, v, {_r('val', 2)} AS val FROM field")(lambda s, d: _out(samples.lineitem_daily(s, d), 2))
_register("field_embeddings", f"{_embedded()} {_FIELD}")(lambda s, d: _out(samples.embeddings(s, d)))
_register("time_slice", f"{_events()} {_FIELD} WHERE t >= 100 AND t < 200")(lambda s, d: _out(fields.time_slice(samples.events(s, d), 100, 200)))
_register("time_stride", f"{_events()} {_FIELD} WHERE t % 4 = 0")(lambda s, d: _out(fields.time_subset(samples.events(s, d), "quarter", HOURS)))
_register("time_list", f"{_events()} {_FIELD} WHERE t IN (0, 7, 719)")(lambda s, d: _out(fields.time_subset(samples.events(s, d), [0, 7, 719], HOURS)))
_register("variable_select", f"{_daily()} SELECT t, x, v, {_r('val', 2)} AS val FROM field WHERE v IN (0, 2)")(lambda s, d: _out(fields.select_variables(samples.lineitem_daily(s, d), [0, 2]), 2))
_register("dataset_concat", f"{_events()} SELECT t, x, v, {_r('val')} AS val FROM field UNION ALL SELECT t + {HOURS}, x, v, {_r('val')} FROM field")(lambda s, d: _out(fields.concat([(samples.events(s, d), HOURS), (samples.events(s, d), HOURS)])))
_register("flatten_index", f"{_events(1, True)} SELECT t, x * 2 + v AS k, {_r('val')} AS val FROM field")(lambda s, d: _out(fields.flatten_index(samples.events(s, d, two=True), 2).select("t", "k", "val")))

# --- reductions ------------------------------------------------------------------------------------------------

_register("longtime_mean", f"{_events()} SELECT x, v, {_r('avg(val)')} AS mu FROM field GROUP BY x, v")(lambda s, d: _out(reductions.longtime_mean(samples.events(s, d))))
_register("block_mean", f"{_events()}{_tapered(STD)} SELECT b, x, v, {_r('mu + 1.3e-8')} AS mu FROM bm")(lambda s, d: _out(_off_ties(reductions.block_mean(blocks.segment(samples.events(s, d), STD, HOURS)))))
_register("block_variance", f"{_events()}{_tapered(STD, 'zero')} SELECT b, x, v, {_r('s2', 4)} AS var FROM bv")(lambda s, d: _out(reductions.block_variance(blocks.segment(samples.events(s, d), STD, HOURS)), 4))
_register("variable_variance", f"{_daily()} SELECT v, {_r('var_pop(val)', 1)} AS var FROM field GROUP BY v")(lambda s, d: _out(reductions.variable_variance(samples.lineitem_daily(s, d)), 1))
_ERR = f"{_events()}, e AS (SELECT t, x, val, 0.5 * val + 1 AS r FROM field)"
_norms = "SELECT 'l1' AS norm, {0} AS error FROM e UNION ALL SELECT 'l2', {1} FROM e UNION ALL SELECT 'linf', {2} FROM e"


def _norm_rows(s, d, suffix=""):
    f = samples.events(s, d)
    ref = f.withColumn("val", 0.5 * F.col("val") + 1)
    parts = [reductions.l_errors(f, ref, n + suffix).select(F.lit(n).alias("norm"), tidy(F.col("error")).alias("error")) for n in ("l1", "l2", "linf")]
    return parts[0].union(parts[1]).union(parts[2])


_register("norms_l", f"{_ERR} {_norms.format(_r('avg(abs(val - r))'), _r('sqrt(sum((val - r) * (val - r))) / count(*)'), _r('max(abs(val - r))'))}")(lambda s, d: _norm_rows(s, d))
_register("norms_l_rel", f"{_ERR} {_norms.format(_r('avg(abs(val - r) / r)'), _r('sqrt(sum((val - r) * (val - r) / (r * r))) / count(*)'), _r('max(abs(val - r) / r)'))}")(lambda s, d: _norm_rows(s, d, "_rel"))
_register("norm_h1", f"{_ERR}, st AS (SELECT t, coalesce(((val - r) - lag(val - r) OVER (PARTITION BY x ORDER BY t)) / 0.5, 0.0) AS dd FROM e), tt AS (SELECT t, sum(dd) AS q FROM st GROUP BY t) SELECT {_r('sqrt(sum(0.5 * q * q))', 4)} AS error FROM tt")(
    lambda s, d: _out(reductions.h1_error(samples.events(s, d), samples.events(s, d).withColumn("val", 0.5 * F.col("val") + 1), 0.5), 4)
)


def _series(s, d):
    return samples.events(s, d).select(F.col("x").alias("k"), "t", F.col("val").alias("re"), (-F.col("val") / 2).alias("im"))


_register("scaler_local", f"{_events()} SELECT x AS k, {_r('10 * max(abs(val))')} AS s_re, {_r('5 * max(abs(val))')} AS s_im FROM field GROUP BY x")(lambda s, d: _out(emulation.scaler(_series(s, d))))
_register("scaler_global", f"{_events()}, m AS (SELECT max(abs(val)) AS q FROM field) SELECT DISTINCT x AS k, {_r('q')} AS s_re, {_r('q / 2')} AS s_im FROM field CROSS JOIN m")(lambda s, d: _out(emulation.scaler(_series(s, d), "globalmax")))
_register("scale_data", f"{_events()}, m AS (SELECT x, 10 * max(abs(val)) AS q FROM field GROUP BY x) SELECT x AS k, t, {_r('val / q')} AS re, {_r('-(val / 2) / (q / 2)')} AS im FROM field JOIN m USING (x)")(lambda s, d: _out(emulation.scale(_series(s, d), emulation.scaler(_series(s, d)))))
_register("descale_data", f"{_events()} SELECT x AS k, t, {_r('val', 5)} AS re, {_r('-val / 2', 5)} AS im FROM field")(
    lambda s, d: _out(emulation.scale(emulation.scale(_series(s, d), emulation.scaler(_series(s, d))), emulation.scaler(_series(s, d)), back=True), 5)
)

# --- windows ---------------------------------------------------------------------------------------------------

_register("hamming", f"SELECT n::INTEGER AS n, {_r(_w('n', 64), 9)} AS w FROM range(64) r(n)")(lambda s, d: _out(blocks.hamming_table(s, STD), 9))
_register("window_gain", f"SELECT {_r('1 / avg(' + _w('n', 64) + ')', 9)} AS gain FROM range(64) r(n)")(lambda s, d: s.range(64).agg(tidy(1 / F.avg(hamming(F.col("id"), 64)), 9).alias("gain")))
_register("block_offsets", "SELECT b::INTEGER AS b, b * 32 AS \"offset\" FROM range(21) r(b)")(lambda s, d: blocks.block_offsets(s, STD, HOURS))
_register("blocks", f"{_events()}{_tapered(STD)} SELECT b, n, x, v, {_r('val')} AS val FROM raw")(lambda s, d: _out(blocks.segment(samples.events(s, d), STD, HOURS)))
_register("blocks_tapered", f"{_events()}{_tapered(STD)} SELECT b, n, x, v, {_r('val')} AS val FROM tap")(lambda s, d: _out(blocks.preprocess(samples.events(s, d), STD, HOURS)))
_TRACE = ", tr AS (SELECT f, sum(re) AS val FROM gram WHERE b1 = b2 GROUP BY f)"
#: The hourly event field with a tide of eight hours, so that its spectrum has a peak at every scale.
_TIDE = _events().replace("field AS (SELECT", "calm AS (SELECT") + ", field AS (SELECT t, x, v, val * (1 + cos(2 * pi() * (t % 8) / 8.0)) AS val FROM calm)"
_PEAK_ROWS = f"""{_TIDE}{_tapered(STD)}{_qhat(STD)}{_gram(STD)}{_TRACE},
s AS (SELECT f, f / 64.0 AS freq, val, avg(val) OVER (ORDER BY f ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mean, lag(val) OVER (ORDER BY f) AS up, lead(val) OVER (ORDER BY f) AS down FROM tr),
p AS (SELECT f, freq, val FROM s WHERE f > 0 AND val > 1.5 * mean AND (up IS NULL OR val > up) AND (down IS NULL OR val > down)
  AND val = (SELECT max(o.val) FROM s o WHERE o.freq BETWEEN s.freq * 0.9 AND s.freq * 1.1))"""
_PEAKS = f"{_PEAK_ROWS} SELECT f, freq, {_r('val', 4)} AS val FROM p"
_REPORT = f"""{_PEAK_ROWS}, h AS (SELECT *, 1 / freq AS hours FROM p)
SELECT f, freq, {_r('val', 4)} AS val, {_r('CASE WHEN hours >= 8766 THEN hours / 8766 WHEN hours >= 730.5 THEN hours / 730.5 WHEN hours >= 24 THEN hours / 24 WHEN hours >= 1 THEN hours ELSE hours * 60 END')} AS period,
  CASE WHEN hours >= 8766 THEN 'years' WHEN hours >= 730.5 THEN 'months' WHEN hours >= 24 THEN 'days' WHEN hours >= 1 THEN 'hours' ELSE 'minutes' END AS unit FROM h"""


def _trace_series(s, d):
    tide = samples.events(s, d).withColumn("val", F.col("val") * (1 + F.cos(F.lit(2 * math.pi) * (F.col("t") % 8) / 8.0)))
    q = blocks.spectra(tide, STD, HOURS)
    return modal.traces(modal.gram(q, weights.uniform(s, 5), 21)).select("f", (F.col("f") / 64.0).alias("freq"), F.col("trace").alias("val"))


_register("peaks", _PEAKS)(lambda s, d: lookup.peaks(_trace_series(s, d)).select("f", "freq", tidy(F.col("val"), 4).alias("val")))
_SEQ = f"""{_events()}, q AS (SELECT x AS k, row_number() OVER w - 1 AS "row", list(val) OVER (PARTITION BY x ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS xs, list(val) OVER (PARTITION BY x ORDER BY t ROWS BETWEEN 4 FOLLOWING AND 5 FOLLOWING) AS ys FROM field WINDOW w AS (PARTITION BY x ORDER BY t))
SELECT k, "row", {_r('xs[1]')} AS x_first, {_r('xs[3]')} AS x_last, {_r('ys[1]')} AS y_first, {_r('ys[2]')} AS y_last FROM q WHERE "row" < {HOURS} - 3 - 2 - 2 + 1"""
_register("sequences", _SEQ)(
    lambda s, d: _out(emulation.sequences(samples.events(s, d).select(F.col("x").alias("k"), "t", "val"), 3, 2, 2).select("k", F.col("row").cast("long").alias("row"), F.get("x", F.lit(0)).alias("x_first"), F.get("x", F.lit(2)).alias("x_last"), F.get("y", F.lit(0)).alias("y_first"), F.get("y", F.lit(1)).alias("y_last")))
)

# --- spectra ---------------------------------------------------------------------------------------------------

_register("freq_axis_real", f"SELECT f::INTEGER AS f, {_r('f / 64.0', 9)} AS freq FROM range(33) r(f)")(lambda s, d: _out(blocks.frequency_axis(s, STD), 9))
_register("freq_axis_full", f"SELECT f::INTEGER AS f, {_r('f / 64.0', 9)} AS freq FROM range(64) r(f)")(lambda s, d: _out(blocks.frequency_axis(s, STD.with_(fullspectrum=True)), 9))
_register("freq_axis_complex", f"SELECT f::INTEGER AS f, {_r('CASE WHEN 2 * f >= 65 THEN f / 65.0 - 1 ELSE f / 65.0 END', 9)} AS freq FROM range(65) r(f)")(lambda s, d: _out(blocks.frequency_axis(s, STD.with_(n_dft=65, complex_data=True)), 9))
_SPEC = f"SELECT f, b, x, v, {_r('re')} AS re, {_r('im')} AS im FROM qhat"


def _dft(p: SpodParams, slow: bool = False):
    def run(s, d):
        f = samples.events(s, d)
        return _out(blocks.dft(blocks.preprocess(f, p, HOURS), p) if slow else blocks.spectra(f, p, HOURS))

    return run


_FULL = STD.with_(fullspectrum=True)
_register("dft_onesided", f"{_events()}{_tapered(STD)}{_qhat(STD)} {_SPEC}")(_dft(STD))
_register("dft_by_aggregation", f"{_events()}{_tapered(STD)}{_qhat(STD)} {_SPEC}")(_dft(STD, slow=True))
_register("dft_full", f"{_events()}{_tapered(STD)}{_qhat(_FULL)} {_SPEC}")(_dft(_FULL))
_register("dft_blockwise", f"{_events()}{_tapered(STD, 'blockwise')}{_qhat(STD)} {_SPEC}")(_dft(STD.with_(mean_type="blockwise")))
_register("dft_zero_mean", f"{_events()}{_tapered(STD, 'zero')}{_qhat(STD)} {_SPEC}")(_dft(STD.with_(mean_type="zero")))
_register("dft_normalized", f"{_events()}{_tapered(STD, 'longtime', True)}{_qhat(STD)} {_SPEC}")(_dft(STD.with_(normalize_data=True)))
_register(
    "energy_spectrum",
    f"{_events()}, e AS (SELECT k, 0.5 * pow(sum(val * cos(2 * pi() * ((k * t) % {HOURS}) / {HOURS})) / {HOURS}, 2) AS e FROM field CROSS JOIN range({HOURS}) r(k) WHERE x = 0 GROUP BY k) SELECT a.k::INTEGER AS k, {_r('CASE WHEN a.k = 0 THEN 0.0 ELSE 0.5 * (a.e + b.e) END')} AS e FROM e a LEFT JOIN e b ON b.k = {HOURS} - a.k WHERE a.k < {HOURS // 2}",
)(lambda s, d: _out(blocks.energy_spectrum(samples.events(s, d).where("x = 0").select("t", F.col("val").alias("u")), HOURS)))

# --- modal -----------------------------------------------------------------------------------------------------

_STDG = f"{_events()}{_tapered(STD)}{_qhat(STD)}{_gram(STD)}"
_register("gram", f"{_STDG} SELECT f, b1, b2, {_r('re', 5)} AS re, {_r('im', 5)} AS im FROM gram")(lambda s, d: _out(modal.gram(_std(s, d)[1], weights.uniform(s, 5), 21), 5))
_register("gram_by_parts", f"{_STDG} SELECT f, b1, b2, {_r('re', 5)} AS re, {_r('im', 5)} AS im FROM gram")(lambda s, d: _out(modal.gram_partial(_std(s, d)[1], weights.uniform(s, 5), 21, 4), 5))
_register("trace_spectrum", f"{_STDG}{_TRACE} SELECT f, {_r('val', 4)} AS trace FROM tr")(lambda s, d: _out(modal.traces(modal.gram(_std(s, d)[1], weights.uniform(s, 5), 21)), 4))
_register("frobenius_spectrum", f"{_STDG} SELECT f, {_r('sum((re * re + im * im) * CASE WHEN b1 = b2 THEN 1 ELSE 2 END)', 2)} AS fro2 FROM gram GROUP BY f")(lambda s, d: _out(modal.frobenius(modal.gram(_std(s, d)[1], weights.uniform(s, 5), 21)), 2))
_register("eigenvalue_sums", f"{_STDG}{_TRACE} SELECT f, {_r('val', 4)} AS total FROM tr")(lambda s, d: _out(modal.eigen(modal.gram(_std(s, d)[1], weights.uniform(s, 5), 21), 21).where("b = 0").groupBy("f").agg(F.sum("lam").alias("total")), 4))
_DOUBLED = "CASE WHEN f > 0 AND f < 180 THEN 2 * lam ELSE lam END"
_register("eigs_two_block", f"{_closed()} SELECT f, m, {_r(_DOUBLED, 5)} AS lam FROM e")(lambda s, d: _out(modal.eigenvalues(_two(s, d)[3], TWO, 2).select("f", "m", "lam"), 5))
# The factors are 2 / 4.743864518 and 2 / 0.355361510: the 95 % and 5 % quantiles of the gamma distribution with shape 2.
_register("eigs_ci_two_block", f"{_closed()} SELECT f, m, {_r('(' + _DOUBLED + ') * 2 / 4.743864518390575', 4)} AS lam_lo, {_r('(' + _DOUBLED + ') * 2 / 0.35536151069866184', 4)} AS lam_hi FROM e")(
    lambda s, d: _out(modal.eigenvalues(_two(s, d)[3], TWO, 2).select("f", "m", "lam_lo", "lam_hi"), 4)
)
_register("modes_abs_two_block", f"{_closed()} SELECT f, m, x, v, {_r('re * re + im * im', 5)} AS mag2 FROM phi")(lambda s, d: _two(s, d)[4].select("f", "m", "x", "v", tidy(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 5).alias("mag2")))
_register("modes_at_frequency", f"{_closed()} SELECT f, m, x, v, {_r('re * re + im * im', 5)} AS mag2 FROM phi WHERE f = {BIN}")(lambda s, d: _two(s, d)[4].where(F.col("f") == BIN).select("f", "m", "x", "v", tidy(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 5).alias("mag2")))


@_register("orthogonality", "SELECT 0 AS m1, 0 AS m2, true AS ok UNION ALL SELECT 0, 1, true UNION ALL SELECT 1, 1, true")
def _orthogonal(s, d):
    _, w, _, _, phi = _two(s, d)
    rows = [modal.orthogonality(phi, w, BIN, a, b).select(F.lit(a).alias("m1"), F.lit(b).alias("m2"), "ok") for a, b in ((0, 0), (0, 1), (1, 1))]
    return rows[0].union(rows[1]).union(rows[2])


_COEF = f"{_closed()}, one AS (SELECT x, v, re, im FROM phi WHERE f = {BIN} AND m = 0), co AS (SELECT t, sum(re * (val - mu)) AS ar, -sum(im * (val - mu)) AS ai FROM field JOIN mu USING (x, v) JOIN one USING (x, v) GROUP BY t)"


def _coeffs(s, d):
    f, w, phi, mu = _one_mode(s, d)
    return modal.oblique_coefficients(f, phi, w, mu), phi, mu


_register("coeffs_two_block", f"{_COEF} SELECT t, {_r('ar * ar + ai * ai', 5)} AS power FROM co")(lambda s, d: _coeffs(s, d)[0].select("t", tidy(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 5).alias("power")))


def _reconstructed(s, d):
    a, phi, mu = _coeffs(s, d)
    return _out(modal.reconstruct(fields.time_subset(a, "tenth", HOURS), phi, mu).select("t", "x", "v", "re"), 5)


_register("reconstruct_two_block", f"{_COEF} SELECT t, x, v, {_r('re * ar - im * ai + mu', 5)} AS re FROM co CROSS JOIN one JOIN mu USING (x, v) WHERE t % 10 = 0")(_reconstructed)
_W64 = _w("(t + 32 - i)", 64)
_ANG = f"2 * pi() * (({4} * (t + 32 - i)) % 64) / 64"
_CONV = f"""{_events()}{_MU}, sl AS (SELECT i, x, v, sum((val - mu) * {_W64} * cos({_ANG})) AS re, -sum((val - mu) * {_W64} * sin({_ANG})) AS im
  FROM field JOIN mu USING (x, v) JOIN range({HOURS}) r(i) ON t >= i - 32 AND t < i + 32 GROUP BY 1, 2, 3),
cum AS (SELECT n, sum({_w('n', 64)}) OVER (ORDER BY n) AS c FROM range(64) q(n)), tot AS (SELECT max(c) AS w FROM cum),
corr AS (SELECT i, CASE WHEN i < 30 THEN sqrt(w / (w - coalesce((SELECT c FROM cum WHERE n = 32 - i - 2), 0))) WHEN i >= {HOURS - 32} THEN sqrt(w / (SELECT c FROM cum WHERE n = {HOURS} + 32 - i - 2)) ELSE 1.0 END AS k FROM range({HOURS}) r(i) CROSS JOIN tot)
SELECT 4 AS f, i AS t, x, v, {_r('re * k', 5)} AS re, {_r('im * k', 5)} AS im FROM sl JOIN corr USING (i)"""


def _sliding(s, d):
    f = samples.events(s, d)
    centred = f.join(reductions.longtime_mean(f), ["x", "v"]).select("t", "x", "v", (F.col("val") - F.col("mu")).alias("val"))
    return _out(blocks.sliding_spectra(centred, STD, HOURS, [4]), 5)


_register("conv_spectra", _CONV)(_sliding)


@_register("conv_coeffs")
def _conv(s, d):
    f = samples.events(s, d)
    w, mu = weights.uniform(s, 5), reductions.longtime_mean(f)
    q = blocks.spectra(f, STD, HOURS).persist()
    phi = modal.modes(q, modal.eigen(modal.gram(q, w, 21), 21), 21, 2).where("f = 4")
    centred = f.join(mu, ["x", "v"]).select("t", "x", "v", (F.col("val") - F.col("mu")).alias("val"))
    a = modal.convolution_coefficients(blocks.sliding_spectra(centred, STD, HOURS, [4]), phi, w)
    return a.select("f", "m", "t", tidy(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 4).alias("power"))


# --- POD -------------------------------------------------------------------------------------------------------

_register("pod_dual_trace", f"{_embedded()}{_MU} SELECT {_r('sum((val - mu) * (val - mu))', 4)} AS trace FROM field JOIN mu USING (x, v)")(lambda s, d: _out(pod.decompose(samples.embeddings(s, d), weights.uniform(s, 64), 64, 10**6, 64)[0].agg(F.sum("lam").alias("trace")), 4))


def _pod(s, d):
    """The field of all vectors, with all its eigenvalues and modes."""
    f = samples.embeddings(s, d)
    return f, *pod.decompose(f, weights.uniform(s, 64), 64, f.select("t").distinct().count(), 64)


_PG = f"{_embedded()}{_MU}, d AS (SELECT t, x, val - mu AS d FROM field JOIN mu USING (x, v))"
_register("pod_gram", f"{_PG} SELECT a.t AS t1, b.t AS t2, {_r('sum(a.d * b.d)')} AS g FROM d a JOIN d b ON a.x = b.x AND a.t <= b.t GROUP BY 1, 2")(lambda s, d: pod.gram_chunks(samples.embeddings(s, d), weights.uniform(s, 64), 2048, 6))
_register("pod_eigs")(lambda s, d: _out(_pod(s, d)[1]))
#: All eigenvalues together, and their squares: the squared Frobenius norm of either Gram matrix.
_register("pod_eigs_norms", f"{_PG}, g AS (SELECT sum(a.d * b.d) AS g FROM d a JOIN d b ON a.t = b.t GROUP BY a.x, b.x) SELECT (SELECT {_r('sum(d * d)', 4)} FROM d) AS trace, (SELECT {_r('sum(g * g)', 2)} FROM g) AS fro2")(lambda s, d: _pod(s, d)[1].agg(tidy(F.sum("lam"), 4).alias("trace"), tidy(F.sum(F.col("lam") * F.col("lam")), 2).alias("fro2")))
_register("pod_coeffs")(lambda s, d: (lambda z: _out(pod.coefficients(z[0], F.broadcast(z[2])).withColumn("a", F.abs("a"))))(_pod(s, d)))
#: With all modes, a snapshot's squared coefficients sum to its squared distance from the mean.
_register("pod_coeff_energy", f"{_PG} SELECT t, {_r('sum(d * d)')} AS energy FROM d GROUP BY t")(lambda s, d: (lambda z: _out(pod.coefficients(z[0], F.broadcast(z[2])).groupBy("t").agg(F.sum(F.col("a") * F.col("a")).alias("energy"))))(_pod(s, d)))
_register("pod_reconstruct", f"{_embedded()} {_FIELD}")(lambda s, d: (lambda z: _out(pod.reconstruct(pod.coefficients(z[0], F.broadcast(z[2])), F.broadcast(z[2]), reductions.longtime_mean(z[0]))))(_pod(s, d)))

# --- lookups ---------------------------------------------------------------------------------------------------

_AX = "WITH ax AS (SELECT f::INTEGER AS f, f / 64.0 AS freq FROM range(33) r(f))"
_register("nearest_freq", f"{_AX} SELECT f, {_r('freq', 9)} AS freq FROM ax ORDER BY abs(freq - 0.1), f LIMIT 1")(lambda s, d: _out(lookup.nearest_frequency(blocks.frequency_axis(s, STD), 0.1), 9))
_register("nearest_coords", f"SELECT 0 AS axis, i::INTEGER AS i, {_r('c', 9)} AS c FROM (SELECT i, i * 10.0 / 99 AS c FROM range(100) r(i) ORDER BY abs(c - 3.3), i LIMIT 1) UNION ALL SELECT 1, i::INTEGER, {_r('c', 9)} FROM (SELECT i, i * 5.0 / 49 AS c FROM range(50) r(i) ORDER BY abs(c - 1.07), i LIMIT 1)")(
    lambda s, d: (lambda a: a[0].select(F.lit(0).alias("axis"), "i", tidy(F.col("c"), 9).alias("c")).union(a[1].select(F.lit(1), "i", tidy(F.col("c"), 9))))(lookup.nearest_coordinates([lookup.axis(s, 0, 10, 100), lookup.axis(s, 0, 5, 50)], [3.3, 1.07]))
)
_register("band_select", f"{_AX}, lo AS (SELECT f FROM ax ORDER BY abs(freq - 1 / 24.0), f LIMIT 1), hi AS (SELECT f FROM ax ORDER BY abs(freq - 1 / 6.0), f LIMIT 1) SELECT ax.f, {_r('freq', 9)} AS freq FROM ax, lo, hi WHERE ax.f BETWEEN lo.f AND hi.f")(
    lambda s, d: (lambda b: _out(blocks.frequency_axis(s, STD).where(F.col("f").between(*b)), 9))(modal.band(STD, 6.0, 24.0))
)
_register("fftshift", f"SELECT ((n + 32) % 64)::INTEGER AS n, {_r(_w('n', 64), 9)} AS w FROM range(64) r(n)")(lambda s, d: _out(lookup.shift_half(blocks.hamming_table(s, STD), "n", 64), 9, n="int"))
_register("slice_axis", f"{_daily()} SELECT t, x, v, {_r('val', 2)} AS val FROM field WHERE x // 2 = 1")(lambda s, d: _out(lookup.slice_axis(samples.lineitem_daily(s, d), (3, 2), 0, 1), 2))
_register("mode_argmax", f"{_closed()} SELECT x, v, {_r('sqrt(re * re + im * im)', 5)} AS mag FROM phi WHERE f = {BIN} AND m = 0 ORDER BY mag DESC LIMIT 1")(lambda s, d: _out(lookup.largest_magnitude(_two(s, d)[4].where(f"f = {BIN} AND m = 0")), 5))
_register("data_tracer", f"{_events()} SELECT t, {_r('val')} AS val FROM field WHERE x = 2 AND t >= 24 AND t < 96")(lambda s, d: _out(lookup.data_tracer(samples.events(s, d), 2, 0, 24, 96)))
_TRACER = f"""{_closed()}, one AS (SELECT x, v, re, im, sqrt(re * re + im * im) AS r FROM phi WHERE f = {BIN} AND m = 0), top AS (SELECT re / r AS pr, im / r AS pi_ FROM one ORDER BY round(r, 9) DESC, x LIMIT 1)
SELECT 0 AS m, x, v, i::INTEGER AS i, {_r('i / (99 * ' + repr(BIN / 360) + ')', 5)} AS t, {_r('(pr * re + pi_ * im) * cos(i * 10 * pi() / 99) + (pr * im - pi_ * re) * sin(i * 10 * pi() / 99)', 5)} AS val FROM one CROSS JOIN top CROSS JOIN range(100) q(i)"""
_register("mode_tracer", _TRACER)(lambda s, d: _out(lookup.mode_tracer(modal.fix_phase(_two(s, d)[4].where(f"f = {BIN} AND m = 0")), BIN / 360), 5))
_register("block_distribution", "SELECT part::INTEGER AS part, (102 + CASE WHEN part < 6 THEN 1 ELSE 0 END)::INTEGER AS n, (part * 102 + least(part, 6))::INTEGER AS start FROM range(7) r(part)")(
    lambda s, d: s.range(7).select(F.col("id").cast("int").alias("part"), *[c.cast("int").alias(n) for c, n in zip(block_share(HOURS, 7, F.col("id")), ("n", "start"))])
)
_register("eigs_by_period", f"{_closed()} SELECT f, {_r('360.0 / f', 6)} AS period, m, {_r(_DOUBLED, 5)} AS lam FROM e WHERE f > 0")(lambda s, d: lookup.eigenvalues_by_period(modal.eigenvalues(_two(s, d)[3], TWO, 2)).select("f", tidy(F.col("period")).alias("period"), "m", tidy(F.col("lam"), 5).alias("lam")))
_register("video_frames", f"{_events()} SELECT t // 24 AS frame, t, x, v, {_r('val')} AS val FROM field WHERE t % 24 = 0")(lambda s, d: _out(lookup.frames(samples.events(s, d), 24).select("frame", "t", "x", "v", "val")))

# --- weights ---------------------------------------------------------------------------------------------------

_AREA = "abs(cos((-90 + i * 20.0) * pi() / 180)) * CASE WHEN i IN (0, 9) THEN 10.0 ELSE 20.0 END * pi() / 180 * CASE WHEN j = 0 THEN 0.0 ELSE 18.0 * pi() / 180 END"
_register("weights_geo_2d", f"SELECT i * 20 + j AS x, 0::INTEGER AS v, {_r(_AREA, 9)} AS w FROM range(10) a(i) CROSS JOIN range(20) b(j)")(lambda s, d: _out(weights.geo_trapz_2d(s, 10, 20), 9))
_register("weights_geo_3d", f"SELECT (i * 20 + j) * 3 + k AS x, 0::INTEGER AS v, {_r(_AREA, 9)} AS w FROM range(10) a(i) CROSS JOIN range(20) b(j) CROSS JOIN range(3) c(k)")(lambda s, d: _out(weights.geo_trapz_3d(s, 10, 20, 3), 9))
_register("weights_normalized", f"{_daily()} SELECT x, v, {_r('1 / var', 9)} AS w FROM (SELECT v, var_pop(val) AS var FROM field GROUP BY v) CROSS JOIN range(6) r(x)")(lambda s, d: _out(weights.normalized(weights.uniform(s, 6, 4), samples.lineitem_daily(s, d)), 9))
_register("weights_uniform", "SELECT x, v::INTEGER AS v, 1.0::DOUBLE AS w FROM range(6) a(x) CROSS JOIN range(4) b(v)")(lambda s, d: weights.uniform(s, 6, 4))

# --- streaming, replayed ---------------------------------------------------------------------------------------

_register("running_mean", f"{_events()} SELECT t, x, v, {_r('1.3e-8 + avg(val) OVER (PARTITION BY x ORDER BY t)')} AS mu FROM field")(lambda s, d: _out(_off_ties(reductions.running_mean(samples.events(s, d)))))
_SCHED = f", sch AS (SELECT row_number() OVER (ORDER BY start) AS k, start FROM (SELECT j * 32 + g * 65 AS start FROM range(2) a(j) CROSS JOIN range(12) b(g)) WHERE start + 64 <= {HOURS})"
_register("stream_schedule", f"WITH z AS (SELECT 1){_SCHED} SELECT k::INTEGER AS k, start::INTEGER AS start FROM sch")(lambda s, d: s.createDataFrame(streaming.schedule(STD, HOURS), "k int, start int"))
_SANG = "2 * pi() * ((f * (t - start)) % 64) / 64"
_SDFT = f"""{_events()}{_SCHED}, rm AS (SELECT t, x, v, avg(val) OVER (PARTITION BY x ORDER BY t) AS mu FROM field),
xh AS (SELECT k, f, c.x, sum((c.val - mu) * {_w('(c.t - start)', 64)} * cos({_SANG.replace('(t -', '(c.t -')})) * s AS re, -sum((c.val - mu) * {_w('(c.t - start)', 64)} * sin({_SANG.replace('(t -', '(c.t -')})) * s AS im
  FROM sch JOIN field c ON c.t >= start AND c.t < start + 64 JOIN rm ON rm.t = start + 63 AND rm.x = c.x CROSS JOIN (SELECT f, {STD.gain!r} / 64 * CASE WHEN f > 0 AND f < 32 THEN 2 ELSE 1 END AS s FROM range(33) r(f)) GROUP BY k, f, c.x, s)"""
_register("stream_block_dft", f"{_SDFT} SELECT k::INTEGER AS k, f::INTEGER AS f, x, 0::INTEGER AS v, {_r('re')} AS re, {_r('im')} AS im FROM xh")(lambda s, d: _out(streaming.block_spectra(samples.events(s, d), STD, HOURS), k="int"))
_register("stream_energy", f"{_SDFT}, n AS (SELECT max(k) AS n FROM sch) SELECT f::INTEGER AS f, {_r('sum((re * re + im * im) * (k + 1) / (k + 2)) / max(n.n + 2)', 4)} AS energy FROM xh CROSS JOIN n GROUP BY f")(
    lambda s, d: _out(streaming.replay(samples.events(s, d), STD, [1.0] * 5).where("x = 0").groupBy("f").agg(F.sum(F.col("sigma") * F.col("sigma")).alias("energy")), 4)
)

# --- kernels without SQL ---------------------------------------------------------------------------------------


@_register("spod_modes_std")
def _modes_std(s, d):
    _, q = _std(s, d)
    q = q.persist()
    pairs = modal.eigen(modal.gram(q, weights.uniform(s, 5), 21), 21)
    return _out(modal.modes(q, pairs, 21, 3).select("f", "m", "x", "v", F.hypot("re", "im").alias("mag")), 5)


@_register("stream_modes")
def _stream_modes(s, d):
    rows = streaming.replay(samples.events(s, d), STD, [1.0] * 5, rank=3)
    return _out(rows.select("f", "m", "x", "v", "sigma", F.hypot("re", "im").alias("mag")), 5)


@_register("lstm_forecast")
def _lstm(s, d):
    series = samples.events(s, d).select(F.col("x").alias("k"), "t", (F.col("val") / 1000).alias("val"))
    return emulation.forecast(series.where("t < 576"), series.where("t >= 576"), 12, 1, epochs=3)


# --- more data products ----------------------------------------------------------------------------------------

_register("compare_series", f"{_events()} SELECT a.t, {_r('a.val')} AS a, {_r('b.val')} AS b FROM field a JOIN field b ON a.t = b.t WHERE a.x = 0 AND b.x = 1")(
    lambda s, d: _out(lookup.compare_series(samples.events(s, d).where("x = 0"), samples.events(s, d).where("x = 1")))
)
_G2 = f"{_events(1, True)}{_tapered(STD)}{_qhat(STD)}, w AS (SELECT v, 1 / var_pop(val) AS w FROM field GROUP BY v)"
_register(
    "gram_weighted_2v",
    f"{_G2} SELECT a.f, a.b AS b1, c.b AS b2, {_r('sum((a.re * c.re + a.im * c.im) * w) / 21')} AS re, {_r('sum((a.re * c.im - a.im * c.re) * w) / 21')} AS im FROM qhat a JOIN qhat c ON a.f = c.f AND a.x = c.x AND a.v = c.v AND a.b <= c.b JOIN w ON w.v = a.v GROUP BY 1, 2, 3",
)(lambda s, d: (lambda f: _out(modal.gram(blocks.spectra(f, STD, HOURS), weights.normalized(weights.uniform(s, 5, 2), f), 21)))(samples.events(s, d, two=True)))


@_register("mode_slice")
def _slice(s, d):
    return _out(lookup.mode_slice(modal.fix_phase(_two(s, d)[4].where(f"f = {BIN} AND m = 0")), BIN, 0), 5)


@_register("spectrum_report", _REPORT)
def _report(s, d):
    return _out(lookup.report(_trace_series(s, d)).withColumn("val", tidy(F.col("val"), 4)))


@_register("npy_source")
def _npy(s, d):
    """A field written as .npy and read back through the data source."""
    import tempfile

    from ..sources import arrays

    path = tempfile.mkdtemp() + "/field.npy"
    arrays.save_npy(samples.events(s, d, hours=6), path, (120, 5, 1))
    return arrays.read_data(s, path)


@_register("dft_table_function", "SELECT f::INTEGER AS f, round(sum(v * cos(2 * pi() * f * n / 4)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * f * n / 4)), 6) + 0.0 AS im FROM (VALUES (0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0)) q(n, v) CROSS JOIN range(4) r(f) GROUP BY f")
def _table_function(s, d):
    from ..functions.expressions import register

    register(s)
    return _out(s.sql("SELECT * FROM dft(array(1D, 2D, 4D, 8D))"))
