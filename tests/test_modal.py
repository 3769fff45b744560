"""Operators against numpy, invariants, and golden values of analytic fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions.expressions import confidence_factors, gamma_cdf, gamma_cdf_inverse, register
from fieldweave.operators import blocks, emulation, fields, lookup, modal, pod, reductions, weights
from fieldweave.plans.model import SnapshotPOD, SpectralPOD, StreamingPOD
from fieldweave.plans.params import SpodParams
from fieldweave.sources import arrays, config
from fieldweave.streaming import spod as streaming


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(3)
    t = np.arange(80)
    base = np.sin(0.7 * t)[:, None, None] * g.normal(size=(3, 2)) + np.cos(1.9 * t)[:, None, None] * g.normal(size=(3, 2))
    return base + 0.3 * g.normal(size=(80, 3, 2))


@pytest.fixture(scope="module")
def field(spark, data):
    return fields.from_arrays(spark, [data[:50], data[50:]], n_variables=2).persist()


P = SpodParams(n_dft=16, time_step=0.5, n_variables=2, overlap=50)


def numpy_spod(x, p, w):
    nt = len(x)
    flat = x.reshape(nt, -1) - x.reshape(nt, -1).mean(0)
    win = np.array(p.window)
    q = np.array([p.gain / p.n_dft * np.fft.rfft(flat[b * p.step : b * p.step + p.n_dft] * win[:, None], axis=0) for b in range(p.n_blocks(nt))])
    return q.transpose(1, 2, 0), w  # [f, cell, block]


def test_sizes_and_slices(spark, field, data):
    assert fields.shape_of(field) == (80, 3, 2)
    assert fields.time_slice(field, 10, 12).count() == 12
    assert sorted(fields.time_indices(None, 80)) == [0, 79]
    assert fields.time_subset(field, np.array([1, 2]), 80).count() == 12
    with pytest.raises(ValueError):
        fields.time_indices("third", 80)
    with pytest.raises(TypeError):
        fields.select_variables(field, "v")
    with pytest.raises(ValueError):
        fields.shape_of(field.where("t <> 5"))


def test_transforms_agree_with_numpy(field, data):
    tapered = blocks.preprocess(field, P, 80)
    q, _ = numpy_spod(data, P, None)
    for f in (blocks.dft, blocks.dft_fast):
        got = np.zeros(q.shape, complex)
        for r in f(tapered, P).collect():
            got[r.f, r.x * 2 + r.v, r.b] = complex(r.re, r.im)
        assert np.allclose(got, q, atol=1e-12)


def test_segmentation_has_no_range_join(field):
    plan = blocks.segment(field, P, 80)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def fitted(spark, field):
    w = spark.createDataFrame([(x, v, 0.5 + x + 2.0 * v) for x in range(3) for v in range(2)], "x long, v int, w double")
    return SpectralPOD(P).fit(field, w)


def test_spod(spark, field, data, fitted):
    w = np.array([0.5 + x + 2.0 * v for x in range(3) for v in range(2)])
    q, _ = numpy_spod(data, P, w)
    nb = q.shape[2]
    lam = np.array([np.linalg.eigvalsh(m.conj().T @ (m * w[:, None]) / nb)[::-1] for m in q])
    got = {(r.f, r.m): r for r in fitted.eigs.collect()}
    for f in range(P.n_freq):
        factor = 2 if 0 < f < P.n_freq - 1 else 1
        for m in range(4):
            assert got[f, m].lam == pytest.approx(factor * lam[f, m], rel=1e-9)
            assert got[f, m].lam_lo < got[f, m].lam < got[f, m].lam_hi
    assert modal.orthogonality(fitted.modes, fitted.weights, 3, 0, 0).first().ok
    assert modal.orthogonality(fitted.modes, fitted.weights, 3, 0, 1).first().ok
    parts = {(r.f, r.b1, r.b2): complex(r.re, r.im) for r in modal.gram_partial(fitted.qhat, fitted.weights, nb, 3).collect()}
    whole = {(r.f, r.b1, r.b2): complex(r.re, r.im) for r in fitted.gram.collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[k] - whole[k]) < 1e-12 for k in whole)


def test_projection_and_reconstruction(field, data, fitted):
    fitted.coefficients(field)
    rec = np.zeros((80, 6))
    for r in fitted.reconstruct("all").collect():
        rec[r.t, r.x * 2 + r.v] = r.re
    assert np.abs(rec - data.reshape(80, -1)).max() < 1e-6  # the modes span the space
    conv = fitted.coefficients_by_convolution(field, 1.0, 4.0)
    assert conv.count() == 80 * len({r.f for r in conv.select("f").distinct().collect()}) * 6
    with pytest.raises(RuntimeError):
        SpectralPOD(P).reconstruct()


def test_save_and_load(spark, field, fitted, tmp_path):
    fitted.save(str(tmp_path))
    again = SpectralPOD.load(spark, f"{tmp_path}/{fitted.run_key()}")
    assert again.params == fitted.params and again.shape == fitted.shape
    assert again.modes_at(2).count() == fitted.modes_at(2).count()
    with pytest.raises(FileNotFoundError):
        SpectralPOD.load(spark, f"{tmp_path}/none")
    p = P.with_(savefft=True, reuse_blocks=True)
    one = SpectralPOD(p).fit(field, cache=str(tmp_path / "fft")).eigs.agg(F.sum("lam")).first()[0]
    two = SpectralPOD(p).fit(field, cache=str(tmp_path / "fft")).eigs.agg(F.sum("lam")).first()[0]
    assert one == pytest.approx(two)


def test_pod(spark, field, data):
    model = SnapshotPOD(6).fit(field)
    flat = data.reshape(80, -1) - data.reshape(80, -1).mean(0)
    lam = np.linalg.svd(flat, compute_uv=False) ** 2
    assert [r.lam for r in model.eigs.orderBy("m").collect()] == pytest.approx(list(lam), rel=1e-9)
    model.coefficients(field)
    rec = {(r.t, r.x, r.v): r.val for r in model.reconstruct("quarter").collect()}
    assert len(rec) == 20 * 6 and all(abs(v - data[k]) < 1e-9 for k, v in rec.items())
    eigs, _ = pod.decompose(fields.time_slice(field, 0, 4), weights.uniform(spark, 3, 2), 3, 4, 6)
    assert eigs.count() == 3


def test_norms(spark, field):
    ref = field.withColumn("val", F.col("val") + 1)
    assert reductions.l_errors(field, ref, "l1").first()[0] == pytest.approx(1)
    assert reductions.l_errors(field, ref, "l2").first()[0] == pytest.approx(1 / np.sqrt(480))
    assert reductions.h1_error(field, ref, 0.1).first()[0] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        reductions.l_errors(field, ref, "l3")


def closed_form(x, p, kind):
    nt = len(x)
    flat, win = x.reshape(nt, -1), np.array(p.window)
    double = np.array([2.0 if 0 < f < p.n_freq - 1 else 1.0 for f in range(p.n_freq)])
    hats = []
    for k, s in streaming.schedule(p, nt, kind):
        mu = flat[: s + p.n_dft].mean(0)
        hats.append((k, p.gain / p.n_dft * double[:, None] * np.fft.rfft((flat[s : s + p.n_dft] - mu) * win[:, None], axis=0)))
    n = len(hats)
    return n, [np.linalg.eigvalsh(sum((k + 1) / (k + 2) * np.outer(h[f], h[f].conj()) for k, h in hats) / (n + 2))[::-1] for f in range(p.n_freq)]


@pytest.mark.parametrize("kind", ["reference", "aligned"])
def test_streaming_closed_form(field, data, kind):
    n, lam = closed_form(data, P, kind)
    rows = StreamingPOD(P, kind).fit(field, [1.0] * 6, nv=2).modes.where("x = 0 and v = 0").collect()
    assert {r.blocks for r in rows} == {n}
    for r in rows:
        assert r.sigma**2 == pytest.approx(lam[r.f][r.m], rel=1e-8, abs=1e-12)


def test_schedule_drifts():
    p = SpodParams(n_dft=8, time_step=1, overlap=50)
    assert [s for _, s in streaming.schedule(p, 31)] == [0, 4, 9, 13, 18, 22]
    assert len(streaming.schedule(SpodParams(n_dft=64, time_step=1, overlap=50), 1000)) == 29


def test_structured_streaming(spark, field, tmp_path):
    for i in range(4):
        fields.time_slice(field, i * 20, i * 20 + 20).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("t long, x long, v int, val double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = StreamingPOD(P).fit(source, [1.0] * 6, nv=2).modes
    q = out.writeStream.outputMode("update").format("memory").queryName("updates").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.f, r.m): r.sigma for r in streaming.latest(spark.table("updates")).where("x = 0 and v = 0").collect()}
    want = {(r.f, r.m): r.sigma for r in streaming.replay(field, P, [1.0] * 6, nv=2).where("x = 0 and v = 0").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_late_snapshots_are_counted():
    s = streaming.State(P, [0, 1], np.ones(2), 2)
    for t in (0, 1, 2, 1):
        s.add(t, np.ones(2))
    assert s.n == 3 and s.late == 1


def test_golden_two_dimensional_field(spark):
    t = np.linspace(0, 200, 1000)
    x1, x2 = np.meshgrid(np.linspace(0, 10, 100), np.linspace(0, 5, 50))
    s = np.sin(x1 * x2) + np.cos(x1) ** 2 + np.sin(0.1 * x2)
    time = np.sin(0.1 * t) ** 2 + np.cos(t) * np.sin(0.5 * t)
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s.ravel())], "x long, s double")
    times = spark.createDataFrame([(i, float(v)) for i, v in enumerate(time)], "t long, a double")
    field = times.crossJoin(cells).select("t", "x", F.lit(0).alias("v"), (F.col("a") * F.col("s")).alias("val"))
    p = SpodParams(n_dft=100, time_step=1.0, n_space_dims=2, mean_type="blockwise")
    w = weights.normalized(weights.geo_trapz_2d(spark, 50, 100), field)
    q = blocks.dft_fast(blocks.preprocess(field, p, 1000), p).where("f = 10").persist()
    phi = modal.modes(q, modal.eigen(modal.gram(q, w, 10), 10), 10, 1)
    mag = np.zeros(5000)
    for r in phi.collect():
        mag[r.x] = np.hypot(r.re, r.im)
    mag = mag.reshape(50, 100)
    assert mag[5, 10] == pytest.approx(0.16561370950286056, abs=1e-10)
    assert mag[0, 0] == pytest.approx(0.20034824428826448, abs=1e-10)
    assert mag.max() == pytest.approx(0.49212975276929255, abs=1e-10)


def test_lookups(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "f int, freq double")
    assert lookup.nearest_frequency(axis, 0.25).first().f == 0
    with pytest.raises(ValueError):
        lookup.nearest_coordinates([axis], 3.0)
    top = lookup.largest_magnitude(spark.createDataFrame([(0, 0, 1.0, 0.0), (1, 0, 0.0, 2.0)], "x long, v int, re double, im double"))
    assert [r.x for r in top.collect()] == [1]
    spectrum = spark.createDataFrame([(f, f / 10, 10.0 if f == 7 else 1.0 + f / 100) for f in range(20)], "f int, freq double, val double")
    assert [r.f for r in lookup.peaks(spectrum).collect()] == [7]
    assert lookup.report(spectrum).first().unit == "hours"


def test_quantiles():
    lo, hi = confidence_factors(30, 0.95)
    assert (round(lo, 3), round(hi, 3)) == (0.759, 1.389)
    assert gamma_cdf(5, gamma_cdf_inverse(5, 0.3)) == pytest.approx(0.3)


def test_parameters(tmp_path):
    with pytest.raises(TypeError):
        SpodParams(n_dft=8.0, time_step=1)
    for bad in ({"n_dft": 3}, {"n_dft": 8, "overlap": 99}, {"n_dft": 8, "mean_type": "x"}, {"n_dft": 8, "dtype": "int"}):
        with pytest.raises(ValueError):
            SpodParams(**({"time_step": 1} | bad))
    with pytest.raises(ValueError):
        P.n_blocks(20)
    odd = SpodParams(n_dft=5, time_step=1, complex_data=True).frequencies()
    assert odd == pytest.approx([0, 0.2, 0.4, -0.4, -0.2])
    path = tmp_path / "c.yaml"
    path.write_text("required:\n - n_dft: 8\n - time_step: 1\n - n_space_dims: 1\n - n_variables: 1\noptional:\n - overlap: 50\n")
    assert SpodParams.from_dict(config.read_config(str(path))).overlap == 50
    path.write_text("required:\n - n_dft: 8\n")
    with pytest.raises(ValueError):
        config.read_config(str(path))


def test_array_files(spark, field, data, tmp_path):
    np.save(tmp_path / "a.npy", data[:50])
    np.save(tmp_path / "b.npy", data[50:])
    got = arrays.read_data(spark, f"{tmp_path}/*.npy", format="npy", n_variables=2)
    assert got.exceptAll(field).count() == 0 and got.count() == 480
    arrays.save_npy(field, str(tmp_path / "out.npy"), (80, 3, 2))
    assert np.array_equal(np.load(tmp_path / "out.npy"), data)
    with pytest.raises(ValueError):
        arrays.read_data(spark, "x.csv")
    with pytest.raises(ImportError):
        arrays.read_data(spark, "x.mat")


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT hamming(0, 64)").first()[0] == pytest.approx(0.08)
    rows = spark.sql("SELECT * FROM dft(array(1D, 2D, 4D))").collect()
    assert rows[0].re == pytest.approx(7)


def test_emulation(spark):
    t = np.arange(120)
    rows = [(k, int(i), float(np.sin(0.3 * i + k))) for k in range(2) for i in t]
    series = spark.createDataFrame(rows, "k long, t long, val double")
    seq = emulation.sequences(series, 4, 2, 1)
    assert seq.count() == 2 * (120 - 4 - 2)
    out = emulation.forecast(series.where("t < 90"), series.where("t >= 90"), 6, 1, epochs=25).collect()
    assert len(out) == 60 and all(r.loss_last < r.loss_first for r in out)
    with pytest.raises(NotImplementedError):
        emulation.build_network("cnn", 1, 1)
    with pytest.raises(ValueError):
        emulation.sequences(series, 4, 2, 0)
    assert emulation.determination(np.ones(3) * [1, 2, 3], np.array([1, 2, 3.0])) == 1


def test_partition_count_does_not_matter(spark, field):
    a = blocks.spectra(fields.by_space(field, 3), P, 80).agg(F.sum(F.abs("re"))).first()[0]
    b = blocks.spectra(field.repartition(7), P, 80).agg(F.sum(F.abs("re"))).first()[0]
    assert a == pytest.approx(b)
