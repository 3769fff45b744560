"""Saved results, training apart from inference, and data products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.functions import expressions
from fieldweave.operators import emulation, fields, lookup
from fieldweave.plans.model import SnapshotPOD, SpectralPOD
from fieldweave.plans.params import SpodParams


@pytest.fixture(scope="module")
def field(spark):
    g = np.random.default_rng(2)
    a = np.sin(np.arange(40)[:, None] * 0.4 + np.arange(6)) + 0.1 * g.normal(size=(40, 6))
    return spark.createDataFrame([(t, x, 0, float(a[t, x])) for t in range(40) for x in range(6)], "t long, x long, v int, val double")


def by_cell(df):
    return {(r.t, r.x): r.val for r in df.collect()}


def test_pod_results_outlive_the_model(spark, field, tmp_path):
    model = SnapshotPOD(6).fit(field)
    model.coefficients(field, weighted=True)
    want = by_cell(model.reconstruct("all"))
    model.save(f"file://{tmp_path}/pod")
    again = SnapshotPOD.load(spark, f"file://{tmp_path}/pod")
    assert again.shape == model.shape == fields.shape_of(field)
    got, real = by_cell(again.reconstruct("all")), by_cell(field)
    assert got.keys() == real.keys()
    for k in real:
        assert got[k] == pytest.approx(want[k]) and got[k] == pytest.approx(real[k], abs=1e-6)  # all six modes give the field back
    with pytest.raises(FileNotFoundError):
        SnapshotPOD.load(spark, f"file://{tmp_path}/none")


def test_caches_of_other_settings_are_not_taken(field):
    keys = set()
    for p in (SpodParams(n_dft=8, time_step=1.0), SpodParams(n_dft=8, time_step=1.0, fullspectrum=True), SpodParams(n_dft=8, time_step=1.0, mean_type="blockwise")):
        m = SpectralPOD(p)
        m._sizes(field, None)
        keys.add(m.run_key())
    assert len(keys) == 3


def test_train_store_infer(spark, tmp_path):
    series = spark.createDataFrame([(k, t, float(np.sin(t * 0.3 + k))) for k in range(2) for t in range(120)], "k long, t long, val double")
    nets = emulation.train(series.where("t < 80"), 6, 2, epochs=12, validation=series.where("t between 80 and 99"))
    nets.write.parquet(f"file://{tmp_path}/nets")
    nets = spark.read.parquet(f"file://{tmp_path}/nets")
    rows = emulation.histories(nets).collect()
    assert len(rows) == 24 and all(r.val_loss is not None for r in rows)
    first = {r.k: r.loss for r in rows if r.epoch == 0}
    assert all(min(r.loss for r in rows if r.k == k) < first[k] for k in (0, 1))
    a, b = (sorted(map(tuple, emulation.inference(nets, series.where("t >= 100")).collect())) for _ in range(2))
    assert a == b and len(a) == 40 and all(x[2] == pytest.approx(np.sin(x[1] * 0.3 + x[0])) for x in a if x[1] < 106)
    bare = emulation.histories(emulation.train(series.where("t < 20"), 6, 1, epochs=2)).collect()
    assert len(bare) == 4 and all(r.val_loss is None for r in bare)


def test_sql_functions(spark):
    expressions.register(spark)
    r = spark.sql("SELECT cmul_re(1, 2, 3, 4) AS a, cmul_im(1, 2, 3, 4) AS b").first()
    assert (r.a, r.b) == (-5.0, 10.0)
    df = spark.createDataFrame([(1, 2.0, 3.0, 0.5), (1, 1.0, -1.0, 2.0), (2, 4.0, 4.0, 0.25)], "g int, a double, b double, w double")
    df.createOrReplaceTempView("inner_rows")
    got = {x.g: x.s for x in spark.sql("SELECT g, weighted_inner(a, b, w) AS s FROM inner_rows GROUP BY g").collect()}
    assert got == {1: 1.0, 2: 4.0} == {x.g: x.s for x in df.groupBy("g").agg(expressions.inner_product("a", "b", "w").alias("s")).collect()}


def test_data_products(spark, field):
    coeffs = spark.createDataFrame([(m, t, float(m + t)) for m in range(3) for t in range(5)], "m int, t long, a double")
    assert sorted((r.m, r.t) for r in lookup.coefficient_series(coeffs, [0, 2], 1, 3).collect()) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    one = field.where("t = 0").select("x", "v", "val")
    rows = lookup.panels(data=one, twice=one.withColumn("val", 2 * F.col("val"))).collect()
    assert len(rows) == 12 and {r.limit for r in rows} == {max(abs(r.val) for r in rows)}
    spectrum = spark.createDataFrame([(f, f / 10, {7: 10.0, 15: 20.0}.get(f, 1.0 + f / 100)) for f in range(20)], "f int, freq double, val double")
    assert [r.f for r in lookup.report(spectrum, 1).collect()] == [15] and lookup.report(spectrum).count() == 2
