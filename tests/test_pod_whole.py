"""POD queries over the whole table, against numpy."""

import numpy as np
import pytest

from fieldweave.operators import pod, weights
from fieldweave.plans import catalog, samples


def written(spark, path, n):
    """n vectors under ids with gaps, and their centred matrix."""
    ids, x = np.arange(n) * 7 + 3, np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    rows = [(int(i), [float(z) for z in v], 0) for i, v in zip(ids, x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    x = x.astype(float)
    return ids, x, x - x.mean(0)


@pytest.mark.parametrize("n", [20, 150])
def test_pod_of_all_vectors(spark, tmp_path, n):
    ids, x, c = written(spark, tmp_path, n)
    u, sv, _ = np.linalg.svd(c, full_matrices=False)
    k = min(n - 1, 64)
    run = {q: catalog.queries()[q](spark, str(tmp_path)).collect() for q in ("pod_gram", "pod_eigs", "pod_coeffs", "pod_reconstruct", "pod_eigs_norms", "pod_coeff_energy")}
    at = {int(t): i for i, t in enumerate(ids)}
    assert len(run["pod_gram"]) == n * (n + 1) // 2
    assert all(r.t1 <= r.t2 and abs(r.g - c[at[r.t1]] @ c[at[r.t2]]) < 2e-6 for r in run["pod_gram"])
    assert [r.lam for r in sorted(run["pod_eigs"])] == pytest.approx(list(sv[:k] ** 2), abs=2e-6)
    assert len(run["pod_coeffs"]) == k * n
    assert all(abs(r.a - abs(u[at[r.t], r.m] * sv[r.m])) < 1e-5 for r in run["pod_coeffs"])
    assert len(run["pod_reconstruct"]) == n * 64
    assert all(abs(r.val - x[at[r.t], r.x]) < 2e-6 for r in run["pod_reconstruct"])
    norms = run["pod_eigs_norms"][0]
    assert (norms.trace, norms.fro2) == pytest.approx(((c * c).sum(), ((c.T @ c) ** 2).sum()), rel=1e-6)
    assert {at[r.t]: r.energy for r in run["pod_coeff_energy"]} == pytest.approx(dict(enumerate((c * c).sum(1))), abs=2e-6)


def test_gram_does_not_shuffle_the_field_by_cell(spark, tmp_path):
    """The field is shuffled by snapshot alone; the mean and the weights come to it."""
    written(spark, tmp_path, 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["pod_gram"](spark, str(tmp_path))
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 210
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_gram_in_a_file_is_small(spark, tmp_path):
    """Every pair is there, by chunks of any side, and a file of the rounded matrix takes much less than the 8 bytes of a value."""
    n = 1500
    x = (0.1 * np.random.default_rng(1).normal(size=(n, 64))).astype(np.float32)
    rows = [(i, [float(z) for z in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    catalog.queries()["pod_gram"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/gram")
    assert sum(p.stat().st_size for p in (tmp_path / "gram").glob("*.parquet")) < 6 * n * (n + 1) // 2
    c = x.astype(float) - x.astype(float).mean(0)
    for df in (spark.read.parquet(f"{tmp_path}/gram"), pod.gram_chunks(samples.embeddings(spark, str(tmp_path)), weights.uniform(spark, 64), 400)):
        got, g = df.toPandas(), np.full((n, n), np.nan)
        assert len(got) == n * (n + 1) // 2
        g[got.t1, got.t2] = got.g
        assert np.isnan(g[np.tril_indices(n, -1)]).all()
        assert np.abs(g - c @ c.T)[np.triu_indices(n)].max() < 2e-6


def test_order_of_rounded_values():
    """Rounded half away from zero, ascending, each at its own place, also where values are too large to be packed with it."""
    x = np.array([0.5, -0.5, 1.25, -1.25, -0.01, 0.0, 3.0, -7.75] * 40000)
    near = np.array([0.5, -0.5, 1.3, -1.3, 0.0, 0.0, 3.0, -7.8] * 40000)
    for big in ([], [1e300], [np.inf, -1e300]):
        parts = list(pod._ordered(np.append(x, big), 1))
        at, values = (np.concatenate(p) for p in zip(*parts))
        assert (np.diff(values[np.isfinite(values)]) >= 0).all() and not np.signbit(values[values == 0]).any()
        assert sorted(at) == list(range(len(x) + len(big)))
        assert (values[np.argsort(at)] == np.append(near, big)).all()
