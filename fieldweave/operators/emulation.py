"""Emulation of coefficients: scaling, training sequences, and a small LSTM trained per coefficient."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaler(coeffs: DataFrame, normalization: str = "localmax") -> DataFrame:
    """(k, s_re, s_im): ten times the largest magnitude of each coefficient, the largest of all, or 1. A real series has im = 0 and s_im is unused."""
    top = lambda c: F.greatest(F.abs(F.max(c)), F.abs(F.min(c)))
    if normalization == "localmax":
        return coeffs.groupBy("k").agg((top("re") * 10).alias("s_re"), (top("im") * 10).alias("s_im"))
    ks = coeffs.select("k").distinct()
    if normalization == "globalmax":
        return ks.join(F.broadcast(coeffs.agg(top("re").alias("s_re"), top("im").alias("s_im"))))
    return ks.select("k", F.lit(1.0).alias("s_re"), F.lit(1.0).alias("s_im"))


def scale(coeffs: DataFrame, scales: DataFrame, back: bool = False) -> DataFrame:
    """Both parts over (or times) their scale; a part with scale 0 stays."""
    s = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    joined = coeffs.join(F.broadcast(scales), "k")
    op = (lambda a, b: a * b) if back else (lambda a, b: a / b)
    return joined.select("k", "t", op(F.col("re"), s("s_re")).alias("re"), op(F.col("im"), s("s_im")).alias("im"))


def sequences(series: DataFrame, n_in: int, n_out: int, horizon: int = 1) -> DataFrame:
    """(k, row, x, y): windows of n_in values and the n_out values from `horizon` after; the last possible window is left out."""
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    order = Window.partitionBy("k").orderBy("t")
    ahead = lambda a, b: F.collect_list("val").over(order.rowsBetween(a, b))
    rows = series.select("k", (F.row_number().over(order) - 1).alias("row"), ahead(0, n_in - 1).alias("x"), ahead(n_in - 1 + horizon, n_in + n_out - 2 + horizon).alias("y"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    return rows.where(F.col("row") < F.col("n") - n_in - n_out - horizon + 1).select("k", "row", "x", "y")


class Lstm:
    """One LSTM layer and a linear output, trained by Adam on the mean squared error."""

    def __init__(self, n_in: int, n_out: int, hidden: int = 16, seed: int = 1):
        g = np.random.default_rng(seed)
        self.h, self.n_in, self.n_out = hidden, n_in, n_out
        lim = 1 / np.sqrt(hidden)
        self.p = {"wx": g.uniform(-lim, lim, (1, 4 * hidden)), "wh": g.uniform(-lim, lim, (hidden, 4 * hidden)), "b": np.zeros(4 * hidden), "wo": g.uniform(-lim, lim, (hidden, n_out)), "bo": np.zeros(n_out)}
        self.p["b"][hidden : 2 * hidden] = 1.0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def forward(self, x: np.ndarray):
        n, H, p = len(x), self.h, self.p
        h, c, kept = np.zeros((n, H)), np.zeros((n, H)), []
        sig = lambda z: 1 / (1 + np.exp(-z))
        for t in range(x.shape[1]):
            z = x[:, t : t + 1] @ p["wx"] + h @ p["wh"] + p["b"]
            i, f, g, o = sig(z[:, :H]), sig(z[:, H : 2 * H]), np.tanh(z[:, 2 * H : 3 * H]), sig(z[:, 3 * H :])
            new = f * c + i * g
            kept.append((h, c, i, f, g, o, new))
            h, c = o * np.tanh(new), new
        return h @ p["wo"] + p["bo"], h, kept

    def step(self, x: np.ndarray, y: np.ndarray, lr: float) -> float:
        out, h, kept = self.forward(x)
        e = out - y
        d = 2 * e / e.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["wo"], g["bo"] = h.T @ d, d.sum(0)
        dh, dc = d @ self.p["wo"].T, 0.0
        for t in range(len(kept) - 1, -1, -1):
            hp, cp, i, f, gg, o, c = kept[t]
            tc = np.tanh(c)
            do, dc = dh * tc, dc + dh * o * (1 - tc * tc)
            z = np.hstack([dc * gg * i * (1 - i), dc * cp * f * (1 - f), dc * i * (1 - gg * gg), do * o * (1 - o)])
            g["wx"] += x[:, t : t + 1].T @ z
            g["wh"] += hp.T @ z
            g["b"] += z.sum(0)
            dh, dc = z @ self.p["wh"].T, dc * f
        self.steps += 1
        for k in self.p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.s[k] = 0.999 * self.s[k] + 0.001 * g[k] ** 2
            self.p[k] -= lr * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.s[k] / (1 - 0.999**self.steps)) + 1e-12)
        return float((e * e).mean())

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, lr: float = 1e-3, check=None) -> tuple[list[float], list[float]]:
        """Losses by epoch, in training and on the windows to check (none: empty); the best parameters are kept, by the latter if there
        are any."""
        best, losses, checked, g = None, [], [], np.random.default_rng(7)
        for _ in range(epochs):
            order = g.permutation(len(x))
            losses.append(float(np.mean([self.step(x[o], y[o], lr) for o in np.array_split(order, max(1, len(x) // batch))])))
            if check is not None and len(check[0]):
                checked.append(float(((self.forward(check[0])[0] - check[1]) ** 2).mean()))
            by = checked or losses
            if best is None or by[-1] <= min(by):
                best = {k: v.copy() for k, v in self.p.items()}
        self.p = best or self.p
        return losses, checked


def determination(y: np.ndarray, out: np.ndarray) -> float:
    """The coefficient of determination R^2."""
    return float(1 - ((y - out) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-300))


def build_network(kind: str, n_in: int, n_out: int, **options):
    if kind == "lstm":
        return Lstm(n_in, n_out, **options)
    if kind == "cnn":
        raise NotImplementedError("there is no convolutional network")
    raise ValueError(f"unknown network {kind!r}")


def _windows(a: np.ndarray, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    total = max(0, len(a) - n_in - n_out)
    return np.array([a[i : i + n_in] for i in range(total)]).reshape(total, n_in), np.array([a[i + n_in : i + n_in + n_out] for i in range(total)]).reshape(total, n_out)


def train(series: DataFrame, n_in: int, n_out: int = 1, epochs: int = 5, hidden: int = 8, network: str = "lstm", validation: DataFrame | None = None) -> DataFrame:
    """(k, network, n_in, n_out, hidden, weights, loss, val_loss): a network for each coefficient's series (k, t, val), its parameters as bytes
    and its losses by epoch; those on the validation series are empty without one. With a validation series, the parameters with the
    least loss on it are kept. Write the table to store the networks; coefficients go in parallel."""

    def run(key, left, right):
        import io

        import pandas as pd

        x, y = _windows(left.sort_values("t").val.to_numpy(float), n_in, n_out)
        if not len(x):
            return pd.DataFrame({c: [] for c in ("k", "network", "n_in", "n_out", "hidden", "weights", "loss", "val_loss")})
        net = build_network(network, n_in, n_out, hidden=hidden, seed=int(key[0]) + 1)
        losses, checked = net.fit(x, y, epochs, check=_windows(right.sort_values("t").val.to_numpy(float), n_in, n_out))
        data = io.BytesIO()
        np.savez(data, **net.p)
        return pd.DataFrame({"k": [int(key[0])], "network": [network], "n_in": [n_in], "n_out": [n_out], "hidden": [hidden], "weights": [data.getvalue()], "loss": [losses], "val_loss": [checked]})

    left = series.select("k", "t", "val").toDF("k", "t", "val")  # parts of one table get names of their own
    right = (series.limit(0) if validation is None else validation).select("k", "t", "val").toDF("k", "t", "val")
    schema = "k long, network string, n_in int, n_out int, hidden int, weights binary, loss array<double>, val_loss array<double>"
    return left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(run, schema)


def inference(networks: DataFrame, series: DataFrame) -> DataFrame:
    """(k, t, val): trained networks applied to the windows of a series, n_out steps at a time; the first n_in values are copied."""

    def run(key, nets, rows):
        import io

        import pandas as pd

        rows = rows.sort_values("t")
        given = rows.val.to_numpy(float)
        if not len(nets) or not len(rows):
            return pd.DataFrame({"k": [], "t": [], "val": []})
        one = nets.iloc[0]
        n_in, n_out = int(one.n_in), int(one.n_out)
        net = build_network(one.network, n_in, n_out, hidden=int(one.hidden))
        with np.load(io.BytesIO(one.weights)) as kept:
            net.p = {k: kept[k] for k in kept.files}
        out = given.copy()
        for i in range(0, len(given) - n_in, n_out):
            step = net.forward(given[None, i : i + n_in])[0][0]
            end = min(n_out, len(out) - i - n_in)
            out[i + n_in : i + n_in + end] = step[:end]
        return pd.DataFrame({"k": int(key[0]), "t": rows.t.to_numpy(), "val": out})

    return networks.groupBy("k").cogroup(series.select("k", "t", "val").toDF("k", "t", "val").groupBy("k")).applyInPandas(run, "k long, t long, val double")


def histories(networks: DataFrame) -> DataFrame:
    """(k, epoch, loss, val_loss) of trained networks; val_loss is null where nothing was held out."""
    return networks.select("k", F.posexplode("loss").alias("epoch", "loss"), "val_loss").select("k", "epoch", "loss", F.get("val_loss", F.col("epoch")).alias("val_loss"))


def forecast(train_on: DataFrame, test: DataFrame, n_in: int, n_out: int = 1, epochs: int = 5, hidden: int = 8, network: str = "lstm") -> DataFrame:
    """(k, t, val, loss_first, loss_last): each coefficient's network is trained on its own series and applied to the test series."""
    nets = train(train_on, n_in, n_out, epochs, hidden, network).persist()
    losses = nets.select("k", F.col("loss")[0].alias("loss_first"), F.array_min("loss").alias("loss_last"))
    return inference(nets, test).join(losses, "k")
