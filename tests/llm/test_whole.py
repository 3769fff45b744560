"""Operators of the training-data subpackage on inputs beyond what they once read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import bsi_search, quality_rules, url_filter


def test_every_trusted_document_counts(spark):
    n = 30_000
    ids = spark.range(2 * n).select(F.col("id").alias("doc_id"))
    docs = ids.withColumn("text", F.when(F.col("doc_id") < n, "good").otherwise("junk"))
    labels = ids.select("doc_id", (F.col("doc_id") < n).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = {r.g: r for r in quality_rules.quality_rules(docs, labels).groupBy((F.col("doc_id") < n).alias("g")).agg(F.count("*").alias("n"), F.min("llr").alias("lo"), F.max("llr").alias("hi")).collect()}
    s = quality_rules.SMOOTH
    for good, target in ((True, n), (False, 0)):
        r = math.log((target + s) / (n / 2 + s))
        assert got[good].n == n and got[good].lo == pytest.approx(r, abs=1e-9) and got[good].hi == pytest.approx(r, abs=1e-9)


def test_evidence_anywhere_in_a_url(spark):
    cases = [
        ("http://s%d.net/a/b/casino/", "http://s%d.net/a/b/garden/"),
        ("http://s%d.net/en/cheap-pills", "http://s%d.net/en/careers"),
        ("http://s%d.net/n%d?aff=1", "http://s%d.net/n%d?page=1"),
        ("http://ads.x.y.z.s%d.net/", "http://dev.x.y.z.s%d.net/"),
        ("http://s%d.net/x/Y/z/win-big-now", "http://s%d.net/x/Y/z/read-me-now"),
    ]
    for bad, good in cases:
        # Rules judge hosts in .bad and .good; the same evidence lies in .net urls, which no explicit rule judges.
        rules = (("block", "bad", "/"), ("allow", "good", "/"))
        at = lambda u, k: u % ((k,) * u.count("%d"))
        urls = [at(bad, k).replace(".net", ".bad") for k in range(40)] + [at(good, k).replace(".net", ".good") for k in range(40)] + [at(bad, 999), at(good, 999)]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = {r.page_id: r.verdict for r in url_filter.url_verdicts(df, rules).collect()}
        assert len(got) == 82 and (got[80], got[81]) == ("block", "allow"), (bad, got[80], got[81])


@pytest.mark.parametrize("size", [0.5, 5e3, 5e5])
def test_search_of_large_components(spark, size):
    g = np.random.default_rng(7)
    x = (g.normal(size=(200, 12)) * size).round(3)
    x[::9] /= 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = [[math.floor(256 * z) for z in v] for v in x.tolist()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bsi_search.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()}
    assert len(got) == 50
    for i in range(0, 200, 20):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(200) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


@pytest.mark.parametrize("size", [1e7, 1e300])
def test_search_overflow_is_an_error(spark, size):
    df = spark.createDataFrame([(0, [size] * 4), (1, [-size] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="62 bits" if size > 1e9 else "64 bits"):
        bsi_search.top_k(df, df, 1).collect()


def test_search_of_wide_vectors(spark):
    """More attributes than are added at once."""
    g = np.random.default_rng(9)
    x = g.normal(size=(90, 150)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(256 * x).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bsi_search.top_k(df, df.where("vec_id % 30 = 0"), 5).collect()}
    for i in (0, 30, 60):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(90) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def test_search_broadcasts_queries_in_bounded_passes(spark, monkeypatch):
    """Neither the driver nor a join holds a copy of the queries for each block of the index."""
    monkeypatch.setattr(bsi_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(bsi_search, "QUERY_ROWS", 10)
    monkeypatch.setattr(bsi_search, "ASKED_BYTES", 1500)
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda blocks: sent.append(sum(map(len, blocks))) or send(blocks))
    x = np.random.default_rng(11).integers(-300, 300, (330, 6))
    x[1::5] = x[0]  # equal scores, in many blocks
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    best = bsi_search.top_k(df, df.where("vec_id % 3 = 0"), 5)
    assert "Join" not in best._jdf.queryExecution().toString()
    assert len(sent) > 2 and max(sent) <= 1500
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in best.collect()}
    assert len(got) == 550
    for i in range(0, 330, 3):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(330) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in want]
