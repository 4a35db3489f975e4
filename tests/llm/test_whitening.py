"""Whitening against the decomposition of the covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hopframe.llm import queries, whitening


def usable(rows):
    return [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whole(vectors):
    return np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=np.int64)


def brute(rows):
    rows = usable(rows)
    x = whole([v for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    deviation = [sum(int(c) ** 2 for c in r) for r in off]
    a = off / n
    v = a.T @ a / n
    e, w = np.linalg.eigh(v)
    return [k for k, _ in rows], n, deviation, a, v, e[::-1], w[:, ::-1]


def compare(found, rows, components=8):
    keys, n, deviation, a, v, e, w = brute(rows)
    found = sorted(found, key=lambda r: (r["vec_id"], r["component"]))
    k = min(components, len(e))
    assert [r["vec_id"] for r in found] == sorted(k2 for k2 in keys for _ in range(k))
    assert [r["component"] for r in found] == list(range(1, k + 1)) * len(keys)
    at = {key: i for i, key in enumerate(keys)}
    assert all(r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] for r in found)
    order = [at[r["vec_id"]] for r in found[::k]]
    z = np.array([np.nan if r["whitened"] is None else r["whitened"] for r in found]).reshape(-1, k)
    for j in range(k):
        if e[j] < 1e-9 * e[0]:
            assert np.isnan(z[:, j]).all()
            continue
        assert abs(found[j]["explained"] - e[j] / np.trace(v)) <= 1e-9
        want = a[order] @ w[:, j] / np.sqrt(e[j])
        sign = np.sign(want @ z[:, j])
        gap = min([abs(e[j] - e[i]) for i in (j - 1, j + 1) if 0 <= i < len(e)] or [e[0]]) / e[0]
        assert np.abs(want - sign * z[:, j]).max() <= 1e-12 * len(e) / gap
    assert all(r["identity_error"] <= 1e-9 for r in found)


def test_query_against_the_covariance(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.op13_whitening(spark, sf).collect(), rows)


def run(spark, tmp_path, rows, kind="array<float>"):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, f"vec_id long, embedding {kind}").write.parquet(f"{path}/embeddings.parquet")
    return queries.op13_whitening(spark, path).collect()


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = [(i, (rng.normal(size=5) * [9, 3, 1, 0.3, 0.1]).tolist()) for i in range(80)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    compare(run(spark, tmp_path, base + odd, "array<double>"), base)


@pytest.mark.parametrize("shape", ["flat", "twins", "few", "scales", "one", "far"])
def test_weak_directions(spark, tmp_path, shape):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 10)) * np.geomspace(30, 1, 10)
    if shape == "flat":
        x[:, 4] = 0.25
    if shape == "twins":
        x[:, 3] = x[:, 7]
    if shape == "few":
        x = x[:6]
    if shape == "scales":
        x = rng.normal(size=(200, 10)) * np.geomspace(1e8, 1, 10)
    if shape == "one":
        x = x[:1]
    if shape == "far":
        x[:, 0] += 1e9
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = run(spark, tmp_path, rows, "array<double>")
    if shape == "one":
        assert len(found) == 8 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in found)
    elif shape == "scales":
        # The whole range of variances is beyond what the covariance itself resolves; the rows must still be white.
        z = np.array([r["whitened"] for r in sorted(found, key=lambda r: (r["vec_id"], r["component"]))]).reshape(-1, 8)
        assert np.abs(z.T @ z / len(z) - np.eye(8)).max() < 1e-6
        assert all(r["identity_error"] < 1e-6 for r in found)
    else:
        compare(found, rows)


def test_sizes_beyond_a_long_stay_exact(spark):
    rows = [(i, [float((-1) ** i * 2**40 + i), 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, model).collect()}
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((6 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}


def test_empty_tables_lengths_and_names(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, whitened string, deviation string, label int"
    df = spark.createDataFrame([(1, [1.0, 2.0], "w", "d", 3), (2, [2.0, 1.0], "w", "d", 3), (2, [2.0, 1.0], "w", "d", 3), (None, [0.0, 0.0], "w", "d", 3), (4, [1.0], "w", "d", 3), (5, [], "w", "d", 3)], schema)
    model = whitening.fit(df)
    got = whitening.whiten(df, model, keep=("vec_id", "label", "whitened", "deviation"))
    assert got.columns == ["vec_id", "label", "deviation", "whitened"]
    assert model.n == 4 and sorted(map(str, (r["vec_id"] for r in got.collect()))) == ["1", "2", "2", "None"]
    assert whitening.fit(df.limit(0)).n == 0
    assert run(spark, tmp_path, []) == []


def test_blocks_change_nothing_but_rounding(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    one = whitening.fit(df, components=4)
    monkeypatch.setattr(whitening, "BLOCK", 64 * 7)
    two = whitening.fit(df.repartition(9), components=4)
    assert one.sums == two.sums and one.n == two.n
    assert np.allclose(one.components, two.components, atol=1e-9) and np.allclose(one.variances, two.variances, rtol=1e-12)
