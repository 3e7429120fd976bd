"""Bracketed distances, chi-square tails, running drift and request streams against plain computations."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.numeric import chi_square_tail
from riskweave.operators import brackets, drift, scoring
from riskweave.streaming import drift as running
from riskweave.streaming import logs, requests


def distances(ref, cur):
    """KS and area between two samples, value by value."""
    points = np.unique(np.concatenate([ref, cur]))
    f = [np.searchsorted(np.sort(x), points, "right") / len(x) for x in (ref, cur)]
    gaps = np.abs(f[0] - f[1])
    return gaps.max(), (gaps[:-1] * np.diff(points)).sum()


@pytest.fixture(scope="module")
def slices(spark):
    rng = np.random.default_rng(1)
    n = 30_000
    cur = rng.random(n) < 0.3
    data = {
        "same": rng.normal(0, 1, n),
        "moved": rng.normal(0, 1, n) + 0.1 * cur,
        "wider": rng.normal(0, 1, n) * np.where(cur, 1.3, 1),
        "whole": np.floor(rng.exponential(4, n)),
        "heavy": np.where(rng.random(n) < 0.6, 7.0, rng.random(n) * 10),
        "flag": (rng.random(n) < np.where(cur, 0.3, 0.2)).astype(float),
        "far": np.exp(rng.normal(0, 8, n)) * np.where(rng.random(n) < 0.5, -1, 1),
        "constant": np.full(n, 3.0),
        "few": np.where(np.arange(n) < 12, rng.random(n), np.nan),
    }
    data["gaps"] = np.where(rng.random(n) < 0.4, np.nan, data["same"])
    import pandas as pd

    pdf = pd.DataFrame({**data, "slice": np.where(cur, "current", "reference")})
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    return df.repartition(4).cache(), pdf, list(data)


def test_distances_are_exact(slices):
    df, pdf, names = slices
    ks = {r["feature"]: r for r in drift.ks_two_sample(df, names).collect()}
    area = {r["feature"]: r["distance"] for r in drift.wasserstein(df, names).collect()}
    assert set(ks) == set(area) == set(names) - {"few"}
    for name in ks:
        ref, cur = (pdf.loc[pdf["slice"] == s, name].dropna().to_numpy() for s in ("reference", "current"))
        gap, distance = distances(ref, cur)
        assert ks[name]["ks"] == gap and (ks[name]["n_ref"], ks[name]["n_cur"]) == (len(ref), len(cur))
        assert area[name] == pytest.approx(distance, rel=1e-9, abs=1e-12)


def test_few_values_are_shuffled(slices, monkeypatch):
    df, pdf, _ = slices
    seen = []
    cells = brackets.open_cells
    monkeypatch.setattr(drift, "open_cells", lambda *a: seen.append(cells(*a).count()) or cells(*a))
    names = ["same", "moved", "wider", "gaps"]
    drift.ks_two_sample(df, names).collect()
    assert 0 < sum(seen) < 0.05 * pdf[names].count().sum()
    seen.clear()
    drift.wasserstein(df, names).collect()
    assert 0 < sum(seen) < 0.05 * pdf[names].count().sum()


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_cuts_give_the_same(slices, monkeypatch, cuts):
    """Bad cut points leave more to be counted one by one, and groups of one feature change nothing."""
    df, pdf, _ = slices
    monkeypatch.setattr(brackets, "MIN_CUTS", cuts)
    monkeypatch.setattr(brackets, "MAX_CUTS", cuts)
    monkeypatch.setattr(brackets, "CELLS", 1)
    small = df.where("abs(same) < 0.5")
    part = pdf[pdf["same"].abs() < 0.5]
    for name, r in {r["feature"]: r for r in drift.ks_two_sample(small, ["moved", "heavy"]).collect()}.items():
        assert r["ks"] == distances(*(part.loc[part["slice"] == s, name].to_numpy() for s in ("reference", "current")))[0]
    for r in drift.wasserstein(small, ["whole", "far"]).collect():
        want = distances(*(part.loc[part["slice"] == s, r["feature"]].to_numpy() for s in ("reference", "current")))[1]
        assert r["distance"] == pytest.approx(want, rel=1e-9)


def test_odd_slices(spark):
    rows = [("reference", float(i), None, 0.0) for i in range(20)] + [("current", float(i), 1.0, -0.0) for i in range(20)] + [(None, 5.0, 5.0, 9.0), ("x", 5.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "slice string, a double, b double, z double")
    assert sorted(map(tuple, drift.ks_two_sample(df, ["a", "b", "z"]).collect())) == [("a", 20, 20, 0.0), ("z", 20, 20, 0.0)]
    assert sorted(map(tuple, drift.wasserstein(df, ["a", "b", "z"]).collect())) == [("a", 0.0), ("z", 0.0)]
    assert drift.ks_two_sample(df.limit(0), ["a"]).collect() == [] and drift.wasserstein(df.limit(0), ["a"]).collect() == []


def exact_tail(chi2, dof):
    """Finite sums: the tail of an even number of degrees, and of an odd one with the error function."""
    x = chi2 / 2
    if dof % 2 == 0:
        return sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(dof // 2))
    return math.erfc(math.sqrt(x)) + sum(math.exp(-x + (k + 0.5) * math.log(x) - math.lgamma(k + 1.5)) for k in range(dof // 2))


def test_chi_square_tail(spark):
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05)]
    cases = [(c, d) for c, d, _ in known]
    cases += [(x, d) for d in (1, 2, 3, 7, 30, 101, 1000, 9999) for x in (0.01, 0.5 * d, d - 0.3, d + 2.1, 1.2 * d, 2.0 * d, 40.0 + d)]
    df = spark.createDataFrame(cases, "chi2 double, dof long")
    got = [r[0] for r in df.select(chi_square_tail(F.col("chi2"), F.col("dof"))).collect()]
    assert got[:4] == pytest.approx([0.05] * 4, abs=1e-12)
    assert got == pytest.approx([exact_tail(*c) for c in cases], abs=1e-9)
    edge = spark.createDataFrame([(0.0, 3), (0.0, 0), (None, 3), (1e6, 2)], "chi2 double, dof long")
    assert [r[0] for r in edge.select(chi_square_tail(F.col("chi2"), F.col("dof"))).collect()] == [1.0, 1.0, None, 0.0]


def test_chi_square_of_all_columns_at_once(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        cur = i % 4 == 0
        rows.append(("current" if cur else "reference", str(rng.integers(0, 5)), int(rng.integers(0, 3) * (1 + cur)), "one", None if cur else "r"))
    df = spark.createDataFrame(rows, "slice string, `a b` string, n int, c string, d string")
    got = {r["feature"]: r for r in drift.chi_square_report(df, ["a b", "n", "c", "d"]).collect()}
    alone = drift.chi_square_drift(df, "n").first()
    assert got["n"]["chi2"] == pytest.approx(alone["chi2"]) and got["n"]["dof"] == alone["dof"] and got["n"]["drifted"] == 1
    assert got["a b"]["p_value"] == pytest.approx(exact_tail(got["a b"]["chi2"], 4), abs=1e-9) and got["a b"]["drifted"] == 0
    assert (got["c"]["dof"], got["c"]["p_value"]) == (0, 1.0) and got["d"]["chi2"] is None


# ---- streams ----------------------------------------------------------------------------

ROWS = "ts timestamp, x double, y double"


def arrivals(spark, folder, files):
    """Parquet files, each a minute younger than the last, as files are streamed by age."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            then = time.time() - 60 * (50 - i)
            os.utime(f"{folder}/{i}/{name}", (then, then))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_running_drift_equals_batch_drift_of_each_window(spark, tmp_path):
    import datetime as dt

    rng = np.random.default_rng(5)
    files = [
        [
            (dt.datetime(2026, 1, 1, int(h), 30, tzinfo=dt.timezone.utc), float(rng.normal(h, 1)), None if i % 7 == 0 else float(rng.integers(0, 4)))
            for i, h in enumerate(rng.integers(f, f + 3, 60))
        ]
        for f in range(5)
    ]
    stream = arrivals(spark, tmp_path / "in", files)
    reference = spark.range(500).selectExpr("CAST(pmod(id * 7919, 997) AS DOUBLE) / 250 AS x", "CAST(id % 5 AS DOUBLE) AS y", "id")
    counted = running.reference_values(reference, ["x", "y"])
    place = dict(path=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"), time="ts", width="1 hour", late_by="100 days")
    report = lambda: sorted(map(tuple, running.stream_drift(stream, counted, ["x", "y"], **place).collect()))
    got = report()
    arrived = spark.createDataFrame([r for f in files for r in f], ROWS).withColumn("w", F.window("ts", "1 hour"))
    want = []
    for (w,) in arrived.select("w").distinct().collect():
        mine = arrived.where(F.col("w.start") == w["start"]).select("x", "y", F.lit("current").alias("slice"))
        both = mine.unionByName(reference.select("x", "y", F.lit("reference").alias("slice")))
        for r in drift.ks_two_sample(both, ["x", "y"]).collect():
            want.append((w["start"], w["end"], *r, int(r["ks"] >= drift.DRIFT_AT)))
    assert got == sorted(want) and len({r[0] for r in got}) > 4
    assert report() == got  # nothing new
    # as if the run had ended before the batch of the last file was committed: it runs again and overwrites its counts
    for log, numbers in (("commits", (4, 5)), ("offsets", (5,))):
        for n in numbers:
            for name in (str(n), f".{n}.crc"):
                (tmp_path / "state" / log / name).unlink(missing_ok=True)
    written = (tmp_path / "out" / "batch=4").stat().st_mtime
    assert report() == got and (tmp_path / "out" / "batch=4").stat().st_mtime > written


def test_an_empty_stream_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="no data"):
        logs.run_batches(stream, lambda b: b, str(tmp_path / "out"))


def test_requested_ids_are_scored_or_reported(spark, tmp_path):
    calls = [("a", ["1", "2", "900"]), ("b", ["2", "not_an_int", "-5", "2"]), ("c", []), ("d", None), ("e", [None, "3"])]
    for i, part in enumerate((calls[:2], calls[2:])):
        spark.createDataFrame(part, "call string, client_ids array<string>").write.parquet(f"{tmp_path}/in/{i}")
    stream = (
        spark.readStream.schema("call string, client_ids array<string>")
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(f"{tmp_path}/in")
    )
    features = spark.range(1, 10).selectExpr("id AS SK_ID_CURR", "id / 10D AS x", "1 AS call")
    score = scoring.linear_score({"x": 2.0}, -1.0)
    scored, unknown = requests.stream_requests(stream, features, score, str(tmp_path / "out"))
    p = lambda k: round(1 / (1 + math.exp(1 - 0.2 * k)), 4)
    got = sorted((r["call"], r["position"], r["client_id"], r["score"], r["decision"]) for r in scored.collect())
    want = [("a", 0, 1), ("a", 1, 2), ("b", 0, 2), ("b", 3, 2), ("e", 1, 3)]
    assert got == [(*k, p(k[2]), scoring.REFUSED if p(k[2]) >= 0.46 else scoring.APPROVED) for k in want]
    missing = sorted((r["call"], r["position"], r["requested"], r["client_id"]) for r in unknown.collect())
    assert missing == [("a", 2, "900", 900), ("b", 1, "not_an_int", None), ("b", 2, "-5", -5), ("e", 0, None, None)]
