import pytest

from tidemail.operators import metrics as m
from tidemail.sources.tables import table

from conftest import SF01


def brute_report(pairs):
    labels = sorted({y for y, _ in pairs} | {p for _, p in pairs})
    out = {}
    for c in labels:
        tp = sum(1 for y, p in pairs if y == c and p == c)
        sup = sum(1 for y, _ in pairs if y == c)
        pred = sum(1 for _, p in pairs if p == c)
        pr = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[str(c)] = (pr, rc, f1, sup)
    return out


def test_report_fixture_values(spark):
    lab = table(spark, SF01, "labels")
    rep = {r["label"]: r for r in m.classification_report(lab, "quality", "toxic").collect()}
    assert rep["0"]["precision"] == pytest.approx(0.140804, abs=2e-6)
    assert rep["0"]["recall"] == pytest.approx(0.844827, abs=2e-6)
    assert rep["0"]["support"] == 58
    assert rep["1"]["precision"] == pytest.approx(0.823529, abs=2e-6)
    assert rep["1"]["recall"] == pytest.approx(0.123167, abs=2e-6)
    assert rep["1"]["support"] == 341
    pairs = [(r[0], r[1]) for r in lab.select("quality", "toxic").collect()]
    for k, (pr, rc, f1, sup) in brute_report(pairs).items():
        assert rep[k]["f1_score"] == pytest.approx(f1, abs=1e-6)
    acc = sum(1 for y, p in pairs if y == p) / len(pairs)
    assert rep["accuracy"]["f1_score"] == pytest.approx(acc, abs=1e-6)


def test_confusion_keeps_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (2, 0)], "y int, p int")
    got = sorted(tuple(r) for r in m.confusion_matrix(df, "y", "p").collect())
    assert got == [(0, 0, 2), (0, 2, 0), (2, 0, 1), (2, 2, 0)]


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (0, 1)], "y int, p int")
    rep = {r["label"]: r for r in m.classification_report(df, "y", "p").collect()}
    assert rep["0"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0
    assert rep["1"]["support"] == 0


def test_timing_summary_slow_warmups_and_ties(spark):
    import statistics
    values = [1 + i % 7 * 1e-4 for i in range(100)]
    rows = [("d", i, 1e7) for i in range(10)] + [("d", 10 + i, v) for i, v in enumerate(values)]
    rows += [("t", 5, 2.0)] * 14 + [("t", 6, 5.0), ("few", 1, 1.0), (None, 1, 3.0)] + [(None, 2, 4.0)] * 11
    df = spark.createDataFrame(rows, "device string, k int, ms double")
    got = {r.device: r for r in m.timing_summary(df, "device", "ms", "k", digits=12).collect()}
    assert got["d"].n_runs == 100 and got["d"].std_ms == pytest.approx(statistics.pstdev(values), abs=1e-10)
    tied = [2.0] * 4 + [5.0]
    assert got["t"].n_runs == 5 and got["t"].mean_ms == pytest.approx(2.6)
    assert got["t"].std_ms == pytest.approx(statistics.pstdev(tied))
    assert "few" not in got and got[None].n_runs == 2 and got[None].mean_ms == pytest.approx(4.0)
    none = {r.device: r for r in m.timing_summary(df, "device", "ms", "k", warmups=0).collect()}
    assert none["few"].n_runs == 1 and none["d"].n_runs == 110


def test_timing_summary_brute_force(spark):
    import statistics
    ev = table(spark, SF01, "events")
    got = {r["event_type"]: r for r in m.timing_summary(ev, "event_type", "value", "event_id",
                                                         warmups=10, baseline="view").collect()}
    rows = sorted(ev.select("event_type", "event_id", "value").collect(), key=lambda r: r[1])
    by = {}
    for t, _, v in rows:
        by.setdefault(t, []).append(v)
    means = {t: statistics.fmean(v[10:]) for t, v in by.items()}
    for t, vals in by.items():
        kept = vals[10:]
        assert got[t]["n_runs"] == len(kept)
        assert got[t]["mean_ms"] == pytest.approx(means[t], abs=1e-5)
        assert got[t]["std_ms"] == pytest.approx(statistics.pstdev(kept), abs=1e-5)
        assert got[t]["speedup"] == pytest.approx(means["view"] / means[t], abs=1e-5)
