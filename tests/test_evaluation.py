import itertools
from dataclasses import replace

import numpy as np
import pytest

from tripwright.evaluation import gates
from tripwright.evaluation.anchors import anchor_detection, stop_association
from tripwright.evaluation.matching import best_assignment, checked, match_segments
from tripwright.evaluation.metrics import pattern_ari, segment_metrics
from tripwright.evaluation.orientation import calibration, orientation_scores, risk_coverage
from tripwright.evaluation.sufficiency import data_sufficiency, make_splits
from tripwright.operators.proximity import _distance

SEG = "seg_id string, vehicle_id string, route_id string, start_us bigint, end_us bigint"
M = 60_000_000


def test_assignment_against_all_matchings():
    assert sorted(best_assignment(np.array([[0.5, 0.45], [0.45, 0.0]]))) == [(0, 1), (1, 0)]
    rng = np.random.default_rng(0)
    for _ in range(200):
        r, c = int(rng.integers(1, 5)), int(rng.integers(1, 5))
        w = rng.random((r, c)) * (rng.random((r, c)) < 0.6)
        best = max(sum(w[i, j] for i, j in enumerate(p) if j >= 0) for p in itertools.permutations([*range(c), *[-1] * r], r))
        assert sum(w[i, j] for i, j in best_assignment(w)) == pytest.approx(best)


def segments(spark):
    truth = [("t1", "v", "r", 0, 60 * M), ("t2", "v", "r", 70 * M, 130 * M), ("t3", "v", "r", 140 * M, 200 * M), ("t4", "w", "r2", 0, 60 * M)]
    pred = [("p1", "v", "r", 0, 60 * M), ("p2", "v", "r", 70 * M, 200 * M), ("p4", "w", "r2", 0, 28 * M), ("p5", "w", "r2", 30 * M, 60 * M), ("p6", "w", "r3", 0, M)]
    return spark.createDataFrame(pred, SEG), spark.createDataFrame(truth, SEG)


def test_matching_and_scores(spark):
    pred, truth = segments(spark)
    m = match_segments(pred, truth)
    got = {(r.pred_id, r.truth_id): r.clean for r in m.matches.collect()}
    assert got in ({("p1", "t1"): True, ("p2", "t2"): False, ("p5", "t4"): False}, {("p1", "t1"): True, ("p2", "t3"): False, ("p5", "t4"): False})
    assert m.counts.first().asDict() == {"n_pred": 5, "n_truth": 4, "splits": 1, "merges": 1}
    s = segment_metrics(pred, truth, 0.5).first()
    assert (s.tp, s.fp, s.fn) == (2, 3, 2) and s.fragment_rate == 0.25 and s.merge_rate == 0.2
    assert s.macro_f1 == pytest.approx(np.mean([2 / 5, 2 / 3, 0.0]))  # a route of false positives counts as zero
    assert s.f1_low <= s.weighted_f1 <= s.f1_high
    perfect = segment_metrics(truth, truth).first()
    assert perfect.f1 == perfect.weighted_f1 == perfect.f1_low == perfect.f1_high == 1.0
    none = segment_metrics(pred.limit(0), truth).first()
    assert none.tp == 0 and none.precision is None and none.recall == 0.0
    with pytest.raises(ValueError):
        checked(pred.union(pred), "pred")


def test_matching_refuses_repeated_and_blank_ids(spark):
    pred, truth = segments(spark)
    blank = truth.unionByName(spark.createDataFrame([("\t ", "v", "r", 0, M)], SEG))
    for bad, what in (((pred.union(pred), truth), "pred repeats"), ((pred, truth.union(truth)), "truth repeats"), ((pred, blank), "1 rows of truth have no seg_id")):
        for scored in (match_segments, segment_metrics):
            with pytest.raises(ValueError, match=what):
                scored(*bad)


def test_orientation(spark):
    rows = [("R1", 1, 0, True, 0.9), ("R1", 0, 1, True, 0.3), ("R2", 0, 0, True, 0.8), ("R2", 1, 1, True, None), ("R5", None, 1, True, None), ("R5", None, 0, True, None), ("R6", 1, 1, True, 1.0), ("R7", 0, 1, False, 0.5)]
    df = spark.createDataFrame(rows, "route_id string, pred_orientation int, truth_direction int, clean boolean, pred_confidence double")
    s = orientation_scores(df, 10).first()
    assert s.coverage == pytest.approx(5 / 7) and s.balanced_accuracy == 1.0 and s.end_to_end_recovery == 0.5 and s.min_coverage_gate
    assert [r.coverage for r in risk_coverage(df, "route_id").orderBy("rank").collect()] == pytest.approx([k / 7 for k in range(1, 6)])
    assert {r.bin: r.n for r in calibration(df).collect()} == {3: 1, 8: 1, 9: 1, 10: 1}
    with pytest.raises(ValueError):
        orientation_scores(df.drop("clean"), 10)
    assert orientation_scores(df.drop("clean"), 10, end_to_end=False).first().end_to_end_recovery is None


def test_pattern_ari(spark):
    def ari(pairs):
        return pattern_ari(spark.createDataFrame(pairs, "p string, t string"), "p", "t").first().ari

    assert ari([("x", "A"), ("x", "A"), ("y", "B"), ("y", "B")]) == 1.0
    assert ari([("x", "A"), ("x", "A"), ("x", "B"), ("x", "B")]) == 0.0
    assert ari([("x", "A")]) is None and ari([("x", "A"), (None, "B")]) is None


def test_anchors(spark):
    schema = "anchor int, latitude double, longitude double, recurrence int, coverage double"
    found = spark.createDataFrame([(1, 50.0, 9.0, 5, 0.5), (2, 50.01, 9.0, 5, 0.5), (3, 50.0001, 9.0, 1, 0.5), (4, 51.0, 9.0, 9, 0.9)], schema)
    truth = spark.createDataFrame([(1, 50.0002, 9.0), (2, 50.0101, 9.0)], "anchor int, latitude double, longitude double")
    s = anchor_detection(found, truth)
    assert (s.tp, s.n_discovered_kept, s.n_dropped_low_support, s.recall) == (2, 3, 1, 1.0) and s.precision == pytest.approx(2 / 3)
    assert anchor_detection(found.limit(0), truth).precision is None
    stops = spark.createDataFrame([("a", 50.0, 9.0005), ("b", 50.0, 9.0)], "stop_id string, latitude double, longitude double")
    assert {r.anchor: (r.stop_id, r.matched) for r in stop_association(found, stops).collect()} == {1: ("b", True), 2: (None, False), 3: ("b", True), 4: (None, False)}


def test_unmatched_anchors_keep_their_distance(spark):
    where = "latitude double, longitude double"
    anchors = spark.createDataFrame([(1, 50.0, 9.0), (2, 50.01, 9.0), (3, 0.0, 0.0), (4, -50.0, -171.0), (5, None, 9.0), (1, 51.0, 9.0)], f"anchor int, {where}")
    stops = spark.createDataFrame([("a", 50.0, 9.0005), ("b", 50.0, 9.0), ("c", 0.0, 0.001)], f"stop_id string, {where}")
    places = np.array([(50.0, 9.0005), (50.0, 9.0), (0.0, 0.001)])
    least = lambda a, b: _distance(a, b, places[:, 0], places[:, 1]).min()
    want = [(1, "b", True, 0.0), (1, None, False, least(51.0, 9.0)), (2, None, False, least(50.01, 9.0)), (3, None, False, least(0.0, 0.0)), (4, None, False, least(-50.0, -171.0)), (5, None, False, None)]
    got = sorted(((r.anchor, r.stop_id, r.matched, r.distance_m) for r in stop_association(anchors, stops, 50.0).collect()), key=lambda x: (x[0], x[3] or 0.0))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got[:-1]] == pytest.approx([x[3] for x in want[:-1]]) and got[-1][3] is None
    assert {r.anchor: r.matched for r in stop_association(anchors, stops.limit(0)).collect()} == dict.fromkeys(range(1, 6), False)


def test_sufficiency_and_splits(spark):
    rows = [(i, "v", f"r{i % 2}", i * 3600 * 1_000_000, 50.0 + i * 0.001, 9.0) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, vehicle_id string, route_id string, t bigint, latitude double, longitude double")
    s = data_sufficiency(df, min_vehicle_days=1, min_pings=10).first()
    assert s.sufficient and s.n_routes == 2 and s.complete_vehicle_days == 1 and s.median_vehicle_day_move_m == pytest.approx(23 * 111.19, rel=1e-3)
    assert not data_sufficiency(df.limit(0)).first().sufficient
    data = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p1")], "agency string, period string")
    sp = make_splits(data, "a", "b", "period", ["p1"])
    assert (sp.calibration.count(), sp.heldout.count(), sp.transfer.count(), sp.transfer_claim_supported) == (1, 1, 1, True)
    with pytest.raises(ValueError):
        make_splits(data, "a", "a", "period", ["p1"])
    with pytest.warns(UserWarning):
        make_splits(data, "a", None, "period", ["p9"])


def test_gates():
    r = gates.preregister("2026-01-01")
    one = gates.gate1([True, True, False, False], r)
    two = gates.gate2(0.8, 0.6, 0.1, 0.1, 0.9, r)
    assert gates.report(one, two, r)["build_authorized"]
    assert not gates.report(one, None, r)["build_authorized"]
    assert not gates.report(one | {"pass": True}, two | {"merge_rate": 0.5, "pass": True}, r)["build_authorized"]
    assert "PASS" in gates.shown(gates.report(one, two, r), r)
    for bad in (lambda: gates.preregister(), lambda: gates.gate1([1], r), lambda: gates.gate2(1.2, 0.0, 0.0, 0.0, 0.0, r), lambda: gates.report(one | {"eligible_fraction": 0.9}, two, r), lambda: gates.report({}, two, r), lambda: gates.report(one, two, gates.preregister("2026-01-02")), lambda: gates.gate1([True], replace(r, gate1_min_eligible_fraction=0.0))):
        with pytest.raises(ValueError):
            bad()
    with pytest.warns(UserWarning):
        assert not gates.gate1([None], r)["pass"]
