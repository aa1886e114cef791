import random

from siftwell.operators import alerts


def samples(spark, rows):
    return spark.createDataFrame(rows, "series string, limit string, ts double, value double")


def grown(points, at, width):
    """Increase of one counter over (at - width, at], step by step."""
    w = [(t, v) for t, v in sorted(points) if at - width < t <= at]
    if len(w) < 2:
        return None
    total = w[-1][1] - w[0][1] + sum(a for (_, a), (_, b) in zip(w, w[1:]) if b < a)
    span = w[-1][0] - w[0][0]
    mean = span / (len(w) - 1)
    ends = [w[0][0] - (at - width), at - w[-1][0]]
    ends = [mean / 2 if e >= 1.1 * mean else e for e in ends]
    if total > 0 and w[0][1] >= 0:
        ends[0] = min(ends[0], span * w[0][1] / total)
    return total * (span + sum(ends)) / span


def test_increase_over_resets_and_gaps(spark):
    rng = random.Random(1)
    rows, points = [], {}
    for s in ("a", "b"):
        t, v = 0.0, 0.0
        for _ in range(120):
            t += rng.choice((15, 15, 15, 16.5, 400))
            v = 0.0 if rng.random() < 0.05 else v + rng.randrange(4)
            rows.append((s, "x", t, v))
            points.setdefault(s, []).append((t, v))
    got = {(r.series, r.t): r.increase for r in alerts.increase(samples(spark, rows), 300, 60).collect()}
    end = int(max(t for ps in points.values() for t, _ in ps)) + 600
    want = {(s, t): g for s, ps in points.items() for t in range(0, end, 60) if (g := grown(ps, t, 300)) is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pending_firing_and_back(spark):
    rule = alerts.Rule("Deep", "value", 90, 100.0, 120)
    values = [50, 150, 160, 170, 180, 90, 200, 210]
    rows = [("q", "x", 60.0 * k, float(v)) for k, v in enumerate(values)]
    got = sorted((r.t, r.state, r.active_since) for r in alerts.alerts(samples(spark, rows), rule, 60).collect())
    assert got == [(60, "pending", 60), (120, "pending", 60), (180, "firing", 60), (240, "firing", 60), (360, "pending", 360), (420, "pending", 360), (480, "firing", 360)]
    gap = [("q", "x", t, 150.0) for t in (0.0, 60.0, 600.0)]
    assert {(r.t, r.active_since) for r in alerts.alerts(samples(spark, gap), rule, 60).collect()} == {(0, 0), (60, 0), (120, 0), (600, 600), (660, 600)}


def test_every_rule_of_the_service_runs(spark):
    rows = [(f"s{k % 2}", "tokens" if k % 2 else "storage", 15.0 * k, float(40 * k)) for k in range(200)]
    df = samples(spark, rows).withColumnRenamed("limit", "kind").selectExpr("*", "kind as limit")
    for rule in alerts.RULES.values():
        found = alerts.alerts(df, rule, 60).collect()
        assert {r.state for r in found} >= {"firing"} and all(r.rule == rule.name for r in found)
    spike = alerts.RULES["quota_rejections"]
    assert {r.label for r in alerts.alerts(df, spike, 60).collect()} == {"tokens", "storage"}
