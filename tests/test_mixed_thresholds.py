"""Mixed thresholds against brute force: hulls, equal expected rates, best accuracy."""

import random

import numpy as np
import pytest

from fairaudit.operators import mixed_thresholds as MX


def plain_hull(points):
    """Upper hull by its definition, over (fp, tp) points."""
    points = sorted(set(points), key=lambda p: (p[0] + p[1], p))
    out = []
    for c in points:
        while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (c[1] - out[-1][1])
                                - (out[-1][1] - out[-2][1]) * (c[0] - out[-1][0])) >= 0:
            out.pop()
        out.append(c)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_upper_chain(seed):
    rng = np.random.default_rng(seed)
    scale = 1 if seed % 3 else 10 ** 11
    steps = rng.integers(0, 4, (rng.integers(1, 200), 2)) * scale
    steps = steps[steps.sum(axis=1) > 0]
    pts = np.vstack([[0, 0], np.cumsum(steps, axis=0)]).astype(np.int64)
    got = [tuple(map(int, pts[i])) for i in MX.upper_chain(pts[:, 0], pts[:, 1])]
    assert got == plain_hull([tuple(map(int, p)) for p in pts])


def table(spark, seed, n=400, extra=()):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = rnd.choice(["a", "a", "b", "c", None])
        s = round(min(1.0, max(0.0, rnd.gauss({"a": .6, "b": .45}.get(g, .5), .2))), 2)
        rows.append((i, g, s, int(rnd.random() < s * (0.7 if g == "b" else 1))))
    rows += [(n + k, *r) for k, r in enumerate(extra)]
    return rows, spark.createDataFrame(rows, "id long, g string, s double, y int")


def expected(rows, mixture):
    """Per group: expected (true positives, false positives, positives, negatives) of the mixture."""
    by = {r["grp"]: r for r in mixture}
    out = {}
    for _, g, s, y in rows:
        m = by[g or "Unknown"]
        ignore = m["p_ignore"]
        chance = sum(m[f"p{i}"] for i in (0, 1) if s is not None and s == s and s >= m[f"threshold{i}"])
        chance = ignore * m["prediction_constant"] + (1 - ignore) * chance
        t = out.setdefault(g, [0.0, 0.0, 0, 0])
        t[0 if y == 1 else 1] += chance
        t[2 if y == 1 else 3] += 1
    return out


def accuracy(e):
    return sum(tp + n - fp for tp, fp, p, n in e.values()) / sum(p + n for _, _, p, n in e.values())


def hulls(rows):
    out = {}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        cuts = sorted({r[2] for r in mine if r[2] is not None})
        pts = [(0, 0)] + [(sum(r[3] != 1 for r in mine if r[2] is not None and r[2] >= c),
                           sum(r[3] == 1 for r in mine if r[2] is not None and r[2] >= c)) for c in cuts]
        out[g] = (plain_hull(pts), sum(r[3] == 1 for r in mine), sum(r[3] != 1 for r in mine))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_parity_mixture(spark, seed):
    rows, df = table(spark, seed)
    mix = MX.parity_mixture(MX.group_hull(df, "s", "y", "g")).collect()
    e = expected(rows, mix)
    x = mix[0]["target_rate"]
    assert len(mix) == 4 and "Unknown" in {r["grp"] for r in mix}
    assert all(abs((tp + fp) / (p + n) - x) < 1e-9 for tp, fp, p, n in e.values())
    assert abs(accuracy(e) - mix[0]["accuracy"]) < 1e-9
    best = max(sum(np.interp(r * (p + n), [a + b for a, b in h], [b - a + n for a, b in h]) for h, p, n in hulls(rows).values())
               for r in np.linspace(0, 1, 4001)) / len(rows)
    assert mix[0]["accuracy"] >= best - 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_equalized_odds_mixture(spark, seed):
    rows, df = table(spark, seed)
    mix = MX.equalized_odds_mixture(MX.group_hull(df, "s", "y", "g")).collect()
    e = expected(rows, mix)
    tpr, fpr = [tp / p for tp, _, p, _ in e.values()], [fp / n for _, fp, _, n in e.values()]
    assert max(tpr) - min(tpr) < 1e-9 and max(fpr) - min(fpr) < 1e-9        # expected gap 0 on the fitting rows
    assert max(r["eo_gap"] for r in mix) < 1e-9 and abs(accuracy(e) - mix[0]["accuracy"]) < 1e-9

    def value(x):
        low = min(np.interp(x, [a / n for a, _ in h][h[1][0] == 0:], [b / p for _, b in h][h[1][0] == 0:]) for h, p, n in hulls(rows).values())
        p, n = sum(v[1] for v in hulls(rows).values()), sum(v[2] for v in hulls(rows).values())
        return (p * low + n * (1 - x)) / (p + n)
    assert mix[0]["accuracy"] >= max(value(x) for x in np.linspace(0, 1, 2001)) - 1e-9


def test_groups_of_one_label_and_rows_without_a_score(spark):
    rows, df = table(spark, 3, 200, extra=[("pos", .4, 1), ("pos", .9, 1), ("neg", .3, 0), ("neg", .2, 0), ("a", None, 1), ("a", float("nan"), 0)])
    hull = MX.group_hull(df, "s", "y", "g")
    mix = MX.parity_mixture(hull).collect()
    e = expected([r if r[2] == r[2] else (*r[:2], None, r[3]) for r in rows], mix)
    assert len({round((tp + fp) / (p + n), 9) for tp, fp, p, n in e.values()}) == 1
    eo = MX.equalized_odds_mixture(hull).collect()
    e = expected([r if r[2] == r[2] else (*r[:2], None, r[3]) for r in rows], eo)
    assert len({round(tp / p, 9) for tp, _, p, _ in e.values() if p}) == 1
    assert len({round(fp / n, 9) for _, fp, _, n in e.values() if n}) == 1


def test_labels_are_drawn_once_and_for_all(spark):
    rows, df = table(spark, 4, 3000)
    mix = MX.parity_mixture(MX.group_hull(df, "s", "y", "g"))
    one = {r["id"]: r["y_pred"] for r in MX.apply_mixture(df, mix, "s", "g", "id").collect()}
    two = {r["id"]: r["y_pred"] for r in MX.apply_mixture(df.repartition(5), mix, "s", "g", "id").collect()}
    x = mix.first()["target_rate"]
    assert one == two and set(one.values()) <= {0, 1}
    for g in ("a", "b", "c", None):
        mine = [one[r[0]] for r in rows if r[1] == g]
        assert abs(sum(mine) / len(mine) - x) < 0.06
    other = spark.createDataFrame([(1, "never seen", .9)], "id long, g string, s double")
    assert MX.apply_mixture(other, mix, "s", "g", "id").first()["y_pred"] == 0
    empty = df.limit(0)
    assert MX.parity_mixture(MX.group_hull(empty, "s", "y", "g")).count() == 0
    assert MX.equalized_odds_mixture(MX.group_hull(empty, "s", "y", "g")).count() == 0


def test_one_null_group_leaves_the_level_form_intact(spark):
    from fairaudit.operators import mitigate as MI
    _, df = table(spark, 5)
    th = MI.threshold_parity(MI.group_roc(df, "s", "y", "g"))
    assert {r["grp"] for r in th.collect()} == {"a", "b", "c", "Unknown"}
    assert MI.apply_group_threshold(df, th, "s", "g").where("g is null and y_pred = 1").count() > 0
