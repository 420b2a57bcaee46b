"""Hierarchies and units against brute force and edge cases."""

import random

from tessera.operators import hierarchy as H
from tessera.operators import units as U


def brute(parents):
    out = {}
    for x in parents:
        path, y, seen = [x], x, {x}
        while parents.get(y) in parents:
            y = parents[y]
            if y in seen:
                path = None
                break
            seen.add(y)
            path.append(y)
        out[x] = ("", -1, []) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent string, t int, root string")
    last = {}
    for i, p, t, _ in rows:
        if i is not None and (i not in last or (t, p or "") >= last[i][0]):
            last[i] = ((t, p or ""), p or None)
    want = brute({i: p for i, (_, p) in last.items()})
    below = {i: sum(i in path[:-1] for _, _, path in want.values()) for i in want}
    for tail in (0, 12, 10_000):
        got = {r.id: (r.root, r.depth, list(r.path), r.n_descendants) for r in H.resolve(df, "id", "parent", ["t"], tail=tail).collect()}
        assert got == {i: (*x, below[i]) for i, x in want.items()}, tail
    got = {r.id: (r.root, r.depth) for r in H.resolve(df, "id", "parent", ["t"], with_path=False, tail=5).collect()}
    assert got == {i: x[:2] for i, x in want.items()}


def test_random_forest_with_cycles_and_chain(spark):
    r = random.Random(3)
    rows = [(f"n{i}", f"n{r.randrange(i)}" if i and r.random() < 0.9 else r.choice([None, "", "gone"]), 0, "clash") for i in range(60)]
    rows += [(f"c{i}", f"c{(i + 1) % 5}", 0, None) for i in range(5)] + [("tail", "c2", 0, None), ("self", "self", 0, None)]
    rows += [(f"k{i}", f"k{i - 1}" if i else None, 0, None) for i in range(40)]
    rows += [("n3", "n0", 1, None), ("n3", "n0", 1, None), (None, "n1", 0, None)]
    check(spark, rows)


def test_hot_parent_and_empty(spark):
    check(spark, [("r", None, 0, None), *[(f"x{i}", "r", 0, None) for i in range(200)]])
    assert H.resolve(spark.createDataFrame([], "id string, parent string"), "id", "parent").count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    res = H.resolve(df, "id", "parent")
    assert {tuple(r) for r in H.descendants(res).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert {r.id: r.n_descendants for r in res.collect()} == {"a": 3, "b": 1, "c": 0, "d": 0}


def test_parse_units_and_numbers():
    assert U.parse_unit("€ MM", "money") == ("EUR", 1e6, 0.0)
    assert U.parse_unit(" hk$'000", "money") == ("HKD", 1e3, 0.0)
    assert U.parse_unit("十亿新加坡元", "money") == ("SGD", 1e9, 0.0)
    assert U.parse_unit("Rs crore", "money") == ("INR", 1e7, 0.0)
    assert U.parse_unit("see note", "money") is None
    assert U.stated_unit("-", "Paper used (lbs)", None, "mass") == ("", 0.00045359237, 0.0)
    assert U.stated_unit(None, "Revenue", "985,56 M€", "money") == ("EUR", 1e6, 0.0)
    assert U.stated_unit(None, "Staff", "27.2 '000 people", "people") == ("", 1e3, 0.0)
    assert [U.parse_number(x) for x in ("5 675,9 M€", "296.569,0 Tsd. €", "1,232.5 people", "(12.5)", "7,771,880.0", None, "none")] == [5675.9, 296569.0, 1232.5, -12.5, 7771880.0, None, None]


def _brute_states(cost):
    import itertools

    n, s = cost.shape
    total = lambda p: sum(cost[i, k] for i, k in enumerate(p)) + U.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
    return min(total(p) for p in itertools.product(range(s), repeat=n)), total


def test_viterbi_against_all_paths_and_blocks():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(40):
        cost = r.uniform(0, 2, (6, 3))
        least, total = _brute_states(cost)
        assert abs(total(U.viterbi(cost, np.array([True] + [False] * 5)).tolist()) - least) < 1e-9
        parts = [cost[:2], cost[2:5], cost[5:]]
        m = [U.block_matrix(p) for p in parts]
        front, back = [np.zeros(3)], [np.zeros(3)]
        for x in m[:-1]:
            front.append(U.through(front[-1], x))
        for x in reversed(m[1:]):
            back.insert(0, U.back_through(back[0], x))
        path = [s for p, f, b in zip(parts, front, back) for s in U.viterbi(p, np.array([True] + [False] * (len(p) - 1)), f[None], b[None])]
        assert abs(total(path) - least) < 1e-9


FACT = "fact_id long, metric_code string, entity string, channel string, period_type string, period string, value double, unit string, raw_label string, raw_value string, series string"


def facts(spark, rows):
    df = spark.createDataFrame(rows, FACT)
    metrics = spark.createDataFrame([("FLOOR", "area"), ("REVENUE", "money"), ("SRVTEMP", "temp")], "metric_code string, kind string")
    fx = spark.createDataFrame([("EUR", 2020, 1.2), ("USD", 2020, 1.0)], "currency string, fiscal_year int, usd_per_unit double")
    return U.convert(df, metrics, fx)


def test_convert_and_pairs(spark):
    k = ("E", "TOTAL", "FY", "2020")
    rows = [
        (1, "REVENUE", *k, 12.0, "USD_M", "Revenue", None, "clash"),
        (2, "REVENUE", *k, None, None, "Revenue", "€10,000.0 thousand", None),
        (3, "REVENUE", *k, 12.0, None, "Revenue", None, None),
        (4, "REVENUE", *k, 12.3, "US$ mn", "Revenue", None, None),
        (5, "FLOOR", *k, 1.0, "ha", "x", None, None),
        (6, "FLOOR", *k, 10000.0, "m²", "x", None, None),
        (7, "FLOOR", *k, None, "m²", "x", None, None),
        (8, "SRVTEMP", *k, 20.0, "°C", "x", None, None),
        (9, "SRVTEMP", *k, 68.0, "°F", "x", None, None),
        (10, "NOSUCH", *k, 1.0, "kg", "x", None, None),
        (11, None, None, None, None, None, None, None, None, None, None),
    ]
    out = facts(spark, rows)
    by = {r.fact_id: r for r in out.collect()}
    assert len(by) == 11 and abs(by[2].common_value - 12.0) < 1e-9 and not by[3].stated and by[7].common_value is None and not by[10].stated
    assert abs(by[3].common_value - 12.0) < 1e-6  # the unit that fits the level of the series
    assert {tuple(r) for r in U.agreeing_pairs(out).collect()} == {(1, 2), (5, 6), (8, 9)}


def test_decoded_unit_overrules_the_usual_reading(spark):
    rows = [(i, "REVENUE", "E", "TOTAL", "FY", "2020", 12.0 + 0.01 * i, "EUR_M", "Revenue", None, None) for i in range(1, 6)]
    rows += [(6, "REVENUE", "E", "TOTAL", "FY", "2020", 14.46, "$ mn", "Revenue", None, None), (7, "REVENUE", "E", "TOTAL", "FY", "2020", 14400.0, "USD mil", "Revenue", None, None), (8, "REVENUE", "E", "TOTAL", "FY", "2020", 14.4, "$", "Revenue", None, None)]
    assert U.stated_unit("USD mil", None, None, "money") == ("USD", 1e6, 0.0) and U.stated_unit("$", None, None, "money") == ("USD", 1.0, 0.0)
    out = facts(spark, rows)
    by = {r.fact_id: round(r.common_value, 4) for r in out.collect()}
    assert by[6] == 14.46 and by[7] == 14.4 and by[8] == 14.4  # mil for thousand and a scale left out
    found = {tuple(r) for r in U.agreeing_pairs(out).collect()}
    assert (7, 8) in found and (1, 7) in found and (1, 8) in found and (6, 8) not in found  # 6 and 8 are decoded to the same unit


def test_long_series_equal_whole_ones(spark):
    r = random.Random(5)
    units = ["EUR_M", "$", "$ mil", None, "€ k", "USD", "EUR"]
    rows = [(i, "REVENUE", r.choice("EF"), "TOTAL", "FY", "2020", r.choice([12.0, 12000.0, 12e6]) * r.uniform(0.9, 1.1), r.choice(units), "Revenue", None, None) for i in range(300)]
    rows += [(i, "REVENUE", "E", None, "FY", None, 5.0, "EUR", "Revenue", None, None) for i in range(300, 330)]
    df = spark.createDataFrame(rows + rows[:3], FACT)
    metrics = spark.createDataFrame([("REVENUE", "money")], "metric_code string, kind string")
    fx = spark.createDataFrame([("EUR", 2020, 1.2), ("USD", 2020, 1.0)], "currency string, fiscal_year int, usd_per_unit double")
    take = lambda block: sorted((x.fact_id, x.common_value, x.unit_factor, x.stated) for x in U.convert(df, metrics, fx, block).collect())
    small, large = take(16), take(10_000)
    assert len(small) == 333
    assert small == large


def test_many_copies_of_a_figure(spark):
    k = ("E", "TOTAL", "FY", "2020")
    rows = [(i, "REVENUE", *k, 12.0, "USD_M", "Revenue", None, None) for i in range(50)] + [(99, "REVENUE", *k, 12000.0, "USD K", "Revenue", None, None)]
    assert {tuple(r) for r in U.agreeing_pairs(facts(spark, rows)).collect()} == {(i, 99) for i in range(50)}


def test_empty_facts(spark):
    assert U.agreeing_pairs(facts(spark, [])).count() == 0
