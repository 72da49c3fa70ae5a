"""Scores against plain definitions."""

import itertools
import math
import random

import pytest

from vellumine.operators import layout as L
from vellumine.operators import scores as C


def slow_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def test_distance():
    g = random.Random(3)
    for _ in range(200):
        a, b = ([g.choice("abc") for _ in range(g.randint(0, 8))] for _ in range(2))
        assert C.distance(a, b) == slow_distance(a, b)
    assert C.word_error_rate("", "") == 0 and C.word_error_rate("", "x") == 1 and C.word_error_rate("a b", "a c d") == 1.0


def test_bleu():
    assert C.bleu("a b c d", "a b c d") == pytest.approx(1)
    assert C.bleu("a b c", "a b") == pytest.approx(math.exp(1 - 3 / 2))
    assert C.bleu("a b", "x y") == pytest.approx(math.sqrt(0.1 / 2 * 0.1))
    with pytest.raises(ValueError):
        C.bleu_tokens(["a"], ["a"], 0)


def test_tables():
    a = "<table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert C.teds(a, a) == 1 and C.teds("<table></table>", "<table></table>") == 1
    assert C.teds(a, a.replace("<tr><td>1</td><td>2</td></tr>", "")) == pytest.approx(1 - 3 / 7)
    assert C.teds(a, a.replace("y", "z")) == pytest.approx(1 - 1 / 7) and C.teds(a, a.replace("y", "z"), True) == 1
    assert C.grits([["a", "b"], ["c", "d"]], [["a", "b"], ["c", "d"]]) == 1
    assert C.grits([["a", "b"], ["c", "d"]], [["a", "b"]]) == pytest.approx(2 * 2 / 6)
    assert C.grits([], [["a"]]) == 0
    cells = L.token_grid(["<thead>", "<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td>", "</td>", "</tr>", "</thead>", "<tr>", "<td>", "</td>", "</tr>"])
    assert [(c["row"], c["column"], c["row_span"], c["is_header"]) for c in cells] == [(0, 0, 2, True), (0, 1, 1, True), (1, 1, 1, False)]
    assert L.dense_grid([{"row": 1, "column": 1, "text": "x"}]) == [["", ""], ["", "x"]]


def test_fuzzy():
    assert C.fuzzy_find("the quick brown fox".split(), "quick brwn".split(), 1)
    assert not C.fuzzy_find("the quick brown fox".split(), "slow red".split(), 1)


def test_reading_order():
    page = [(0, 0, 100, 10), (0, 20, 40, 10), (60, 20, 40, 10), (0, 40, 40, 10), (60, 40, 40, 10), (0, 60, 100, 10)]
    assert L.reading_order(page) == [0, 1, 3, 2, 4, 5]
    g = random.Random(5)
    for _ in range(50):
        boxes = [(g.random() * 90, g.random() * 90, g.random() * 60, g.random() * 20) for _ in range(g.randint(0, 30))]
        assert sorted(L.reading_order(boxes)) == list(range(len(boxes)))


def test_matches():
    truth, found = [(0, 0, 10, 10), (20, 0, 10, 10)], [(0.5, (0, 0, 10, 10)), (0.9, (1, 0, 10, 10)), (0.1, (20, 0, 10, 9))]
    assert L.greedy_matches(truth, found) == [None, 0, 1]


def test_mean_average_precision(spark):
    schema = "doc int, label string, bbox struct<x:double,y:double,width:double,height:double>"
    box = (0.0, 0.0, 10.0, 10.0)
    truth = spark.createDataFrame([(1, "a", box), (2, "a", box), (1, "b", box)], schema)
    found = spark.createDataFrame([(1, "a", box, 1, 0.9), (3, "a", box, 2, 0.8), (2, "a", box, 3, 0.7)], schema + ", det_id int, score double")
    got = {r.label: r.ap for r in L.mean_average_precision(truth, found, "doc", "label", (0.5,)).collect()}
    assert got == {"a": pytest.approx((1 + 2 / 3) / 2), "b": 0.0}


def forests(a, b, struct_only):
    """Edit distance of two forests of (label, children), straight from its recursion."""
    from functools import lru_cache

    size = lambda f: sum(1 + size(c) for _, c in f)

    def swap(u, v):
        if isinstance(u, str) or isinstance(v, str):
            return 0 if u == v else 1
        return 1 if u[:3] != v[:3] else 0 if struct_only else 1 - C.similarity(u[3], v[3])

    @lru_cache(None)
    def far(f, g):
        if not f or not g:
            return size(f or g)
        (u, x), (v, y) = f[-1], g[-1]
        return min(far(f[:-1] + x, g) + 1, far(f, g[:-1] + y) + 1, far(f[:-1], g[:-1]) + far(x, y) + swap(u, v))

    return far(a, b)


def test_tree_distance_against_its_recursion():
    import random

    g = random.Random(9)
    tree = lambda t: (("table", tuple(("row", tuple((c, ()) for c in r)) for r in t)),)
    for k in range(60):
        make = lambda: [[(g.choice(["td", "th"]), 1, g.choice([1, 1, 2]), g.choice(["", "a", "ab", "xyz"])) for _ in range(g.randrange(4))] for _ in range(g.randrange(4))]
        a, b = make(), make()
        assert abs(C.tree_distance(a, b, k % 2 == 0) - forests(tree(a), tree(b), k % 2 == 0)) < 1e-9
    cells = [("td", 1, 1, str(k)) for k in range(10)]
    assert C.tree_distance([cells[:5], cells[5:]], [cells], False) == 3
