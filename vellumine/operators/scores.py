"""Scores of one pair at a time that no built-in function has: word error rate, BLEU, tree and grid
similarity of tables. Pure functions, and Arrow-batched Column forms of them."""

from __future__ import annotations

import math
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences, a row at a time."""
    code: dict = {}
    x, y = (np.array([code.setdefault(t, len(code)) for t in s], np.int64) for s in (a, b))
    row = np.arange(len(y) + 1)
    at = np.arange(len(y) + 1)
    for k, t in enumerate(x, 1):
        nxt = np.empty_like(row)
        nxt[0] = k
        nxt[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != t))
        row = np.minimum.accumulate(nxt - at) + at  # insertions run along the row
    return int(row[-1])


def word_error_rate(truth: str, output: str) -> float:
    t, o = truth.split(), output.split()
    return distance(t, o) / len(t) if t else float(bool(o))


def bleu_tokens(truth: list, output: list, most: int = 4, eps: float = 0.1) -> float:
    """Geometric mean of clipped n-gram precisions (orders up to the output's length; none at all: eps)
    times the brevity penalty."""
    if most < 1:
        raise ValueError("at least unigrams are needed")
    if not output or not truth:
        return float(not output and not truth)
    total, orders = 0.0, min(most, len(output))
    for n in range(1, orders + 1):
        t, o = (Counter(zip(*(s[k:] for k in range(n)))) for s in (truth, output))
        total += math.log(max(sum((t & o).values()), eps) / (len(output) - n + 1))
    return min(1.0, math.exp(1 - len(truth) / len(output))) * math.exp(total / orders)


def bleu(truth: str, output: str) -> float:
    return bleu_tokens(truth.split(), output.split())


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            span = lambda k: max(1, int(a[k])) if (a.get(k) or "").strip().isdigit() else 1
            self.rows[-1].append([tag, span("rowspan"), span("colspan"), ""])
            self.open = True

    def handle_endtag(self, tag):
        self.open &= tag not in ("td", "th", "tr", "table")

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1][3] += data


def parse_table(html: str) -> list[list[tuple[str, int, int, str]]]:
    """Rows of (tag, row span, column span, text)."""
    p = _Table()
    p.feed(html)
    return [[(t, r, c, " ".join(x.split())) for t, r, c, x in row] for row in p.rows]


def similarity(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1.0 if not most else 1 - distance(list(a), list(b)) / most


def postorder(table: list) -> tuple[list, list[int]]:
    """(labels, first leaf below each) of a table's tree in postorder: cells, their rows, the table."""
    labels, leaf = [], []
    for row in table:
        first = len(labels)
        for c in row:
            leaf.append(len(labels))
            labels.append(c)
        leaf.append(first)
        labels.append("row")
    leaf.append(0)
    labels.append("table")
    return labels, leaf


def tree_distance(a: list, b: list, struct_only: bool) -> float:
    """Ordered tree edit distance of two tables, by the general algorithm over key roots: any node may go,
    and its children move up. A node costs one, cells of equal tag and spans what their texts differ."""
    (x, lx), (y, ly) = postorder(a), postorder(b)

    def swap(u, v):
        if isinstance(u, str) or isinstance(v, str):
            return 0.0 if u == v else 1.0
        if u[:3] != v[:3]:
            return 1.0
        return 0.0 if struct_only else 1 - similarity(u[3], v[3])

    cost = np.array([[swap(u, v) for v in y] for u in x])
    whole = np.zeros((len(x), len(y)))  # between subtrees
    roots = lambda leaf: sorted({f: k for k, f in enumerate(leaf)}.values())
    for i in roots(lx):
        for j in roots(ly):
            p, q = lx[i], ly[j]
            d = [[float(n) for n in range(j - q + 2)]]
            for u in range(p, i + 1):
                last, row = d[-1], [d[-1][0] + 1]
                over = d[lx[u] - p]
                for v in range(q, j + 1):
                    k = v - q
                    if lx[u] == p and ly[v] == q:
                        best = last[k] + cost[u, v]
                    else:
                        best = over[ly[v] - q] + whole[u, v]
                    best = min(best, last[k + 1] + 1, row[k] + 1)
                    row.append(best)
                    if lx[u] == p and ly[v] == q:
                        whole[u, v] = best
                d.append(row)
    return float(whole[-1, -1])


def teds(truth: str, output: str, struct_only: bool = False) -> float:
    a, b = parse_table(truth), parse_table(output)
    nodes = [1 + len(t) + sum(map(len, t)) for t in (a, b)]
    return max(0.0, 1 - tree_distance(a, b, struct_only) / max(nodes))


def grits(truth: list[list], output: list[list], alike=None) -> float:
    """Grid similarity: rows aligned by their best cell alignment, columns likewise within the aligned
    rows; F-measure of the matched cells' similarity over both sizes."""
    alike = alike or similarity
    sizes = [sum(map(len, g)) for g in (truth, output)]
    if not all(sizes):
        return 0.0

    def best(xs, ys, reward):
        d = np.zeros((len(xs) + 1, len(ys) + 1))
        r = np.array([[reward(x, y) for y in ys] for x in xs])
        for i in range(1, len(xs) + 1):
            for j in range(1, len(ys) + 1):
                d[i, j] = max(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1] + r[i - 1, j - 1])
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if d[i, j] == d[i - 1, j]:
                i -= 1
            elif d[i, j] == d[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return float(d[-1, -1]), pairs[::-1]

    pad = lambda g: [list(r) + [""] * (max(map(len, g)) - len(r)) for r in g]
    t, o = pad(truth), pad(output)
    _, rows = best(t, o, lambda x, y: best(x, y, alike)[0])
    _, cols = best(list(zip(*t)), list(zip(*o)), lambda x, y: best(x, y, alike)[0])
    got = sum(alike(t[i][k], o[j][m]) for i, j in rows for k, m in cols)
    return 2 * got / (len(t) * len(t[0]) + len(o) * len(o[0]))


def fuzzy_find(text: list[str], needle: list[str], most: int, slack: int = 2) -> bool:
    """Whether some window of n +- slack tokens is within `most` edits of the needle."""
    n = len(needle)
    return any(distance(text[i : i + w], needle) <= most for w in range(max(1, n - slack), n + slack + 1) for i in range(max(1, len(text) - w + 1)))


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return pandas_udf(run, DoubleType())


wer_column, bleu_column, teds_column = _pairwise(word_error_rate), _pairwise(bleu), _pairwise(teds)
