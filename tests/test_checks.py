"""Fuzzy and table checks and the reasons of failures, against plain Python."""

import random

from pyspark.sql import functions as F

from vellumine.operators import checks as C

CHECK = "first_n int, last_n int, case_sensitive boolean, max_diffs int"
NAMES = ("expected", "up", "down", "left", "right", "top_heading", "left_heading")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def find(text, wanted, most):
    if wanted in text or most <= 0 or not text or not wanted:
        return text.find(wanted) + 1
    words, n = text.split(" "), len(wanted.split(" "))
    for i in range(len(words)):
        for k in range(max(1, n - 2), n + 3):
            if i + k <= len(words) and distance(" ".join(words[i : i + k]), wanted) <= most:
                return len(" ".join(words[:i])) + (i > 0) + 1
    return 0


def test_fuzzy_find(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(k, say(rng.randint(0, 9)), say(rng.randint(0, 4)), rng.randint(0, 3)) for k in range(400)]
    got = spark.createDataFrame(rows, "k int, t string, w string, m int").select("k", C.fuzzy_find(F.col("t"), F.col("w"), F.col("m")).alias("at"))
    want = {k: find(t, w, m) for k, t, w, m in rows}
    assert {r.k: r.at for r in got.collect()} == want and len(set(want.values())) > 8


def test_fuzzy_checks(spark):
    rows = [
        (0, "present", "the qiuck fox", None, None, None, None, False, 2),
        (1, "present", "the qiuck fox", None, None, None, None, False, None),
        (2, "absent", "the qiuck fox", None, None, None, None, False, 2),
        (3, "order", None, "quick fxo", "laxy", None, None, False, 2),
        (4, "present", "quick", None, None, 5, None, True, 1),
        (5, "present", "  ", None, None, None, None, True, 1),
    ]
    checks = spark.createDataFrame(rows, "k int, kind string, expected string, before string, after string, " + CHECK)
    got = checks.select("k", C.check_result(F.lit("The  quick\nfox and a lazy dog"), fuzzy=True).alias("ok")).collect()
    assert {r.k: r.ok for r in got} == {0: True, 1: False, 2: False, 3: True, 4: False, 5: None}


def holds(grid, check):
    has = lambda cell, name: cell is not None and check[name] in cell
    cell = lambda i, j: grid[i][j] if 0 <= i < len(grid) and 0 <= j < len(grid[i]) else None
    for i, row in enumerate(grid):
        for j in range(len(row)):
            near = {"expected": [cell(i, j)], "up": [cell(i - 1, j)], "down": [cell(i + 1, j)], "left": [cell(i, j - 1)], "right": [cell(i, j + 1)]}
            near |= {"top_heading": [cell(r, j) for r in range(i)], "left_heading": row[:j]}
            if all(any(has(c, name) for c in cells) for name, cells in near.items() if check[name]):
                return True
    return False


def test_table_checks(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(300):
        grids = [[[rng.choice("abcd") for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 2))]
        check = {name: rng.choice(["a", "b", "c"]) if rng.random() < (0.95 if name == "expected" else 0.3) else rng.choice([None, ""]) for name in NAMES}
        text = rng.choice(["", "a b", "a b c"])
        rows.append((k, text, grids, *check.values(), None, None, True, 0))
        want[k] = (any(holds(g, check) for g in grids) or all(v in text for v in check.values() if v)) if check["expected"] else None
    schema = "k int, t string, grids array<array<array<string>>>, " + ", ".join(f"{n} string" for n in NAMES) + ", " + CHECK
    got = spark.createDataFrame(rows, schema).select("k", C.table_check(F.col("t"), F.col("grids")).alias("ok")).collect()
    assert {r.k: r.ok for r in got} == want and {True, False, None} == set(want.values())


def test_failure_classes(spark):
    rows = [
        ("math", "", "x", False, "math preservation"), ("table", "t", "x", True, "table structure"), ("order", "", None, False, "reading order"),
        ("present", " \n", "x", True, "scanned/OCR missing"), ("absent", None, "x", False, "scanned/OCR missing"), ("present", "Image image-1 Image image-2\n", "x", True, "scanned/OCR missing"),
        ("absent", "text", "é", True, "Markdown rendering"), ("present", "a\x01b", "x", True, "font decoding"), ("present", "a\tb", "é", True, "font decoding"),
        ("present", "a\tb", "x", True, "table structure"), ("present", "a\tb", None, False, "text-state/matrix handling"),
    ]
    d = spark.createDataFrame(rows, "kind string, text string, expected string, tables boolean, want string")
    got = d.select("want", C.failure_class(F.col("kind"), F.col("text"), F.col("expected"), F.col("tables")).alias("got")).collect()
    assert all(r.got == r.want for r in got), got
