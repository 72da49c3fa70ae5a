"""Reading order, heading runs, table grids and detection matching: folds whose state decides the next step,
so they run within one page or document. Column forms wrap them as Arrow functions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shuffle_parts
from ..workers import reachable
from .metrics import precision_recall


def iou(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    joint = max(a[2], 0) * max(a[3], 0) + max(b[2], 0) * max(b[3], 0) - both
    return both / joint if joint > 0 else 0.0


def widest_gap(spans: list[tuple[float, float]], least: float = 2.0) -> float | None:
    """Where the widest gap of `least` or more between intervals begins to be crossed; None if there is none."""
    best, at, end = least, None, None
    for lo, hi in sorted(spans):
        if end is not None and lo - end >= best and (at is None or lo - end > best):
            best, at = lo - end, (lo + end) / 2
        end = hi if end is None else max(end, hi)
    return at


def reading_order(boxes: list[tuple]) -> list[int]:
    """A permutation: blocks over 85 % of the width part the page into bands; each band is cut at its
    widest gap, between columns first unless the gap between rows is wider, and so on. y grows downwards."""
    out: list[int] = []
    todo = [list(range(len(boxes)))]
    while todo:
        own = todo.pop()
        if len(own) <= 1:
            out += own
            continue
        left, right = min(boxes[i][0] for i in own), max(boxes[i][0] + boxes[i][2] for i in own)
        wide = sorted((i for i in own if boxes[i][2] >= 0.85 * (right - left)), key=lambda i: (boxes[i][1], boxes[i][0], i))
        if wide and len(wide) < len(own):
            rest, bands = [i for i in own if i not in set(wide)], []
            for w in wide:
                bands.append([i for i in rest if boxes[i][1] + boxes[i][3] / 2 < boxes[w][1] + boxes[w][3] / 2])
                rest = [i for i in rest if i not in set(bands[-1])]
                bands.append([w])
            todo += [b for b in [*bands, rest] if b][::-1]
            continue
        x = widest_gap([(boxes[i][0], boxes[i][0] + boxes[i][2]) for i in own])
        y = widest_gap([(boxes[i][1], boxes[i][1] + boxes[i][3]) for i in own])
        for k, at in ((0, x), (1, y)):
            if at is not None:
                first = [i for i in own if boxes[i][k] + boxes[i][k + 2] / 2 < at]
                second = [i for i in own if i not in set(first)]
                if first and second:
                    todo += [second, first]
                    break
        else:
            out += sorted(own, key=lambda i: (boxes[i][1], boxes[i][0], i))
    return out


def order_pages(blocks: DataFrame, page: list[str], ident: str) -> DataFrame:
    """(page..., ident, block_index): reading order within each page. A page with a block that has no box
    keeps the order of its idents."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ident, kind="stable").reset_index(drop=True)
        boxes = [None if b is None else (b["x"], b["y"], b["width"], b["height"]) for b in part["bbox"]]
        order = reading_order(boxes) if all(boxes) else range(len(boxes))
        got = part[[*page, ident]].iloc[list(order)].copy()
        got["block_index"] = range(len(got))
        return got

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*page, ident]) + ", block_index long"
    return reachable(blocks).select(*page, ident, "bbox").groupBy(*page).applyInPandas(one, schema)


def near_boxes(truth: np.ndarray, boxes: np.ndarray, least: float, most: int = 1 << 20):
    """For blocks of boxes in their order: (first, last, starts, index, overlap), the true boxes that overlap
    each by `least` and more than nothing; those of box k are at starts[k - first] to starts[k - first + 1].

    An overlap of t leaves left edges within (1 - t) times the width of the box that begins first, and widths
    within a factor of t; so a box looks up a small part of a grid of left upper corners. A block has about
    `most` pairs, or one box.
    """
    whole = np.flatnonzero(np.isfinite(truth).all(1) & (truth[:, 2:] > 0).all(1))
    part, slack = truth[whole], 1e-9
    t = min(max(least, 0.0), 1.0)
    if not len(part):
        yield 0, len(boxes), np.zeros(len(boxes) + 1, np.int64), whole, np.zeros(0)
        return
    span, first, last, names = part[:, 2:].max(0), [], [], []
    usable = np.isfinite(boxes).all(1) & (boxes[:, 2:] > 0).all(1)
    asked = np.where(usable[:, None], boxes, 0.0)
    for k in (0, 1):
        cell = max(float(np.median(part[:, k + 2])), float(np.ptp(part[:, k])) / len(part) ** 0.5)
        at = np.floor(part[:, k] / cell)
        names.append(np.unique(at))
        size, pad = asked[:, k + 2], slack * (np.abs(asked[:, k]) + asked[:, k + 2] + span[k])
        back = np.minimum((1 - t) * span[k], (1 - t) / t * size if t > 0 else np.inf)
        first.append(np.searchsorted(names[k], np.floor((asked[:, k] - back - pad) / cell), "left"))
        last.append(np.searchsorted(names[k], np.floor((asked[:, k] + (1 - t) * size + pad) / cell), "right"))
        part = np.column_stack([part, np.searchsorted(names[k], at)])
    key = part[:, 4].astype(np.int64) * len(names[1]) + part[:, 5].astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, part, whole = key[order], part[order, :4], whole[order]
    area = part[:, 2] * part[:, 3]
    expand = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    for i in range(0, len(boxes), 256):
        j = min(i + 256, len(boxes))
        row, nth = expand(np.where(usable[i:j], last[0][i:j] - first[0][i:j], 0))
        column = (first[0][i:j][row] + nth) * len(names[1])
        lo, hi = np.searchsorted(key, column + first[1][i:j][row], "left"), np.searchsorted(key, column + last[1][i:j][row], "left")
        counts = np.maximum(hi - lo, 0)
        total = np.bincount(row, counts, minlength=j - i).astype(np.int64)
        while i < j:
            n = max(1, int(np.searchsorted(np.cumsum(total), most, "right")))
            n = min(n, j - i)
            cut = int(np.searchsorted(row, n, "left"))
            which, nth = expand(counts[:cut])
            index, q = lo[:cut][which] + nth, row[:cut][which]
            a, b = asked[i : i + n][q], part[index]
            w = np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
            h = np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            overlap = both / (a[:, 2] * a[:, 3] + area[index] - both)
            good = (overlap >= least) & (overlap > 0)
            starts = np.concatenate([[0], np.cumsum(np.bincount(q[good], minlength=n))])
            yield i, i + n, starts, whole[index[good]], overlap[good]
            row, lo, counts, total, i = row[cut:] - n, lo[cut:], counts[cut:], total[n:], i + n


def matches_by_score(truth: np.ndarray, boxes: np.ndarray, scores: np.ndarray, thresholds) -> np.ndarray:
    """For each threshold and each found box in its place: the index of the true box it takes, by falling
    score; -1 for none. Of true boxes that overlap alike the first is taken; equal ones wait in one queue."""
    order = np.lexsort(truth.T[::-1])
    new = np.ones(len(truth), bool)
    new[1:] = (truth[order[1:]] != truth[order[:-1]]).any(1)
    starts = np.flatnonzero(new)
    ends, heads = np.append(starts[1:], len(truth)), [starts.copy() for _ in thresholds]
    out = np.full((len(thresholds), len(boxes)), -1, np.int64)
    turn = np.argsort(-scores, kind="stable")
    for first, last, at, index, overlap in near_boxes(truth[order[starts]], boxes[turn], min(thresholds)):
        until, at = ends[index], at.tolist()
        for k in range(first, last):
            own = slice(at[k - first], at[k - first + 1])
            if own.start == own.stop:
                continue
            near, over, end = index[own], overlap[own], until[own]
            for n, (least, head) in enumerate(zip(thresholds, heads)):
                next_of = head[near]
                left = np.where(next_of < end, over, -1.0)
                best = left.max()
                if best >= least and best > 0:
                    same = np.flatnonzero(left == best)
                    pick = same[0] if len(same) == 1 else same[order[next_of[same]].argmin()]
                    out[n, turn[k]] = order[next_of[pick]]
                    head[near[pick]] += 1
    return out


def greedy_matches(truth: list[tuple], found: list[tuple], least: float = 0.5) -> list[int | None]:
    """For each found (score, box) in its place: the index of the true box it takes, by falling score."""
    table = lambda boxes: np.array(boxes, float).reshape(-1, 4)
    got = matches_by_score(table(truth), table([b for _, b in found]), np.array([s for s, _ in found], float), [least])[0]
    return [None if h < 0 else h for h in got.tolist()]


def match_at(truth: DataFrame, found: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """(keys..., det_id, score, threshold, hit): found boxes matched one to one within document and label, at
    each threshold. truth: keys..., bbox, and truth_id if ties between true boxes go by it (else by the box);
    found: keys..., det_id, score, bbox."""
    sides = ["x", "y", "width", "height"]

    def one(_, t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        t, f = t.sort_values(ties, kind="stable"), f.sort_values("det_id", kind="stable")
        hits = matches_by_score(t[sides].to_numpy(float), f[sides].to_numpy(float), f["score"].to_numpy(float), thresholds)
        own = f[[*keys, "det_id", "score"]]
        return pd.concat([own.assign(threshold=x, hit=(h >= 0).astype("int32")) for x, h in zip(thresholds, hits)])

    ties = ["truth_id"] if "truth_id" in truth.columns else sides
    kinds = {x.name: x.dataType.simpleString() for x in found.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "det_id", "score"]) + ", threshold double, hit int"
    parts = shuffle_parts(found.sparkSession)  # few bytes make much work: not to be put together
    flat = lambda df, *more: df.select(*keys, *more, *[F.col("bbox")[s].alias(s) for s in sides]).repartition(parts, *keys)
    t, f = flat(truth, *[c for c in ties if c == "truth_id"]), flat(found, "det_id", "score")
    return reachable(t).groupBy(*keys).cogroup(f.groupBy(*keys)).applyInPandas(one, schema)


def match_detections(truth: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys..., det_id, score, hit): as match_at, at one threshold."""
    return match_at(truth, found, keys, [float(least)]).drop("threshold")


def mean_average_precision(truth: DataFrame, found: DataFrame, document: str, label: str, thresholds=None) -> DataFrame:
    """(label, threshold, ap): all-points average precision of each true label. Columns as match_at."""
    steps = [float(t) for t in thresholds or [k / 100 for k in range(50, 100, 5)]]
    total = truth.groupBy(label).agg(F.count("*").alias("positives")).withColumn("threshold", F.explode(F.array(*map(F.lit, steps))))
    flags = match_at(truth, found, [document, label], steps)
    rows = precision_recall(flags, [label, "threshold"], "score", "hit", [document, "det_id"])
    area = rows.where("hit = 1").groupBy(label, "threshold").agg(F.sum("envelope").alias("area"))
    return total.join(area, [label, "threshold"], "left").select(label, "threshold", F.coalesce(F.col("area") / F.col("positives"), F.lit(0.0)).alias("ap"))


def token_grid(tokens: list[str]) -> list[dict]:
    """Cells (row, column, row_span, col_span, is_header) of table structure tokens, spans kept free of overlap."""
    import re

    out, taken, row, head = [], set(), -1, False
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t in ("<thead>", "</thead>"):
            head = t == "<thead>"
        elif t == "<tr>":
            row += 1
        elif t.startswith(("<td", "<th")) and t not in ("<thead>", "<tbody>") and row >= 0:
            text = t
            while ">" not in text and k + 1 < len(tokens):
                k += 1
                text += tokens[k]
            span = {m[0]: max(1, int(m[1])) for m in re.findall(r'(colspan|rowspan)="?(\d+)', text)}
            column = next(c for c in range(len(taken) + 1) if (row, c) not in taken)
            h, w = span.get("rowspan", 1), span.get("colspan", 1)
            taken |= {(row + i, column + j) for i in range(h) for j in range(w)}
            out.append({"row": row, "column": column, "row_span": h, "col_span": w, "is_header": head or text.startswith("<th")})
        k += 1
    return out


def dense_grid(cells: list[dict]) -> list[list[str]]:
    at: dict = defaultdict(str, {(c["row"], c["column"]): c.get("text", "") for c in cells})
    rows = 1 + max((r for r, _ in at), default=-1)
    columns = 1 + max((c for _, c in at), default=-1)
    return [[at[(r, c)] for c in range(columns)] for r in range(rows)]
