"""Unit checks, ground truth, table quality and reports: projections, equi-joins and grouped sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# States of a check that is not to be counted.
DISABLED = ("disabled", "rejected", "skip", "skipped")


def enabled(checks: DataFrame) -> DataFrame:
    """Checks without those marked as disabled in `checked`."""
    return checks.where(~F.coalesce(F.lower(F.trim("checked")).isin(*DISABLED), F.lit(False)))


def window_of(text: Column, first_n: Column, last_n: Column) -> Column:
    """The first or last characters of a text where a check asks for them."""
    return F.when(first_n > 0, F.substr(text, F.lit(1), first_n)).when(last_n > 0, F.substr(text, F.greatest(F.length(text) - last_n + 1, F.lit(1)), last_n)).otherwise(text)


def fuzzy_find(text: Column, wanted: Column, most: Column) -> Column:
    """Where a text (single spaces) has what is wanted, from 1: exactly, else the first run of words, two more or
    fewer than wanted, within so many edits; 0 for nowhere."""
    exact, words, n = F.instr(text, wanted), F.split(text, " "), F.size(F.split(wanted, " "))
    run = lambda i, k: F.array_join(F.slice(words, i + 1, k), " ")

    def near(i: Column) -> Column:
        lengths = F.filter(F.transform(F.array(*map(F.lit, range(-2, 3))), lambda d: n + d), lambda k: (k >= 1) & (i + k <= F.size(words)))
        return F.exists(lengths, lambda k: F.call_function("levenshtein", run(i, k), wanted, most) >= 0)

    start = F.try_element_at(F.filter(F.transform(words, lambda _, i: i), near), F.lit(1))
    place = F.when(start == 0, 1).otherwise(F.length(F.array_join(F.slice(words, F.lit(1), start), " ")) + 2)
    return F.when((exact > 0) | (most <= 0) | (text == "") | (wanted == ""), exact).otherwise(F.coalesce(place, F.lit(0)))


def found(text: Column, wanted: Column, fuzzy: bool = False) -> Column:
    """Where a check's text is in the part that the check looks at, from 1; 0 for nowhere. Its columns: first_n, last_n,
    case_sensitive, and max_diffs if it may be fuzzy."""
    plain = lambda c: F.when(F.col("case_sensitive"), T.collapse(c)).otherwise(T.collapse(F.lower(c)))
    seen = plain(window_of(text, F.col("first_n"), F.col("last_n")))
    return fuzzy_find(seen, plain(wanted), F.coalesce("max_diffs", F.lit(0))) if fuzzy else F.instr(seen, plain(wanted))


def named(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) != ""


def check_result(text: Column, fuzzy: bool = False) -> Column:
    """Whether a check passes over a text; null where it names nothing. Columns of the check: kind
    (present, absent, order, math), expected, before, after, and those of found()."""
    at = lambda name: found(text, F.col(name), fuzzy)
    return (
        F.when((F.col("kind") == "present") & named("expected"), at("expected") > 0)
        .when((F.col("kind") == "absent") & named("expected"), at("expected") == 0)
        .when((F.col("kind") == "order") & named("before") & named("after"), (at("before") > 0) & (at("after") > 0) & (at("before") < at("after")))
        .when((F.col("kind") == "math") & named("expected"), F.contains(T.normalize_math(text), T.normalize_math(F.col("expected"))))
    )


# What a table check may name beside its cell, and where that stands (rows down, columns right).
BESIDE = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
HEADINGS = ("top_heading", "left_heading")


def table_check(text: Column, grids: Column, fuzzy: bool = False) -> Column:
    """Whether a table (rows of cells, the header first) has the expected cell with the neighbours and headings that
    the check names; else, whether the text has all of them. Null where no cell is named. Columns of the check:
    expected, up, down, left, right, top_heading, left_heading, and those of found()."""
    has = lambda cell, name: F.coalesce(found(cell, F.col(name), fuzzy) > 0, F.lit(False))

    any_has = lambda cells, name: F.exists(cells, lambda c: has(c, name))

    def holds(grid: Column, row: Column, i: Column, value: Column, j: Column) -> Column:
        good = has(value, "expected")
        for name, (down, right) in BESIDE.items():
            good &= ~named(name) | has(F.get(F.get(grid, i + down), j + right), name)
        above = F.transform(F.slice(grid, F.lit(1), i), lambda r: F.get(r, j))
        for name, cells in zip(HEADINGS, (above, F.slice(row, F.lit(1), j))):
            good &= ~named(name) | any_has(cells, name)
        return good

    yes = lambda x: x
    in_grid = lambda g: F.exists(F.transform(g, lambda row, i: F.exists(F.transform(row, lambda value, j: holds(g, row, i, value, j)), yes)), yes)
    everything = F.lit(True)
    for name in ("expected", *BESIDE, *HEADINGS):
        everything &= ~named(name) | has(text, name)
    return F.when(named("expected"), F.coalesce(F.exists(grids, in_grid), F.lit(False)) | everything)


# What failed, by the kind of a check, and a text that images alone leave.
FAILED = {"math": "math preservation", "table": "table structure", "order": "reading order"}
ONLY_IMAGES = r"^Image image-\S+( Image image-\S+)*$"


def failure_class(kind: Column, text: Column, expected: Column, with_tables: Column) -> Column:
    """The likely reason of a failed check."""
    out = F.when(F.lit(False), "")
    for name, reason in FAILED.items():
        out = out.when(kind == name, reason)
    plain = T.collapse(F.coalesce(text, F.lit("")))
    return (
        out.when((plain == "") | plain.rlike(ONLY_IMAGES), "scanned/OCR missing")
        .when(kind == "absent", "Markdown rendering")
        .when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | F.coalesce(expected, F.lit("")).rlike(r"[^\x00-\x7F]"), "font decoding")
        .when(with_tables & (kind == "present"), "table structure")
        .otherwise("text-state/matrix handling")
    )


def check_report(results: DataFrame) -> DataFrame:
    """(kind, passed, scored, pass_rate), with a row of null kind for all; checks without a result don't count."""
    scored = results.where("passed is not null")
    got = scored.rollup("kind").agg(F.count_if("passed").alias("passed"), F.count("*").alias("scored"))
    return got.withColumn("pass_rate", F.col("passed") / F.col("scored"))


def preferred_join(documents: DataFrame, truths: DataFrame, ways: list[tuple[str, str]], keep: str) -> DataFrame:
    """Each document with its ground truth by the first way that finds one: an equi-join on each pair of
    columns (document's, truth's), then the least of (way, truth). A document without any has null.
    Never a join on alternatives: each way is a join of its own."""
    found = [
        documents.select("document", F.col(mine).alias("key")).join(truths.select(F.col(theirs).alias("key"), F.col(keep).alias("truth")), "key").select("document", F.lit(n).alias("way"), "truth")
        for n, (mine, theirs) in enumerate(ways)
    ]
    best = reduce(DataFrame.unionByName, found).groupBy("document").agg(F.min(F.struct("way", "truth")).alias("best"))
    return documents.select("document").join(best, "document", "left").select("document", F.col("best.way").alias("way"), F.col("best.truth").alias("truth"))


def metric_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, documents): over the documents that have the metric."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics])).alias("m")
    return rows.select(each).select("m.*").groupBy("metric").agg(F.avg("score").alias("mean"), F.count("score").alias("documents"))


def table_quality(rows: Column) -> Column:
    """Flags of a table that needs no ground truth, as a struct (rows, cols, nonempty, flags, verdict)."""
    cells = F.flatten(rows)
    full = F.filter(cells, lambda c: F.trim(c) != "")
    numbers = F.filter(full, T.is_numeric_value)
    wordy = lambda c: (F.size(T.tokens(c)) >= 4) & ~T.is_numeric_value(c) & ~T.letter_spaced(c)
    shredded = F.exists(rows, lambda r: F.size(F.filter(r, wordy)) >= 2)
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(F.exists(full, T.letter_spaced), "LETTER_SPACED"),
            flag(shredded, "PROSE_CONTAM"),
            flag((F.size(full) > 0) & (F.size(numbers) / F.greatest(F.size(full), F.lit(1)) < 0.1) & (F.size(rows) > 1), "NO_NUMBERS"),
            flag(F.size(full) / F.greatest(F.size(cells), F.lit(1)) < 0.3, "MOSTLY_EMPTY"),
            flag(F.size(F.array_distinct(F.transform(rows, F.size))) != 1, "RAGGED"),
        )
    )
    verdict = F.when(F.size(flags) == 0, "clean").when(F.arrays_overlap(flags, F.array(F.lit("LETTER_SPACED"), F.lit("PROSE_CONTAM"))), "broken").otherwise("minor")
    return F.struct(F.size(rows).alias("rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("cols"), F.size(full).alias("nonempty"), flags.alias("flags"), verdict.alias("verdict"))


def glued_words(output: Column, truth: Column) -> Column:
    """Tokens of eight letters or more that are two words of the truth written together, as first|second."""
    known = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(truth), F.lit("([a-z]+)")), lambda w: F.length(w) > 1))
    words = F.filter(F.regexp_extract_all(F.lower(output), F.lit("([a-z]{8,})")), lambda w: ~F.array_contains(known, w))

    def split(w: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(3), F.length(w) - 3), lambda i: F.array_contains(known, F.substr(w, F.lit(1), i)) & F.array_contains(known, F.substr(w, i + 1, F.length(w))))
        at = F.try_element_at(cuts, F.lit(1))
        return F.when(at.isNotNull(), F.concat(F.substr(w, F.lit(1), at), F.lit("|"), F.substr(w, at + 1, F.length(w))))

    return F.array_compact(F.transform(words, split))


def grid_of_cells(cells: Column) -> Column:
    """Dense rows from cells (row, column, text), both from 0; what no cell fills is empty."""
    place = lambda r, c: F.concat_ws(",", r.cast("string"), c.cast("string"))
    at = F.map_from_entries(F.transform(cells, lambda c: F.struct(place(c["row"], c["column"]), c["text"])))
    upto = lambda name: F.sequence(F.lit(0), F.coalesce(F.array_max(F.transform(cells, lambda c: c[name])), F.lit(0)))
    known = F.array(F.struct(at.alias("at"), upto("column").alias("columns")))  # made once, not for each place
    fill = lambda k: F.transform(upto("row"), lambda r: F.transform(k["columns"], lambda c: F.coalesce(F.try_element_at(k["at"], place(r, c)), F.lit(""))))
    grid = F.element_at(F.transform(known, fill), 1)
    return F.when(F.size(cells) > 0, grid).otherwise(F.array().cast("array<array<string>>"))


def least_cells(cell: str) -> Column:
    """Aggregate: cells (row, column, empty, text) with the least text of each place, `empty` ones last."""
    ranked = F.sort_array(F.collect_list(cell))
    place = lambda c: F.struct(c["row"], c["column"])
    alone = lambda cells: F.filter(cells, lambda c, i: (i == 0) | ~place(c).eqNullSafe(place(F.get(cells, i - 1))))
    return F.element_at(F.transform(F.array(ranked), alone), 1)


def block_text(kind: Column, text: Column, headers: Column, rows: Column, caption: Column) -> Column:
    """What a block says: its text; a table's headers and rows, a line each; a figure's caption."""
    lines = F.concat(F.array(F.array_join(headers, " ")), F.transform(rows, lambda r: F.array_join(r, " ")))
    return F.when(kind == "table", F.array_join(F.filter(lines, lambda s: s != ""), "\n")).when(kind == "figure", F.coalesce(caption, F.lit(""))).otherwise(F.coalesce(text, F.lit("")))


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance; limit + 1 for anything above the limit, where the search stops early."""
    got = F.levenshtein(a, b, limit)
    return F.when(got < 0, limit + 1).otherwise(got)


def axis_cell(value: Column, lines: Column) -> Column:
    """The interval between sorted axis lines that holds a value, within one unit of tolerance; null outside."""
    inside = F.filter(F.sequence(F.lit(0), F.size(lines) - 2), lambda i: (value >= F.element_at(lines, i + 1) - 1) & (value <= F.element_at(lines, i + 2) + 1))
    return F.try_element_at(inside, F.lit(1))
