"""Queries of the evaluation side: checks, ground truth, table quality, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import checks as C
from ..operators import segments as S
from . import catalogue as Q
from . import render as R

CHECKS_SQL = f"""c AS (SELECT d.doc_id, d.text, (['present', 'absent', 'order', 'math'])[CAST(d.doc_id % 4 + 1 AS INT)] AS kind, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE substr(b.text, 1, 24) END AS expected,
 substr(b.text, 1, 6) AS before, substr(b.text, 30, 5) AS after, CASE WHEN d.doc_id % 3 = 0 THEN 400 END AS first_n, CASE WHEN d.doc_id % 3 = 1 THEN 300 END AS last_n, d.doc_id % 2 = 0 AS cs, CASE WHEN d.doc_id % 13 = 0 THEN ' Skip ' END AS checked
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)),
w AS (SELECT *, CASE WHEN first_n > 0 THEN substr(text, 1, first_n) WHEN last_n > 0 THEN substr(text, greatest(length(text) - last_n + 1, 1), last_n) ELSE text END AS win FROM c WHERE coalesce(lower(trim(checked)) NOT IN ('disabled', 'rejected', 'skip', 'skipped'), true)),
n AS (SELECT *, CASE WHEN cs THEN {Q.sql_collapse('win')} ELSE {Q.sql_collapse('lower(win)')} END AS seen, CASE WHEN cs THEN {Q.sql_collapse('expected')} ELSE {Q.sql_collapse('lower(expected)')} END AS e,
 CASE WHEN cs THEN {Q.sql_collapse('before')} ELSE {Q.sql_collapse('lower(before)')} END AS b, CASE WHEN cs THEN {Q.sql_collapse('after')} ELSE {Q.sql_collapse('lower(after)')} END AS a FROM w),
r AS (SELECT doc_id, kind, CASE WHEN kind = 'present' AND coalesce(expected, '') <> '' THEN strpos(seen, e) > 0 WHEN kind = 'absent' AND coalesce(expected, '') <> '' THEN strpos(seen, e) = 0
 WHEN kind = 'order' AND coalesce(before, '') <> '' AND coalesce(after, '') <> '' THEN strpos(seen, b) > 0 AND strpos(seen, a) > 0 AND strpos(seen, b) < strpos(seen, a)
 WHEN kind = 'math' AND coalesce(expected, '') <> '' THEN contains(regexp_replace(text, '\\\\left|\\\\right|[$`{{}} ]', '', 'g'), regexp_replace(expected, '\\\\left|\\\\right|[$`{{}} ]', '', 'g')) END AS passed FROM n)"""


@Q.query(f"WITH {CHECKS_SQL} SELECT doc_id, kind, CASE WHEN passed IS NULL THEN 'unscored' WHEN passed THEN 'passed' ELSE 'failed' END AS outcome FROM r")
def unit_checks(spark, sf_dir):
    outcome = F.when(F.col("passed").isNull(), "unscored").when(F.col("passed"), "passed").otherwise("failed")
    return document_checks(spark, sf_dir).select("doc_id", "kind", outcome.alias("outcome"))


def document_checks(spark, sf_dir):
    """A check of each document against a benchmark passage."""
    k = F.col("doc_id")
    one = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    c = Q.document_pairs(spark, sf_dir).select(
        "doc_id", F.col("output").alias("text"), one(4, "present", "absent", "order", "math").alias("kind"), F.when(k % 11 != 0, F.substring("truth", 1, 24)).alias("expected"),
        F.substring("truth", 1, 6).alias("before"), F.substring("truth", 30, 5).alias("after"), F.when(k % 3 == 0, 400).alias("first_n"), F.when(k % 3 == 1, 300).alias("last_n"),
        (k % 2 == 0).alias("case_sensitive"), F.when(k % 13 == 0, " Skip ").alias("checked"),
    )
    return C.enabled(c).select("doc_id", "kind", C.check_result(F.col("text")).alias("passed"))


@Q.query(f"WITH {CHECKS_SQL} SELECT kind, count(*) FILTER (WHERE passed) AS passed, count(*) AS scored, count(*) FILTER (WHERE passed)::DOUBLE / count(*) AS pass_rate FROM r WHERE passed IS NOT NULL GROUP BY ROLLUP (kind)")
def unit_check_report(spark, sf_dir):
    return C.check_report(document_checks(spark, sf_dir))


@Q.query("WITH s AS (SELECT l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic, CASE WHEN d.n_chars > 500 THEN d.n_chars::DOUBLE END AS length FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT 'quality' AS metric, avg(quality) AS mean, count(quality) AS documents FROM s UNION ALL SELECT 'toxic', avg(toxic), count(toxic) FROM s UNION ALL SELECT 'length', avg(length), count(length) FROM s")
def metric_means(spark, sf_dir):
    """Means over the documents that have a metric."""
    s = Q.table(spark, sf_dir, "documents").join(Q.table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("length", F.when(F.col("n_chars") > 500, F.col("n_chars")))
    return C.metric_means(s, ["quality", "toxic", "length"])


_REASON = """CASE WHEN kind = 'math' THEN 'math preservation' WHEN kind = 'order' THEN 'reading order' WHEN trim(text) = '' THEN 'scanned/OCR missing' WHEN kind = 'absent' THEN 'Markdown rendering'
 WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') OR regexp_matches(expected, '[^\\x00-\\x7F]') THEN 'font decoding' WHEN kind = 'present' AND source = 'web' THEN 'table structure' ELSE 'text-state/matrix handling' END"""


@Q.query(
    f"SELECT kind, reason, count(*) AS failures FROM (SELECT kind, {_REASON} AS reason FROM (SELECT (['present', 'absent', 'order', 'math'])[CAST(d.doc_id % 4 + 1 AS INT)] AS kind, d.text, d.source, substr(b.text, 1, 24) AS expected "
    "FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))) GROUP BY ALL"
)
def failure_classes(spark, sf_dir):
    """Why checks of documents would fail, tallied; those from the web count as having tables."""
    kind = F.element_at(F.array(*map(F.lit, ("present", "absent", "order", "math"))), (F.col("doc_id") % 4 + 1).cast("int"))
    source = Q.table(spark, sf_dir, "documents").select("doc_id", "source")
    c = Q.document_pairs(spark, sf_dir).join(source, "doc_id").select(kind.alias("kind"), F.col("output").alias("text"), F.substring("truth", 1, 24).alias("expected"), F.coalesce(F.col("source") == "web", F.lit(False)).alias("tables"))
    reason = C.failure_class(F.col("kind"), F.col("text"), F.col("expected"), F.col("tables"))
    return c.groupBy("kind", reason.alias("reason")).agg(F.count("*").alias("failures"))


@Q.query(
    "WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS seen, CASE p_partkey % 3 WHEN 0 THEN 'x' || p_type WHEN 1 THEN 'xyz' || p_type ELSE p_type END AS e FROM part), "
    "w AS (SELECT *, string_split(seen, ' ') AS words, len(string_split(e, ' ')) AS n FROM t), "
    "f AS (SELECT p_partkey, seen, e, words, list_filter(range(1, len(words) + 1), lambda i: len(list_filter(range(greatest(n - 2, 1), least(n + 2, len(words) - i + 1) + 1), lambda k: levenshtein(array_to_string(words[i:i + k - 1], ' '), e) <= 2)) > 0)[1] AS hit FROM w) "
    "SELECT p_partkey, CAST(CASE WHEN strpos(seen, e) > 0 THEN strpos(seen, e) WHEN hit IS NULL THEN 0 WHEN hit = 1 THEN 1 ELSE length(array_to_string(words[1:hit - 1], ' ')) + 2 END AS INT) AS place FROM f"
)
def fuzzy_places(spark, sf_dir):
    """A part's type with letters before it, in its name and type, within two edits."""
    k, kind = F.col("p_partkey"), F.col("p_type")
    wanted = F.when(k % 3 == 0, F.concat(F.lit("x"), kind)).when(k % 3 == 1, F.concat(F.lit("xyz"), kind)).otherwise(kind)
    return Q.table(spark, sf_dir, "part").select("p_partkey", C.fuzzy_find(F.concat_ws(" ", "p_name", "p_type"), wanted, F.lit(2)).alias("place"))


ORDER_ROWS_SQL = """g AS (SELECT l_orderkey, list(CASE WHEN l_suppkey % 19 = 0 THEN [l_returnflag, 'a b c d ' || l_linestatus] WHEN l_suppkey % 23 = 0 THEN ['one two three ' || l_returnflag, 'four five six ' || l_linestatus] WHEN l_suppkey % 3 = 0 THEN [l_returnflag, CAST(l_linenumber AS VARCHAR) || '%'] WHEN l_suppkey % 7 = 0 THEN ['', ''] ELSE [l_returnflag, ''] END ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows FROM lineitem GROUP BY l_orderkey)"""
_NUM = "(regexp_matches(trim(c), '^[0-9$(),.%+ –—-]+$') AND regexp_matches(trim(c), '[0-9]'))"
_TOK = Q.sql_tokens("c")
_SPACED = f"(len({_TOK}) >= 4 AND len(list_filter({_TOK}, lambda x: length(x) = 1)) * 10 >= len({_TOK}) * 6)"
QUALITY_SQL = f"""{ORDER_ROWS_SQL}, f AS (SELECT l_orderkey, rows, flatten(rows) AS cells, list_filter(flatten(rows), lambda c: trim(c) <> '') AS filled FROM g),
q AS (SELECT l_orderkey, len(rows) AS n_rows, len(filled) AS nonempty, list_filter([CASE WHEN len(list_filter(filled, lambda c: {_SPACED})) > 0 THEN 'LETTER_SPACED' END,
 CASE WHEN len(list_filter(rows, lambda r: len(list_filter(r, lambda c: len({_TOK}) >= 4 AND NOT {_NUM} AND NOT {_SPACED})) >= 2)) > 0 THEN 'PROSE_CONTAM' END,
 CASE WHEN len(filled) > 0 AND len(list_filter(filled, lambda c: {_NUM}))::DOUBLE / len(filled) < 0.1 AND len(rows) > 1 THEN 'NO_NUMBERS' END,
 CASE WHEN len(filled)::DOUBLE / greatest(len(cells), 1) < 0.3 THEN 'MOSTLY_EMPTY' END], lambda x: x IS NOT NULL) AS flags FROM f),
v AS (SELECT l_orderkey, CAST(n_rows AS INT) AS n_rows, CAST(nonempty AS INT) AS nonempty, coalesce(array_to_string(flags, ','), '') AS flags, CASE WHEN len(flags) = 0 THEN 'clean' WHEN list_contains(flags, 'LETTER_SPACED') OR list_contains(flags, 'PROSE_CONTAM') THEN 'broken' ELSE 'minor' END AS verdict FROM q)"""


@Q.query(f"WITH {QUALITY_SQL} SELECT * FROM v")
def table_quality(spark, sf_dir):
    """Line items of each order as a table."""
    s = F.col("l_suppkey")
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    cells = (
        F.when(s % 19 == 0, row(flag, F.concat(F.lit("a b c d "), status))).when(s % 23 == 0, row(F.concat(F.lit("one two three "), flag), F.concat(F.lit("four five six "), status)))
        .when(s % 3 == 0, row(flag, F.concat(F.col("l_linenumber").cast("string"), F.lit("%")))).when(s % 7 == 0, row("", "")).otherwise(row(flag, ""))
    )
    l = Q.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells")))).alias("items"))
    q = l.select("l_orderkey", C.table_quality(F.transform("items", lambda i: i["cells"])).alias("q"))
    return q.select("l_orderkey", F.col("q.rows").alias("n_rows"), F.col("q.nonempty").alias("nonempty"), F.array_join("q.flags", ",").alias("flags"), F.col("q.verdict").alias("verdict"))


@Q.query(f"WITH {QUALITY_SQL} SELECT verdict, count(*) AS tables FROM v GROUP BY verdict")
def verdict_tally(spark, sf_dir):
    return table_quality(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("tables"))


_GLUED = "CASE WHEN len(list_filter(range(3, length(w) - 2), lambda i: list_contains(k, substr(w, 1, i)) AND list_contains(k, substr(w, i + 1)))) > 0 THEN substr(w, 1, list_filter(range(3, length(w) - 2), lambda i: list_contains(k, substr(w, 1, i)) AND list_contains(k, substr(w, i + 1)))[1]) || '|' || substr(w, list_filter(range(3, length(w) - 2), lambda i: list_contains(k, substr(w, 1, i)) AND list_contains(k, substr(w, i + 1)))[1] + 1) END"


@Q.query(f"SELECT item_id, coalesce(array_to_string(list_filter(list_transform(list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z]) ([a-z])', '\\1\\2', 'g')), '[a-z]{{8,}}'), lambda w: NOT list_contains(k, w)), lambda w: {_GLUED}), lambda x: x IS NOT NULL), ' '), '') AS glued FROM (SELECT item_id, text, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 1) AS k FROM benchmark)")
def glued_words(spark, sf_dir):
    """Benchmark passages with some of their spaces lost, against themselves."""
    b = Q.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(C.glued_words(F.regexp_replace("text", "([a-z]) ([a-z])", "$1$2"), F.col("text")), " ").alias("glued"))


@Q.query("SELECT p_partkey, 50.0::DOUBLE + CAST(p_partkey % 17 * 10 AS DOUBLE) / 2.0::DOUBLE AS x, 700.0::DOUBLE - CAST(p_partkey % 23 * 8 AS DOUBLE) / 2.0::DOUBLE - CAST(p_size % 20 + 5 AS DOUBLE) / 2.0::DOUBLE AS y, CAST(p_size AS DOUBLE) / 2.0::DOUBLE AS width, (CAST(p_partkey % 17 * 10 AS DOUBLE) - 8.0::DOUBLE) / 4.0::DOUBLE AS source_x FROM part")
def pixel_boxes(spark, sf_dir):
    """Crop pixels in page space, and model input in its source image."""
    b = F.col("bbox")
    p = Q.part_boxes(spark, sf_dir).select("p_partkey", G.pixels_to_page(b, F.lit(50.0), F.lit(700.0), F.lit(2.0)).alias("b"), G.unletterbox(b, F.lit(8.0), F.lit(0.0), F.lit(4.0)).alias("s"))
    return p.select("p_partkey", "b.x", "b.y", "b.width", F.col("s.x").alias("source_x"))


@Q.query(f"SELECT conv_id, turn, coalesce(array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' '), '') AS tokens FROM (SELECT conv_id, turn, {Q.sql_tokens('text')} AS t FROM conversations)")
def distinct_in_order(spark, sf_dir):
    """Each token where it comes first."""
    return Q.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(T.tokens(F.col("text"))), " ").alias("tokens"))


@Q.query("SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def first_and_last(spark, sf_dir):
    return Q.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"), F.min_by("role", "turn").alias("first_role"))


@Q.query("SELECT p_partkey, CAST(least(levenshtein(p_name, p_type), 9) AS INT) AS distance FROM part")
def bounded_distance(spark, sf_dir):
    return Q.table(spark, sf_dir, "part").select("p_partkey", C.bounded_distance(F.col("p_name"), F.col("p_type"), 8).alias("distance"))


@Q.query(f"SELECT page, max(i / (44000.0::DOUBLE + a - i)) AS accuracy FROM (SELECT page, w * h AS a, greatest(least(x + w, 200.0::DOUBLE) - x, 0.0::DOUBLE) * greatest(least(y + h, 220.0::DOUBLE) - y, 0.0::DOUBLE) AS i FROM (SELECT {Q.PART_BOX} FROM part)) GROUP BY page")
def page_box_accuracy(spark, sf_dir):
    """Best overlap of any box with that of its page."""
    page = G.box(F.lit(0), F.lit(0), F.lit(200), F.lit(220))
    return Q.part_boxes(spark, sf_dir).groupBy("page").agg(F.max(G.iou(page, F.col("bbox"))).alias("accuracy"))


@Q.query(
    "WITH d AS (SELECT 'in/d' || doc_id || '.pdf' AS document, 'd' || doc_id AS stem, doc_id FROM documents), t AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'in/d' || doc_id || '.pdf' ELSE 'gt/d' || doc_id || '.md' END AS path, CASE WHEN doc_id % 4 = 2 THEN NULL ELSE 'd' || doc_id END AS stem, CASE WHEN doc_id % 4 < 3 THEN 'd' || doc_id || '.pdf' END AS base, doc_id AS truth FROM documents WHERE doc_id % 5 <> 0), "
    "c AS (SELECT document, 0 AS way, truth FROM d JOIN t ON d.document = t.path UNION ALL SELECT document, 1, truth FROM d JOIN t ON d.stem = t.stem UNION ALL SELECT document, 2, truth FROM d JOIN t ON d.stem || '.pdf' = t.base) "
    "SELECT d.document, coalesce(x.way, -1) AS way, coalesce(x.truth, -1) AS truth FROM d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document ORDER BY way, truth) AS n FROM c) x ON d.document = x.document AND n = 1"
)
def ground_truth(spark, sf_dir):
    """Documents with the truth of the same path, else of the same stem, else of the same file name."""
    k, d = F.col("doc_id"), Q.table(spark, sf_dir, "documents").select("doc_id")
    stem = F.concat(F.lit("d"), k.cast("string"))
    docs = d.select(F.concat(F.lit("in/"), stem, F.lit(".pdf")).alias("document"), F.concat(F.lit("in/"), stem, F.lit(".pdf")).alias("path"), stem.alias("stem"), F.concat(stem, F.lit(".pdf")).alias("base"))
    path = F.when(k % 4 == 0, F.concat(F.lit("in/"), stem, F.lit(".pdf"))).otherwise(F.concat(F.lit("gt/"), stem, F.lit(".md")))
    truths = d.where(k % 5 != 0).select(path.alias("path"), F.when(k % 4 != 2, stem).alias("stem"), F.when(k % 4 < 3, F.concat(stem, F.lit(".pdf"))).alias("base"), k.alias("truth"))
    got = C.preferred_join(docs, truths, [("path", "path"), ("stem", "stem"), ("base", "base")], "truth")
    return got.select("document", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("way", "truth")])  # none: -1


@Q.query("SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) > 100000 AS over_budget FROM documents GROUP BY source")
def folder_sizes(spark, sf_dir):
    d = Q.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return d.withColumn("over_budget", F.col("bytes") > 100000)


@Q.query("WITH s AS (SELECT o_custkey, o_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS score FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), k AS (SELECT *, max(score) OVER (PARTITION BY o_custkey) AS most FROM s) SELECT o_custkey, o_orderkey, score, CAST(n AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM k WHERE score > 0 OR most = 0) WHERE n <= 2")
def densest_pages(spark, sf_dir):
    """The two densest pages of each document, without empty ones if there are others: a top-k report."""
    l = Q.table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.count("*").alias("score"))
    s = Q.table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("score", F.lit(0)).alias("score"))
    return S.densest(s, "o_custkey", "o_orderkey", 2)


@Q.query("SELECT p_partkey, alt, CASE WHEN trim(c) <> '' AND c <> shown THEN '![' || shown || '](' || coalesce(ref, '#image') || ')' || chr(10) || chr(10) || c ELSE '![' || shown || '](' || coalesce(ref, '#image') || ')' END AS markdown FROM (SELECT *, coalesce(alt, c, ref, 'image') AS shown FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS alt, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS c, CASE WHEN p_partkey % 5 = 0 THEN 'img/' || p_partkey || '.png' END AS ref FROM part))")
def figure_markdown(spark, sf_dir):
    k = F.col("p_partkey")
    p = Q.table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, F.col("p_name")).alias("alt"), F.when(k % 3 == 0, F.col("p_type")).alias("c"), F.when(k % 5 == 0, F.concat(F.lit("img/"), k.cast("string"), F.lit(".png"))).alias("ref"))
    return p.select("p_partkey", "alt", R.markdown_figure(F.col("alt"), F.col("c"), F.col("ref")).alias("markdown"))


@Q.query("WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS r, CAST(l_quantity AS INT) % 3 AS c, min(l_returnflag || l_linestatus) AS t FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(r) AS h, max(c) AS w FROM c GROUP BY l_orderkey), g AS (SELECT l_orderkey, a.r, b.c FROM m, range(100) AS a(r), range(3) AS b(c) WHERE a.r <= h AND b.c <= w) SELECT g.l_orderkey, string_agg(coalesce(t, ''), '|' ORDER BY g.r, g.c) AS grid FROM g LEFT JOIN c ON g.l_orderkey = c.l_orderkey AND g.r = c.r AND g.c = c.c GROUP BY g.l_orderkey")
def dense_grid(spark, sf_dir):
    """Cells of each order's table as dense rows."""
    row, column = (F.col("l_linenumber") - 1).alias("row"), (F.col("l_quantity").cast("int") % 3).alias("column")
    text = F.concat("l_returnflag", "l_linestatus")
    lines = Q.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(row, column, text.isNull().alias("empty"), text.alias("text")).alias("cell"))
    cells = lines.groupBy("l_orderkey").agg(C.least_cells("cell").alias("cells"))  # one shuffle, no sort by strings
    return cells.select("l_orderkey", F.array_join(F.flatten(C.grid_of_cells(F.col("cells"))), "|").alias("grid"))


@Q.query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id FROM events")
def run_ids(spark, sf_dir):
    return Q.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("run_id"))


@Q.query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS manifest FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def manifests(spark, sf_dir):
    """Documents of each language by source, as a map."""
    n = Q.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    m = n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    return m.select("source", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("m"), k).cast("string"))), ",").alias("manifest"))


@Q.query("SELECT p_partkey, CASE WHEN v BETWEEN -1 AND 41 THEN 0 WHEN v BETWEEN 39 AND 81 THEN 1 WHEN v BETWEEN 79 AND 151 THEN 2 ELSE -1 END AS cell FROM (SELECT p_partkey, p_partkey % 17 * 10 + p_size / 2.0::DOUBLE AS v FROM part)")
def runs_to_cells(spark, sf_dir):
    """Centres of runs between the lines of an axis."""
    lines = F.array(*map(F.lit, (0.0, 40.0, 80.0, 150.0)))
    return Q.part_boxes(spark, sf_dir).select("p_partkey", F.coalesce(C.axis_cell(G.center(F.col("bbox"))[0], lines), F.lit(-1)).alias("cell"))


@Q.query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Name Type' || chr(10) || p_name || ' ' || p_type WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END ELSE p_name END AS text FROM part")
def block_texts(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "table").when(k % 3 == 1, "figure").otherwise("paragraph")
    got = C.block_text(kind, F.col("p_name"), F.array(F.lit("Name"), F.lit("Type")), F.array(F.array("p_name", "p_type")), F.when(k % 2 == 0, F.col("p_type")))
    return Q.table(spark, sf_dir, "part").select("p_partkey", got.alias("text"))


@Q.query(f"SELECT page, p_partkey FROM (SELECT p_partkey, {Q.PART_BOX}, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS n FROM part) WHERE n <= 8")
def table_cap(spark, sf_dir):
    """At most eight tables a page, the first ones: the cap is the feature."""
    n = F.row_number().over(Window.partitionBy("page").orderBy("p_partkey"))
    return Q.part_boxes(spark, sf_dir).select("page", "p_partkey", n.alias("n")).where("n <= 8").select("page", "p_partkey")


def sql_math_alias(x: str) -> str:
    got = x
    for command, sign in T.MATH_SIGNS:
        got = f"replace({got}, '{command}', '{sign}')"
    got = f"translate(regexp_replace({got}, '([_^])\\{{([^{{}}]+)\\}}', '\\1\\2', 'g'), '{{}}', '')"
    return f"nullif({got}, {x})"


_FORMULA = "'\\' || (['alpha', 'infty', 'in', 'leq', 'Sigma', 'cdots', 'none'])[CAST(p_partkey % 7 + 1 AS INT)] || CASE WHEN p_partkey % 2 = 0 THEN '_{' || p_size || '}' ELSE ' x^{a' || p_size || '} {b}' END"


@Q.query(f"SELECT p_partkey, {sql_math_alias('f')} AS alias FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE {_FORMULA} END AS f FROM part)")
def math_aliases(spark, sf_dir):
    """Formulas made of parts, and their names, which hold no formula."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    names = F.array(*map(F.lit, ("alpha", "infty", "in", "leq", "Sigma", "cdots", "none")))
    tail = F.when(k % 2 == 0, F.concat(F.lit("_{"), size, F.lit("}"))).otherwise(F.concat(F.lit(" x^{a"), size, F.lit("} {b}")))
    formula = F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("\\"), F.element_at(names, (k % 7 + 1).cast("int")), tail))
    return Q.table(spark, sf_dir, "part").select("p_partkey", T.math_alias(formula).alias("alias"))
