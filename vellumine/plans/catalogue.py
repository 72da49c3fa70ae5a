"""Every registered query over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import text as T
from ..operators import metrics as M
from ..operators import segments as S
from ..sources.detect import FORMATS, TEXT_LIKE, detect_format, support_status
from . import render as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WS = r"\t-\r \x{85}\p{Z}"
BLANK = r"\t\x{0B}\f\r \x{85}\p{Z}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def sql_html(x: str) -> str:
    x = f"regexp_replace({x}, '{T.hidden_ranges()}', '', 'g')"
    x = f"regexp_replace({x}, '{T.unclosed_ranges()}', '', 'g')"
    x = f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{T.block_tags()}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    code = "CASE WHEN regexp_matches(p, '^[xX][0-9a-fA-F]{1,8};') THEN CAST('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]{1,8});', 1) AS BIGINT) WHEN regexp_matches(p, '^[0-9]{1,10};') THEN CAST(regexp_extract(p, '^([0-9]{1,10});', 1) AS BIGINT) END"
    rest = "substr(p, strpos(p, ';') + 1)"
    x = f"array_to_string(list_transform(str_split({x}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p WHEN ({code}) = 38 THEN '&amp;' || {rest} WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INT)) || {rest} ELSE '&#' || p END), '')"
    for name, char in T.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql_tidy(x)


def sql_tidy(x: str) -> str:
    x = f"regexp_replace({x}, '[{BLANK}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?(\\n ?)+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\n\\n|\\n\\n$|^ | $', '', 'g')"


def sql_paragraphs(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n[\\t\\x{{0B}}\\f \\x{{85}}\\p{{Z}}]*\\n'), lambda p: {sql_collapse('p')}), lambda p: p <> '')"


# --------------------------------------------------------------------------- pages, text and counts


@query(f"SELECT page_id, {sql_html('html')} AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, CAST(i - 1 AS BIGINT) AS block_index, 'paragraph' AS kind, p[i] AS text FROM (SELECT page_id, {sql_paragraphs(sql_html('html'))} AS p FROM pages), unnest(range(1, len(p) + 1)) AS u(i)")
def html_blocks(spark, sf_dir):
    return S.paragraph_blocks(html_text(spark, sf_dir), "page_id", "text")


def sql_counts(key: str, text: str, source: str) -> str:
    return f"SELECT {key}, CAST(length(j) AS BIGINT) AS character_count, CAST(len(regexp_extract_all(j, '[^{WS}]+')) AS BIGINT) AS word_count, CAST(len(p) AS BIGINT) AS block_count FROM (SELECT {key}, p, coalesce(array_to_string(p, chr(10) || chr(10)), '') AS j FROM (SELECT {key}, {sql_paragraphs(text)} AS p FROM {source}))"


@query(sql_counts("page_id", sql_html("html"), "pages"))
def page_counts(spark, sf_dir):
    return S.document_counts(html_text(spark, sf_dir), "page_id", "text")


@query(sql_counts("doc_id", "text", "documents"))
def doc_counts(spark, sf_dir):
    return S.document_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS block_index, 'paragraph' AS kind, p[i] AS text FROM (SELECT doc_id, {sql_paragraphs('text')} AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i)")
def paragraph_blocks(spark, sf_dir):
    return S.paragraph_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"WITH b AS (SELECT page_id, {sql_paragraphs(sql_html('html'))} AS p FROM pages), m AS (SELECT page_id, p, coalesce(array_to_string(list_transform(p, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '[\\t \\p{{Zs}}]+', ' ', 'g'), '(?m)^ | $', '', 'g')), chr(10) || chr(10)), '') AS markdown, coalesce(array_to_string(p, chr(10) || chr(10)), '') AS j FROM b) "
    f"SELECT page_id, markdown, CAST(length(j) AS BIGINT) AS character_count, CAST(len(regexp_extract_all(j, '[^{WS}]+')) AS BIGINT) AS word_count, CAST(len(p) AS BIGINT) AS block_count FROM m"
)
def pages_to_markdown(spark, sf_dir):
    """Scan, text, paragraphs, counts and rendering: the whole way of a page, in one projection a page."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.paragraphs(T.html_to_text(F.col("html"))).alias("parts"))
    counted = S.paragraph_counts(pages, ["page_id"], F.col("parts"))
    return counted.select("page_id", R.paragraphs_to_markdown(F.col("parts")).alias("markdown"), "character_count", "word_count", "block_count")


@query(f"SELECT doc_id, {sql_collapse('text')} AS text FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'), '[\\t \\p{Zs}]+', ' ', 'g'), '(?m)^ | $', '', 'g') AS text FROM conversations")
def sanitize_markdown(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sanitize_markdown(F.col("text")).alias("text"))


def sql_latex(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '[\\t\\x{{0B}}\\f\\r\\x{{85}}]', ' ', 'g'), '[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x{{84}}\\x{{86}}-\\x{{9F}}]', '', 'g')"
    x = f"replace(replace({x}, '{{', chr(1)), '}}', chr(2))"
    for char, out in T._LATEX:
        x = f"replace({x}, '{char}', '{out}')"
    x = f"replace(replace({x}, chr(1), '\\{{'), chr(2), '\\}}')"
    for char, out in T._PLAIN:
        x = f"replace({x}, '{char}', '{out.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g')"


@query(f"SELECT doc_id, {sql_latex('text')} AS latex FROM documents")
def escape_latex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_latex(F.col("text")).alias("latex"))


@query("SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def accuracy_tokens(spark, sf_dir):
    t = T.accuracy_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


SQL_HEALTH = f"CASE WHEN len(w) < 25 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - least(1.0::DOUBLE, len(list_filter(w, lambda t: length(t) > 18))::DOUBLE / len(w) / 0.04::DOUBLE) END"
SQL_HEALTH_WORDS = f"list_filter({sql_tokens('text')}, lambda t: regexp_matches(t, '\\p{{L}}'))"


@query(f"SELECT doc_id, {SQL_HEALTH} AS health FROM (SELECT doc_id, {SQL_HEALTH_WORDS} AS w FROM documents)")
def text_health(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_health(F.col("text")).alias("health"))


@query(
    f"SELECT doc_id, CASE WHEN r = 'born_digital' AND chars >= 50 AND health < 0.5 THEN 'scanned' ELSE r END AS route FROM (SELECT doc_id, chars, health, CASE WHEN chars >= 50 THEN CASE WHEN big AND chars < 400 THEN 'hybrid' ELSE 'born_digital' END WHEN chars >= 10 THEN CASE WHEN big THEN 'hybrid' ELSE 'born_digital' END ELSE CASE WHEN big THEN 'scanned' ELSE 'born_digital' END END AS r FROM (SELECT doc_id, length(regexp_replace(text, '[{WS}]+', '', 'g')) AS chars, (doc_id % 10) / 10.0::DOUBLE >= 0.5 AS big, {SQL_HEALTH} AS health FROM (SELECT doc_id, text, {SQL_HEALTH_WORDS} AS w FROM documents)))"
)
def triage_route(spark, sf_dir):
    """Route of each document, with a made-up image share from its id."""
    chars = F.length(F.regexp_replace("text", f"[{WS}]+", ""))
    return table(spark, sf_dir, "documents").select("doc_id", S.route(chars, F.col("doc_id") % 10 / F.lit(10.0), T.text_health(F.col("text"))).alias("route"))


@query(f"SELECT conv_id, turn, {sql_collapse(chr(114) + 'egexp_replace(lower(text), ' + chr(39) + '[0-9]+' + chr(39) + ', ' + chr(39) + '#' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS margin_key FROM conversations")
def margin_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.margin_key(F.col("text")).alias("margin_key"))


MARGIN_BLOCKS_SQL = f"""
WITH b AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS block_index, p[i] AS text, i = 1 AS margin FROM
  (SELECT conv_id, turn, list_prepend(role || ' 12', {sql_paragraphs('text')}) AS p FROM conversations), unnest(range(1, len(p) + 1)) AS u(i)),
k AS (SELECT *, CASE WHEN margin THEN trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[{WS}]+', ' ', 'g'), ' ') END AS margin_key FROM b),
n AS (SELECT conv_id, count(DISTINCT turn) AS n_pages FROM b GROUP BY conv_id),
r AS (SELECT k.conv_id, margin_key FROM k JOIN n USING (conv_id) WHERE margin_key <> '' AND n_pages >= 2 GROUP BY k.conv_id, margin_key, n_pages HAVING count(DISTINCT turn) >= greatest(2, (n_pages + 1) // 2))
SELECT k.conv_id, k.turn, k.block_index, k.text FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = k.conv_id AND r.margin_key = k.margin_key)
"""


@query(MARGIN_BLOCKS_SQL)
def repeated_margin_drop(spark, sf_dir):
    """Conversations as documents, turns as pages, each with its role as a running header."""
    pages = table(spark, sf_dir, "conversations")
    parts = F.concat(F.array(F.concat("role", F.lit(" 12"))), T.paragraphs(F.col("text")))
    blocks = pages.select("conv_id", "turn", F.posexplode(parts).alias("block_index", "text")).withColumn("block_index", F.col("block_index").cast("long"))
    return S.drop_repeated_margins(blocks, "conv_id", "turn", "text", F.col("block_index") == 0).select("conv_id", "turn", "block_index", "text")


def sql_case(names, ext: str) -> str:
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in FORMATS[n])}) THEN '{n}'" for n in names) + " END"


SQL_PATH = "'in/Doc-' || p_partkey || (['.TXT', '.md', '.tex', '.pdf', '.json.gz', '.bin.gz', '.xlsx', '.doc', '.unknown', '.html', '.tar', ''])[CAST(p_partkey % 12 + 1 AS INT)]"


@query(
    f"SELECT p_partkey, path, format, CASE WHEN format IS NULL THEN 'unknown' WHEN format = 'planned' THEN 'planned' ELSE 'supported' END AS status FROM (SELECT p_partkey, path, CASE WHEN ext = 'gz' THEN coalesce({sql_case(TEXT_LIKE, 'inner_ext')}, 'archive') ELSE {sql_case(FORMATS, 'ext')} END AS format FROM (SELECT p_partkey, path, regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) AS ext, regexp_extract(lower(path), '\\.([a-z0-9]+)\\.gz$', 1) AS inner_ext FROM (SELECT p_partkey, {SQL_PATH} AS path FROM part)))"
)
def detect_formats(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".TXT", ".md", ".tex", ".pdf", ".json.gz", ".bin.gz", ".xlsx", ".doc", ".unknown", ".html", ".tar", "")])
    path = F.concat(F.lit("in/Doc-"), F.col("p_partkey").cast("string"), F.element_at(ends, (F.col("p_partkey") % 12 + 1).cast("int")))
    got = table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("format", detect_format(F.col("path")))
    return got.withColumn("status", support_status(F.col("format")))


@query(f"SELECT doc_id, {sql_collapse('lower(replace(regexp_replace(text, ' + chr(39) + '[#*_`|>~-]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), chr(304), chr(105) || chr(775)))')} AS text FROM documents")
def norm_text(spark, sf_dir):
    """Of every document, null texts included. The SQL lowers U+0130 to two characters, as Unicode has it."""
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_text(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, len(t) >= 4 AND len(list_filter(t, lambda x: length(x) = 1)) * 10 >= len(t) * 6 AS letter_spaced FROM (SELECT conv_id, turn, {sql_tokens('text')} AS t FROM conversations)")
def letter_spaced(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.letter_spaced(F.col("text")).alias("letter_spaced"))


# --------------------------------------------------------------------------- metrics


def document_pairs(spark, sf_dir):
    """Each document with one benchmark passage as its ground truth."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    items = bench.agg(F.max("item_id") + 1).first()[0]
    docs = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % items)
    return docs.join(bench, "item_id").select("doc_id", "truth", F.col("text").alias("output"))


PAIRS_SQL = "p AS (SELECT d.doc_id, b.text AS truth, d.text AS output FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"


def sql_overlap(tokens) -> str:
    return f"""WITH {PAIRS_SQL},
tt AS (SELECT doc_id, unnest({tokens('truth')}) AS token, 1 AS t, 0 AS o FROM p UNION ALL SELECT doc_id, unnest({tokens('output')}), 0, 1 FROM p),
c AS (SELECT doc_id, token, sum(t) AS t, sum(o) AS o FROM tt GROUP BY doc_id, token),
g AS (SELECT doc_id, CAST(sum(t) AS BIGINT) AS n_truth, CAST(sum(o) AS BIGINT) AS n_output, CAST(sum(least(t, o)) AS BIGINT) AS n_both FROM c GROUP BY doc_id),
x AS (SELECT p.doc_id, coalesce(n_truth, 0) AS n_truth, coalesce(n_output, 0) AS n_output, coalesce(n_both, 0) AS n_both FROM p LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN n_truth = 0 THEN 1.0::DOUBLE ELSE n_both::DOUBLE / n_truth END AS token_coverage,
 CASE WHEN n_output = 0 THEN 0.0::DOUBLE ELSE (n_output - n_both)::DOUBLE / n_output END AS spurious_rate,
 CASE WHEN n_truth = 0 THEN NULL ELSE 2.0::DOUBLE * n_both / (n_truth + n_output) END AS token_f1 FROM x"""


@query(sql_overlap(sql_tokens))
def token_coverage(spark, sf_dir):
    return M.coverage_scores(M.token_overlap(document_pairs(spark, sf_dir), "doc_id", "truth", "output"), "doc_id")


@query(sql_overlap(lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"))
def token_f1(spark, sf_dir):
    return M.coverage_scores(M.token_overlap(document_pairs(spark, sf_dir), "doc_id", "truth", "output", T.accuracy_tokens), "doc_id")


@query(f"WITH {PAIRS_SQL} SELECT doc_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS jaccard FROM (SELECT doc_id, list_distinct({sql_tokens('truth')}) AS a, list_distinct({sql_tokens('output')}) AS b FROM p)")
def token_jaccard(spark, sf_dir):
    pairs = document_pairs(spark, sf_dir)
    return pairs.select("doc_id", A.jaccard(T.tokens(F.col("truth")), T.tokens(F.col("output"))).alias("jaccard"))


@query()
def char_error_rate(spark, sf_dir):
    """Of every two adjacent turns; null for a null text and above 20,000 characters. No SQL: DuckDB's
    levenshtein counts bytes. Tests compare with brute force."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("output"), F.lag("text").over(order).alias("truth"), F.row_number().over(order).alias("nth")).where("nth > 1")
    scored = F.col("truth").isNotNull() & F.col("output").isNotNull() & (F.greatest(F.length("truth"), F.length("output")) <= 20000)
    cer, similarity = M.char_error_rate(F.col("truth"), F.col("output")), M.edit_similarity(F.col("truth"), F.col("output"))
    return pairs.select("conv_id", "turn", F.when(scored, cer).alias("cer"), F.when(scored, similarity).alias("edit_similarity"))


def user_ranks(spark, sf_dir):
    """Events of a user ranked by time (truth) and by value (output)."""
    e = table(spark, sf_dir, "events")
    by = lambda *c: F.row_number().over(Window.partitionBy("user_id").orderBy(*c)) - 1
    return e.select("user_id", "event_id", by("value", "event_id").alias("p"), by("ts", "event_id").alias("g"))


RANKS_SQL = "r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS g FROM events)"


@query(f"WITH {RANKS_SQL} SELECT user_id, count(*) AS n, CAST(sum(abs(p - g)) AS BIGINT)::DOUBLE / count(*) / count(*) AS ard FROM r GROUP BY user_id")
def reading_order_ard(spark, sf_dir):
    return M.order_distance(user_ranks(spark, sf_dir), "user_id")


TIED_SQL = "r AS (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY round(value, 1)) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS g FROM events)"


@query(f"WITH {TIED_SQL}, s AS (SELECT a.user_id, sign((a.p - b.p)) * sign((a.g - b.g)) AS s, CASE WHEN a.p = b.p THEN 1 ELSE 0 END AS tp, CASE WHEN a.g = b.g THEN 1 ELSE 0 END AS tg FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_id < b.event_id), g AS (SELECT user_id, count(*) FILTER (WHERE s > 0) AS concordant, count(*) FILTER (WHERE s < 0) AS discordant, sum(1 - tp) AS dp, sum(1 - tg) AS dg FROM s GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM r) SELECT u.user_id, coalesce(concordant, 0) AS concordant, coalesce(discordant, 0) AS discordant, CASE WHEN dp * dg > 0 THEN round((concordant - discordant)::DOUBLE / sqrt((dp * dg)::DOUBLE), 12) ELSE 0.0::DOUBLE END AS tau FROM u LEFT JOIN g USING (user_id)")
def kendall_tau(spark, sf_dir):
    """Events ranked by rounded value, with ties, against their order in time; a lone event has 0."""
    e = table(spark, sf_dir, "events")
    by = lambda *c: Window.partitionBy("user_id").orderBy(*c)
    ranks = e.select("user_id", F.rank().over(by(F.round("value", 1))).alias("p"), (F.row_number().over(by("ts", "event_id")) - 1).alias("g"))
    return M.kendall(ranks, "user_id").withColumn("tau", F.round("tau", 12)).drop("normalized")


@query(
    "WITH s AS (SELECT l.doc_id, d.lang, l.quality AS hit, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER w AS tp, sum(hit) OVER (PARTITION BY lang) AS positives FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT doc_id, lang, CAST(rank AS INT) AS rank, tp::DOUBLE / rank AS precision, CASE WHEN positives > 0 THEN tp::DOUBLE / positives ELSE 0.0::DOUBLE END AS recall, max(tp::DOUBLE / rank) OVER (PARTITION BY lang ORDER BY score DESC, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM r"
)
def precision_recall_curve(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return M.precision_recall(s, "lang", "n_chars", "quality", "doc_id").select("doc_id", "lang", F.col("rank").cast("int").alias("rank"), "precision", "recall", "envelope")


@query("SELECT d.source, CAST(count(*) AS BIGINT) AS n_documents, sum(l.quality * d.n_chars)::DOUBLE / sum(d.n_chars) AS weighted_quality, avg(l.quality)::DOUBLE AS mean_quality, count(*) FILTER (WHERE l.toxic = 1) AS n_toxic FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source")
def weighted_accuracy(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return s.groupBy("source").agg(F.count("*").alias("n_documents"), (F.sum(F.col("quality") * F.col("n_chars")) / F.sum("n_chars")).alias("weighted_quality"), F.avg("quality").alias("mean_quality"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


# --------------------------------------------------------------------------- relations


@query("SELECT doc_id, source, CAST(turn AS INT) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 100")
def round_robin_sample(spark, sf_dir):
    return S.balanced_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 100)


def two_runs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    before = d.where("id % 7 <> 0").select("id", F.lit("score").alias("metric"), ((F.col("id") * 37 % 101) / F.lit(100.0)).alias("score"))
    after = d.where("id % 5 <> 0").select("id", F.lit("score").alias("metric"), ((F.col("id") * 53 % 101) / F.lit(100.0)).alias("score"))
    return before, after


RUNS_SQL = "b AS (SELECT doc_id AS id, (doc_id * 37 % 101) / 100.0::DOUBLE AS s FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT doc_id AS id, (doc_id * 53 % 101) / 100.0::DOUBLE AS s FROM documents WHERE doc_id % 5 <> 0)"


@query(f"WITH {RUNS_SQL} SELECT coalesce(b.id, c.id) AS id, 'score' AS metric, CASE WHEN b.id IS NULL THEN 'only_in_candidate' WHEN c.id IS NULL THEN 'only_in_baseline' ELSE 'shared' END AS side, c.s - b.s AS delta, CASE WHEN c.s - b.s > 0.005::DOUBLE THEN 'improved' WHEN c.s - b.s < -0.005::DOUBLE THEN 'regressed' WHEN c.s - b.s IS NOT NULL THEN 'unchanged' END AS verdict FROM b FULL JOIN c ON b.id = c.id")
def run_diff(spark, sf_dir):
    return S.run_diff(*two_runs(spark, sf_dir))


@query(f"WITH {RUNS_SQL} SELECT b.id, c.s - b.s AS delta FROM b JOIN c ON b.id = c.id ORDER BY delta, id LIMIT 10")
def worst_regressions(spark, sf_dir):
    """The report's top ten."""
    return S.run_diff(*two_runs(spark, sf_dir)).where("side = 'shared'").orderBy("delta", "id").limit(10).select("id", "delta")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS text FROM events")
def json_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", A.first_present(F.col("v"), "$.key", "$.k", kind="long").alias("k"), F.col("props").alias("text"))


PART_BOX = "p_partkey % 50 AS page, CAST(p_partkey % 17 * 10 AS DOUBLE) AS x, CAST(p_partkey % 23 * 8 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_size % 20 + 5 AS DOUBLE) AS h"


def part_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", (k % 50).alias("page"), G.box(k % 17 * 10, k % 23 * 8, F.col("p_size"), F.col("p_size") % 20 + 5).alias("bbox"))


@query(
    f"WITH b AS (SELECT p_partkey, {PART_BOX} FROM part), j AS (SELECT a.p_partkey, c.p_partkey AS other, greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0.0::DOUBLE) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0.0::DOUBLE) AS i, a.w * a.h + c.w * c.h AS s FROM b a LEFT JOIN b c ON a.page = c.page AND a.p_partkey <> c.p_partkey) SELECT p_partkey, max(CASE WHEN other IS NOT NULL AND s - i > 0 THEN i / (s - i) ELSE 0.0::DOUBLE END) AS best_iou FROM j GROUP BY p_partkey"
)
def best_iou(spark, sf_dir):
    """Of each part's box with any other on its page; 0 where it overlaps none."""
    return S.best_overlaps(part_boxes(spark, sf_dir), ["page"], "p_partkey").select("p_partkey", "best_iou")


SPANS_SQL = f"""
WITH r AS (SELECT p_partkey AS region_id, {PART_BOX}, (['table', 'figure', 'formula', 'text', 'other'])[CAST(p_partkey % 5 + 1 AS INT)] AS class FROM part),
s AS (SELECT DISTINCT ((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber AS span_id, l_partkey % 50 AS page, CAST(l_suppkey * 7 % 200 AS DOUBLE) AS cx, CAST(l_orderkey * 3 % 220 AS DOUBLE) AS cy FROM lineitem),
j AS (SELECT s.span_id, s.page, r.region_id, s.cx BETWEEN r.x AND r.x + r.w AND s.cy BETWEEN r.y AND r.y + r.h AS inside,
  CASE class WHEN 'table' THEN 4 WHEN 'figure' THEN 3 WHEN 'formula' THEN 2 WHEN 'text' THEN 1 ELSE 0 END AS rank, r.w * r.h AS area,
  power(s.cx - greatest(r.x, least(s.cx, r.x + r.w)), 2) + power(s.cy - greatest(r.y, least(s.cy, r.y + r.h)), 2) AS d2
  FROM s LEFT JOIN r ON s.page = r.page),
o AS (SELECT page, span_id, region_id, row_number() OVER (PARTITION BY page, span_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN -rank ELSE d2 END, CASE WHEN inside THEN area ELSE 0 END, region_id) AS n FROM j WHERE inside OR d2 <= 144)
SELECT s.page, s.span_id, coalesce(o.region_id, -1) AS region_id FROM s LEFT JOIN o ON s.span_id = o.span_id AND s.page = o.page AND o.n = 1
"""


@query(SPANS_SQL)
def span_region_assign(spark, sf_dir):
    """Line items as text spans, parts as layout regions."""
    kinds = F.array(*[F.lit(x) for x in ("table", "figure", "formula", "text", "other")])
    regions = part_boxes(spark, sf_dir).select("page", F.col("p_partkey").alias("region_id"), F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("class"), "bbox")
    l = table(spark, sf_dir, "lineitem")
    spans = l.select((F.col("l_partkey") % 50).alias("page"), (((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")).alias("span_id"), G.box(F.col("l_suppkey") * 7 % 200, F.col("l_orderkey") * 3 % 220, F.lit(0), F.lit(0)).alias("bbox"))
    got = S.assign_spans(spans, regions, ["page"], 12.0).distinct()  # the same span, the same region
    return got.withColumn("region_id", F.coalesce("region_id", F.lit(-1)))  # an orphan: -1


@query("WITH g AS (SELECT event_type, value, event_id, CASE WHEN value - lag(value) OVER (PARTITION BY event_type ORDER BY value) > 0.05 THEN 1 ELSE 0 END AS new FROM events), i AS (SELECT event_type, value, sum(new) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS island FROM g) SELECT event_type, CAST(island AS BIGINT) AS island, count(*) AS support, min(value) AS low, max(value) AS high FROM i GROUP BY event_type, island")
def axis_clusters(spark, sf_dir):
    """One-dimensional clusters split at gaps, with their support."""
    got = S.gap_islands(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", 0.05)
    return got.groupBy("event_type", "island").agg(F.count("*").alias("support"), F.min("value").alias("low"), F.max("value").alias("high"))


def nation_tables(spark, sf_dir):
    """Nations of each region as one table block."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    got = j.groupBy("r_name").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return got.select("r_name", F.array(F.lit("Nation"), F.lit("Key")).alias("headers"), F.transform("rows", lambda r: r["cells"]).alias("rows"))


NATION_SQL = "t AS (SELECT r_name, n_name, CAST(n_nationkey AS VARCHAR) AS k, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), w AS (SELECT r_name, greatest(6, max(length(n_name))) AS a, greatest(3, max(length(k))) AS b FROM t GROUP BY r_name)"


@query(f"WITH {NATION_SQL} SELECT t.r_name, '| ' || rpad('Nation', any_value(w.a)::INT, ' ') || ' | ' || rpad('Key', any_value(w.b)::INT, ' ') || ' |' || chr(10) || '| ' || repeat('-', any_value(w.a)) || ' | ' || repeat('-', any_value(w.b)) || ' |' || chr(10) || string_agg('| ' || rpad(n_name, w.a::INT, ' ') || ' | ' || rpad(k, w.b::INT, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM t JOIN w ON t.r_name = w.r_name GROUP BY t.r_name")
def markdown_table(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("r_name", R.pipe_table(F.col("headers"), F.col("rows")).alias("markdown"))


@query(f"WITH {NATION_SQL} SELECT r_name, '<table><tr><th>Nation</th><th>Key</th></tr>' || string_agg('<tr><td>' || n_name || '</td><td>' || k || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM t GROUP BY r_name")
def html_table(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("r_name", R.html_table(F.col("headers"), F.col("rows")).alias("html"))


@query(f"WITH {NATION_SQL} SELECT r_name, '\\begin{{tabular}}{{lr}}' || chr(10) || '\\hline' || chr(10) || 'Nation & Key \\\\' || chr(10) || '\\hline' || chr(10) || string_agg({sql_latex('n_name')} || ' & ' || k || ' \\\\', chr(10) ORDER BY n_nationkey) || chr(10) || '\\hline' || chr(10) || '\\end{{tabular}}' AS latex FROM t GROUP BY r_name")
def latex_table(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("r_name", R.latex_table(F.col("headers"), F.col("rows")).alias("latex"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[0-9$(),.%+ –—-]+$') AND regexp_matches(t, '[0-9]') THEN true ELSE false END AS numeric_value FROM (SELECT o_orderkey, trim(CASE WHEN o_orderkey % 3 = 0 THEN '$' || CAST(o_custkey AS VARCHAR) || ',00 %' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '-' END) AS t FROM orders)")
def numeric_cells(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    cell = F.when(k == 0, F.concat(F.lit("$"), F.col("o_custkey").cast("string"), F.lit(",00 %"))).when(k == 1, F.col("o_orderpriority")).otherwise(F.lit("-"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_numeric_value(cell).alias("numeric_value"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings")
def argmax_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("best"))


@query("SELECT lang, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS characters, count(*) FILTER (WHERE n_chars > 5000) AS long_documents, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY lang")
def coverage_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("characters"), F.count_if(F.col("n_chars") > 5000).alias("long_documents"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


from . import evaluation, more  # noqa: E402,F401  more queries
