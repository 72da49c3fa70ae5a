"""Queries whose operators parse bytes or fold over their own state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout as L
from ..operators import scores as C
from ..sources.extract import extract
from ..workers import reachable
from . import catalogue as Q


_PAGES = f"SELECT CAST(page_id AS VARCHAR) || '.html' AS path, {Q.sql_paragraphs(Q.sql_html('html'))} AS p FROM pages"


@Q.query(f"SELECT path, true AS ok, CAST(i - 1 AS INT) AS block_index, 'paragraph' AS kind, p[i] AS text FROM ({_PAGES}), unnest(range(1, len(p) + 1)) AS u(i) UNION ALL SELECT path, true, NULL, NULL, NULL FROM ({_PAGES}) WHERE len(p) = 0")
def extract_pages(spark, sf_dir):
    """Web pages as HTML files."""
    p = Q.table(spark, sf_dir, "pages")
    files = p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return extract(files).select("path", "ok", "block_index", "kind", "text")


@Q.query("SELECT CAST(event_id AS VARCHAR) || '.json' AS path, 'k' AS kind, json_extract_string(props, '$.k') AS text FROM events")
def generic_json_text(spark, sf_dir):
    """Event properties as JSON files."""
    e = Q.table(spark, sf_dir, "events")
    files = e.select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.encode("props", "utf-8").alias("content"))
    return extract(files).select("path", "kind", "text")


@Q.query("SELECT CAST(c_custkey AS VARCHAR) || '.csv' AS path, CAST(i AS INT) AS block_index, 'row' AS kind, CASE i WHEN 0 THEN 'name segment' ELSE c_name || ' ' || c_mktsegment END AS text FROM customer, range(2) AS r(i)")
def csv_rows(spark, sf_dir):
    """A two-line CSV file for each customer."""
    c = Q.table(spark, sf_dir, "customer")
    body = F.concat(F.lit("name,segment\n"), "c_name", F.lit(","), "c_mktsegment")
    files = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(body, "utf-8").alias("content"))
    return extract(files).select("path", "block_index", "kind", "text")


@Q.query()
def word_error_and_bleu(spark, sf_dir):
    """Of adjacent turns."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = Q.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("output"), F.lag("text").over(order).alias("truth")).where("truth is not null")
    return reachable(pairs).select("conv_id", "turn", C.wer_column("truth", "output").alias("wer"), C.bleu_column("truth", "output").alias("bleu"))


@Q.query()
def table_teds(spark, sf_dir):
    """Tables of regions against that of the region before in the alphabet."""
    from pyspark.sql import Window

    tables = Q.html_table(spark, sf_dir).withColumn("other", F.lag("html").over(Window.orderBy("r_name"))).where("other is not null")  # five rows
    return reachable(tables).select("r_name", C.teds_column("other", "html").alias("teds"))


@Q.query()
def page_reading_order(spark, sf_dir):
    """Parts as blocks on pages."""
    return L.order_pages(Q.part_boxes(spark, sf_dir), ["page"], "p_partkey")


@Q.query()
def detection_map(spark, sf_dir):
    """Average precision of parts' boxes against the same boxes moved a little, every seventh missing."""
    boxes = Q.part_boxes(spark, sf_dir).withColumn("label", F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")))
    b = F.col("bbox")
    found = boxes.where("p_partkey % 7 <> 0").select("page", "label", F.col("p_partkey").alias("det_id"), (F.col("p_partkey") * 37 % 101 / F.lit(100.0)).alias("score"), G.box(b["x"] + F.col("p_partkey") % 4, b["y"], b["width"], b["height"]).alias("bbox"))
    return L.mean_average_precision(boxes.select("page", "label", F.col("p_partkey").alias("truth_id"), "bbox"), found, "page", "label", (0.5, 0.75))
