"""Operator 6, mixing sources to target weights.

Tokens (words) are summed by source, a target for each source follows from the weights, the repetition
rate is target / source tokens, and each document comes floor(rate) times plus once more with the
probability of the fraction, drawn from a hash of its doc_id.  DataFrame functions only.

Targets: sources share `share` times all tokens by weight; a source stops at `cap` times its own tokens
and the excess is shared by weight among the rest until none is above.  That is water filling: with
sources by tokens / weight ascending, the first ones stop and the others get the same level times weight.

Null source: a source of its own, last in order.  Null text: size 0.  Null doc_id: drawn by the text.
Repeated rows are drawn alike.  A source without words has target 0 and rate 0.  Empty table: empty result.
Empty texts have size 0 and may be taken; very long ones are counted whole by one expression in the JVM.
Columns of the input named size, target, copies or the like stay what they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts, word_count

SEED = "mix-42"


def before_each(rows: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds, for each name of `sums`, the sum of its column over all rows that come before in `order`.

    The rows are dealt out by ranges of the order and written, each range is summed, and a row adds what
    its own range and the ranges before hold: no task sees more than a range of rows, or one row a range.
    """
    parts = shuffle_parts(rows.sparkSession)
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("range").agg(*[F.sum(c).alias(f"{n}_of") for n, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    bases = per.select("range", *[F.coalesce(F.sum(f"{n}_of").over(earlier), F.lit(0)).alias(f"{n}_base") for n in sums])
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{n}_own") for n, c in sums.items()]).join(F.broadcast(bases), "range")
    return got.select(*rows.columns, *[(F.col(f"{n}_base") + F.col(f"{n}_own")).alias(n) for n in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row a source, as a written table, however many sources there are."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    per = before_each(per, [F.col("source").asc_nulls_last()], {"rank": "one"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    per = per.select("source", "source_size", weight.alias("weight")).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    per = materialize(before_each(per, [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"full_before": "full", "weight_before": "weight"}), "sources")
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    level = (F.lit(float(whole["size"] or 0) * share) - F.col("full_before")) / (F.lit(whole["weight"] or 0.0) - F.col("weight_before"))
    per = per.withColumn("level", level)
    # the level that holds is that of the first source that doesn't stop: from there on levels only fall
    goes_on = ~(F.col("level") * F.col("weight") > F.col("full"))
    held = per.agg(F.max(F.when(goes_on, F.col("level"))).alias("held")).first()["held"]
    target = F.col("full") if held is None else F.least(F.col("full"), F.lit(held) * F.col("weight"))
    return materialize(per.select("source", "source_size", target.alias("target")), "targets")


def draw(doc_id, text) -> F.col:
    """A number in [0, 1) from the document's id; from its text if it has none."""
    own = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(own, F.lit(":" + SEED)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def repeats(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies); with `carry` also `row`, the input's columns as a struct.

    The targets are a written table, so Spark knows its size: it is broadcast only below
    spark.sql.autoBroadcastJoinThreshold, and joined by source, hot sources split, above it."""
    text = F.col("text").cast("string")
    more = [F.struct("*").alias("row")] if carry else []
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), draw(F.col("doc_id"), text).alias("drawn"), *more)
    slim = docs.select(F.col("source").cast("string").alias("source"), word_count(text).alias("size"))
    targets = source_targets(slim, weights, share, cap).withColumnRenamed("source", "mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (F.col("drawn") < rate - F.floor(rate)).cast("long")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.floor(rate) + extra).alias("copies"), *(["row"] if carry else []))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of the input and no others,
    whatever they are called. Copies follow their document; a document that isn't taken is left out."""
    taken = repeats(docs, carry=True, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")).select("row.*")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    return repeats(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size,
    CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM per
), lev AS (
  SELECT source, source_size, weight,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM ranked
  WINDOW w AS (ORDER BY source_size / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT max(level) FILTER (WHERE NOT level * weight > source_size * 2.0::DOUBLE) AS held FROM lev
), target AS (
  SELECT source, source_size, CASE WHEN held IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, held * weight) END AS target FROM lev, held
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.digest) || ':mix-42'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
