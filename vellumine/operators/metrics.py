"""Text and order metrics: grouped multisets and built-in distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..shared import materialize, shuffle_parts
from ..workers import reachable


def token_overlap(pairs: DataFrame, key: str, truth: str, output: str, words=T.tokens) -> DataFrame:
    """(key, n_truth, n_output, n_both): multiset sizes and their intersection. Both texts of a pair are in
    one row, so nothing is shuffled: tokens are made in the JVM and counted a batch of rows at a time."""

    def counted(tokens: pa.Array, codes: np.ndarray, wide: int):
        row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        return np.unique(row * wide + codes, return_counts=True)

    def run(batches):
        for batch in batches:
            t, o = batch.column("t"), batch.column("o")
            coded = pa.concat_arrays([t.flatten(), o.flatten()]).dictionary_encode()
            codes, wide = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1
            n = len(t.flatten())
            (a, x), (b, y) = counted(t, codes[:n], wide), counted(o, codes[n:], wide)
            both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            shared = np.bincount(both // wide, np.minimum(x[i], y[j]), minlength=batch.num_rows).astype(np.int64)
            sizes = [pc.list_value_length(v).cast(pa.int64()) for v in (t, o)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *sizes, pa.array(shared)], names=[key, "n_truth", "n_output", "n_both"])

    none = F.array().cast("array<string>")
    slim = pairs.select(key, F.coalesce(words(F.col(truth)), none).alias("t"), F.coalesce(words(F.col(output)), none).alias("o"))
    schema = StructType([slim.schema[key], *[StructField(c, LongType()) for c in ("n_truth", "n_output", "n_both")]])
    return reachable(slim).mapInArrow(run, schema)


def coverage_scores(overlap: DataFrame, key: str) -> DataFrame:
    """token_coverage (nothing to cover: 1), spurious_rate (nothing produced: 0), token_f1 (no truth: null)."""
    t, o, b = F.col("n_truth"), F.col("n_output"), F.col("n_both")
    cover = F.when(t == 0, F.lit(1.0)).otherwise(b / F.greatest(t, F.lit(1)))
    spurious = F.when(o == 0, F.lit(0.0)).otherwise((o - b) / F.greatest(o, F.lit(1)))
    f1 = F.when(t == 0, F.lit(None).cast("double")).otherwise(2.0 * b / F.greatest(t + o, F.lit(1)))
    return overlap.select(key, cover.alias("token_coverage"), spurious.alias("spurious_rate"), f1.alias("token_f1"))


def char_error_rate(truth: Column, output: Column) -> Column:
    return F.when(F.length(truth) == 0, F.when(output == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, output) / F.greatest(F.length(truth), F.lit(1)))


def edit_similarity(truth: Column, output: Column) -> Column:
    longest = F.greatest(F.length(truth), F.length(output))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(truth, output) / F.greatest(longest, F.lit(1)))


def order_distance(ranks: DataFrame, key: str) -> DataFrame:
    """(key, n, ard): mean |p - g| over common ids, over their number."""
    return ranks.groupBy(key).agg(F.count("*").alias("n"), (F.sum(F.abs(F.col("p") - F.col("g"))) / F.count("*") / F.count("*")).alias("ard"))


def kendall(ranks: DataFrame, key: str) -> DataFrame:
    """(key, concordant, discordant, tau, normalized): tau-b of ranks p and g (whole numbers from 0), by key;
    a key with one item has tau 0.

    Discordant pairs are inversions, counted bit by bit: two ranks differ first at one bit, so in the order
    of g each 0 counts the 1s before it among ranks of the same leading bits. That is n log n, without
    pairs and within the JVM. Ties of g come with p rising, so that they count nowhere.
    """
    whole = Window.partitionBy(key)
    ranks = ranks.select(key, "p", "g").repartition(key)  # dealt out once: all below groups by key and more
    rows = ranks.select(key, F.col("p").cast("long").alias("p"), F.col("g").cast("long").alias("g")).withColumn("top", F.max("p").over(whole))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("top"), F.lit(1)))).cast("int"))
    bits = rows.select(key, "p", "g", F.explode(levels).alias("level"))
    lead = F.expr("shiftright(p, level + 1)")
    bits = bits.select(key, "g", "p", "level", lead.alias("lead"), F.expr("shiftright(p, level) & 1").alias("bit"))
    before = Window.partitionBy(key, "level", "lead").orderBy("g", "p").rowsBetween(Window.unboundedPreceding, -1)
    inversions = bits.withColumn("ones", F.sum("bit").over(before)).where("bit = 0").groupBy(key).agg(F.sum("ones").alias("discordant"))
    pairs = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) div 2"))
    tied = lambda *c: ranks.groupBy(key, *c).agg(F.count("*").alias("c")).groupBy(key)
    got = ranks.groupBy(key).agg(F.count("*").alias("n")).withColumn("n0", F.expr("n * (n - 1) div 2"))
    for name, cols in (("n1", ["p"]), ("n2", ["g"]), ("n3", ["p", "g"])):
        got = got.join(tied(*cols).agg(pairs("c").alias(name)), key)
    got = got.join(inversions, key, "left").withColumn("discordant", F.coalesce("discordant", F.lit(0)))
    got = got.withColumn("concordant", F.expr("n0 - n1 - n2 + n3 - discordant"))
    under = F.sqrt(((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2"))).cast("double"))
    got = got.withColumn("tau", F.when(under > 0, (F.col("concordant") - F.col("discordant")) / F.greatest(under, F.lit(1.0))).otherwise(F.lit(0.0)))
    return got.select(key, "concordant", "discordant", "tau", ((F.col("tau") + 1) / 2).alias("normalized"))


def precision_recall(scored: DataFrame, group: str | list[str], score: str, hit: str, ident: str | list[str]) -> DataFrame:
    """Running precision and recall in score order, with the precision envelope, by group; ties go by ident.

    The rows are dealt out by ranges of the order and written, so a group of any size is many tasks' work.
    A row adds what its range has up to it to what the ranges before have; the envelope, the other way round.
    """
    by, ties = [group] if isinstance(group, str) else list(group), [ident] if isinstance(ident, str) else list(ident)
    order = [F.desc(score), *ties]
    dealt = materialize(scored.repartitionByRange(shuffle_parts(scored.sparkSession), *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    upto = lambda *c: Window.partitionBy("_range", *by).orderBy(*c).rowsBetween(Window.unboundedPreceding, 0)
    past = lambda c: Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  over one row a range

    def with_each_range(rows: DataFrame, per: DataFrame) -> DataFrame:
        per = per.withColumnsRenamed({c: f"_of_{c}" for c in ["_range", *by]})
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
        return rows.join(per, [F.col("_range") == F.col("_of__range"), *same]).drop(*[f"_of_{c}" for c in ["_range", *by]])

    per = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.sum(hit).alias("_tp"))
    per = per.select("_range", *by, F.coalesce(F.sum("_n").over(past("_range")), F.lit(0)).alias("_n"), F.sum("_tp").over(past("_range")).alias("_tp"), F.sum("_tp").over(Window.partitionBy(*by)).alias("positives"))
    own = F.sum(hit).over(upto(*order))
    rows = with_each_range(dealt, per).withColumn("rank", F.col("_n") + F.row_number().over(upto(*order))).withColumn("tp", F.coalesce(F.col("_tp") + own, own, "_tp")).drop("_n", "_tp")
    rows = rows.withColumn("precision", F.col("tp") / F.col("rank")).withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.greatest("positives", F.lit(1))).otherwise(F.lit(0.0)))
    later = rows.groupBy("_range", *by).agg(F.max("precision").alias("_most"))
    later = later.select("_range", *by, F.max("_most").over(past(F.desc("_range"))).alias("_later"))
    envelope = F.greatest(F.max("precision").over(upto(F.desc("rank"))), "_later")
    return with_each_range(rows, later).withColumn("envelope", envelope).drop("_range", "_later")
