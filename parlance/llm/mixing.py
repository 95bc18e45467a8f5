"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token target (see `targets`). Complete epochs of the source
come first; what is left of its target is filled by a weighted sample without
replacement: each document draws the key -ln(u) / weight, u being a keyed hash
of its id, and documents are taken in the order of their keys while their prefix
sum is nearest the rest of the budget.

The prefix sum of a source is never computed in one task. Keys are mapped
monotonically to buckets whose expected size is bounded, bucket totals are
summed before they are shuffled, and only the one bucket per source in which the
budget ends is sorted by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, word_count

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Rows that a bucket holds at most, in expectation.
BUCKET_ROWS = 4096
#: Tables with a row per source are broadcast up to so many sources, some 10 MB; with more they are joined by shuffles.
BROADCAST_SOURCES = 100_000


def uniform(seed: str, *keys: Column) -> Column:
    """A double in (0, 1) from 52 bits of the MD5 of seed and keys (null: as '')."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Adds `target` (double) to a table of one row per source.

    sizes has source_null, source and source_size. Sources in code point order,
    null last, take the weights in turn. The budget is share times all sizes;
    target = min(weight * level, most * size), with the one level at which the
    targets add up to the budget, which is where repeated resharing of the
    excess ends. With sources sorted by size / weight, the level is the largest
    of (budget left by those before) / (weight of the others).
    The table has one row per source, so it may be ordered in one task.
    """
    by_name = Window.orderBy("source_null", "source")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("source_weight"), "source_null", "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    budget = share * F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("source_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.withColumn("source_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("level", (budget - most * before) / others)
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .withColumn("target", F.least(F.col("source_weight") * F.col("level"), most * F.col("source_size")))
        .drop("level", "source_weight")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    size: Column | None = None,
    source_col: str = "source",
    weight: Column | None = None,
    weights=SOURCE_WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    tie: Column | None = None,
    seed: str = "mix-1",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, epochs, sampled, taken.

    size: tokens of a document; by default the words of its column text.
    weight: quality weight of a document, above 0; null or not above 0 counts as 1.
    taken = size * (epochs + 1 if sampled). Null or empty text: size 0, taken 0.
    tie: what tells rows of one id apart, the MD5 of the text by default.
    A null source is a source of its own, the last. Every row has a draw of its own:
    rows of one id, null too, draw by their tie as well, and rows equal in that by
    their number among such rows, whose order makes no difference. An empty table
    gives an empty result. Other columns of docs are not looked at, whatever their
    names.
    """
    weight = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(1.0)
    tie = F.md5("text") if tie is None else tie
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().alias("source_null"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        (word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        weight.alias("w"),
        F.coalesce(tie.cast("string"), F.lit("")).alias("tie"),
    )
    slim = checkpointed(_numbered(checkpointed(rows)).withColumn("key", -F.log(uniform(seed, F.col("doc_id"), F.col("tie"), F.col("number"))) / F.col("w")))
    name = ["source_null", "source"]
    sources = slim.groupBy(*name).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("w").alias("least_w"), F.max("w").alias("most_w")
    )
    sources = checkpointed(
        targets(sources, weights, share, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") * F.col("most_w") / F.col("least_w") / bucket_rows).cast("long"))
    )
    few = sources.count() <= BROADCAST_SOURCES

    def per_source(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    #: 1 - exp(-key * least weight) is monotone in the key and has a density of at most most_w / least_w.
    place = 1.0 - F.exp(-F.col("key") * F.col("least_w"))
    placed = slim.join(per_source(sources), name).withColumn("bucket", F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1))
    along = Window.partitionBy(*name).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = (
        placed.groupBy(*name, "bucket", "rest")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("upto", F.sum("bucket_size").over(along))
        .filter(F.col("upto") > F.col("rest"))
        .groupBy(*name)
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before")), "bucket").alias("border"))
        .select(*name, F.col("border.bucket").alias("border_bucket"), F.col("border.before").alias("before"))
    )
    border = checkpointed(border)
    order = ["key", "doc_id", "tie", "number", "size"]
    inside = Window.partitionBy(*name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = (
        placed.join(per_source(border), name)
        .filter(F.col("bucket") == F.col("border_bucket"))
        .withColumn("prefix", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .filter(2 * F.col("prefix") + F.col("size") <= 2 * F.col("rest"))
        .groupBy(*name)
        .agg(F.max(F.struct(*order)).alias("last_taken"))
    )
    ends = sources.join(border, name, "left").join(last, name, "left")
    ends = ends.select(*name, "source_size", "target", "epochs", "rest", "buckets", "least_w", "border_bucket", "last_taken")
    bucket = F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1)
    sampled = F.when(
        F.col("border_bucket").isNull(), F.col("rest") > 0
    ).otherwise(
        (bucket < F.col("border_bucket"))
        | ((bucket == F.col("border_bucket")) & F.coalesce(F.struct(*order) <= F.col("last_taken"), F.lit(False)))
    )
    return slim.join(per_source(ends), name).select(
        "doc_id",
        F.when(~F.col("source_null"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        "epochs",
        sampled.alias("sampled"),
        (F.col("size") * (F.col("epochs") + sampled.cast("long"))).alias("taken"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with number, which counts those equal in all columns, from 0.

    Equal rows become one with a count, by partial counts before the shuffle, and
    then rows again, in blocks of a bounded size that are dealt over tasks.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET_ROWS))))
    if not counted.filter(F.col("n") > BUCKET_ROWS).isEmpty():
        blocks = blocks.repartition(*rows.columns, "block")
    first, last = F.col("block") * BUCKET_ROWS, F.least("n", (F.col("block") + 1) * BUCKET_ROWS) - 1
    return blocks.withColumn("number", F.explode(F.sequence(first, last))).drop("n", "block")


#: Weight of a document by its quality label; 1 without one.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
#: Rows without an id are joined as if they had one of so many keys.
NULL_KEYS = 1024


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, _size, _tie, quality_weight) of docs; of several labels of a document the best counts.

    _size counts the words of the text, _tie is its MD5. Rows without an id have no
    label, weigh 1 and are dealt over tasks.
    """
    best = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.lit(1.0)
    for quality, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("_quality") == quality, value).otherwise(weight)
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.md5("text").alias("_tie"))
    dealt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("_tie"), F.lit(NULL_KEYS))).otherwise(F.lit(0))
    joined = slim.withColumn("_dealt", dealt).join(best.withColumn("_dealt", F.lit(0).cast("long")), ["doc_id", "_dealt"], "left")
    return joined.withColumn("quality_weight", weight).drop("_quality", "_dealt")
