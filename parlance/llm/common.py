"""What the operators share: tables, checkpoints, words."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, its lineage cut by files in the shared checkpoint folder.

    The folder is what the cluster names in spark.checkpoint.dir. Where that is
    unset (a single machine, as in tests) a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch: a thousand documents are some megabytes, in the JVM and in the Python worker alike.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, in batches of BATCH_ROWS at most unless the session already asks for fewer."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES)) <= BATCH_ROWS:
        conf.set(_BATCHES, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no column of frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key with more than this share of all rows, one in so many, is dealt over several tasks.
HEAVY = 1000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """The inner join of many with one, which has a row for a key at most; frequent keys are dealt over tasks.

    Keys of more than one in heavy of all rows of many are counted first, with
    partial sums before the shuffle. There are fewer than heavy of them, so their
    table may be broadcast. The rows of such a key are split into parts of that
    many rows, and its row of one is repeated for each. many is read three times,
    so it should be checkpointed. Null keys match nothing.
    """
    total = many.count()
    n, part = fresh("_parts", many, one), fresh("_part", many, one)
    hot = many.groupBy(*keys).agg(F.count("*").alias(n)).filter(F.col(n) * heavy > total)
    hot = checkpointed(hot.withColumn(n, F.ceil(F.col(n) * heavy / max(1, total)).cast("int")))
    if hot.isEmpty():
        return many.join(one, keys)
    parts = F.coalesce(n, F.lit(1))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn(part, F.pmod(F.xxhash64(*many.columns), parts).cast("int"))
    copies = one.join(F.broadcast(hot), keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop(n).join(copies.drop(n), [*keys, part]).drop(part)
