"""Pieces shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where none is set, a temporary folder serves a local session, whose executors are this very process; on a cluster
    that is an error, as its executors could not see such a folder.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="loomline-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str, slice_rows: int = 1024
) -> DataFrame:
    """Arrow batches through make()(rows), at most slice_rows rows at a time.

    make runs once for each task, so that what it loads stays in that task.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                rows = list(zip(*(c.to_pylist() for c in part.columns)))
                if out := work(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                    )

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., bool]], slice_rows: int = 256) -> DataFrame:
    """The rows of df for which make()(values of columns) is true; its columns go through unchanged.

    A task turns slice_rows rows at a time into Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                values = [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
                yield part.filter(pa.array([bool(good(*v)) for v in zip(*values)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


#: Rows that `numbered` orders together.
PER_BUCKET = 500


def numbered(df: DataFrame, group: list[str], spread: Column, order: list[Column], buckets: Column, out: str) -> DataFrame:
    """df with out: 0, 1, 2, ... without gaps in each group, also where a group holds most rows.

    A row's group is dealt over `buckets` buckets (its rows by PER_BUCKET, say) by spread; the rows are numbered inside
    their bucket, and the bucket's start, a sum over the group's bucket counts, is added. There are as many starts as
    buckets, so that where groups are few the second join is small.
    """
    keys = [*group, "__bucket"]
    dealt = df.withColumn("__bucket", F.pmod(spread, buckets).cast("int"))
    inside = dealt.withColumn("__inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    starts = starts.select(*[F.col(k).alias(f"__s_{k}") for k in keys], "__start")
    on = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]
    joined = inside.join(starts, on).withColumn(out, (F.col("__start") + F.col("__inside")).cast("long"))
    return joined.select(*df.columns, out)


def dense_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with out: the row's place 0, 1, 2, ... in the order of all rows, by a distributed sort.

    The starts of the sorted ranges come from one count a range.
    """
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col("__p").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # n rows at most
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    placed = ranged.withColumn("__inside", inside).join(starts, F.col("__p") == F.col("__r"))
    return placed.withColumn(out, (F.col("__start") + F.col("__inside")).cast("long")).select(*df.columns, out)


#: Keys of a number and a small count up to which `tiles` broadcasts them.
FEW_KEYS = 100_000


def tiles(df: DataFrame, key: str, item: str, most: int, also: Column | None = None) -> DataFrame:
    """Rows of each key, dealt into tiles so that each two rows of a key meet in exactly one tile.

    A key of up to `most` rows is one tile. A larger one is split into chunks of about that size by a hash of
    item, and each two chunks make a tile; columns tile_i, tile_j name it and `chunk` the row's own chunk.
    Rows that are alone with their key are left out, and keys for which the aggregate `also` is false.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), (F.lit(True) if also is None else also).alias("__also"))
    sizes = sizes.filter("__n > 1 and __also")
    # cut: few sizes are broadcast, so that rows aren't shuffled by key; else the join has shuffles of its own and a large key can be split
    sizes = cut(sizes.select(key, F.ceil(F.col("__n") / F.lit(most)).cast("int").alias("__k")))
    few = sizes.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    rows = df.join(F.broadcast(sizes) if few else sizes, key).withColumn("chunk", F.pmod(F.xxhash64(item), F.col("__k")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("__k") - 1),
        lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")),
    )
    rows = rows.withColumn("__t", F.explode(others))
    return rows.select(*df.columns, "chunk", F.col("__t.i").alias("tile_i"), F.col("__t.j").alias("tile_j"))
