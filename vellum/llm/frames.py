"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

#: Arrow batches as Spark cuts them by default are large for texts; executors hold several at a time.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(rows: DataFrame, f: Callable, schema) -> DataFrame:
    """mapInArrow over batches of a few megabytes, unless the session sets another size than Spark's 64 MB."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES, "67108864b") in ("67108864b", "64m"):
        conf.set(BATCH_BYTES, "4m")
    return rows.mapInArrow(f, schema)


Part = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]]


def append_columns(docs: DataFrame, result: list[tuple[str, pa.DataType]], part: Part) -> DataFrame:
    """Columns computed batch by batch beside those of `docs`.

    `part` yields each batch with the arrays of the result columns.  Raises
    ValueError when `docs` already has a result column.
    """
    clash = sorted({x.lower() for x in docs.columns} & {n.lower() for n, _ in result})
    if clash:
        raise ValueError(f"columns already present: {', '.join(clash)}")
    schema = StructType(docs.schema.fields + [StructField(n, from_arrow_type(kind)) for n, kind in result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in part(batches):
            arrays = [x if isinstance(x, pa.Array) else pa.array(np.asarray(x), kind) for x, (_, kind) in zip(columns, result, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(n for n, _ in result)])

    return batched(docs, run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing on a local master (tests on one machine) a temporary
    folder stands in; on a cluster it must be set.
    """
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def exists(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether the folder holds this table; any other fault in reading it is raised."""
    try:
        table(spark, sf_dir, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written to the shared folder (with these options) and read back, which cuts the lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more rows than this is hot; at most so many hot keys are broadcast, the hottest first.
HOT, MOST_HOT = 1000, 1 << 18


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys with more than HOT rows, of a table that has the number of rows of each."""
    return written(counted.where(F.col(n) > HOT).orderBy(F.desc(n)).limit(MOST_HOT).select(*keys), "hot-keys")


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join with `one`, which has a row a key: rows with a hot key meet a broadcast of these keys' rows, the others are shuffled."""
    if not hot.limit(1).count():
        return many.join(one, keys)
    apart = many.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(one.join(F.broadcast(hot), keys, "left_semi")), keys)
    return apart.unionByName(many.join(F.broadcast(hot), keys, "left_anti").join(one, keys))


def held_out(key: str, of: int, part: int) -> Column:
    """Whether crc32 of the identifier as text leaves the remainder `part`; a null identifier does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == part, F.lit(False))
