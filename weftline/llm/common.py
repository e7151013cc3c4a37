"""Session settings, intermediate tables and batch plumbing shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch between the JVM and Python. Texts are long, so few rows.
BATCH_ROWS = 512
NEAR_DUPLICATE_WORDS = 5
NEAR_DUPLICATE_SIMILARITY = 0.8


def configure(spark: SparkSession) -> SparkSession:
    """Bounds Python workers' memory: small Arrow batches, whatever the partition's size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one, but only if all run on this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.weftline.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.weftline.scratch", folder)
    return folder


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch; it gives one or more dicts of columns, in the schema's types."""
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(batch)
            for cols in [made] if isinstance(made, dict) else made or ():
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in ((cols[f.name], f.type) for f in kinds)]
                out = pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, kinds, strict=True)], schema=kinds)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return simple[kind.simpleString()]


def binaries(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column over adjacent ranges of one buffer, which has less than 2 GB as each row of Spark has."""
    if len(ends) and ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one column of a batch")
    offsets = np.concatenate([begins[:1], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """List column: ``counts`` values for each row, in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def held_out(doc_id, modulus: int) -> F.Column:
    """The contract's split: crc32 of the id as text leaves remainder 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def row_key(id_col: str, text_col: str) -> F.Column:
    """Equal for rows of equal id and text only (but for 64-bit collisions between rows of one id)."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
