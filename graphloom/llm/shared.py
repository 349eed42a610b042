"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Location of the vocabulary files; callers may pass any other path.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.  Where that is unset, one is made only for a session on one machine; a cluster would lose it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The file and the row of a document, while it is on its way through an operator.
FILE, ROW = "__from_file", "__from_row"


def located(docs: DataFrame) -> DataFrame:
    """docs with FILE and ROW; what does not come straight from files is written first, under names that clash with nothing."""
    names = docs.columns
    if len(clean := [c for c in names if c not in (FILE, ROW)]) == len(names) and "_metadata" not in map(str.lower, names):
        try:
            return docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        except AnalysisException:
            pass
    held = written(docs.toDF(*(f"c{i}" for i in range(len(names)))))
    return held.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c in clean), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def input_bytes(df: DataFrame) -> int:
    """Size of a scan by its files, as the optimizer has it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def read_bytes(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        return f.readall()


def write_bytes(path: str, data: bytes) -> None:
    """Under another name first, then moved: a repeated task replaces a file by an equal one, never by half of one."""
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, at)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under those names: further columns, whatever they are called, are not read."""
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


SALTS = 16


def salted(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with `one` (a single row for each key) under SALTS keys for each, drawn from `by`: the rows of a hot key are not one task's."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return left.join(one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"]).drop("__salt")
