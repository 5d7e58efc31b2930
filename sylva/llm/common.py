"""What the operators of this subpackage share: safe column picking, shared storage, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target size of an Arrow batch sent to Python. A single longer row still travels whole.
ARROW_BATCH_BYTES = 2 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``df``, found by position.

    An exact match of the name wins over a match in another case; the first match wins over later
    ones. Any other columns may be there, also ones with clashing or repeated names.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    found = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not exact and not loose:
            raise ValueError(f"no column {name!r} among {df.columns}")
        found.append(F.col(f"c{(exact or loose)[0]}").alias(name))
    return plain.select(*found)


def pick_with_text(df: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """The kept columns and the text, which is sent once, with the text's place."""
    if text in keep:
        return pick(df, *keep), keep.index(text)
    return pick(df, *keep, text).toDF(*keep, "text" if "text" not in keep else "__text"), len(keep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a temporary one of a session that runs on this machine alone."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="sylva-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables that one operator writes into the shared folder, each removed when nothing needs it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.written: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back, which cuts its lineage."""
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove the tables of ``frames``, which ``cut`` returned, as what is made of them has been written."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for out, path in self.written:
            if any(out is x for x in frames):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        self.written = [x for x in self.written if not any(x[0] is y for y in frames)]

    def replaced(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The table of ``new``, which is made of ``old``; that of ``old`` goes."""
        out = self.cut(new)
        self.drop(old)
        return out

    def close(self, *kept: DataFrame) -> None:
        """Remove all tables but those of ``kept``, which the result reads."""
        self.drop(*[x for x, _ in self.written if not any(x is y for y in kept)])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage. The result reads it, so it stays."""
    return Scratch(df.sparkSession).cut(df)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that batches of long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null becomes an empty string."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups_of(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts of about ``limit`` bytes together; a longer text is alone."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def crc32_of_id(column: str | Column) -> Column:
    """crc32 of the decimal text of an id; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary"))


def concat_frames(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out
