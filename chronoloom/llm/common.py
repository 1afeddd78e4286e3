"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import ship

#: Frequent function words of the supported languages (fixed values).
FUNCTION_WORDS = (
    "the and of to in is that it for with as by this are be on or at from not was "
    "le la les de des du et un une en que qui pour par dans sur au il elle est "
    "der die das und ein eine zu mit den von dem sich auf ist nicht an im es für auch als "
    "el los las y una por con del se para no lo su al como más o"
).split()

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/chronoloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; ``free`` deletes it."""
    path = new_path(df.sparkSession, name)
    write_freeing(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once nothing that is still to run reads it."""
    for df in written:
        drop_path(df.sparkSession, df.scratch_path)


def write_freeing(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet and drop the shuffle files that this took."""
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by this package."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(column: str = "text"):
    """The text, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_blocks(batch, sizes, most: int):
    """Slices of an Arrow batch, in order, each of at most ``most`` bytes of text or one row."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first, len(sizes) - first)


def map_texts(df: DataFrame, carry: list[str], made: str, factory, text: str = "text", block_bytes: int = 8 << 20, keep=None) -> DataFrame:
    """Add columns computed from whole texts, a block of texts at a time, without a shuffle.

    ``factory()`` runs once a task and returns ``fn(list[bytes]) -> dict[column, list]``.
    ``made`` is the DDL of the new columns, which replace carried columns of their names.
    ``keep`` names a boolean made column: rows where it is false go, and so does it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    new = StructType.fromDDL(made)
    carry = [c for c in carry if c not in new.fieldNames()]
    body = F.col(text) if dict(df.dtypes)[text] == "binary" else text_or_empty(text).cast("binary")
    d = df.select(*carry, body.alias("__text"))
    schema = StructType([*d.schema.fields[:-1], *[f for f in new.fields if f.name != keep]])
    types = to_arrow_schema(new)

    def run(batches):
        fn = factory()
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            for block in in_blocks(batch, [len(x) for x in body.to_pylist()], block_bytes):
                out = fn(block.column(block.num_columns - 1).to_pylist())
                columns = [block.column(i) for i in range(len(carry))]
                names = list(carry)
                for f in types:
                    if f.name != keep:
                        columns.append(pa.array(out[f.name], f.type))
                        names.append(f.name)
                made_batch = pa.RecordBatch.from_arrays(columns, names)
                yield made_batch.filter(pa.array(out[keep], pa.bool_())) if keep else made_batch

    return d.mapInArrow(run, schema)
