"""Helpers that the training-data operators share: shared storage, samples, row ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship

#: What a hash sample takes the remainder by; a sample is never finer than one in so many rows.
SAMPLE_STEPS = 1 << 24


#: Bytes of words as themselves, A to Z in lower case; all else parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Folders that `written` has made.
_MADE: list[str] = []


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: digits, letters in lower case and all beyond ASCII; null has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing and Spark runs in one local JVM is a
    temporary folder made and set; on a cluster a missing setting is an error,
    since a machine-local folder would lose results with the machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    It cuts the lineage, survives lost executors, and gives later plans real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables ``written`` has made and ``swept`` has not deleted."""
    return len(_MADE)


def swept(spark: SparkSession, since: int) -> None:
    """Deletes the tables that ``written`` has made since there were ``since``; for use once nothing reads them any more."""
    while len(_MADE) > since:
        removed(spark, _MADE.pop())


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores put before it until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_sample(df: DataFrame, key: Column, rows: int, bound: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, chosen by a hash of ``key``: the same on each run."""
    if rows <= bound:
        return df
    step = max(1, int(SAMPLE_STEPS * bound / rows))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(SAMPLE_STEPS)) < step)


def hash_sample_by(df: DataFrame, key: Column, by: str, sizes: dict[str, int], bound: int) -> DataFrame:
    """About ``bound`` rows of each value of ``by``, chosen like those of ``hash_sample`` in one pass; ``sizes`` has the rows of each value."""
    steps = {v: SAMPLE_STEPS if n <= bound else max(1, int(SAMPLE_STEPS * bound / n)) for v, n in sizes.items()}
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in steps.items() for x in kv)), F.col(by))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(SAMPLE_STEPS)) < own)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def by_row(df: DataFrame, columns: list[str], schema: str, f: Callable[[dict[str, list]], dict[str, list]], most: int = 16 << 20) -> DataFrame:
    """Each Arrow batch of ``columns`` as lists through ``f``, which returns lists for ``schema``.

    The work stays in the scan's own tasks: no shuffle, one batch in memory,
    of which ``f`` gets about ``most`` bytes.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most):
                got = f({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows, so that a piece holds about ``most`` bytes, or one row."""
    each = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, most // each)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def with_text_verdict(df: DataFrame, added: str, f: Callable[[list], dict[str, list]], text: str = "text") -> DataFrame:
    """All columns of ``df`` plus those of the schema ``added``, computed from ``text`` in the same task."""
    ship(df.sparkSession)
    more = df.sparkSession.createDataFrame([], added).schema
    schema = type(df.schema)([*df.schema.fields, *more.fields])
    arrow, at = to_arrow_schema(more), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                got = f(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[x.name], x.type) for x in arrow)], names=[*part.schema.names, *arrow.names])

    return df.mapInArrow(run, schema)
