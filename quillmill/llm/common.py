"""What the training-data operators share: sessions, shared storage, word rules."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, as a Java or Python character class.
GAP = r"[\x20\x09-\x0D]"

_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound an Arrow batch in rows and bytes."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local[...] session without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _scratch:
        folder = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _scratch[key] = f"file://{folder}"
    return _scratch[key]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Losing an executor then costs only what had not been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the stored tables that ``frames`` read.  Nothing may read them any more; what does not come from ``stored`` is left alone."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("quillmill-"):
                path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are done, which it does once the driver has collected what refers to them.

    The threads that listen to a session refer to the query that ended last until they hear of another one.
    """
    spark.sql("select 1").collect()
    time.sleep(0.1)
    spark.sparkContext._jvm.java.lang.System.gc()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text):
    """Array of the words of a text column; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP + "+"), "")


def bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n: the folds of the learning operators."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(n)


#: Of the map of ids that ``sifted`` broadcasts, as at most BITS / 64 longs.
BITS = 1 << 23


def sifted(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows whose ``column`` is surely not among that of ``ids``, and all others.

    Each id sets a bit of a map of bounded size, so that rows are told apart where they are read. The others, which are those of
    the ids and those that share a bit with one, are still to be joined with the ids; only they are shuffled for it.
    """
    bit = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.select(F.shiftright(bit, 6).alias("_word"), flag.alias("_flag")).groupBy("_word").agg(F.bit_or("_flag").alias("_flags"))
    marked = rows.join(F.broadcast(words), F.shiftright(bit, 6) == F.col("_word"), "left")
    hit = F.coalesce(F.col("_flags").bitwiseAND(flag) != 0, F.lit(False))
    return marked.filter(~hit).select(*rows.columns), marked.filter(hit).select(*rows.columns)


def whole_rows(docs: DataFrame) -> DataFrame:
    """``k`` (doc_id), ``t`` (text) and ``row`` (all columns): names that joins can add to without a clash."""
    return docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.struct(*docs.columns).alias("row"))


def with_text(rows: DataFrame, schema, text) -> DataFrame:
    """The columns of ``schema`` again from ``row``, with a new text; ``n_chars``, where there is one, follows it."""
    changed = ~F.col("t").eqNullSafe(F.col("new"))
    out = []
    for f in schema.fields:
        old = F.col(f"row.`{f.name}`")
        if f.name == "text":
            old = F.col("new")
        elif f.name == "n_chars":
            old = F.when(changed, F.length("new").cast(f.dataType)).otherwise(old)
        out.append(old.alias(f.name))
    return rows.withColumn("new", text).select(*out)


class Recent(dict):
    """A memo bounded in entries and bytes: when it is full, its entries become the old ones, which are looked up once more before they go.

    What is known of keys over ``LONGEST`` bytes is kept until the next batch only.
    """

    LONGEST = 64

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.passing = limit, {}, {}

    def __missing__(self, key):
        return self.passing[key]

    def keep(self, key, value) -> None:
        (self.passing if len(key) > self.LONGEST else self).__setitem__(key, value)

    def turn(self) -> None:
        """Between batches: make room."""
        self.passing.clear()
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, keys) -> list:
        """The keys that are not known; known old ones are taken over."""
        out, old = [], self.old
        for k in set(itertools.chain.from_iterable(keys)):
            if k in self:
                continue
            found = old.get(k)
            if found is None:
                out.append(k)
            else:
                self[k] = found
        return out
