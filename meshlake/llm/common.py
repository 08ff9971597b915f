"""What the operators of this subpackage share: inputs, written tables, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textnum import release

#: The white space that separates words.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Batches of texts and packed rows between Spark and Python: 1000 rows or 16 MB.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: A step's shuffle files go with it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may lack it; it then gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="meshlake-")
    return shared_dir.own


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for a while; the caller's come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no more than the
    step at hand and no plan is computed twice. Shuffle files of a step are dropped once
    its table is written. Tables that no later step reads are dropped with ``drop`` or ``keep``; those that
    a returned DataFrame reads stay, until ``release`` drops them for a caller that has written the result."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        Scratch.made.append(self)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.append(name)
        with settings(self.spark, **{_CLEANUP: "true"}, **_BATCHES):
            out = df.write.option("compression", compression)
            (out.partitionBy(partition_by) if partition_by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)
            self.names.remove(name)

    @staticmethod
    def release(since: int) -> None:
        """Drop all tables of those made since ``len(Scratch.made)`` was ``since``."""
        for one in Scratch.made[since:]:
            one.drop()
        del Scratch.made[since:]

    def drop(self, name: str = "") -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, least: int = 1) -> int:
    """The number of shuffle partitions that the session sets."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def by_bytes(df: DataFrame, each: int) -> int:
    """How many parts of ``each`` bytes a scanned table has by its files' size; 0 where that isn't known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // each) if size < 1 << 56 else 0


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every end of the edges ``(a, b)``: the smallest node reachable.

    Contraction: each round every node hooks to its smallest neighbour or itself, hooks are followed to
    their ends by doubling, edges are mapped to the ends, and loops and repeats go. A node that nobody hooks to and
    that hooks to nobody lies, in the next round, beside a smaller one and hooks to that, so two rounds halve the
    nodes at least: rounds grow with the logarithm of the nodes and doublings with that of the longest chain,
    whatever the labels. Only minima are aggregated (partial sums first, so a hub that a third of the
    edges share is no large group); joins read written tables, so adaptive execution may split hot keys. Hooks of
    all rounds are then composed from the last to the first."""
    live = scratch.write(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0"
    )
    hooks, k = [], 0
    while not live.isEmpty():
        k += 1
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        own = f"{name}-h{k}"
        hook = scratch.write(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")), own)
        doubled = 0
        while True:
            inner = hook.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("up2"))
            if hook.where("node <> up").join(inner, "up", "left_semi").isEmpty():
                break
            doubled += 1
            further = scratch.write(hook.join(inner, "up", "left").select("node", F.coalesce("up2", "up").alias("up")), f"{name}-h{k}-{doubled}")
            scratch.drop(own)
            hook, own = further, f"{name}-h{k}-{doubled}"
        moved = hook.where("node <> up")
        ma, mb = moved.select(F.col("node").alias("a"), F.col("up").alias("a2")), moved.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        a, b = F.coalesce("a2", "a"), F.coalesce("b2", "b")
        mapped = live.join(ma, "a", "left").join(mb, "b", "left").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        live = scratch.write(mapped.where("a <> b").distinct(), f"{name}-e{k}")
        scratch.drop(f"{name}-e{k - 1}")
        hooks.append((hook, own))
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    out, last = hooks[-1][0].select("node", F.col("up").alias("component")), hooks[-1][1]
    for i, (hook, own) in reversed(list(enumerate(hooks[:-1]))):
        up = out.select(F.col("node").alias("up"), "component")
        out = scratch.write(hook.join(up, "up", "left").select("node", F.coalesce("component", "up").alias("component")), f"{name}-c{i}")
        scratch.drop(own), scratch.drop(last)
        last = f"{name}-c{i}"
    return out


#: Bits of an id filter: 16 an id, from 128 kB up to 128 MB, which is what a task ever holds of it.
LEAST_BITS, MOST_BITS = 20, 30


def maybe_in(ids: DataFrame, column: str = "doc_id"):
    """A filter for rows whose id may be among ``ids``: a bitmap of hashed ids, built by partial
    aggregation and sized by their number. It keeps all that are, and some that aren't, so an exact join must follow;
    what it saves is to shuffle the rest. Beyond some 10^9 ids it fills: it then loses its effect, not its rightness."""
    import numpy as np
    import pyarrow as pa

    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    got: pa.Table = words.toArrow()  # at most bits / 64 rows
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(hashed):  # pandas Series in, pandas Series out
        b = hashed.to_numpy()
        import pandas as pd

        return pd.Series(shared.value[b >> 6] >> (b & 63) & 1 == 1)

    return test(bit)


#: Rows that a row operator holds beside its batch.
SLICE = 256


def filter_texts(docs: DataFrame, good) -> DataFrame:
    """The rows for whose texts ``good(list of texts)`` is true, with all their columns, where they are read."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                yield part.filter(pa.array(good(part.column(at).to_pylist()), pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def map_texts(docs: DataFrame, change) -> DataFrame:
    """The rows with texts ``change(text)``, nulls kept; ``n_chars``, where there is one, is counted anew."""
    import pyarrow as pa

    names = docs.columns

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                texts = [t if t is None else change(t) for t in part.column(names.index("text")).to_pylist()]
                columns = list(part.columns)
                columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([t if t is None else len(t) for t in texts], columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        release()

    return docs.mapInArrow(run, docs.schema)
