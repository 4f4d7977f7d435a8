"""Shared pieces of the training-data operators: storage, batching, hashing and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python operator holds at once; a longer single text forms a step of its own.
SLICE_BYTES = 2_000_000
#: Rows of an Arrow batch between the JVM and Python, in place of Spark's 10,000: whole texts are wide rows.
BATCH_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine takes a temporary folder; a cluster, whose machines share none, is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _local_dir()
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="veriloom-")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts its lineage.

    What the write shuffled isn't needed afterwards: collecting the driver's garbage lets Spark's cleaner delete
    those files now rather than at its next periodic collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veriloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


#: Groups of more rows than this, and than a thousandth of all rows, are broadcast: there are a thousand at most.
HEAVY_ROWS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """``rows`` joined on ``keys`` with one row for each group; no task gets all rows of a large group.

    ``size`` names the column of ``groups`` that counts a group's rows, ``n_rows`` all rows.
    """
    large = F.col(size) > max(HEAVY_ROWS, n_rows // 1_000)
    heavy = F.broadcast(groups.where(large))
    return rows.join(heavy, keys).unionByName(rows.join(F.broadcast(groups.where(large).select(*keys)), keys, "left_anti").join(groups.where(~large), keys))


def keep_rows(docs: DataFrame, decided: DataFrame, key_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay.

    ``decided`` has doc_id, key and kept for each row of docs; of rows that share id and key one stays if they are
    kept.  ``key_of`` adds the key to rows (doc_id, text); only ids that repeat need it.
    """
    counts = stash(decided.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.sum(F.col("kept").cast("int")).alias("_kept")).where("_kept > 0"), "kept-ids")
    # a merge at every size: whether few enough ids stay to be broadcast shall not change how rows move
    once = docs.join(counts.where("_rows = 1").hint("merge"), docs["doc_id"].cast("long").eqNullSafe(counts["_id"]), "left_semi")
    if not counts.where("_rows > 1").limit(1).count():
        return once
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    again = wrapped.join(counts.where("_rows > 1"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    keys = decided.where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    keyed = key_of(again.select("doc_id", "text").distinct()).select("doc_id", "text", "key")
    chosen = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).groupBy("doc_id", "key").agg(F.min("text").alias("text"))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    one = again.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))).groupBy("doc_id", "text").agg(F.first("row").alias("row"))
    return once.unionByName(one.select("row.*"))


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def narrow_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now cuts Arrow batches at ``BATCH_ROWS`` unless its setting was changed before."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name, "10000")) == 10_000:
        conf.set(name, BATCH_ROWS)
    return df


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to slices of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    return narrow_batches(df).mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that other columns can't clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold_of(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def mix(x: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: Bytes of the folded word form: ASCII letters in lower case, digits and all beyond ASCII stay, the rest are spaces.
FOLDED = bytes(c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def folded(column: pa.Array) -> pa.Array:
    """The texts with every byte replaced by ``FOLDED``; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    held = (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None and len(column) else b"").translate(FOLDED)
    return pa.StringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(held))


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every word of every text, and where each text's words start (one entry more than texts).

    Words are runs of characters other than space and U+0009 to U+000D.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return (flat, starts) if before[-1] == len(flat) else (flat.filter(full), before[starts])


_SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and where each text's words start (one entry more than texts).

    Words are as in ``split_words``.  The hash adds up a mixed value for each byte at its place in the word.
    """
    column = pc.fill_null(column.cast(pa.string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SEPARATES[held]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    starts = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(held), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(held)]])))
    table = _byte_table()
    near = place < len(table) // 256
    value = table[(np.where(near, place, 0) << 8) | held] if near.all() else np.where(near, table[(np.where(near, place, 0) << 8) | held], mix((place << 8) | held))
    value[~inside] = 0
    return mix(np.add.reduceat(value, at)), starts


@cache
def _byte_table() -> np.ndarray:
    return mix(np.arange(64 * 256))


def labels_of(labels: DataFrame, label: str, id_col: str, usable: Column) -> DataFrame:
    """(doc_id, y): every labelled document of the training folds."""
    return labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(usable).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def bounded_labels(labels: DataFrame, label: str, id_col: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, y): at most about ``most`` labelled documents of the training folds, picked by a hash of the id."""
    rows = labels_of(labels, label, id_col, usable)
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return rows


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last coefficient is the constant (for x with a column of ones)."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
