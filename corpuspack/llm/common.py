"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a cut table that may lie in one partition, or be sent to all tasks.
FEW = 10_000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the
    session is local (tests) a new temporary folder is taken; ``ValueError`` on a cluster.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor loses no work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame) -> tuple[DataFrame, bool]:
    """A cut table of few rows in one partition, so that sums and joins over it need no shuffle; a larger one as it is.  And whether it has few rows."""
    few = df.count() <= FEW
    return (df.coalesce(1) if few else df), few


def crc32_text(col: Column) -> Column:
    """Unsigned crc32 of the column's text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a document is kept out of training; a null id never is."""
    return F.coalesce(crc32_text(doc_id) % modulus == remainder, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_hot(entries: DataFrame, keys: list[str], item: str, block: int, at_least=None) -> DataFrame:
    """Deal the members of each bucket out to groups of at most two blocks.

    ``entries`` has one row for each member ``item`` of a bucket ``keys``.
    Buckets of one member go.  A bucket of up to ``block`` members is one
    group; a larger one is split by a hash of ``item`` into blocks, and each
    pair of blocks meets in one group, so that no task has to hold a hot
    bucket.  Adds ``bi``, ``bj`` (the group's blocks) and ``own`` (the row's):
    two rows of a group are to be compared if ``bi = bj`` or their ``own``
    differ, which happens once for every pair of members.

    ``at_least`` is a further condition on the bucket's aggregate ``n`` and on
    ``homes``, the number of rows whose column ``home`` is true, if there is one.
    """
    counts = [F.count(F.lit(1)).alias("n")]
    if "home" in entries.columns:
        counts.append(F.count_if("home").alias("homes"))
    sizes = entries.groupBy(*keys).agg(*counts).where("n >= 2")
    if at_least is not None:
        sizes = sizes.where(at_least)
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = entries.join(sizes.select(*keys, blocks.alias("blocks")), keys)
    met = met.withColumn("own", F.pmod(F.xxhash64(item), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(
        *entries.columns,
        F.least("own", "other").alias("bi"),
        F.greatest("own", "other").alias("bj"),
        "own",
    )


def sorted_runs(batches, keys: list[str]):
    """From Arrow batches sorted by ``keys``: tables of whole runs, each with the bounds of its runs.

    Yields ``(table, starts)`` where ``starts`` has the first row of each run and
    the number of rows at its end.  Only a run that isn't over yet is kept back.
    """
    import numpy as np
    import pyarrow as pa

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        starts = run_starts(table, keys)
        last = int(starts[-1])
        rest = table.slice(last)
        if last:
            yield table.slice(0, last), np.append(starts[:-1], last)
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        yield rest, np.append(run_starts(rest, keys), rest.num_rows)


def run_starts(table, keys: list[str]):
    """The first row of each run of equal keys."""
    import numpy as np

    new = np.ones(table.num_rows, dtype=bool)
    for i, key in enumerate(keys):
        column = table.column(key).to_numpy()
        differs = column[1:] != column[:-1]
        new[1:] = differs if i == 0 else new[1:] | differs
    return np.flatnonzero(new)


def merge_labels(labels, i, j) -> None:
    """Lower, in place, the labels of linked rows ``i`` and ``j`` to the least one of their component."""
    import numpy as np

    while len(i):
        low = np.minimum(labels[i], labels[j])
        open_ = (labels[i] != low) | (labels[j] != low)
        if not open_.any():
            return
        # the roots that stand above a lower label are tied to it as well
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]
