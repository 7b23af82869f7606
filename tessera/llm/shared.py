"""Small helpers of the training-data operators: tables, shared folder, empties."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none and runs on one machine, as in tests, a
    temporary folder is made and set for this session; on a cluster it has to
    name one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessera.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the
    table, and a column that several later steps use is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text"):
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def worker_state(name: str, make):
    """An object that a Python worker keeps between its tasks, such as a loaded tokenizer.

    Functions reach the workers by value, so that a module's own globals start
    anew in each task; a small module in ``sys.modules`` outlives them.
    """
    import sys
    import types

    held = sys.modules.setdefault("tessera_worker_state", types.ModuleType("tessera_worker_state"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def give_back_memory() -> None:
    """Return what Arrow's pool and the C library keep for later to the system, at the end of a task whose worker lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever extra columns it brings."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(batches, column: int, limit: int = 4 << 20):
    """Slices of Arrow batches with about ``limit`` bytes in one text or binary column, so that Python objects stay few."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def with_columns_from(df: DataFrame, column: str, make, fields: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """``df`` with new columns that a function makes from one text column, batch by batch.

    ``make()`` is called once in each task and gives a function from a list of
    texts (null as '') to a list of Arrow arrays. Returns the frame and the names
    of the new columns, which differ from ``fields`` where those clash.
    """
    import pyarrow as pa

    names = fresh(df, *[f for f, _ in fields])
    at = df.columns.index(column)
    kinds = ", ".join(f"`{c}` {t.dataType.simpleString()}" for c, t in zip(df.columns, df.schema, strict=True))
    schema = ", ".join([kinds, *(f"`{n}` {t}" for n, (_, t) in zip(names, fields, strict=True))])

    def run(batches):
        function = make()
        for batch in small_batches(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(texts)], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema), names
