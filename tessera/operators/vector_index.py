"""A vector index: cells around trained centres, probed by partition pruning, distances exact.

Centres come from Spark's k-means (cosine) on at most ``SAMPLE`` vectors for each
cell, chosen by a hash of the id; every vector is then put into the cell of its
nearest centre, and cells are partitions of the stored table. A search compares the
query with the centres, opens the nearest cells only, filters them by access and
ranks what is left by the exact distance. With all cells the answer is that of a scan.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import acl, vectors
from tessera.sources.generations import Generations

#: Vectors for training, for each cell.
SAMPLE = 256
#: Queries and vectors of a cell that one task compares.
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 4096, 16384


def _directed(rows: DataFrame) -> DataFrame:
    """Rows whose vector has a direction; the others have no distance to anything."""
    e = F.col("embedding")
    return rows.where(e.isNotNull() & (vectors.dot(e, e) > 0))


class VectorIndex:
    """Vectors (id, source_id, embedding) by cell, and the centres of the cells, in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = Generations(spark, f"{self.path}/cells", "id long, source_id string, embedding array<float>")

    def train(self, rows: DataFrame, cells: int, rounds: int = 10, seed: int = 7, sample: int = SAMPLE) -> None:
        """Find and store the centres; fewer than ``cells`` where there are fewer directions."""
        known = _directed(rows).select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        some = known.orderBy(F.xxhash64(F.lit(seed).cast("long"), "id")).limit(sample * cells)
        model = KMeans(k=cells, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(some)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(centres, "id int, embedding array<double>").coalesce(1).write.parquet(f"{self.path}/centres")

    def centres(self) -> DataFrame:
        """id and embedding of each cell's centre: as many rows as cells."""
        return self.spark.read.schema("id int, embedding array<double>").parquet(f"{self.path}/centres")

    def _placed(self, rows: DataFrame, probes: int = 1) -> DataFrame:
        """``rows`` with ``part``, the ids of the nearest cells, and their order ``probe``; a row for each cell."""
        import numpy as np
        import pyarrow as pa

        held = self.centres().orderBy("id").collect()  # bounded by the number of cells
        ids, centres = np.array([r["id"] for r in held], np.int32), np.array([r["embedding"] for r in held])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        n = min(probes, len(ids))
        at, names = rows.columns.index("embedding"), [*rows.columns, "part", "probe"]

        def place(batches):
            for batch in batches:
                for begin in range(0, batch.num_rows, 4096):
                    some = batch.slice(begin, 4096)
                    e = some.column(at)
                    x = e.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(some.num_rows, -1)
                    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
                    taken = some.take(pa.array(np.repeat(np.arange(some.num_rows), n)))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[near].ravel()), pa.array(np.tile(np.arange(n, dtype=np.int32), some.num_rows))], names)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(place, f"{kinds}, part int, probe int")

    def add(self, rows: DataFrame) -> int:
        """Put more vectors (id, source_id, embedding) into their cells; rows without direction are left out."""
        placed = self._placed(_directed(rows.select("id", "source_id", F.col("embedding").cast("array<float>").alias("embedding")))).drop("probe")
        return self.table.commit([self.table.stage(placed, "id")])

    def replace(self, ids: DataFrame, rows: DataFrame | None = None) -> int:
        """Take the vectors of ``ids`` out and put ``rows`` in, in one switch: only cells that held an id, or get a row, are written."""
        held = self.table.read()
        gone = [r["part"] for r in held.join(ids.select("id"), "id", "left_semi").select("part").distinct().collect()]
        left = self.table.read(gone).join(ids.select("id"), "id", "left_anti").select("id", "source_id", "embedding", "part")
        if rows is not None:
            left = left.unionByName(self._placed(_directed(rows.select("id", "source_id", F.col("embedding").cast("array<float>").alias("embedding")))).drop("probe"))
        return self.table.commit([self.table.stage(left, "id")], gone)

    def search(self, query: list[float], k: int, probes: int, sources: DataFrame | None = None, who: acl.Principal | None = None) -> DataFrame:
        """id, source_id, distance and rank of the k nearest visible vectors in the ``probes`` nearest cells."""
        cells = [r["id"] for r in vectors.nearest(self.centres(), query, probes).select("id").collect()]
        rows = self.table.read(cells)
        if who is not None:
            rows = acl.secured(rows, sources, who)
        return vectors.nearest(rows, query, k).select("id", "source_id", "distance", "rank")

    def search_many(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query, id, distance and rank of the k nearest vectors of each of many queries (query, embedding).

        Queries meet vectors by the cell. Both are dealt in blocks of bounded size; a
        task compares a block of queries with one of vectors by products of
        matrices, and only the k best of each query in it are shuffled.
        """
        asked = self._placed(_directed(queries.select("query", F.col("embedding").cast("array<float>").alias("embedding"))), probes)
        held = self.table.read().select("id", "embedding", "part")
        counts = lambda rows, at_once: F.create_map(*[F.lit(x) for r in rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / at_once).cast("int").alias("n")).collect() for x in (r["part"], r["n"])] or [F.lit(-1), F.lit(1)])  # noqa: E731 (bounded by the number of cells)
        blocks, chunks = counts(asked, QUERIES_AT_ONCE)[F.col("part")], counts(held, VECTORS_AT_ONCE)[F.col("part")]
        mine = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        asked = asked.where(chunks.isNotNull()).select("query", F.col("embedding").alias("asked"), "part", mine("query", blocks).alias("block"), every(chunks).alias("chunk"))
        held = held.where(blocks.isNotNull()).select("id", "embedding", "part", every(blocks).alias("block"), mine("id", chunks).alias("chunk"))
        kinds = ", ".join(f"{n} {t.dataType.simpleString()}" for n, t in (("query", asked.schema["query"]), ("id", held.schema["id"])))
        best = lambda a, v: nearest_of(a, v, k)
        # a number of its own: the work grows with pairs, not with bytes, so that tasks must not be put together by size
        key, tasks = ("part", "block", "chunk"), max(64, 4 * self.spark.sparkContext.defaultParallelism)
        groups = [rows.repartition(tasks, *key).groupBy(*key) for rows in (asked, held)]
        met = groups[0].cogroup(groups[1]).applyInArrow(best, f"{kinds}, distance double")
        met = met.select("query", "id", F.round("distance", 6).alias("distance"))
        return met.selectExpr("*", "row_number() over (partition by query order by distance, id) as rank").where(F.col("rank") <= k)


def nearest_of(asked, held, k: int):
    """query, id and distance of the ``k`` nearest of a block of vectors for each of a block of queries; of equal distances at six digits the smallest ids."""
    import numpy as np
    import pyarrow as pa

    matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    kinds = pa.schema([asked.schema.field("query"), held.schema.field("id"), pa.field("distance", pa.float64())])
    if not asked.num_rows or not held.num_rows:
        return kinds.empty_table()
    held = held.sort_by("id")
    x, y = matrix(asked.column("asked")), matrix(held.column("embedding"))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    n = min(k, len(y))
    which, distances = [], []
    for begin in range(0, len(x), 64):
        d = 1 - x[begin : begin + 64] @ y.T
        order = np.floor(d * 1e6 + 0.5).astype(np.int64) * len(y) + np.arange(len(y))
        near = np.argpartition(order, n - 1, axis=1)[:, :n]
        which.append(near.ravel())
        distances.append(np.take_along_axis(d, near, 1).ravel())
    queries = asked.column("query").take(pa.array(np.repeat(np.arange(len(x)), n)))
    return pa.Table.from_arrays([queries, held.column("id").take(pa.array(np.concatenate(which))), pa.array(np.concatenate(distances))], schema=kinds)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers (query, id) that were found."""
    both = exact.select("query", "id").join(found.select("query", "id"), ["query", "id"], "left_semi").count()
    return both / max(1, exact.count())
