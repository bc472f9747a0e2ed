"""Approximate nearest neighbours by a stored partition index.

Centres are fitted by Lloyd's rounds on a bounded sample in the order of a hash of the ids, so
they are the same in every run. Every vector is stored in the folder of its nearest centre. A
search probes the cells whose centres are nearest to each query, reads the folders of probed cells
only, and ranks what it finds by exact distance. More probes find more and read more; how many are
needed depends on how clustered the vectors are, not on their number.

Rows are dealt into files by cell and a hash of the id, so a cell that holds a third of all vectors
is read by many tasks. Vectors are never shuffled by a search: query blocks of a checked size go to
the tasks, and each hands on its k best per query.

Defined cases: null vectors are neither stored nor asked for; fewer vectors than cells give fewer
cells; an empty table gives no result; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .knn import _block_best, _keep_best, _matrix, _result_schema, _spread

CELLS, PROBES, ROUNDS, SAMPLE = 64, 36, 5, 20_000
_ROWS = 1 << 14


@dataclass(frozen=True)
class Index:
    """Centres, and the folder with a subfolder of vectors for each of them."""

    centres: np.ndarray
    path: str


def nearest_centres(vectors: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The numbers of the ``n`` nearest centres of each vector, nearest first."""
    out = []
    for lo in range(0, len(vectors), _ROWS):
        part = vectors[lo:lo + _ROWS]
        # summed centre by centre: the expanded formula would not tell close distances apart
        far = np.stack([((part - c) ** 2).sum(axis=1) for c in centres], axis=1)
        out.append(np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


def fit_centres(vectors: DataFrame, cells: int = CELLS, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Centres from at most ``sample`` vectors of ``(id, embedding)``, rounded to six digits."""
    order = F.md5(F.col("id").cast("string").cast("binary"))
    rows = vectors.where("embedding IS NOT NULL").select("embedding", order.alias("h"), "id") \
        .orderBy("h", "id").limit(sample).toArrow()
    order = np.lexsort((rows.column("id").to_numpy(), rows.column("h").to_numpy()))
    x = _matrix(rows.column("embedding"))[order]
    centres = x[:cells].copy()
    for _ in range(rounds):
        at = nearest_centres(x, centres)[:, 0]
        for c in range(len(centres)):
            if (at == c).any():
                centres[c] = np.round(x[at == c].mean(axis=0), 6)
    return centres


def _with_cell(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest_centres(_matrix(batch.column("embedding")), centres)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))],
                                             names=[*batch.schema.names, "cell"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{schema}, cell int")


def append(index: Index, vectors: DataFrame) -> None:
    """Store more vectors in the cells of an index; ids must be new."""
    rows = vectors.where("embedding IS NOT NULL").select("id", "embedding")
    if not len(index.centres):
        return
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _with_cell(rows, index.centres).repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(parts)))
    dealt.sortWithinPartitions("cell").write.mode("append").partitionBy("cell").parquet(index.path)


def build(vectors: DataFrame, cells: int = CELLS, rounds: int = ROUNDS, sample: int = SAMPLE,
          path: str | None = None) -> Index:
    """An index of ``vectors(id, embedding)`` in ``path`` (default: a scratch folder)."""
    index = Index(fit_centres(vectors, cells, rounds, sample), path or scratch_path(vectors.sparkSession, "cells"))
    append(index, vectors)
    return index


def _probe(shared, k, metric, id_type):
    """Compare each vector with the queries that probe its cell; the best of the task go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, wanted = shared.value
        best = None
        for batch in batches:
            ids, cells = batch.column("id").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy()
            vectors, parts = _matrix(batch.column("embedding")), [best] if best is not None else []
            for cell in np.unique(cells).tolist():
                asked, here = wanted.get(cell), np.flatnonzero(cells == cell)
                if asked is not None:
                    q, found, far = _block_best(queries[asked], vectors[here], ids[here], k, metric)
                    parts.append((asked[q], found, far))
            if parts:
                found = tuple(np.concatenate(column) for column in zip(*parts))
                keep = _keep_best(*found, k)
                best = tuple(column[keep] for column in found)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[best[0]]), pa.array(best[1], type=id_type), pa.array(best[2], type=pa.float64())],
                names=["query_id", "id", "distance"])
    return run


def search(queries: DataFrame, index: Index, vectors: DataFrame, k: int = 5, probes: int = PROBES,
           metric: str = "l2_squared", max_query_bytes: int = 64 << 20) -> DataFrame:
    """``query_id, id, distance, rank`` of the k nearest vectors in the probed cells.

    ``vectors`` gives the types of the stored columns. Queries are cut into blocks of at most
    ``max_query_bytes``; each block is one read of the folders its queries probe.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    spark = queries.sparkSession
    q = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    schema = _result_schema(q, vectors)
    size = F.size("embedding") * 8 + F.octet_length(F.col("query_id").cast("string")) + 64 + 8 * probes
    total = q.agg(F.sum(size.cast("long"))).first()[0] or 0
    if not total or not len(index.centres):
        return spark.createDataFrame([], f"{schema}, rank int")
    blocks = max(1, math.ceil(1.25 * total / max_query_bytes))
    stored = spark.read.schema(f"id {vectors.schema['id'].dataType.simpleString()}, embedding "
                               f"{vectors.schema['embedding'].dataType.simpleString()}, cell int").parquet(index.path)
    id_type, parts = to_arrow_type(vectors.schema["id"].dataType), []
    for block in range(blocks):
        batch = q.where(_spread("query_id", blocks) == block).toArrow()     # bounded by max_query_bytes
        matrix = _matrix(batch.column("embedding"))
        near = nearest_centres(matrix, index.centres, probes)
        wanted = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}
        shared = spark.sparkContext.broadcast((batch.column("query_id").to_numpy(), matrix, wanted))
        found = stored.where(F.col("cell").isin(*wanted)).mapInArrow(_probe(shared, k, metric, id_type), schema)
        parts.append(cut_lineage(found, "probed") if blocks > 1 else found)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
