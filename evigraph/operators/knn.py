"""Filtered k-nearest-neighbour search over a vector table, exact or hashed.

Vectors are never paired through a join that would emit every pair. Tasks compare blocks of
queries with blocks of vectors by matrix products and hand on only the k best per query,
so what is shuffled is at most k rows per query and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

METRICS = ("l2_squared", "cosine")
FILTER_FIELDS = (
    "domain", "subdomain", "tool", "version", "visibility", "document_type", "source",
)
_CELLS = 4_000_000       # entries of one distance block held in a task
_SLACK = 1e-9            # widens the first cut, which uses the cheaper expanded formula
_STEP = 8192             # vectors of a cell compared at a time
_BLOCK_BYTES = 24 << 20  # entries of one side of a cell, in single precision


# --- metadata filter and threshold -------------------------------------------

def metadata_filter(df: DataFrame, **fields) -> DataFrame:
    """AND of equalities on the supplied fields; they reach the Parquet scan.

    Values are stripped and compared case-sensitively; ``None`` means "not supplied".
    """
    for name, value in fields.items():
        if name not in FILTER_FIELDS:
            raise ValueError(f"unknown filter field: {name}")
        if value is None:
            continue
        if not isinstance(value, str):
            raise TypeError(f"{name} must be a string")
        if not value.strip():
            raise ValueError(f"{name} cannot be empty")
        df = df.where(F.col(name) == value.strip())
    return df


def threshold(hits: DataFrame, max_distance: float = 0.85) -> DataFrame:
    """Drop hits farther than the limit; equal and unknown distances stay."""
    return hits.where(F.col("distance").isNull() | (F.col("distance") <= max_distance))


# --- block kernel -------------------------------------------------------------

def _matrix(column, kind=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix of ``kind``, by default float64; ``None`` keeps its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(kind or (flat.dtype if flat.dtype.kind == "f" else np.float64), copy=False)
    if flat.size % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _keep_best(q, ids, dist, k):
    """Positions of the k smallest (distance, id) of each query index."""
    rank = ids if ids.dtype.kind == "i" else np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((rank, dist, q))
    sorted_q = q[order]
    first = np.searchsorted(sorted_q, sorted_q, side="left")
    return order[np.arange(len(order)) - first < k]


def _merge(best, found, cap, k):
    """The k best of both; only queries with something new are sorted, ``cap`` is their k-th distance."""
    touched = np.zeros(len(cap), dtype=bool)
    touched[found[0]] = True
    again = touched[best[0]]
    both = tuple(np.concatenate([old[again], new]) for old, new in zip(best, found))
    keep = _keep_best(*both, k)
    both = tuple(part[keep] for part in both)
    far = np.full(len(cap), -np.inf)
    np.maximum.at(far, both[0], both[2])
    full = np.bincount(both[0], minlength=len(cap)) >= k
    cap[touched] = np.where(full & ~np.isnan(far), far, np.inf)[touched]
    return tuple(np.concatenate([old[~again], new]) for old, new in zip(best, both))


def _candidates(rough, margin, cap, vectors, rank, k, allowed=None):
    """Positions that may be among the k nearest by exact distance, then by id.

    ``rough`` is right to half of ``margin``; nothing beyond ``cap`` is asked for. Vectors at
    about the k-th distance can be many, as corpora have copies. Of equal vectors the k smallest
    ids are enough. Pairs that are not ``allowed`` are none.
    """
    if allowed is None:
        allowed = np.broadcast_to(True, rough.shape)
    else:
        rough[~allowed] = np.inf
    if rough.shape[1] <= k:
        return np.nonzero(allowed)
    limit = cap.copy()
    open_ones = np.flatnonzero(~np.isfinite(limit))
    if len(open_ones):
        limit[open_ones] = np.partition(rough[open_ones], k - 1, axis=1)[:, k - 1]
    near = (rough <= (limit + margin).astype(rough.dtype)[:, None]) & allowed
    crowded = np.flatnonzero(near.sum(axis=1) > 4 * k)
    if len(crowded):
        kth = np.partition(rough[crowded], k - 1, axis=1)[:, k - 1]
        limit[crowded] = np.minimum(limit[crowded], kth)
        near[crowded] = (rough[crowded] <= (limit + margin).astype(rough.dtype)[crowded, None]) & allowed[crowded]
        crowded = crowded[near[crowded].sum(axis=1) > 4 * k]
    if len(crowded):
        rows = np.ascontiguousarray(vectors)
        same = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)[1]
    for q in crowded:
        at = np.flatnonzero(near[q])
        order = at[np.lexsort((rank[at], same[at]))]
        group = same[order]
        place = np.arange(len(order)) - np.searchsorted(group, group, side="left")
        near[q, order[place >= k]] = False
    return np.nonzero(near)


def _rough(part, vectors, metric, p_norm, v_norm):
    """Distances by the expanded formula, and twice their error or more, for each query.

    Single precision where the norms allow it: the error of a product of n terms is n roundings
    of the product of the norms.
    """
    single = 1e-20 < v_norm.max() < 1e30 and p_norm.max(initial=0.0) < 1e30
    if metric == "cosine":
        single = single and v_norm.min() > 1e-20 and p_norm.min(initial=1.0) > 1e-20
    if not single:
        cross = part @ vectors.T
        if metric == "l2_squared":
            rough = p_norm[:, None] + v_norm[None, :] - 2.0 * cross
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                rough = 1.0 - cross / np.sqrt(p_norm[:, None] * v_norm[None, :])
            rough = np.where(np.isnan(rough), np.inf, rough)
        return rough, _SLACK * (1.0 + p_norm + v_norm.max())
    error = 4.0 * (part.shape[1] + 8) * float(np.finfo(np.float32).eps)
    rough = part.astype(np.float32) @ vectors.astype(np.float32).T
    if metric == "l2_squared":
        rough *= np.float32(-2.0)
        rough += v_norm.astype(np.float32)
        rough += p_norm.astype(np.float32)[:, None]
        return rough, error * (p_norm + v_norm.max())
    rough /= np.sqrt(v_norm).astype(np.float32)
    rough /= np.sqrt(p_norm).astype(np.float32)[:, None]
    np.subtract(np.float32(1.0), rough, out=rough)
    return rough, np.full(len(part), error)


def _block_best(queries, vectors, ids, k, metric, cap=None, codes=None):
    """(query index, id, distance) of the k nearest of one block, exact in float64.

    With ``cap`` vectors farther than that from a query need not be found. With ``codes`` of queries
    and of vectors only pairs that have a code of one table in common count.
    """
    out = []
    if len(vectors) == 0 or len(queries) == 0:
        return (np.zeros(0, dtype=np.int64), ids[:0], np.zeros(0))
    vectors = vectors.astype(np.float64, copy=False)
    v_norm = (vectors * vectors).sum(axis=1)
    rank = ids if ids.dtype.kind == "i" else np.unique(ids, return_inverse=True)[1]
    cap = np.full(len(queries), np.inf) if cap is None else cap
    rows = max(1, _CELLS // len(vectors))
    for start in range(0, len(queries), rows):
        part = queries[start:start + rows].astype(np.float64, copy=False)
        q_norm = (part * part).sum(axis=1)
        rough, margin = _rough(part, vectors, metric, q_norm, v_norm)
        allowed = None if codes is None else _share_code(codes[0][start:start + rows], codes[1])
        qi, vi = _candidates(rough, margin, cap[start:start + rows], vectors, rank, k, allowed)
        a, b = part[qi], vectors[vi]
        if metric == "l2_squared":
            exact = ((a - b) ** 2).sum(axis=1)
        else:
            exact = 1.0 - (a * b).sum(axis=1) / np.sqrt(q_norm[qi] * v_norm[vi])
        best = _keep_best(qi, rank[vi], exact, k)
        out.append((qi[best] + start, ids[vi[best]], exact[best]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _share_code(a, b):
    """Whether rows of ``a`` and ``b`` have the same code in one of the hash tables."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for mine, other in zip(a.T, b.T):
        out |= mine[:, None] == other[None, :]
    return out


def _scan(shared, k, metric, id_type):
    """A partition scan that keeps a running top k per query and emits it once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best, cap = None, np.full(len(queries), np.inf)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            found = _block_best(queries, _matrix(batch.column("embedding"), None), ids, k, metric, cap)
            empty = tuple(part[:0] for part in found)
            best = _merge(empty if best is None else best, found, cap, k)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[best[0]]), pa.array(best[1], type=id_type),
                 pa.array(best[2], type=pa.float64())],
                names=["query_id", "id", "distance"])
    return run


def _codes(table, bits):
    """Codes of a cell's rows, a contiguous row for each hash table; ``None`` without codes."""
    if "codes" not in table.column_names:
        return None
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int64
    return np.asfortranarray(_matrix(table.column("codes"), kind))


def _pair_best(k, metric, bits=0):
    """Compare the queries and the vectors of one cell, a few thousand vectors at a time."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q, v = _matrix(queries.column("embedding"), None), _matrix(vectors.column("embedding"), None)
        asked, held = _codes(queries, bits), _codes(vectors, bits)
        cap, best = np.full(len(q), np.inf), (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        order = pa.compute.sort_indices(vectors.column("id")).to_numpy()    # places stand for ids, ties go by them
        for lo in range(0, len(v) if len(q) else 0, _STEP):
            places = np.arange(lo, min(lo + _STEP, len(v)))
            codes = None if asked is None else (asked, np.asfortranarray(held[order[places]]))
            best = _merge(best, _block_best(q, v[order[places]], places, k, metric, cap, codes), cap, k)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(best[0])),
                         "id": vectors.column("id").take(pa.array(order[best[1]])),
                         "distance": pa.array(best[2], type=pa.float64())})
    return run


def _cell_best(k, metric):
    """Compare the queries and the vectors of one cell."""
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        query_ids = queries["query_id"].to_numpy()
        qi, ids, dist = _block_best(
            np.stack(queries["embedding"].to_numpy()).astype(np.float64),
            np.stack(vectors["embedding"].to_numpy()).astype(np.float64),
            vectors["id"].to_numpy(), k, metric)
        return pd.DataFrame({"query_id": query_ids[qi], "id": ids, "distance": dist})
    return run


# --- plans ----------------------------------------------------------------------

def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "l2_squared",
        approx: bool = False, max_query_bytes: int = 16 << 20, block_rows: int = 20_000,
        tables: int = 20, bits: int = 4) -> DataFrame:
    """The k nearest vectors of every query: ``(query_id, id, distance, rank)``.

    ``queries(query_id, embedding)`` and ``vectors(id, embedding)``; ties go to the smaller id.

    * A query batch of at most ``max_query_bytes`` is shipped to every task, and the vector
      table is read once, without a shuffle of vectors. Larger batches never come to the driver:
      queries and vectors are stored, dealt into blocks, and each pair of blocks is one task's
      work of bounded memory. The result is exact.
    * ``approx=True`` compares only vectors that share one of ``tables`` sign hashes of
      ``bits`` bits with the query. More bits make it faster and find less, more tables find
      more; both are fixed parameters, so what is found does not depend on the size of the
      table. The defaults are chosen for a recall of at least 0.9. A crowded bucket
      is split over several cells of ``block_rows``, never truncated.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    v = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    if approx:
        found = _hashed(q, v, k, metric, block_rows, tables, bits)
    else:
        found = _in_blocks(q, v, k, metric, max_query_bytes)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (found.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))


def _result_schema(q: DataFrame, v: DataFrame) -> str:
    return (f"query_id {q.schema['query_id'].dataType.simpleString()}, "
            f"id {v.schema['id'].dataType.simpleString()}, distance double")


def _broadcast_scan(q, v, k, metric) -> DataFrame:
    spark = v.sparkSession
    batch = q.toArrow()     # its size was checked by the caller
    shared = spark.sparkContext.broadcast(
        (batch.column("query_id").to_numpy(), _matrix(batch.column("embedding"))))
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(v.schema["id"].dataType)
    return v.mapInArrow(_scan(shared, k, metric, id_type), _result_schema(q, v))


def _spread(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _pair_up(q, v, cell, k, metric) -> DataFrame:
    return (q.groupBy(*cell).cogroup(v.groupBy(*cell))
            .applyInPandas(_cell_best(k, metric), _result_schema(q, v)))


def _in_blocks(q, v, k, metric, max_query_bytes) -> DataFrame:
    """One scan of the vectors for a small batch of queries, a grid of blocks for a larger one."""
    size = F.size("embedding") * 8 + F.octet_length(F.col("query_id").cast("string")) + 64
    total, width = q.agg(F.sum(size.cast("long")), F.max(F.size("embedding"))).first()
    if (total or 0) <= max_query_bytes:
        return _broadcast_scan(q, v, k, metric)
    return _grid(cut_lineage(q, "queries"), cut_lineage(v, "vectors"), k, metric, max(1, _BLOCK_BYTES // (4 * max(1, width))))


def _grid(q, v, k, metric, rows, bits=0) -> DataFrame:
    """Every block of about ``rows`` queries against every block of as many vectors.

    Where both have ``codes`` of ``bits`` bits, only pairs that share a code are answers.
    """
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_v = q.count(), v.count()
    qs = max(1, math.ceil(n_q / rows))
    vs = max(1, math.ceil(n_v / rows), min(math.ceil(parts / qs), math.ceil(n_v / _STEP)))

    def dealt(df, key, mine, n, other, m):
        block = F.pmod(F.xxhash64(key, "embedding"), F.lit(n)).cast("int")
        return df.select(key, "embedding", *[c for c in df.columns if c == "codes"], block.alias(mine),
                         F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    cell = ["qb", "vb"]
    return (dealt(q, "query_id", "qb", qs, "vb", vs).groupBy(*cell)
            .cogroup(dealt(v, "id", "vb", vs, "qb", qs).groupBy(*cell))
            .applyInArrow(_pair_best(k, metric, bits), _result_schema(q, v)))


def hash_planes(tables: int, bits: int, width: int) -> np.ndarray:
    """Normal vectors of the hash planes, ``bits`` rows for each table; the same in every run."""
    return np.random.default_rng(7).standard_normal((tables * bits, width))


def _with_codes(df: DataFrame, planes: np.ndarray, tables: int, bits: int) -> DataFrame:
    """Add the sign-hash codes, one for each hash table, as an array ``codes``."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = (_matrix(batch.column("embedding")) @ planes.T >= 0)
            codes = (signs.reshape(batch.num_rows, tables, bits) * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(codes), type=pa.list_(pa.int64()))],
                names=[*batch.schema.names, "codes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, codes array<bigint>")


def _by_table(coded: DataFrame) -> DataFrame:
    """One row ``(tbl, code)`` per hash table."""
    return coded.select(*[c for c in coded.columns if c != "codes"], F.posexplode("codes").alias("tbl", "code"))


def _hashed(q, v, k, metric, block_rows, tables, bits) -> DataFrame:
    """Locality-sensitive hashing with random hyperplanes.

    Both sides of a crowded bucket are spread over cells: a vector goes to one vector part
    and is repeated for every query part, and the other way round. Where so many pairs share several
    buckets that there would be more comparisons than pairs, blocks of queries meet blocks of
    vectors once instead, and the codes say which pairs count: the same answers, with no row repeated
    for its tables.
    """
    width = q.agg(F.max(F.size("embedding"))).first()[0] or 0
    planes = hash_planes(tables, bits, width)
    q_coded, v_coded = (cut_lineage(_with_codes(df, planes, tables, bits), "coded") for df in (q, v))
    q_rows, v_rows = _by_table(q_coded), _by_table(v_coded)
    key = ["tbl", "code"]

    def parts(rows, name):
        return rows.groupBy(*key).agg(F.count("*").alias(f"{name}_rows")).withColumn(
            name, F.ceil(F.col(f"{name}_rows") / F.lit(block_rows)).cast("int"))

    # At most tables * 2^bits rows: one per bucket that both sides use.
    sizes = cut_lineage(parts(q_rows, "qn").join(parts(v_rows, "vn"), key), "sizes")
    compared = sizes.agg(F.sum(F.col("qn_rows").cast("double") * F.col("vn_rows"))).first()[0] or 0
    rows, ids = v_coded.agg(F.count("*"), F.countDistinct("id")).first()
    if ids == rows and compared > float(rows) * q_coded.count():
        found = _grid(q_coded, v_coded, k, metric, max(1, _BLOCK_BYTES // (4 * width)), bits)
        return found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    sizes = sizes.drop("qn_rows", "vn_rows")
    q_cells = (q_rows.join(sizes, key)
               .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qn")).cast("int"))
               .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vn") - 1))))
    v_cells = (v_rows.join(sizes, key)
               .withColumn("vb", F.pmod(F.xxhash64("id"), F.col("vn")).cast("int"))
               .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1))))
    cell = [*key, "qb", "vb"]
    found = _pair_up(q_cells.select(*cell, "query_id", "embedding"),
                     v_cells.select(*cell, "id", "embedding"), cell, k, metric)
    # The same pair may come from several hash tables.
    return found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
