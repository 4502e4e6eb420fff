"""Exact cosine search of job vectors over chunk vectors.

Each task multiplies its chunk batches with the query matrix and keeps the best k per job, so only
partitions x jobs x k rows are shuffled. Few query vectors (size checked) are broadcast; more are
processed in blocks that are shuffled to salted groups of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.ranking import top_k
from matchloom.session import send_by_value

send_by_value(__name__)

_MAX_BROADCAST_BYTES = 64 << 20
_BLOCK_BYTES = 16 << 20
_GROUP_ROWS = 50_000
_TILE_CELLS = 8_000_000


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1e-9
    return matrix / norms


def _values(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_pandas().to_numpy()


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """The vectors of a column as unit rows."""
    column = table[name].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return unit_rows(flat.reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def _best(jobs, q: np.ndarray, c: np.ndarray, candidates, chunk_index, k: int) -> pd.DataFrame:
    """Best k chunks of each query, ties by candidate then chunk; similarities in tiles of bounded size."""
    n = len(c)
    tile = max(1, _TILE_CELLS // n)
    parts = []
    for start in range(0, len(q), tile):
        sims = np.round(q[start : start + tile] @ c.T, 6)
        if n > k:
            kth = np.partition(sims, n - k, axis=1)[:, n - k]
            rows, cols = np.nonzero(sims >= kth[:, None])
        else:
            rows, cols = np.indices(sims.shape).reshape(2, -1)
        found = pd.DataFrame(
            {
                "job_id": jobs[start + rows],
                "candidate_id": candidates[cols],
                "chunk_index": chunk_index[cols],
                "score": sims[rows, cols],
            }
        )
        parts.append(_cut(found, ["job_id"], k))
    return pd.concat(parts)


def _cut(found: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    ordered = found.sort_values(
        [*keys, "score", "candidate_id", "chunk_index"], ascending=[True] * len(keys) + [False, True, True]
    )
    return ordered.groupby(keys, sort=False).head(k)


def _output_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("tenant_id", chunks.schema["tenant_id"].dataType),
            T.StructField("job_id", queries.schema["job_id"].dataType),
            T.StructField("candidate_id", chunks.schema["candidate_id"].dataType),
            T.StructField("chunk_index", chunks.schema["chunk_index"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _by_broadcast(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    # Bounded by _MAX_BROADCAST_BYTES, checked by the caller.
    local = queries.toPandas()
    per_tenant = {
        tenant: (part["job_id"].to_numpy(), unit_rows(np.stack(part["vector"].to_numpy()).astype("float64")))
        for tenant, part in local.groupby("tenant_id")
    }
    shared = chunks.sparkSession.sparkContext.broadcast(per_tenant)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            tenants = _values(table, "tenant_id")
            candidates, chunk_index = _values(table, "candidate_id"), _values(table, "chunk_index")
            matrix = _matrix(table, "embedding")
            for tenant in pd.unique(tenants):
                if tenant not in shared.value:
                    continue
                jobs, q = shared.value[tenant]
                mine = tenants == tenant
                found = _best(jobs, q, matrix[mine], candidates[mine], chunk_index[mine], k)
                if tenant in best:
                    found = _cut(pd.concat([best[tenant], found]), ["job_id"], k)
                best[tenant] = found
        for tenant, found in best.items():
            found.insert(0, "tenant_id", tenant)
            yield pa.RecordBatch.from_pandas(found, schema=arrow_schema, preserve_index=False)

    schema = _output_schema(queries, chunks)
    arrow_schema = _arrow(schema)
    return chunks.select("tenant_id", "candidate_id", "chunk_index", "embedding").mapInArrow(search, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _by_blocks(queries: DataFrame, chunks: DataFrame, k: int, n_blocks: int, n_salts: int) -> DataFrame:
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("job_id"), F.lit(n_blocks)).cast("int"))
    # Aliases, because both sides of the cogroup come from `blocked`.
    tenant_blocks = blocked.select(
        F.col("tenant_id").alias("tenant_id"), F.col("block").alias("block")
    ).distinct()
    # Each chunk is copied to every block of its tenant: only its key and vector go along, not its text.
    vectors = chunks.select("tenant_id", "candidate_id", "chunk_index", "embedding")
    spread = vectors.withColumn(
        "salt", F.pmod(F.xxhash64("candidate_id", "chunk_index"), F.lit(n_salts)).cast("int")
    ).join(tenant_blocks, "tenant_id")
    copies = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    schema = _output_schema(queries, chunks)
    arrow_schema = _arrow(schema)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow_schema.empty_table()
        found = _best(
            _values(right, "job_id"),
            _matrix(right, "vector"),
            _matrix(left, "embedding"),
            _values(left, "candidate_id"),
            _values(left, "chunk_index"),
            k,
        )
        found.insert(0, "tenant_id", left["tenant_id"][0].as_py())
        return pa.Table.from_pandas(found, schema=arrow_schema, preserve_index=False)

    keys = ["tenant_id", "block", "salt"]
    return spread.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(search, schema)


def dense_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    max_broadcast_bytes: int = _MAX_BROADCAST_BYTES,
    block_bytes: int = _BLOCK_BYTES,
    group_rows: int = _GROUP_ROWS,
) -> DataFrame:
    """Best k chunks per job inside the tenant: (tenant, job, candidate, chunk_index, score, rank).

    `queries`: tenant_id, job_id, vector. `chunks`: tenant_id, candidate_id, chunk_index, embedding.
    """
    queries = queries.select("tenant_id", "job_id", "vector").where(F.col("vector").isNotNull())
    chunks = chunks.where(F.col("embedding").isNotNull())
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    row_bytes = max(size["d"], 1) * 8
    if size["n"] * row_bytes <= max_broadcast_bytes:
        hits = _by_broadcast(queries, chunks, k)
    else:
        n_blocks = -(-size["n"] * row_bytes // block_bytes)
        n_salts = max(1, -(-chunks.count() // group_rows))
        hits = _by_blocks(queries, chunks, k, n_blocks, n_salts)
    order = [F.desc("score"), F.asc("candidate_id"), F.asc("chunk_index")]
    return top_k(hits, ["tenant_id", "job_id"], order, k)
