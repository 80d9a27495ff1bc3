"""Nearest neighbours by cosine through randomly rotated one-bit codes.

Every unit vector is rotated by one random orthogonal matrix per dimension count and kept as the signs of its
coordinates, packed into bytes, beside a correction scalar: the inner product of the
vector with its own code. A query's inner product with a code, divided by that scalar, estimates its
cosine without bias, and the error is at most ``width * sqrt((1 - c^2) / c^2 / (d - 1))`` but
for a chance that falls with the square of ``width``. The vectors of the best estimates are ranked by their exact
cosines, and so are all others whose upper bound reaches the k-th best of these, in double precision.

The index covers every vector; nothing is fitted. Vectors are hashed into blocks of about ``block_rows`` and
queries into blocks of ``query_rows``; each pair of blocks is one task-sized group, whose
k best go into a ranking per query. The inner product with a code is read from tables of 256 sums per byte.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id; a query is compared with vectors of its own
dimension count; rows with the query's own id are not its neighbours; repeated rows
of other ids are neighbours each; ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import ship

ship(__name__)
PROBES = 4  # exact cosines looked at first, in multiples of k


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes (n, ceil(d / 8)) and correction scalars of unit vectors (n, d), rotated by ``turn``."""
    turned = vectors @ turn.T
    scalar = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), scalar


def byte_sums(query: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Per byte of a code, the inner product of that part of the query for all 256 values."""
    dim = len(query)
    turned = np.zeros(-(-dim // 8) * 8)
    turned[:dim] = turn @ query / np.sqrt(dim)
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
    return turned.reshape(-1, 8) @ signs.T


def bounds(codes, scalar, dim, sums, width):
    """Lower and upper bounds of the cosines of one query with all codes."""
    inner = np.zeros(len(codes))
    for j in range(codes.shape[1]):
        inner += sums[j][codes[:, j]]
    estimate = inner / scalar
    error = width * np.sqrt(np.maximum(1 - scalar**2, 0) / max(dim - 1, 1)) / scalar
    return estimate - error, estimate + error


def _rows(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def _search(k: int, width: float, seed: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        base, asked = _rows(vectors), _rows(queries)
        ids = vectors.column("id").to_numpy()
        norms = np.sqrt((base * base).sum(axis=1))
        dim = base.shape[1]
        turn = rotation(dim, seed)
        codes, scalar = encode(base / norms[:, None], turn)
        out = []
        for own, query in zip(queries.column("id").to_numpy(), asked, strict=True):
            norm = np.sqrt((query * query).sum())
            low, high = bounds(codes, scalar, dim, byte_sums(query / norm, turn), width)
            other = np.flatnonzero(ids != own)
            if not len(other):
                continue
            if len(other) > k:
                # The k-th best of some exact cosines bounds the k-th best of all from below.
                probe = other[np.argpartition(low[other] + high[other], -min(PROBES * k, len(other)))]
                probe = probe[-min(PROBES * k, len(other)) :]
                known = (base[probe] @ query) / (norms[probe] * norm)
                least = np.partition(known, -k)[-k] - 1e-9
                near = other[high[other] >= least]
            else:
                near = other
            score = (base[near] * query).sum(axis=1) / (norms[near] * norm)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), own), ids[near][best], score[best]))
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema)

    return run


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    width: float = 4.0,
    block_rows: int = 4096,
    query_rows: int = 2048,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, nearest first."""
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.size(vector_col).alias("dim"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    rows, asked = good.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0))
    ).first()
    n_blocks, n_query_blocks = -(-rows // block_rows) or 1, -(-asked // query_rows) or 1

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")

    base = good.select("id", "v", "dim", own(n_blocks, 1).alias("b")).withColumn(
        "q", spread(n_query_blocks)
    )
    queries = (
        good.where("asked")
        .select("id", "v", "dim", own(n_query_blocks, 2).alias("q"))
        .withColumn("b", spread(n_blocks))
    )
    keys = ["dim", "b", "q"]
    found = (
        base.groupBy(keys)
        .cogroup(queries.groupBy(keys))
        .applyInArrow(_search(k, width, seed), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
