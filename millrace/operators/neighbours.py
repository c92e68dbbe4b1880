"""Nearest vectors by cosine, in blocks: the arithmetic that a task does for one block of queries and one of vectors.

Both blocks arrive as Arrow tables whose sizes the caller bounds; each pair of blocks is one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "query_id long, vec_id long, score double"
ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Scores are equal if they agree so far, whatever the shapes of the products that gave them.
DECIMALS = 12


def matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: the rows that have it, and their matrix of unit rows; rows of norm 0 stay 0."""
    column = vectors.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        values = column.take(pa.array(rows)).flatten()
        x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        top = np.abs(x).max(1)
        usable = np.isfinite(top) & (top > 0)  # scaled first, so that squares neither vanish nor overflow
        x = np.divide(x, top[:, None], out=np.zeros_like(x), where=usable[:, None])
        norm = np.sqrt((x * x).sum(1))
        out[int(n)] = rows, np.divide(x, norm[:, None], out=np.zeros_like(x), where=usable[:, None])
    return out


def best(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k rows (vec_id, embedding) of highest cosine for each row (query_id, embedding); ties go by vec_id.

    Rows of another length than the query's, and those of norm 0 or with null or non-finite components, score 0. Rows
    without a vec_id are left out.
    """
    vectors = vectors.filter(pc.is_valid(vectors["vec_id"])).sort_by("vec_id")
    ids = vectors["vec_id"].to_numpy()
    k = min(k, len(ids))
    if not k or not queries.num_rows:
        return ARROW.empty_table()
    held, asked = matrices(vectors["embedding"]), matrices(queries["embedding"])
    score = np.zeros((queries.num_rows, len(ids)))
    for n, (rows, q) in asked.items():
        if n in held:
            score[np.ix_(rows, held[n][0])] = np.round(q @ held[n][1].T, DECIMALS)
    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
    chosen = np.empty((queries.num_rows, k), np.int64)
    for i, s in enumerate(score):
        above = np.flatnonzero(s > least[i])
        chosen[i] = np.concatenate([above, np.flatnonzero(s == least[i])[: k - len(above)]])
    asked_ids = queries["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(queries.num_rows), k)))
    asked_ids = asked_ids.chunk(0) if isinstance(asked_ids, pa.ChunkedArray) else asked_ids
    return pa.Table.from_arrays([asked_ids, pa.array(ids[chosen].ravel()), pa.array(np.take_along_axis(score, chosen, 1).ravel())], schema=ARROW)
