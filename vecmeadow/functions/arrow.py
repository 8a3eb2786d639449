"""Arrow batches as NumPy matrices, for the operators that multiply or add whole batches."""

import numpy as np
import pyarrow as pa


def matrix_of(column, dim: int | None = None) -> np.ndarray:
    """A list column as a (rows, dim) matrix of doubles; any other row length is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if dim is None:
        dim = int(sizes[0]) if len(sizes) else 0
    if column.null_count or not (sizes == dim).all():
        raise ValueError(f"every vector needs {dim} dimensions")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), dim)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row shorter than 1e-12 becomes uniform."""
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    flat = 1.0 / np.sqrt(m.shape[1])
    return np.where(lengths < 1e-12, flat, m / np.where(lengths < 1e-12, 1.0, lengths))


def list_column(m: np.ndarray) -> pa.Array:
    rows, dim = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(m.reshape(-1)))


def group_codes(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """For key columns of one batch: first row of each distinct key, and each row's key number."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        encoded = column.dictionary_encode(null_encoding="encode")
        code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return first, number
