"""User-supplied embedding models over sample arrays."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecmeadow.functions.arrow import list_column, matrix_of

MODELS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


def register_model(name: str, factory: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> None:
    """``factory()`` is called once per task and returns a function from (N, samples) to (N, D)."""
    MODELS[name] = factory


def embed(
    df: DataFrame, model: str | Callable, dim: int, samples: str = "samples", out: str = "embedding", rows: int = 256
) -> DataFrame:
    """Replace ``samples`` by the model's unit vector.

    The model is loaded once per task and fed ``rows`` clips at a time. A wrong shape,
    a value that is not finite or a length off 1 by more than 1e-5 fails the job: there is no
    stand-in vector.
    """
    factory = MODELS[model] if isinstance(model, str) else model
    keep = [c for c in df.columns if c != samples]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = np.asarray(fn(matrix_of(part.column(part.schema.get_field_index(samples)))), dtype=np.float64)
                if found.shape != (part.num_rows, dim):
                    raise ValueError(f"the model returned {found.shape}, expected {(part.num_rows, dim)}")
                if not np.isfinite(found).all():
                    raise ValueError("the model returned values that are not finite")
                if np.abs(np.linalg.norm(found, axis=1) - 1.0).max(initial=0.0) > 1e-5:
                    raise ValueError("the model returned vectors that are not of length 1")
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, list_column(found)], names=[*keep, out])

    return df.mapInArrow(run, schema)
