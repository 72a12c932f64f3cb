"""Fixed-size arrays gathered from every partition and merged on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = 64


def _packed(a: np.ndarray) -> bytes:
    import pyarrow as pa

    return len(a).to_bytes(8, "little") + pa.compress(a.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, dtype: str) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(raw[:8], "little") * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(raw[8:], n, "zstd", asbytes=True), dtype)


def merged_array(
    df: DataFrame,
    partial: Callable[[Iterator], np.ndarray],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray],
    dtype: str,
    finish: Callable[[np.ndarray], np.ndarray] | None = None,
    finished: str | None = None,
) -> np.ndarray:
    """partial(batches) gives one array of the same fixed length a partition; they are merged chunk by chunk, 256 at a time.

    Only the merged array, whose length the caller fixes, reaches the driver;
    with ``finish``, what that makes of each merged chunk, of type ``finished``.
    """

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        whole = partial(batches)
        if whole is None:
            return
        parts = np.array_split(whole, CHUNKS)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array(range(CHUNKS), pa.int32()),
                "pid": pa.array([pid] * CHUNKS, pa.int64()),
                "data": pa.array([_packed(p.astype(dtype)) for p in parts], pa.binary()),
            }
        )

    schema = "chunk int, pid bigint, data binary"

    def combine(pdf: pd.DataFrame, last: bool = False) -> pd.DataFrame:
        acc = None
        for raw in pdf["data"]:
            a = _unpacked(raw, dtype)
            acc = a.copy() if acc is None else merge(acc, a)
        acc = finish(acc) if last and finish else acc
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "pid": [pdf["pid"].iloc[0] // 256], "data": [_packed(acc)]})

    width = df.rdd.getNumPartitions()
    parts = df.mapInArrow(gather, schema)
    while width > 256:
        parts = parts.groupBy("chunk", F.floor(F.col("pid") / 256).alias("g")).applyInPandas(lambda k, p: combine(p), schema)
        width = -(-width // 256)
    rows = parts.groupBy("chunk").applyInPandas(lambda k, p: combine(p, True), schema).collect()
    out = finished or dtype
    return np.concatenate([_unpacked(r["data"], out) for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else np.zeros(0, out)
