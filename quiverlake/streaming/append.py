"""Continuous appends to a saved index."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from quiverlake.operators import model as M


def follow(stream: DataFrame, model: M.Model, path: str, checkpoint: str, **trigger):
    """Encodes every micro-batch of a streaming DataFrame (id, vec) onto the index at path, which `model.load` reads with what was saved there before.

    A batch has a folder by its number and its stream (told by the checkpoint): one that runs again replaces itself, and
    several streams may write to one index. The index there must have been built by the same model.
    """
    if M.load(stream.sparkSession, path)[1] != model:
        raise ValueError("the index there was built by another model")
    name = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, number: int) -> None:
        M.build(batch, model).write.mode("overwrite").parquet(f"{path}/rows/batch={name}-{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
