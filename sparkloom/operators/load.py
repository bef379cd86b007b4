"""Loading passages through an embedding service that can fail: batch by batch, failures apart from rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

from ..storage import kept

BATCH = 32


@dataclass
class Loaded:
    """``rows`` with their ``embedding``, ``failures`` with their ``error``, and how many there are of each."""

    rows: DataFrame
    failures: DataFrame
    loaded: int
    failed: int


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH, text: str = "text") -> DataFrame:
    """The rows of ``chunks`` with ``embedding`` and ``error``, from calls of at most ``batch`` texts each; with a batch of 1, one call a text.

    A call that raises, or gives another number of vectors than texts, fails all its texts and none besides. Null texts count as empty.
    """
    if batch < 1:
        raise ValueError("a batch has one text or more")
    schema = StructType(chunks.schema.fields[:]).add("embedding", ArrayType(FloatType())).add("error", StringType())

    def run(batches):
        for table in batches:
            for a in range(0, table.num_rows, batch):
                some = table.slice(a, batch)
                texts = [t or "" for t in some.column(text).to_pylist()]
                vectors, error = [None] * len(texts), None
                try:
                    found = embed(texts)
                    if len(found) != len(texts):
                        raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                    vectors = found
                except Exception as failure:  # noqa: BLE001  whatever a service raises
                    error = f"{type(failure).__name__}: {failure}"
                columns = [pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * len(texts), pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=[*some.schema.names, "embedding", "error"])

    return chunks.mapInArrow(run, schema)


def load(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH, text: str = "text") -> Loaded:
    """Embed ``chunks`` once, into one written table, of which rows and failures are the two parts; the counts are taken while it is written.

    Tasks that are run again replace what they wrote, so a text is in the result once, however often its call was made.
    """
    counts = Observation()
    made = embedded(chunks, embed, batch, text).observe(counts, F.count_if(F.col("error").isNull()).alias("loaded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    table = kept(made, "loaded")
    got = counts.get
    return Loaded(table.where("error is null").drop("error"), table.where("error is not null").drop("embedding"), got["loaded"], got["failed"])
