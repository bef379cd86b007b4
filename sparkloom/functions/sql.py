"""The chunker and the embedder as functions of Spark SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import MAX_CHARS, chunk_text
from .text import DIMS, unit_vectors


class ChunkFiles:
    """``chunk_files(table [, max_chars])``: rows ``source_path, chunk_no, text`` of a table with ``path`` and ``content``."""

    @staticmethod
    def analyze(files: AnalyzeArgument, max_chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable or not {"path", "content"} <= set(files.dataType.names):
            raise ValueError("chunk_files takes a table with path and content")
        if max_chars is not None and (not max_chars.isConstantExpression or max_chars.value is None or max_chars.value < 1):
            raise ValueError("max_chars is a constant above 0")
        return AnalyzeResult(StructType().add("source_path", StringType()).add("chunk_no", IntegerType()).add("text", StringType()))

    def eval(self, files, max_chars=MAX_CHARS):
        if files["path"] is not None and files["content"] is not None:
            for number, text in enumerate(chunk_text(f"FILE: {files['path']}", files["content"], max_chars)):
                yield files["path"], number, text


@arrow_udf(ArrayType(DoubleType()))
def _embed(texts: pa.Array) -> pa.Array:
    return unit_vectors(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), DIMS)


def register(spark: SparkSession) -> None:
    """Make ``chunk_files(TABLE(...))`` and ``stub_embedding(text)`` known to a session."""
    spark.udtf.register("chunk_files", udtf(ChunkFiles))
    spark.udf.register("stub_embedding", _embed)
