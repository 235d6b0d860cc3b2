"""Packs documents into sequences that hold one piece each, of a power-of-two length.

A document's ids and the end id are cut into blocks of the longest length, and what is left into
powers of two by its binary digits, longest first. Pieces of equal length go to one bucket, where a
batch is rectangular without padding, and no sequence crosses documents. A piece carries its bucket
and its place there; places are numbered by task, so numbering moves no row, and reading a bucket in
their order gives it back in that of the documents.

A null or empty text is the end id alone. Repeated rows are packed each; they have equal pieces
in places of their own, so places have no ties. Texts of any length are packed whole. An empty
table gives no pieces. Only doc_id and text are read, whatever else the table has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm import tokens
from looptrace.llm.common import bounded_batches, parts_of

LONGEST = 2048
END_ID = 1
PLACE_BITS = 40  # of a place that count the pieces of one task


def cuts(n: int, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids; `longest` is a power of two."""
    start = 0
    for start in range(0, n - longest + 1, longest):
        yield start, longest
    start = n // longest * longest
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


def pack(
    docs: DataFrame,
    longest: int = LONGEST,
    end_id: int = END_ID,
    path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, bucket_place, ids,
    sequence_id, offset.

    The bucket is the binary logarithm of the length; bucket_place is unique in it and grows with the
    task and in it by one. sequence_id is unique over all pieces; offset is 0, as a piece fills its
    sequence.
    """
    path = path or tokens.default_path()
    key = docs.schema["doc_id"]
    fields = [
        T.StructField("doc_id", key.dataType),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("bucket_place", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.ids(path), end_id.to_bytes(4, "little")
        context = TaskContext.get()
        next_place = [(context.partitionId() if context else 0) << PLACE_BITS] * longest.bit_length()
        for batch in batches:
            for part in parts_of(batch, [1]):
                rows, made, pieces = [], [[], [], [], [], [], []], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    data = memoryview((encode.of(text) if text else b"") + end)
                    n = len(data) // 4
                    for start, length in cuts(n, longest):
                        piece = data[4 * start : 4 * (start + length)]
                        rows.append(row)
                        bucket = length.bit_length() - 1
                        place = next_place[bucket]
                        next_place[bucket] = place + 1
                        told = (start, length, zlib.crc32(piece), n, bucket, place)
                        for values, v in zip(made, told):
                            values.append(v)
                        if with_ids:
                            pieces.append(piece)
                columns = [part.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(values, pa.int64()) for values in made[:4]]
                columns += [pa.array(made[4], pa.int32()), pa.array(made[5], pa.int64())]
                if with_ids:
                    ends = [0, *(len(p) // 4 for p in pieces)]
                    flat = pa.Array.from_buffers(
                        pa.int32(), sum(ends), [None, pa.py_buffer(b"".join(pieces))]
                    )
                    offsets = pa.array(ends, pa.int32()).to_numpy().cumsum(dtype="int32")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    bounded_batches(docs.sparkSession)
    pieces = docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences by bucket, one folder for each power of two, in the order of their places."""
    order = ("bucket", "bucket_place")
    pieces.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)
