"""Flat token files with 64-bit document offsets.

A part is three files: ``.bin`` (unsigned little-endian ids, 2 or 4 bytes each), ``.idx`` (unsigned
64-bit offsets in ids, one more than documents) and ``.doc`` (signed 64-bit doc_id, the least value
standing for null).  Documents are range-partitioned by doc_id; a part's base is the prefix sum of
the ids in the parts before it.  Each task writes files of its own name and reports them in its
committed row, so a repeated or speculative task leaves no trace in the result.

Defined results: null text is the empty text with its end id; equal doc_ids are separate documents
in the order of a text hash; an empty table gives no part; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._memory import slices, task

NULL_ID = -(1 << 63)
MANIFEST = "first_doc long, first_key long, file string, width int, n_docs long, n_tokens long"


def _open(path: str, mode: str):
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        import os

        local = "/" + path.removeprefix("file:").lstrip("/")
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if mode == "wb" else store.open_input_file(inner)


def load(path: str, dtype: str) -> np.ndarray:
    """The file's numbers; memory-mapped where the file is on a mounted path."""
    if path.startswith("file:") or path.startswith("/"):
        import os

        local = "/" + path.removeprefix("file:").lstrip("/")
        return np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
    with _open(path, "rb") as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the parts under ``path``; the manifest (one row a part, with its base) is written beside them and returned."""
    spark = docs.sparkSession

    def run(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        name, first, counts, ids, out = f"{path}/data/part-{uuid.uuid4().hex}", None, [], [], None
        with task(enc.memo.forget):
            for batch in slices(batches, 256):
                if out is None:
                    out, first = _open(f"{name}.bin", "wb"), (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
                ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).copy())
                for raw in enc.encode(batch.column(2).to_pylist()):
                    out.write(raw)
                    out.write(end)
                    counts.append(len(raw) // enc.width + 1)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        for tail, values in (("idx", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with _open(f"{name}.{tail}", "wb") as f:
                f.write(values.tobytes())
        row = [*first, name, enc.width, len(counts), int(offsets[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    parts = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").mapInArrow(run, MANIFEST)
    parts.write.parquet(f"{path}/parts")
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_key")  # one row a part
    manifest = spark.read.parquet(f"{path}/parts").withColumn("base", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                data = load(f"{r['file']}.bin", "<u2" if r["width"] == 2 else "<u4")
                offsets = load(f"{r['file']}.idx", "<u8").astype(np.int64)
                docs = np.array(load(f"{r['file']}.doc", "<i8"))
                for at in range(0, len(docs), 10_000):
                    d, o = docs[at : at + 10_000], offsets[at : at + 10_001]
                    crc = [zlib.crc32(data[o[i] : o[i + 1]].astype("<u4").tobytes()) for i in range(len(d))]
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == NULL_ID), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{path}/manifest").select("file", "width", "base")
    n = manifest.count()  # parts, not documents
    return manifest.repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
