"""Token-id files: one compressed frame per document under a shared dictionary.

File layout (little-endian)::

    "JWIDS1\\0\\0" | sha256 of the dictionary (32 bytes)
    frames, one zstandard frame per document (ids as unsigned 32-bit)
    index, 24 bytes per document: doc_id i64, offset u64, frame length u32, number of ids u32
    footer: index offset u64, documents u64, "JWIDS1\\0\\0"

A short document is read with two small reads and one decompression.
Documents stand in ascending doc_id order within a file and from file to file.

Null text counts as empty (its ids are the end id alone).  A null doc_id sorts
first and comes back as null.  Repeated doc_ids are all kept, ordered by text.
An empty table gives no file and no row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.token_ids import encoder, in_blocks
from jointwork.operators.skew import shared_dir

MAGIC = b"JWIDS1\0\0"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
NO_ID = np.iinfo(np.int64).min
SAMPLE_DOCS = 256
SAMPLE_CHARS = 65_536
DICTIONARY_BYTES = 65_536
MANIFEST = "shard int, path string, first_id long, n_docs long, n_ids long, n_bytes long"
READ = "shard int, place long, doc_id long, in_file long, n_tokens long, ids_crc32 long"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """Dictionary from SAMPLE_DOCS documents (smallest hash of the id) of at most SAMPLE_CHARS characters."""
    import zstandard

    short = docs.filter(F.length("text") <= SAMPLE_CHARS)
    ids = [r[0] for r in short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    texts = [r[0] for r in short.filter(F.col("doc_id").isin(ids)).select("text").limit(SAMPLE_DOCS).collect()]
    end = np.array([end_id], "<u4").tobytes()
    samples = [x + end for x in encoder(vocabulary, True).encode(texts)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: frames without a dictionary
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> DataFrame:
    """Encode and write all documents; one manifest row per file.

    A file gets its name only when it is whole, so an attempt that dies leaves
    nothing behind that a reader would take for a file.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, end_id)
    digest = hashlib.sha256(dictionary).digest()
    store, base = place(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{digest.hex()}.dictionary") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(path)
        task, enc, (press, _) = TaskContext.get(), encoder(vocabulary, True), _codec(dictionary)
        end = np.array([end_id], "<u4").tobytes()
        out, at, index = None, 0, []
        final = f"{base}/ids-{task.partitionId():06d}.zids"
        part = f"{final}.{task.taskAttemptId()}"
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            for block in in_blocks(rows):
                for (doc, _), ids in zip(block, enc.encode([t or "" for _, t in block])):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(part)
                        out.write(MAGIC + digest)
                        at = len(MAGIC) + len(digest)
                    frame = press.compress(ids + end)
                    out.write(frame)
                    index.append((NO_ID if doc is None else doc, at, len(frame), len(ids) // 4 + 1))
                    at += len(frame)
        if out is None:
            return
        rows = np.array(index, INDEX)
        out.write(rows.tobytes() + np.array([at, len(rows)], "<u8").tobytes() + MAGIC)
        out.close()
        store.move(part, final)
        scheme = path.split(":", 1)[0] + "://" if ":" in path else ""
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([task.partitionId()], pa.int32()), "path": [scheme + final],
            "first_id": [None if index[0][0] == NO_ID else index[0][0]], "n_docs": [len(rows)],
            "n_ids": [int(rows["ids"].sum(dtype="u8"))], "n_bytes": [at],
        })

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_index(path: str) -> tuple[np.ndarray, bytes]:
    """Index and dictionary hash of a file."""
    store, name = place(path)
    with store.open_input_file(name) as file:
        head = file.read_at(len(MAGIC) + 32, 0)
        size = file.size()
        foot = file.read_at(24, size - 24)
        if head[:8] != MAGIC or foot[16:] != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        at, n = np.frombuffer(foot[:16], "<u8").tolist()
        return np.frombuffer(file.read_at(n * INDEX.itemsize, at), INDEX), head[8:]


def read_dictionary(path: str, digest: bytes) -> bytes:
    store, name = place(path.rpartition("/")[0])
    with store.open_input_file(f"{name}/{digest.hex()}.dictionary") as file:
        dictionary = file.read()
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError(f"the dictionary of {path} has another hash")
    return dictionary


def read_document(path: str, k: int) -> np.ndarray:
    """Ids of the k-th document of a file, without reading the others."""
    index, digest = read_index(path)
    _, expand = _codec(read_dictionary(path, digest))
    store, name = place(path)
    with store.open_input_file(name) as file:
        return np.frombuffer(expand.decompress(file.read_at(int(index["bytes"][k]), int(index["offset"][k]))), "<u4")


def read_store(manifest: DataFrame) -> DataFrame:
    """All documents of the files: id, first place over all files, number of ids, checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                index, digest = read_index(path)
                _, expand = _codec(read_dictionary(path, digest))
                store, name = place(path)
                starts = np.cumsum(index["ids"], dtype="i8") - index["ids"]
                with store.open_input_stream(name, buffer_size=1 << 20) as file:
                    file.read(len(MAGIC) + 32)
                    for lo in range(0, len(index), 4096):
                        rows = index[lo : lo + 4096]
                        ids = [expand.decompress(file.read(int(n))) for n in rows["bytes"]]
                        if [len(x) for x in ids] != (rows["ids"] * 4).tolist():
                            raise ValueError(f"{path} holds another number of ids than its index says")
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array(np.full(len(rows), shard, "i4")),
                            "place": pa.array(np.arange(lo, lo + len(rows))),
                            "doc_id": pa.array(rows["doc_id"], mask=rows["doc_id"] == NO_ID),
                            "in_file": pa.array(starts[lo : lo + len(rows)]),
                            "n_tokens": pa.array(rows["ids"].astype("i8")),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        })

    # One row per file: the running sum over files is as small as the list of files.
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    files = manifest.select("shard", "path").repartition(n)
    return (
        files.mapInArrow(read, READ).join(F.broadcast(bases), "shard")
        .select("doc_id", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
    )


@register("op8_token_store")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-store")
    return read_store(write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 0))
