"""Sums over keys of whole corpora, exchanged in packed runs.

Documents are dealt into chunks of about ``CHUNK`` bytes. A chunk sends, for every bucket of key
hashes that it has keys of, one run of its distinct sorted keys with what belongs to them; a bucket
merges its runs and answers each with a run of the same length. Runs cost a few bytes a key where
rows cost dozens. The number of chunks and that of buckets follow the size of the corpus, so that no
task holds more than a bounded part of it; a key in very many documents has one entry a chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.kernels import U64

CHUNK, BUCKET = 4 << 20, 4 << 20


def chunked(docs: DataFrame, chunks: int, *columns) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *columns, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))


def parts_of(total: int) -> tuple[int, int]:
    """Chunks and buckets for so many bytes of text."""
    return max(1, -(-total // CHUNK)), max(1, -(-total // BUCKET))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted keys have sorted buckets."""
    return ((keys >> U64(32)) * U64(buckets)) >> U64(32)


def bucket_slices(keys: np.ndarray, buckets: int):
    """(bucket, slice) of the runs of sorted keys."""
    if not len(keys):
        return
    b = bucket_of(keys, buckets)
    cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        yield int(b[i]), slice(i, j)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the differences, byte planes apart, squeezed."""
    gaps = np.diff(keys, prepend=U64(0)).astype("<u8")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def pack(values: np.ndarray) -> bytes:
    """Small numbers, byte planes apart, squeezed; the first byte is the width."""
    return bytes([values.dtype.itemsize]) + zlib.compress(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_counts(values: np.ndarray) -> bytes:
    """Unsigned numbers that are mostly small: as ``pack``, without the upper byte planes that are all zero."""
    planes = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + zlib.compress(b"".join((values >> values.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(planes)), 1)


def unpack_counts(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = planes[0].astype(dtype)
    for k in range(1, len(planes)):
        out |= planes[k].astype(dtype) << dtype(8 * k)
    return out
