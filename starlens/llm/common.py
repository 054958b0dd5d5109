"""What the corpus operators share: scratch tables, batches of texts and hashes of words."""

from __future__ import annotations

import atexit
import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.session import checkpoint_dir

# Kernels travel inside the task, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 18
LONG_WORD = 256


def by_value(name: str) -> None:
    """Called by a module whose kernels run on executors."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again.

    Cuts lineage: the result survives lost executors.  The folder is deleted by ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/starlens-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` once everything that reads them has been stored itself."""
    for table in tables:
        _delete(table.sparkSession, table._scratch)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session has gone already
        return


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, whatever other columns ``docs`` has."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES):
    """(from, to) of consecutive texts that hold about ``limit`` bytes; a longer text is a chunk alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        if size > 1 << 22:
            _POWERS.clear()
        ups = np.full(size, _MULTIPLIER, np.uint64)
        downs = np.full(size, _INVERSE, np.uint64)
        ups[0] = downs[0] = 1
        _POWERS[size] = np.cumprod(ups), np.cumprod(downs)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values`` (uint64): equal spans have equal hashes wherever they stand."""
    n = len(values)
    ups, downs = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * ups[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))


class Words:
    """White-space words of a chunk of texts: their hashes, and ``first[d]:first[d + 1]`` for text d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False) -> None:
        data = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
        self.bytes = np.frombuffer(data.translate(LOWER) if lower else data, np.uint8)
        white = WHITE[self.bytes]
        self.starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        self.ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[1], np.cumsum(sizes) + 1])
        self.first = np.searchsorted(self.starts, self.text_at)
        self.hashes = span_hashes(self.bytes.astype(np.uint64) + np.uint64(1), self.starts, self.ends)
        # Sums of powers modulo 2**64 agree for some long words of two letters; those get another hash.
        for k in np.flatnonzero(self.ends - self.starts >= LONG_WORD):
            word = self.bytes[self.starts[k] : self.ends[k]].tobytes()
            self.hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed one by one, for the shuffle and the table that follow; other columns as they are."""
    others = [c for c in docs.columns if c != "text"]

    def kernel(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            out = [pack(t or b"") for t in as_bytes(batch.column("text"))]
            yield batch.select(others).append_column("packed", pa.array(out, pa.binary()))

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(kernel, f"{kinds}, packed binary")


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompressobj
    return [unpack().decompress(t) for t in batch.column("packed").to_pylist()]
