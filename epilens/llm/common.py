"""Helpers shared by the operators: word splitting on bytes, 64-bit word and
shingle hashes, cutting lineage in the shared folder, vectors of whole
numbers."""

from __future__ import annotations

import ctypes.util
import gc
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import epilens
from epilens.session import staging_path

# ASCII letters lowered, every other ASCII byte that is no digit a separator,
# bytes of non-ASCII characters kept.
ALNUM_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered (bytes.lower and
    bytes.split are ASCII-only)."""
    return to_bytes(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return to_bytes(text).translate(ALNUM_FOLD).split()


class WordHash:
    """Words -> 64-bit hashes. (To keep them costs more than to hash a word
    again where many words are rare.)"""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_LOW = np.uint64(0xFFFFFFFF)


def _xxh3(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """xxhash.xxh3_64_intdigest of each raw[start:stop] (none is empty): up to
    16 bytes all at once by its definition, the few longer ones by the library."""
    u = np.uint64
    at = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the 8 bytes from each place on
    n, x = (stops - starts).astype(u), at[starts]
    # 4 to 8 bytes: the last four above the first four
    h = (x << u(32) | x >> ((n - u(4)) * u(8) & u(63)) & _LOW) ^ u(0xC73AB174C5ECD5A2)
    h ^= (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))
    h *= u(0x9FB21C651E98DF25)
    h ^= (h >> u(35)) + n
    h *= u(0x9FB21C651E98DF25)
    h ^= h >> u(28)
    k = np.flatnonzero(n < 4)
    m, byte = n[k], [x[k] >> u(8) * c & u(255) for c in (u(0), n[k] >> u(1), n[k] - u(1))]
    y = (byte[0] << u(16) | byte[1] << u(24) | byte[2] | m << u(8)) ^ u(0x87275A9B)
    for shift, factor in ((33, 0xC2B2AE3D27D4EB4F), (29, 0x165667B19E3779F9)):
        y = (y ^ y >> u(shift)) * u(factor)
    h[k] = y ^ y >> u(32)
    k = np.flatnonzero((n > 8) & (n <= 16))
    p, q = x[k] ^ u(0x6782737BEA4239B9), at[stops[k] - 8] ^ u(0xAF56BC3B0996523A)
    p0, p1, q0, q1 = p & _LOW, p >> u(32), q & _LOW, q >> u(32)
    mid = (p0 * q0 >> u(32)) + (p1 * q0 & _LOW) + p0 * q1
    y = n[k] + p.byteswap() + q + (p * q ^ (p1 * q0 >> u(32)) + (mid >> u(32)) + p1 * q1)
    y = (y ^ y >> u(37)) * u(0x165667919E3779F9)
    h[k] = y ^ y >> u(32)
    k = np.flatnonzero(n > 16)
    h[k] = WordHash().of([raw[a:z] for a, z in zip(starts[k].tolist(), stops[k].tolist())])
    return h


def shingled(texts: list[bytes], width: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The shingle hashes of each text (see ``space_words``, ``WordHash`` and
    ``shingle_hashes``), of about ``most`` bytes of texts at a time."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < most):
            size += len(texts[last]) + 1
            last += 1
        raw = b" ".join(texts[first:last]).translate(_FOLD)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = np.frombuffer(raw, np.uint8) == 32
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, stops = edges[::2], edges[1::2]
        every = shingle_hashes(_xxh3(raw, starts, stops), width)
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts[first:last]]])
        own = np.searchsorted(starts, bounds).tolist()
        for a, z in zip(own, own[1:]):
            yield every[a : max(a, z - width + 1)]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n] * _ODD
    for j in range(1, width):
        h += words[j : j + n]
        h *= _ODD
        h ^= h >> np.uint64(29)
    return mix64(h)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes. A text of fewer words, but not none,
    has its whole sequence as its one shingle."""
    if 0 < len(words) < width:
        return shingle_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(shingle_hashes(words, width))


def lean(run: Callable) -> Callable:
    """``run`` of a task's batches, giving memory back at its end: a worker
    lives on for the next task, and what its allocators keep adds up."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
            ctypes.CDLL(libc).malloc_trim(0)

    return task


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result is written:
    its cleaner does so once the driver's JVM has collected their handles,
    which otherwise may wait until long after the disk is full. The first
    collection frees what holds the query, the second the handles."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def cut(df: DataFrame, wide: bool = False, label: str = "step") -> DataFrame:
    """The rows of ``df``, computed once and written as a table in the shared
    checkpoint folder: later jobs read them there, whichever executors are
    lost. (``checkpoint()`` would keep the size that Spark estimated for the
    plan; in a loop of joins that estimate is squared in every round until it
    fills the driver's memory. A table has its own size.) ``wide``: much more
    was shuffled for the rows than they are."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    if wide:
        _free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """``cut`` of rows for which much was shuffled."""
    return cut(df, True, label)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS, BATCH_BYTES = 500, "4m"


def _ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run and however the
    driver found it: Spark copies one small archive of its code to them."""
    sc = spark.sparkContext
    if getattr(sc, "_epilens_shipped", False):
        return
    root = Path(epilens.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="epilens-code-")) / "epilens_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._epilens_shipped = True


def prepare(spark: SparkSession) -> None:
    """What every operator with Python tasks needs first: the code on the
    workers, and a bound by bytes (and by rows for short texts) on an Arrow
    batch, which lies in the executor outside its heap and in the worker."""
    _ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def row_batches(spark: SparkSession, rows: int = 1 << 13) -> Iterator[None]:
    """Arrow batches of up to ``rows`` rows (and the bytes of ``prepare``), for
    jobs run inside, whose Python tasks read many short rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def usable(vector: Column) -> Column:
    """Whether a vector is there, with finite components only."""
    x = vector.cast("array<double>")
    return x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * component), as doubles: whole numbers of any size (the
    SQL floor overflows a long for huge values)."""

    def floor(x):
        return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)

    return F.transform(vector.cast("array<double>"), lambda e: floor(e * F.lit(float(scale))))


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x (of whole numbers) with q, or
    with each row of q; clipped to +-(2**63 - 1)."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2.0**53:
        return (x @ q.T).astype(np.int64)
    limit = 2**63 - 1
    whole = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in np.atleast_2d(q)] for r in x]
    out = np.array([[max(-limit, min(limit, s)) for s in r] for r in whole], np.int64)
    return out.reshape(len(x), *q.shape[:-1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

