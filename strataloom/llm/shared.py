"""What several operators need: the folder that all executors share, and array hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom import importable

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a Java regular expression.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_U64 = np.uint64

#: Setting with the folder of the workspace that is open, below the shared folder.
WORKSPACE = "spark.strataloom.workspace"
#: A key of more rows than this share of all is joined by a broadcast; so many keys at most.
MOST_HOT = 1000
#: A key of fewer rows isn't worth it.
LEAST_HOT = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rsplit("/", 1)[0]
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get(WORKSPACE, None) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, whichever executor is lost."""
    at = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


class Tables:
    """Stored tables of one operation: all are removed at its end but those that its result reads.

    ``with Tables() as t: ... return t.result(df, name)``; ``store`` makes a table that later steps of the operation read.
    """

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        for spark, at in self.made:
            remove(spark, at)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        out, at = materialize_at(df, name)
        self.made.append((df.sparkSession, at))
        return out

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Whatever operators store inside the block goes to a folder of its own, which is removed at the end.

    Results read these tables, so they must be written elsewhere, or collected, before the block ends.
    """
    before, at = spark.conf.get(WORKSPACE, None), new_path(spark, "workspace")
    spark.conf.set(WORKSPACE, at)
    try:
        yield at
    finally:
        spark.conf.set(WORKSPACE, before) if before else spark.conf.unset(WORKSPACE)
        remove(spark, at)


def with_key_row(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with the one row that ``per_key`` has for their key; its column ``members`` counts the key's rows.

    ``total`` is how many rows there are. Keys of more than a thousandth of them, fewer than a thousand keys
    therefore, are broadcast and the others shuffled, so no task gets all rows of a frequent key.
    """
    frequent = F.col("members") > max(LEAST_HOT, total // MOST_HOT)
    hot, cold = F.broadcast(per_key.filter(frequent)), per_key.filter(~frequent)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(per_key.filter(frequent).select(*keys)), keys, "left_anti").join(cold, keys))


def materialize(df: DataFrame, name: str) -> DataFrame:
    return materialize_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parts_of(docs: DataFrame, part_bytes: int, most: int) -> int:
    """Partitions for a pass that orders ``docs``: the session's number, more where texts need it, no more than rows."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return int(min(most, max(1, size // part_bytes, min(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and ``text`` with null as empty; any other column, whatever its name, is left behind."""
    importable(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch, most_bytes: int = 4 << 20, column: str = "text"):
    """Zero-copy slices of an Arrow batch whose texts have about ``most_bytes`` at most, or one long text.

    A column of lists counts four bytes an entry."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    lengths = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    total, first = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most_bytes:
            yield batch.slice(first, i - first)
            total, first = 0, i
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.empty(n, dtype=_U64)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * _U64(pow(base, have, 1 << 64))
        have += take
    return out


_UP = _powers(_BASE, _BLOCK)
_DOWN = _powers(_INVERSE, _BLOCK)


def _spread(low: np.ndarray, base: int, n: int) -> np.ndarray:
    """base**i for i < n, from the stored powers below _BLOCK."""
    if n <= _BLOCK:
        return low[:n]
    return (low[None, :] * _powers(pow(base, _BLOCK, 1 << 64), -(-n // _BLOCK))[:, None]).reshape(-1)[:n]


def word_hashes(texts: list[str], lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in one array, and the place where each text's words begin.

    The second array has one entry more than texts. A word is a run of bytes without white space; its hash
    is a polynomial of its bytes, found from running sums, so no loop touches single words.
    """
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    if lower_ascii:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    inner = ~space
    edge = np.diff(inner.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(data)
    sums = np.zeros(n + 1, dtype=_U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * _spread(_UP, _BASE, n), out=sums[1:])
    down = _spread(_DOWN, _INVERSE, n)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U64))
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    hashes, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - width + 1), dtype=_U64)
    for k in range(width):
        rolled += mix(hashes[k : k + len(rolled)] + _U64(k + 1)) * _U64(2 * k + 1)
    rolled = mix(rolled + _U64(width))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            k = np.arange(b - a, dtype=_U64)
            one = (mix(hashes[a:b] + k + _U64(1)) * (_U64(2) * k + _U64(1))).sum(dtype=_U64, keepdims=True)
            out.append(mix(one + _U64(b - a)))
        else:
            out.append(np.empty(0, dtype=_U64))
    return out


def keep_scored(docs: DataFrame, score, model, passes) -> DataFrame:
    """Rows of docs whose text's score passes, in one pass without a shuffle; columns and their types stay."""
    import pyarrow as pa

    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):

        for batch in batches:
            for piece in slices(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                yield piece.filter(pa.array(passes(score(texts, sent.value))))

    return docs.mapInArrow(run, docs.schema)
