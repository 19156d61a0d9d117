"""What several operators share: tables written to the shared folder, table readers."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the code of Python operators with the tasks: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["tidemark.llm"])

#: Folder for this session where ``spark.checkpoint.dir`` is unset (tests, one machine).
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and all of Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
    return _OWN[app]


#: Scratches of this process, so that ``tidied`` finds those of the operators called within.
_OPEN: list[Scratch] = []


@contextlib.contextmanager
def tidied():
    """Deletes at its end what operators have written for themselves within; their results must have been written by then."""
    before = len(_OPEN)
    try:
        yield
    finally:
        for scratch in _OPEN[before:]:
            scratch.close()
        del _OPEN[before:]


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder and read back.

    A written table cuts the lineage (a lost executor re-reads it), fixes what
    non-deterministic columns such as row ids hold, and has a size that Spark
    knows when it decides on a broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
        self._n = 0
        self._kept: list[DataFrame] = []
        _OPEN.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` now and return the written table."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        self._kept.append(back)
        return back

    def last(self, df: DataFrame) -> DataFrame:
        """Write ``df``, delete all other tables, and return the written one."""
        before, self._kept = self._kept, []
        result = self.table(df)
        self.drop(*before)
        return result

    def close(self) -> None:
        """Delete all tables."""
        self.drop(*self._kept)
        self._kept = []

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if its rows are counted and ``most`` at most; else joined as Spark sees fit."""
    return F.broadcast(table) if table.count() <= most else table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of text that one call of a Python operator gets at most, but for a single longer text.
SLICE_BYTES = 2_000_000


def slices(batch, column: str, most: int = SLICE_BYTES):
    """The rows of a record batch in runs of bounded bytes of ``column``."""
    start = total = 0
    for k, n in enumerate(pc_lengths(batch.column(column))):
        if total and total + n > most:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def pc_lengths(values) -> list[int]:
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = values.type
    size = pc.list_value_length if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pc.binary_length
    return pc.fill_null(size(values), 0).to_pylist()


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have."""
    while wish.lower() in [c.lower() for c in df.columns]:
        wish = "_" + wish
    return wish


def add_columns(df: DataFrame, source: str, added: str, make, keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """``df`` with new columns that Python makes of column ``source``, a bounded slice of rows at a time.

    ``added``: their DDL.  ``make()`` is called once in each task and returns a
    function from an Arrow array to the new Arrow arrays.  ``keep``: the columns
    of ``df`` to pass on (all).  A new column replaces one of its name.
    ``most``: bytes of text, or items of lists, in a slice, but for a single
    longer value.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    read = free_name(df, "__source")
    narrow = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(read))
    schema = StructType([f for f in narrow.schema.fields if f.name != read] + new.fields)

    def run(batches):
        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, read, most):
                made = work(part.column(read))
                arrays = [part.column(c).cast(arrow.field(c).type) for c in kept] + [pa.array(x, type=arrow.field(f).type) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for f, x in zip(new.names, made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return narrow.mapInArrow(run, schema)


def drawn(digest: Column, share: float) -> Column:
    """Whether a 64-bit digest falls within a share, told to 1 in 2 ** 60, so that small shares of large tables are not rounded to none."""
    fine = F.pmod(digest, F.lit(1 << 20)) * F.lit(1 << 40) + F.pmod(F.shiftrightunsigned(digest, 20), F.lit(1 << 40))
    return fine < F.lit(int(share * (1 << 60)))
