"""Sequential functions of a row's values as columns, in Arrow batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch between the JVM and Python, and of the rows whose results are made at once.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 18


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Half-open ranges of neighbours with a sum of `most` at most, or of one that has more by itself."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin = i
            total = 0
        total += n
    yield begin, len(sizes)


def small_batches() -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, if it is higher: its other limit, rows, bounds nothing where texts are
    long."""
    spark, name = SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Table(dict):
    """What make(key) gives, kept for keys that come again, as words do; begun anew when it is full."""

    def __init__(self, make: Callable, most: int = 1 << 17):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def kept(name: object, make: Callable):
    """make(), once a worker. Functions travel by value, so what their modules keep ends with a task."""
    import sys

    store = sys.__dict__.setdefault("_tokenpress_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def sliced(many: Callable, returned) -> Callable[[Iterator], Iterator]:
    """From batches of a function's arguments to arrays of many(rows), a slice of a batch each."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(returned)

    def made(rows: list) -> pa.Array:
        values = many(rows)
        if not pa.types.is_struct(kind):
            return pa.array(values, kind)
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([pa.array([v[i] for v in values], f.type) for i, f in enumerate(fields)], fields=fields)

    def run(batches):
        for b in batches:
            arrays = b if isinstance(b, tuple) else (b,)
            small = sum(a.nbytes for a in arrays) <= SLICE_BYTES
            sizes = [0 if small else sum(a.slice(i, 1).nbytes for a in arrays) for i in range(len(arrays[0]))]
            for i, j in slices(sizes):
                yield made(list(zip(*(a.slice(i, j - i).to_pylist() for a in arrays))))

    return run


def slicewise(many: Callable[[list[tuple]], list], returns: str, *columns: Column | str, once: bool = False) -> Column:
    """What many(rows) gives for each of a list of rows, as tuples of the columns' values; for a struct, tuples. Results go back a slice of a
    batch at a time: lists of short strings take many times the bytes of their text, which must not be multiplied by the rows of a batch. once: a filter on the result doesn't
    repeat the function, in workers of its own, below the place where it stands."""
    from pyspark.sql.pandas.functions import ArrowUDFType
    from pyspark.sql.types import DataType

    small_batches()
    returned = DataType.fromDDL(returns)
    with warnings.catch_warnings():  # the kind of function is given, not read from type hints
        warnings.simplefilter("ignore", UserWarning)
        f = F.arrow_udf(sliced(many, returned), returned, ArrowUDFType.SCALAR_ITER)
    return (f.asNondeterministic() if once else f)(*(c if isinstance(c, Column) else F.col(c) for c in columns))


def rowwise(one: Callable, returns: str, *columns: Column | str, once: bool = False) -> Column:
    """one(values of a row) for each row."""
    return slicewise(lambda rows: [one(*r) for r in rows], returns, *columns, once=once)
