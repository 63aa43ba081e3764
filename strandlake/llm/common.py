"""Tables, shared storage and Arrow batches used by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_path, written

__all__ = ["Bits", "free_name", "salt_of", "shared_path", "table", "whole_groups", "without_ids", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that hold every row of each key they hold; the batches come sorted by integer keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        joined = pa.Table.from_batches(held)
        same = np.ones(count, dtype=bool)
        for k in keys:
            v = joined[k].to_numpy()
            same &= v == v[-1]
        cut = count - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield joined.slice(0, cut)
        rest = joined.slice(cut).combine_chunks()
        held, count = rest.to_batches(), rest.num_rows
    if count:
        yield pa.Table.from_batches(held)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salt_of(column: Column, n: int | Column, seed: int = 7) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(n) if isinstance(n, int) else n).cast("int")


class Bits:
    """A bitmap of hashes: which values may be in a set. Hashes not in it surely are not.

    It has about 16 bits for each value and 2 ** MOST (16 MB) at the very most, so its size is bounded
    whatever the set; a set that fills it only lets more values through. Exact joins follow."""

    MOST, LEAST = 27, 16

    def __init__(self, words: np.ndarray, shift: int):
        self.words, self.shift = words, shift

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bits:
        """Of a column of 64-bit hashes; its top bits are the place."""
        k = min(cls.MOST, max(cls.LEAST, (16 * df.count()).bit_length()))
        place = df.select(F.shiftrightunsigned(column, 64 - k).alias("at"))
        word = place.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        got = word.toArrow()  # 2 ** (k - 6) rows at most
        words = np.zeros(1 << (k - 6), dtype=np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return cls(words, 64 - k)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(self.shift)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def column(self, hashes: Column) -> Column:
        """Whether a column's hashes may be in the set."""
        held = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def may(x):
            return type(x)(held.value.has(x.to_numpy(dtype=np.int64)))

        return may(hashes)


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose id is in gone(doc_id); null is an id. Of the ids in again(doc_id), rows that are equal in every column become one.

    Only rows whose id may be in one of the two are shuffled; all others stay where they are."""
    ids = gone.select("doc_id") if again is None else gone.select("doc_id").unionByName(again.select("doc_id"))
    touched = Bits.of(ids.select(F.xxhash64("doc_id").alias("h")), "h")
    may, name = touched.column(F.xxhash64(docs[id_col].cast("long"))), free_name(docs, "__id")
    out = gone.select(F.col("doc_id").alias(name)).distinct()
    rest = docs.where(may)
    rest = rest.join(out, rest[id_col].eqNullSafe(out[name]), "left_anti")
    return docs.where(~may).unionByName(rest if again is None else rest.dropDuplicates())
