"""What the three classifiers share: folds by checksum and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampling hashes are compared as shares of this many steps.
GRAIN = 1 << 40


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; null for null."""
    return F.crc32(F.col(column).cast("string")) % divisor


def bounded_sample(rows: DataFrame, label: str, each: int, key: str = "doc_id") -> DataFrame:
    """About ``each`` different rows of every label (all, where there are fewer), by a hash of the key and the row.

    The shares come from counts over all rows; the counts are one row per label.  Rows equal in all columns are one.  The number drawn
    is binomial, so it exceeds ``each`` by a few roots of it at most; which rows are drawn depends on nothing but themselves.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    share = None
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        cut = F.lit(min(GRAIN, -(-GRAIN * each // max(n, 1))))
        share = F.when(F.col(label) == value, cut) if share is None else share.when(F.col(label) == value, cut)
    drawn = rows.withColumn("_drawn", F.xxhash64(*rows.columns)).where(F.pmod(F.xxhash64(key, "_drawn", F.lit("sample")), F.lit(GRAIN)) < share)
    return drawn.dropDuplicates([label, "_drawn"]).drop("_drawn")
