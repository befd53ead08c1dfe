"""O10 train_test_split: deterministic 80/20 split, by buckets or exact.

A hash bucket in 0..99 is stable under re-partitioning and task retries
(unlike ``randomSplit``), so every rerun and the SQL oracle see the same
sides.  When the input already carries a bucket column it is used as is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SPLIT_SEED, TRAIN_PERCENT

TRAIN_FLAG = "is_train"


def split_bucket(key_cols: list[str], seed: int = SPLIT_SEED):
    return F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(100))


def with_split(df: DataFrame, *, bucket_col: str = "split_bucket",
               key_cols: list[str] | None = None,
               train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add boolean ``is_train`` (bucket < train_percent; a null bucket is test)."""
    if bucket_col in df.columns:
        bucket = F.col(bucket_col)
    else:
        if not key_cols:
            raise ValueError("need key_cols to hash when no bucket column exists")
        bucket = split_bucket(key_cols)
    # a row without a bucket is in the test set: it must not feed the statistics
    return df.withColumn(TRAIN_FLAG, F.coalesce(bucket < F.lit(train_percent), F.lit(False)))


def train_test_split(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    s = with_split(df, **kw)
    return (s.where(F.col(TRAIN_FLAG)).drop(TRAIN_FLAG),
            s.where(~F.col(TRAIN_FLAG)).drop(TRAIN_FLAG))


def row_hash(key_cols: list[str], seed: int = SPLIT_SEED):
    """128 bits of a row's key as two 60-bit numbers and a rest."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]))
    part = lambda start, n: F.conv(F.substring(text, start, n), 16, 10).cast("long")
    return part(1, 15), part(16, 15), part(31, 2)


# Bits of a hash word that one histogram pass settles.
PASS_BITS = 12
WORD_BITS = (60, 60, 8)


def smallest(hashed: DataFrame, words: list[str], k: int) -> tuple[dict[str, int], int]:
    """The k-th smallest hash of a table, word by word, and how many rows with
    just this hash belong to the k smallest.

    Each pass counts rows by the next bits among those that agree with what is
    known so far: at most ``2 ** PASS_BITS`` counts, whatever the table, which
    are the only thing that reaches the driver.  Nothing is sorted."""
    known: dict[str, int] = {}
    left = k
    rows = hashed
    for word, bits in zip(words, WORD_BITS, strict=True):
        done, value = 0, 0
        while done < bits:
            n = min(PASS_BITS, bits - done)
            shift = bits - done - n
            digit = F.shiftright(word, shift).bitwiseAND(F.lit((1 << n) - 1))
            for d, count in sorted(rows.groupBy(digit.alias("d")).count().collect()):
                if left <= count:
                    break
                left -= count
            value, done = value << n | d, done + n
            rows = rows.where(F.shiftright(word, shift) == F.lit(value))
            if count == left:  # all of them: the largest hash with these bits
                known[word] = ((value + 1) << shift) - 1
                return {**known, **{w: (1 << b) - 1 for w, b in zip(words, WORD_BITS, strict=True) if w not in known}}, -1
        known[word] = value
    return known, left


def exact_split(df: DataFrame, *, key_cols: list[str], test_percent: int = 100 - TRAIN_PERCENT, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``is_train`` so that exactly ``ceil(rows * test_percent / 100)`` rows are
    test rows: those with the smallest hashes of their keys, whatever the
    partitioning.  Rows with equal keys are alike; where the cut falls among
    them, the first ones by partition and place are taken."""
    from ..plans.materialize import materialize

    words = ["_w0", "_w1", "_w2"]
    hashed = materialize(df.select("*", *[h.alias(w) for h, w in zip(row_hash(key_cols, seed), words, strict=True)],
                                   F.monotonically_increasing_id().alias("_row")), name="split")
    n = hashed.count()
    k = -(-n * test_percent // 100)
    if not 0 < k < n:
        return df.withColumn(TRAIN_FLAG, F.lit(k == 0))
    cut, among = smallest(hashed.select(*words), words, k)
    at = F.struct(*words)
    limit = F.struct(*[F.lit(cut[w]).alias(w) for w in words])
    if among < 0:
        return hashed.withColumn(TRAIN_FLAG, at > limit).drop(*words, "_row")
    tied = hashed.where(at == limit).select("_row")
    last = _nth(tied, "_row", among)
    return hashed.withColumn(TRAIN_FLAG, (at > limit) | ((at == limit) & (F.col("_row") > F.lit(last)))).drop(*words, "_row")


def _nth(rows: DataFrame, column: str, k: int) -> int:
    """The k-th smallest of distinct whole numbers, by the same histogram passes
    (partition numbers lie in the high bits, places in the low 33)."""
    value, done, left = 0, 0, k
    while done < 64:
        n = min(PASS_BITS, 64 - done)
        shift = 64 - done - n
        digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << n) - 1))
        for d, count in sorted(rows.groupBy(digit.alias("d")).count().collect()):
            if left <= count:
                break
            left -= count
        value, done = value << n | d, done + n
        rows = rows.where(F.shiftrightunsigned(column, shift) == F.lit(value))
    return value
