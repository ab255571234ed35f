"""Reproducible train/test splits and fold ids from a hash of the row key.

The hash is plain integer arithmetic on the key columns (no engine-specific
hash function), so any engine reproduces the same split. All splits are
computed where the rows are (a projection), except the exact stratified
split, which needs per-class counts (see :func:`stratified_split`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondo.session import staged

P = 1000003          # prime modulus of the key mix
MIX = (7919, 104729, 1299709, 15485863)
SPREAD = (2654435761, 4294967296)  # Knuth multiplicative hash to 32 bits


def key_hash_sql(key: list[str]) -> str:
    """Hash of up to four integer key columns (one of ``P`` values, spread
    over 32 bits), as SQL text valid in Spark SQL and DuckDB. Remainders of
    negative keys are made positive."""
    terms = " + ".join(f"((CAST({k} AS BIGINT) % {P} + {P}) % {P}) * {m}" for k, m in zip(key, MIX))
    return f"((({terms}) % {P}) * {SPREAD[0]} % {SPREAD[1]})"


def key_hash(key: list[str]) -> Column:
    return F.expr(key_hash_sql(key))


def bucket_sql(key: list[str], buckets: int = 100) -> str:
    return f"({key_hash_sql(key)} % {buckets})"


def train_test_split(df: DataFrame, key: list[str], test_pct: int = 20,
                     out: str = "split") -> DataFrame:
    """``test`` when the key's bucket (0..99) is below ``test_pct``."""
    return df.withColumn(out, F.when(F.expr(bucket_sql(key)) < test_pct, "test")
                         .otherwise("train"))


def bucket_counts(df: DataFrame, key: list[str], target: str = "y", bits: int = 16) -> DataFrame:
    """Rows per class and hash bucket (``_b``), at most ``2**bits`` rows per
    class, written once: the split and the folds both start from them."""
    return staged(df.withColumn("_b", F.shiftright(key_hash(key), 32 - bits)).groupBy(target, "_b")
                  .agg(F.count(F.lit(1)).alias("_n")), "bucket-counts")


def stratified_split(df: DataFrame, key: list[str], target: str = "y",
                     test_frac: float = 0.3, out: str = "split",
                     coarse_bits: int = 16, counts: DataFrame | None = None) -> DataFrame:
    """Exact stratified split: in each class the ``floor(test_frac * n_c +
    0.5)`` rows with the smallest ``(hash, key)`` form the test set.

    No class-wide window (a class may be a third of the table):
    (1) counts per (class, coarse hash bucket), at most ``2**coarse_bits``
    rows per class, and a running sum over them find each class's boundary
    bucket; (2) only the rows of the boundary buckets are ranked, giving one
    cutoff ``(hash, key)`` per class (a few numbers on the driver); (3) the
    split itself is a projection against the broadcast cutoff table.
    ``counts`` are those of :func:`bucket_counts`, where they are known.
    """
    h = key_hash(key)
    shift = 32 - coarse_bits
    base = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), shift))
    if counts is None:
        counts = base.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wcls = Window.partitionBy(target)
    wcum = Window.partitionBy(target).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per = counts.select(
        target, "_b", "_n",
        F.sum("_n").over(wcum).alias("_cum"),
        F.floor(F.sum("_n").over(wcls) * F.lit(float(test_frac)) + F.lit(0.5)).alias("_target"))
    # the boundary bucket: first bucket whose running count reaches the target
    bound = per.where((F.col("_cum") >= F.col("_target"))
                      & (F.col("_cum") - F.col("_n") < F.col("_target"))) \
        .select(target, F.col("_b").alias("_bb"),
                (F.col("_target") - (F.col("_cum") - F.col("_n"))).alias("_need"))
    # one row per class: rank the boundary bucket's rows, keep the last test row
    wr = Window.partitionBy(target).orderBy("_h", *key)
    cut = base.join(F.broadcast(bound), target).where(F.col("_b") == F.col("_bb")) \
        .withColumn("_r", F.row_number().over(wr)).where(F.col("_r") == F.col("_need")) \
        .select(target, "_bb", F.struct("_h", *key).alias("_cut"))
    cut_rows = cut.collect()
    cuts = df.sparkSession.createDataFrame(cut_rows, cut.schema)
    j = base.join(F.broadcast(cuts), target, "left")
    in_test = (F.col("_b") < F.col("_bb")) | (
        (F.col("_b") == F.col("_bb")) & (F.struct("_h", *key) <= F.col("_cut")))
    # classes with a zero target have no cutoff: all train
    return j.select(*df.columns, F.when(F.coalesce(in_test, F.lit(False)), "test")
                    .otherwise("train").alias(out))


def fold_ids(df: DataFrame, key: list[str], folds: int = 5, out: str = "fold") -> DataFrame:
    """Fold number 0..folds-1 from the key hash (for ``CrossValidator``'s
    ``foldCol``)."""
    return df.withColumn(out, (key_hash(key) % folds).cast("int"))


def stratified_folds(df: DataFrame, key: list[str], target: str = "y", folds: int = 5,
                     out: str = "fold") -> DataFrame:
    """Fold number 0..folds-1, dealt in turn to the rows of each class in the
    order of the key hash. The dealing runs inside hash ranges, each starting
    where the one before it ended, so that no class meets in one task and the
    folds of a class differ by at most one row."""
    base = df.withColumn("_h", key_hash(key)).withColumn("_b", F.shiftright(F.col("_h"), 20))
    counts = base.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(target).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(target).alias("_t"), F.col("_b").alias("_sb"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", *key)) - 1
    ranked = base.withColumn("_r", place)
    return (ranked.join(starts, ranked[target].eqNullSafe(starts["_t"]) & (F.col("_b") == F.col("_sb")))
            .withColumn(out, ((F.col("_start") + F.col("_r")) % folds).cast("int"))
            .select(*df.columns, out))


def folds_of(df: DataFrame, wanted: Column, key: list[str], target: str = "y", folds: int = 5,
             out: str = "fold", bits: int = 16, counts: DataFrame | None = None,
             some: DataFrame | None = None) -> DataFrame:
    """The ``wanted`` rows of ``df``, with the fold that :func:`stratified_folds`
    deals them among all rows. Counts per class and hash bucket give where a
    bucket starts; only rows of buckets with a wanted row are shuffled and
    ranked, of the others nothing but the counts. A pass is saved by each of
    ``counts`` (of :func:`bucket_counts`) and ``some``, rows of ``df`` among
    which all wanted ones are."""
    def placed(rows):
        return rows.withColumn("_h", key_hash(key)).withColumn("_b", F.shiftright(F.col("_h"), 32 - bits)) \
            .withColumn("_w", F.coalesce(wanted, F.lit(False)))

    base = placed(df)
    before = Window.partitionBy(target).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    if counts is None:
        counts = base.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_w").alias("_any"))
        # at most ``2**bits`` rows per class
        starts = counts.select(F.col(target).alias("_t"), F.col("_b").alias("_sb"), "_any", start).where("_any")
    else:
        held = staged(placed(df if some is None else some).where("_w").select(
            F.col(target).alias("_wt"), F.col("_b").alias("_wb")).distinct(), "wanted-buckets")
        # a look-up of the bucket alone leaves few rows for the one of class and bucket
        base = base.join(F.broadcast(held.select(F.col("_wb").alias("_b")).distinct()), "_b", "left_semi")
        every = counts.select(F.col(target).alias("_t"), F.col("_b").alias("_sb"), start)
        # at most ``2**bits`` rows per class
        starts = every.join(F.broadcast(held), F.col("_t").eqNullSafe(F.col("_wt"))
                            & F.col("_sb").eqNullSafe(F.col("_wb")), "left_semi")
    rest = [c for c in df.columns if c not in {*key, target}]
    # what does not order the rows travels only with the wanted ones
    slim = base.select(*key, target, "_h", "_b", "_w",
                       F.when(F.col("_w"), F.struct(*[F.col(c) for c in rest])).alias("_rest"))
    near = slim.join(F.broadcast(starts), slim[target].eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_sb")))
    place = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", *key)) - 1
    return near.withColumn("_r", place).where("_w").select(
        *key, target, *[F.col(f"_rest.`{c}`").alias(c) for c in rest],
        ((F.col("_start") + F.col("_r")) % folds).cast("int").alias(out))
