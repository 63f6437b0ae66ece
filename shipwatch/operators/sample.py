"""Exact-size, seeded, repeatable selection of rows by hash rank.

The rows kept are the ``k`` with the smallest ``md5("<seed>-<key>")``, so the
result is the same under any partitioning and matches
``ORDER BY md5(...) LIMIT k`` exactly, without a global sort or a single-task
top-k. The first hash digits cut the rows into buckets; a histogram finds the
bucket in which the running count reaches ``k``. While that bucket holds more
than ``EDGE_ROWS`` rows its own rows are cut by the next digits, and the hash
of the last row kept is read from what is left. A row is kept if its hash is
not above that limit: a comparison with a literal per group, so the rows
themselves are neither shuffled nor joined.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from shipwatch import fixed_values as fv

BUCKET_HEX = 4          # digits that one histogram looks at
EDGE_ROWS = 10_000      # hashes of one group that may be ordered on the driver
HASH_HEX = 32


def seeded_hash(key: Column | str, seed: int = fv.RANDOM_SEED) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))


def _literal_of(values: dict, column: str, kind: str) -> Column:
    """The value of the row's group, as a chain of literals (one per group)."""
    out = F.lit(None).cast(kind)
    for group, value in values.items():
        out = F.when(F.col(column).eqNullSafe(F.lit(group)), F.lit(value).cast(kind)).otherwise(out)
    return out


def hash_limits(hashed: DataFrame, h: str, group: str, quotas) -> dict:
    """Per group the hash of its last row kept (``""``: none is, ``None``: all are).

    ``quotas`` gives rows to keep per group from the group sizes. Groups are
    few (classes of a label); each round reads one histogram of at most
    16 ** BUCKET_HEX counts a group, summed per task first.
    """
    def histogram(rows: DataFrame, width: int) -> dict:
        counts: dict = {}
        for g, prefix, n in rows.groupBy(group, F.substring(h, 1, width)).agg(F.count(F.lit(1))).collect():
            counts.setdefault(g, []).append((prefix, n))
        return {g: sorted(x) for g, x in counts.items()}

    counts = histogram(hashed, BUCKET_HEX)
    sizes = {g: sum(n for _, n in x) for g, x in counts.items()}
    wanted = quotas(sizes)
    limits = {g: None if wanted.get(g, 0) >= n else "" for g, n in sizes.items()}
    need = {g: wanted[g] for g, n in sizes.items() if 0 < wanted.get(g, 0) < n}
    edge = {}                                           # group: prefix of its edge bucket, rows in it
    width = BUCKET_HEX
    wide = set(need)
    while wide:
        for g in wide:
            for prefix, n in counts[g]:
                if need[g] <= n:
                    edge[g] = (prefix, n)
                    break
                need[g] -= n
        wide = {g for g in wide if edge[g][1] > EDGE_ROWS and width < HASH_HEX}
        if wide:
            width += BUCKET_HEX
            counts = histogram(hashed.where(_inside(wide, edge, group, h)), width)
    if need:
        last: dict = {g: [] for g in need}
        for g, x in hashed.where(_inside(set(need), edge, group, h)).select(group, h).collect():
            last[g].append(x)
        limits |= {g: sorted(x)[need[g] - 1] for g, x in last.items()}
    return limits


def _inside(groups: set, edge: dict, group: str, h: str) -> Column:
    """The row lies in the edge bucket of its group."""
    out = F.lit(False)
    for g in groups:
        out = out | (F.col(group).eqNullSafe(F.lit(g)) & F.col(h).startswith(edge[g][0]))
    return out


def mark_bottom_k(df: DataFrame, key: str, quotas, group: str, seed: int = fv.RANDOM_SEED,
                  flag: str = "selected") -> DataFrame:
    """Add boolean ``flag``: row is among the smallest hashes of its group.

    ``quotas`` maps group sizes (a dict) to the rows to mark per group;
    ``key`` must be unique within a group.
    """
    h = "_h"
    hashed = df.select(group, seeded_hash(key, seed).alias(h)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        limits = hash_limits(hashed, h, group, quotas)
    finally:
        hashed.unpersist()
    return df.withColumn(flag, is_kept(seeded_hash(key, seed), limits, group))


def is_kept(hashed: Column, limits: dict, group: str) -> Column:
    """The row's hash is not above the limit of its group."""
    limit = _literal_of({g: "g" if x is None else x for g, x in limits.items()}, group, "string")
    return F.coalesce(hashed <= limit, F.lit(False))


def exact_sample(df: DataFrame, key: str, n: int = fv.ORDER_SAMPLE_ROWS,
                 seed: int = fv.RANDOM_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, seeded and repeatable."""
    one = df.withColumn("_all", F.lit(0))
    return mark_bottom_k(one, key, lambda sizes: {0: n}, "_all", seed).filter("selected").drop("selected", "_all")


def orders_sample(orders: DataFrame, n: int = fv.ORDER_SAMPLE_ROWS,
                  seed: int = fv.RANDOM_SEED) -> DataFrame:
    """Sample of curated order lines (whole table when it is small enough)."""
    return exact_sample(orders, "order_item_id", n, seed)


def sort_orders_sample(sample: DataFrame) -> DataFrame:
    return sample.orderBy("order_date", "order_id", "order_item_id")


def class_quotas(sizes: dict, test_fraction: float) -> dict:
    """Test rows per class from the class sizes.

    The total is ceil(fraction x n); each class gets floor(total x n_c / n)
    and the rows left over go to the classes with the largest remainders
    (ties to the smaller label). Integer arithmetic only.
    """
    share, n = Fraction(str(test_fraction)), sum(sizes.values())
    total = -(-n * share.numerator // share.denominator)
    out = {c: total * k // n for c, k in sizes.items()}
    by_rest = sorted(sizes, key=lambda c: (-(total * sizes[c] % n), c is None, c))
    for c in by_rest[:total - sum(out.values())]:
        out[c] += 1
    return out


def stratified_split(df: DataFrame, key: str, label: str,
                     test_fraction: float = fv.TEST_FRACTION,
                     seed: int = fv.RANDOM_SEED) -> DataFrame:
    """Add ``split`` = train/test with exact, stratified test sizes.

    Sizes follow ``class_quotas``; within a class the test rows are the ones
    with the smallest seeded hash of ``key``.
    """
    marked = mark_bottom_k(df, key, lambda sizes: class_quotas(sizes, test_fraction), label, seed, "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")) \
        .drop("_test")
