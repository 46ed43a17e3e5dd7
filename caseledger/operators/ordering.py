"""Ranks, running totals and exact quantiles that never need one big task.

A window over a hot key, or over no key, sorts everything it covers in one
task. Here the rows of hot keys are first cut into *bands*: consecutive slices of the sort
order of about equal size. A window then runs inside ``(key, band)``, the band
totals (a few rows per key) are accumulated in a second small window, and the
two are added. A value that alone fills a band is cut further by the next sort
column, so ties do not defeat the split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.scalars import hash32

BAND = "_band"
HOT_ROWS = 2_000_000  # rows of one key that a single task may sort
LAST = 1 << 60  # band of null, which sorts last whatever the direction
Order = Sequence[tuple[str, bool]]  # (column, ascending)

_NUMERIC = (T.NumericType, T.BooleanType)


def band_count(spark: SparkSession, most: int = 4096) -> int:
    """Bands for this cluster: four per shuffle partition, 32 at least."""
    return max(32, min(most, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]


def _as_number(df: DataFrame, name: str, up: bool) -> Column | None:
    """A double that rises along the sort direction, or None for text and structs."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, (T.TimestampNTZType, T.DateType)):
        c = (F.datediff(c, F.lit("1970-01-01")).cast("long") * 86400
             + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))
    elif not isinstance(kind, _NUMERIC):
        return None
    value = c.cast("double")
    return value if up else -value


def _text_edges(df: DataFrame, name: str, up: bool, bands: int) -> Column:
    """Band of a text column: position among a fixed-size hash sample of its values."""
    sample = (df.select(name).where(F.col(name).isNotNull()).distinct()
              .orderBy(hash32(F.col(name)), name).limit(bands * 8))
    values = sorted((r[0] for r in sample.collect()), key=lambda s: s.encode())
    edges = values[8::8]
    if not edges:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(name)))
    return below if up else F.lit(len(edges)) - below


def with_band(df: DataFrame, order: Order, bands: int | None = None,
              source: DataFrame | None = None) -> DataFrame:
    """Adds ``_band``, non-decreasing along ``order`` and of about equal row counts.

    Edges come from one column-pruned quantile pass; at most ``bands`` numbers
    reach the driver. Values found on several quantiles are heavy and get bands
    of their own, which the next numeric sort column splits again. ``source``
    names the ungrouped input of an aggregated ``df``, so that the pass needs
    no shuffle.
    """
    bands = bands or band_count(df.sparkSession)
    name, up = order[0]
    value = _as_number(df, name, up)
    if value is None:
        return df.withColumn(BAND, F.coalesce(_text_edges(df, name, up, bands).cast("long"), F.lit(LAST)))

    probs = [i / bands for i in range(1, bands)]
    work = df.withColumn("_v0", value)
    seen = work if source is None else source.withColumn("_v0", value)
    found = seen.where(F.col("_v0").isNotNull() & ~F.isnan("_v0")).agg(
        F.percentile_approx("_v0", probs, 4 * bands)).first()[0] or []
    distinct = sorted(set(found))
    heavy = sorted({v for i, v in enumerate(found) if i and found[i - 1] == v})
    work = _bucket(work, "_v0", distinct, heavy, "_b0")
    band = F.col("_b0").cast("long")
    inner_last = F.lit(2 * bands + 3)

    if heavy and len(order) > 1:
        tied = work.where(F.col("_v0").isin(*heavy))
        second = _as_number(df, order[1][0], order[1][1])
        if second is not None:
            work = work.withColumn("_v1", second)
            inner = tied.withColumn("_v1", second).where(F.col("_v1").isNotNull() & ~F.isnan("_v1")).agg(
                F.percentile_approx("_v1", probs, 4 * bands)).first()[0] or []
            work = _bucket(work, "_v1", sorted(set(inner)), [], "_b1")
            # as the sort says: null last, NaN above every number
            inside = (F.when(F.col("_v1").isNull(), inner_last).when(F.isnan("_v1"), inner_last - 1 if order[1][1] else F.lit(0))
                      .otherwise(F.col("_b1").cast("long") + 1))
            sub = F.when(F.col("_v0").isin(*heavy), inside).otherwise(F.lit(0))
            band = band * F.lit(2 * bands + 6) + sub
    # never null, so that no null filter is inferred on one side of the self-join only
    band = F.when(F.col("_v0").isNull(), F.lit(LAST)).when(F.isnan("_v0"), F.lit(LAST - 1 if up else -1)).otherwise(band)
    return work.withColumn(BAND, F.coalesce(band.cast("long"), F.lit(LAST))).drop("_v0", "_b0", "_v1", "_b1")


def _bucket(df: DataFrame, value: str, edges: list[float], heavy: list[float], out: str) -> DataFrame:
    splits = sorted(set(edges) | {math.nextafter(v, math.inf) for v in heavy})
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *[s for s in splits if math.isfinite(s)], math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


KEY = "_key"


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the keys as one struct: it is never null, and equal where all keys are equal or both null."""
    return rows.withColumn(KEY, F.struct(*keys))


def hot_keys(rows: DataFrame, keys: Sequence[str], most_rows: int) -> DataFrame | None:
    """Keys (as ``_key``) with more than ``most_rows`` rows, or None when there are none.

    One pass over the key columns with map-side combine. The keys stay a table:
    there is no bound of their number, so Spark chooses how to join them.
    """
    counts = keyed(rows, keys).groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= most_rows:
        return None
    return counts.where(F.col("_n") > most_rows).drop("_n")


def running_totals(rows: DataFrame, keys: Sequence[str], order: Order, sums: dict[str, str],
                   bands: int | None = None, grouped: bool = True, source: DataFrame | None = None,
                   hot_rows: int | None = None, rows_per_key: int | None = None,
                   grand: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` (output name -> input column) per key.

    Keys of ordinary size use one plain window, and so does a whole table of at
    most ``hot_rows`` rows. Keys above that are split off and go through bands;
    a larger table without keys does as a whole. Both ways place null last and
    NaN above every number, and a null key is a key like any other.
    ``source`` is the ungrouped input of aggregated ``rows``, if there is one:
    sizes and band edges are then read from it without a shuffle. A caller that
    knows an upper bound of ``rows_per_key`` spares the size pass. ``grand``
    (output name -> input column, one of those summed) adds each key's total
    without another join.
    """
    keys = list(keys)
    by = sort_columns(order)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if not keys and rows_per_key is None:
        rows_per_key = (rows if source is None else source).count()
    if rows_per_key is not None:
        if rows_per_key <= hot_rows:
            return _plain(rows, keys, by, sums, grand)
        return _two_level(with_band(rows, order, bands, source), keys, by, sums, grouped, grand)
    hot = hot_keys(rows if source is None else source, keys, hot_rows)
    if hot is None:
        return _plain(rows, keys, by, sums, grand)
    cold = _plain(keyed(rows, keys).join(hot, KEY, "left_anti").drop(KEY), keys, by, sums, grand)
    split = keyed(rows, keys).join(hot, KEY, "left_semi").drop(KEY)
    seen = None if source is None else keyed(source, keys).join(hot, KEY, "left_semi").drop(KEY)
    return cold.unionByName(_two_level(with_band(split, order, bands, seen), keys, by, sums, grouped, grand))


def _plain(rows: DataFrame, keys: list[str], by: list[Column], sums: dict[str, str],
           grand: dict[str, str] | None = None) -> DataFrame:
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    w = whole.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.sum(c).over(w).alias(o) for o, c in sums.items()],
                       *[F.sum(c).over(whole).alias(o) for o, c in (grand or {}).items()])


def _two_level(banded: DataFrame, keys: Sequence[str], by: list[Column], sums: dict[str, str],
               grouped: bool = True, grand: dict[str, str] | None = None) -> DataFrame:
    """``grouped`` inputs are aggregates, dearer to build than to keep whole: the
    totals side then reads the very same columns, so Spark reuses one exchange
    instead of building the input twice. Row inputs keep the two sides apart:
    the totals side scans only its own columns and combines before its shuffle.
    """
    kept = [c for c in banded.columns if c != BAND]
    by_key = [KEY] if keys else []
    values = [c for c in kept if c not in keys] if grouped else []
    if keys:
        banded = keyed(banded, keys)
    placed = banded.repartition(*by_key, BAND)
    inside = Window.partitionBy(*by_key, BAND).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(inside).alias(o) for o, c in sums.items()])
    totals = (placed if grouped else banded).groupBy(*by_key, BAND).agg(
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()], *[F.max(c).alias(f"_m_{c}") for c in values])
    whole = Window.partitionBy(*(by_key or [F.lit(0)]))
    earlier = whole.orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    by_input = {c: o for o, c in sums.items()}
    grand = grand or {}
    offsets = totals.select(
        *by_key, BAND,
        *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_t_{by_input[c]}").over(whole).alias(o) for o, c in grand.items()],
        *[f"_m_{c}" for c in values])
    joined = local.join(offsets, [*by_key, BAND])
    for c in values:  # always true: a band's maximum is null only if all its values are
        joined = joined.where(F.col(f"_m_{c}").isNotNull() | F.col(c).isNull())
    return joined.select(*kept, *[(F.col(o) + F.col(f"_o_{o}")).alias(o) for o in sums], *grand)


def rank_within(df: DataFrame, keys: Sequence[str], order: Order, out: str,
                bands: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """1-based row number per key; ``order`` should identify the row."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), keys, order,
                          {out: "_one"}, bands, grouped=False, hot_rows=hot_rows).drop("_one")


def hash_index(df: DataFrame, keys: Sequence[str], identity: Sequence[str], out: str,
               salt: str = "", size: str | None = None) -> DataFrame:
    """Dense 0-based index per key in stable-hash order of ``identity``, and on
    request the ``size`` of the key beside it.

    The hash is uniform, so its leading bits are the bands: no quantile pass.
    """
    bands = band_count(df.sparkSession, 65536)
    hashed = (df.withColumn("_h", hash32(F.lit(salt), *[F.col(c) for c in identity]))
              .withColumn(BAND, F.coalesce(
                  F.floor(F.col("_h").cast("double") / F.lit(4294967296.0) * bands).cast("long"), F.lit(-1).cast("long")))
              .withColumn("_one", F.lit(1).cast("long")))
    by = [F.col("_h"), *[F.col(c) for c in identity]]
    return (_two_level(hashed, keys, by, {out: "_one"}, grouped=False, grand={size: "_one"} if size else None)
            .withColumn(out, F.col(out) - 1).drop("_h", "_one"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      out: str = "percentile_value", bands: int | None = None,
                      hot_rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles: rows ``(keys, p, out)``.

    Works on distinct values with counts, so it neither buffers a group nor
    sorts it in one task.
    """
    keys = list(keys)
    raw = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = raw.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    joined = running_totals(counts, keys, [("_v", True)], {"_cum": "_n"}, bands, source=raw, hot_rows=hot_rows,
                            grand={"_size": "_n"})
    spots = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("pos"))
        for p in probs])
    hit = (joined.select(*keys, "_v", "_n", "_cum", F.explode(spots).alias("_s"))
           .select(*keys, "_v", F.col("_s.p").alias("p"),
                   F.floor("_s.pos").alias("_lo"), F.ceil("_s.pos").alias("_hi"),
                   (F.col("_s.pos") - F.floor("_s.pos")).alias("_f"),
                   (F.col("_cum") - F.col("_n")).alias("_from"), F.col("_cum").alias("_to")))
    low = (F.col("_lo") >= F.col("_from")) & (F.col("_lo") < F.col("_to"))
    high = (F.col("_hi") >= F.col("_from")) & (F.col("_hi") < F.col("_to"))
    return (hit.where(low | high).groupBy(*keys, "p")
            .agg((F.max(F.when(low, F.col("_v"))) * (1 - F.max("_f"))
                  + F.max(F.when(high, F.col("_v"))) * F.max("_f")).alias(out)))
