"""Bootstrap without rows of unit x replicate outside a task.

A replicate draws, in each stratum of n units, n units with replacement. How often
each is drawn is decided where the unit lies: first every unit takes a Poisson number
of draws, from a hash of itself and the replicate, at a rate a little below one.
Given their sum, such numbers are distributed as that many draws with replacement;
the draws that are still missing, some sqrt(n) of n, are dealt out one by one to hashed
places. They travel as packed lists, one per block of places, and every unit gets the
replicates that draw it once more. Units carry the columns that a metric needs: a task
makes the numbers of a few units for all replicates at a time, as an array, and multiplies
them with the units' values. Only sums leave it. Poisson numbers are made once: the same
pass counts them and sums the metric, and dealt draws are added to its sums (``unit_sums``).

Should a replicate's Poisson numbers exceed n (six standard deviations), all of its
draws are dealt out instead, which leaves the distribution what it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.constants import BOOTSTRAP_REPLICATES, SEED
from ..functions.scalars import BILLION, billionths, hash_halves
from ..session import cut_lineage, ship_package, spread
from .detection import ranked_sums
from .ordering import KEY, hash_index, keyed

REPLICATE, WEIGHT = "replicate", "weight"

#: A stratum of SLACK**2 * 4**k units or more takes Poisson draws at the rate 1 - 2**-k, k up to LEVELS.
SLACK, LEVELS = 6, 14
#: Most Poisson draws of a unit that 32 bits can tell.
MOST = 12
_STEP, _MASK = 2654435769, 0xFFFFFFFF
#: What decides a unit's Poisson numbers.
_DRAWN = ("__a", "__b", "__level")
#: Places of a block of dealt draws, units of one array, draws that are packed at a time, groups that a task holds.
BLOCK, UNITS, PACK, HELD = 1 << 14, 64, 1 << 20, 128


def least_units(level: int) -> int:
    """Units of the smallest stratum that draws at a level."""
    return SLACK * SLACK * 4 ** level


def poisson_limits(level: int) -> list[int]:
    """For counts 0, 1, ..: the 32-bit hashes from which on a unit is drawn more often."""
    rate = 1 - 0.5 ** level
    if not rate:
        return [1 << 32] * MOST
    term, total, out = math.exp(-rate), 0.0, []
    for j in range(MOST):
        total += term
        term *= rate / (j + 1)
        out.append(min(round(total * 2 ** 32), 1 << 32))
    return out


# ---- inside a task ------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix32`` of an array of 32-bit numbers, which it overwrites."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x45D9F3B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def _replicate_hashes(replicates: int, seed: int) -> np.ndarray:
    return _mixed(((np.arange(1, replicates + 1) * _STEP + (seed & _MASK)) & _MASK).astype(np.uint32))


def _poisson(a: np.ndarray, b: np.ndarray, limits: list[int], ks: np.ndarray) -> np.ndarray:
    """Poisson draws, (units, replicates), of units of one level."""
    u = _mixed(a[:, None] + ks[None, :])
    u ^= b[:, None]
    u = _mixed(u)
    some = [np.uint32(x) for x in limits if x < 1 << 32]
    count = np.zeros(u.shape, np.uint8)
    for x in some[:3]:
        count += u >= x
    if len(some) > 3:  # few are drawn more often
        high = np.flatnonzero(u >= some[3])
        count.reshape(-1)[high] += np.searchsorted(np.array(some[3:]), u.reshape(-1)[high], "right").astype(np.uint8)
    return count


def _blocks(batch: pa.RecordBatch, groups: np.ndarray, ks: np.ndarray, tables: list[list[int]]):
    """Rows (positions in the batch) and their weights (rows, replicates), level by level and,
    within a level, group by group."""
    level = np.asarray(batch.column("__level"))
    a, b = (np.asarray(batch.column(c)).astype(np.uint32) for c in ("__a", "__b"))
    extra = batch.column("__extra") if "__extra" in batch.schema.names else None
    over = batch.column("__over") if "__over" in batch.schema.names else None
    order = np.lexsort((groups, level))
    edges = [0, *(np.flatnonzero(np.diff(level[order])) + 1).tolist(), len(order)]
    for start, stop in zip(edges, edges[1:]):
        limits = tables[level[order[start]]]
        for at in range(start, stop, UNITS):
            rows = order[at:min(at + UNITS, stop)]
            w = _poisson(a[rows], b[rows], limits, ks).astype(float)
            for column, add in ((over, False), (extra, True)):
                if column is None:
                    continue
                lists = [np.frombuffer(column[int(r)].as_buffer() or b"", np.int32) for r in rows]
                where = np.repeat(np.arange(len(rows)), [len(x) for x in lists]) * len(ks) + np.concatenate(lists) - 1
                if add:
                    np.add.at(w.reshape(-1), where, 1.0)
                else:
                    w.reshape(-1)[where] = 0.0
            yield rows, w


def _coded(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """Each row's group, and the groups' keys."""
    code = np.zeros(batch.num_rows, np.int64)
    first = np.zeros(1, np.int64)
    for c in keys:
        column = batch.column(c).dictionary_encode()
        own = np.asarray(column.indices.fill_null(len(column.dictionary)))
        _, first, code = np.unique(code * (len(column.dictionary) + 1) + own, return_index=True, return_inverse=True)
    columns = [batch.column(c).take(pa.array(first)).to_pylist() for c in keys]
    return code, list(zip(*columns)) if keys else [()]


def _exact_product(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whole values (columns, rows) times weights, without rounding."""
    if np.abs(values).max(initial=0) < 1 << 40:
        return (values.astype(float) @ w).astype(np.int64)
    return ((values >> 24).astype(float) @ w).astype(np.int64) * (1 << 24) + ((values & 0xFFFFFF).astype(float) @ w).astype(np.int64)


def _dealt(batch: pa.RecordBatch, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dealt draws, group by group: the row of each in the batch and its replicate, from 0."""
    lists = batch.column("__extra")
    _, edges, packed = lists.buffers()
    kind = np.int64 if pa.types.is_large_binary(lists.type) else np.int32
    edges = np.frombuffer(edges, kind)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64) // 4
    order = np.argsort(groups, kind="stable")
    sizes = np.diff(edges)[order]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(edges[:-1][order] - ends + sizes, sizes)
    return np.repeat(order, sizes), np.frombuffer(packed or b"", np.int32, edges[-1])[at] - 1


def _summing(keys: Sequence[str], whole: Sequence[str], real: Sequence[str], replicates: int, seed: int, schema: pa.Schema, dealt: bool = False):
    """Sums of weight x value per group and replicate, or of value over the ``dealt`` draws
    alone. ``schema`` names keys, replicate, sums."""
    ks, tables = _replicate_hashes(replicates, seed), [poisson_limits(k) for k in range(LEVELS + 1)]

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}

        def rows():
            for key, (a, b, seen) in held.items():
                there = np.flatnonzero(seen)
                columns = [pa.array([x] * len(there), schema.field(i).type) for i, x in enumerate(key)]
                yield pa.record_batch([*columns, pa.array(there + 1, pa.int64()), *[pa.array(x[there]) for x in (*a, *b)]], schema=schema)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, names = _coded(batch, keys)
            a = np.array([np.asarray(batch.column(c)) for c in whole], np.int64).reshape(len(whole), batch.num_rows)
            b = np.array([np.asarray(batch.column(c)) for c in real], float).reshape(len(real), batch.num_rows)
            for at, w in [_dealt(batch, groups)] if dealt else _blocks(batch, groups, ks, tables):
                g = groups[at]
                edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else []
                for i, j in zip(edges, edges[1:]):
                    key = names[g[i]]
                    if key not in held:
                        if len(held) >= HELD:
                            yield from rows()
                        held[key] = [np.zeros((len(whole), replicates), np.int64), np.zeros((len(real), replicates)), np.zeros(replicates, bool)]
                    sums = held[key]
                    if dealt:
                        for total, column in zip((*sums[0], *sums[1]), (*a, *b)):
                            np.add.at(total, w[i:j], column[at[i:j]])
                        sums[2][w[i:j]] = True
                        continue
                    if whole:
                        sums[0] += _exact_product(a[:, at[i:j]], w[i:j])
                    if real:
                        sums[1] += b[:, at[i:j]] @ w[i:j]
                    sums[2] |= w[i:j].any(0)
        yield from rows()

    return run


def _weighing(columns: Sequence[str], replicates: int, seed: int):
    """One row per unit and replicate that draws it."""
    ks, tables = _replicate_hashes(replicates, seed), [poisson_limits(k) for k in range(LEVELS + 1)]

    def run(batches):
        for batch in batches:
            for at, w in _blocks(batch, np.zeros(batch.num_rows, np.int64), ks, tables) if batch.num_rows else ():
                row, r = np.nonzero(w)
                take = pa.array(at[row])
                yield pa.record_batch([pa.array(r + 1, pa.int64()), pa.array(w[row, r].astype(np.int64)), *[batch.column(c).take(take) for c in columns]],
                                      names=[REPLICATE, WEIGHT, *columns])

    return run


def _dealing(strata: Sequence[str], seed: int, schema: pa.Schema):
    """The missing draws of a (stratum, replicate) as packed lists, one per block of places."""
    def run(batches):
        def packed(key, places, of):
            p, r = np.concatenate(places), np.concatenate(of)
            block = p // BLOCK
            order = np.argsort(block, kind="stable")
            p, r, block = (p % BLOCK).astype(np.int32)[order], r[order], block[order]
            edges = np.array([0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)])
            n = len(edges) - 1
            lists = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * 4).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x in (p, r)]
            columns = [pa.array([x] * n, schema.field(i).type) for i, x in enumerate(key)]
            return pa.record_batch([*columns, pa.array(block[edges[:-1]]), *lists], schema=schema)

        now, places, of, size = None, [], [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*strata, REPLICATE, "__n", "__m")]
            for *key, r, n, m in sorted(zip(*columns), key=lambda x: str(x[:-3])):
                k = _mixed(np.array([(r * _STEP + (seed & _MASK)) & _MASK], np.uint32))[0]
                for low in range(1, m + 1, PACK):
                    if size and (key != now or size >= PACK):
                        yield packed(now, places, of)
                        places, of, size = [], [], 0
                    j = np.arange(low, min(low + PACK, m + 1))
                    h = _mixed(((j * _STEP + int(k)) & _MASK).astype(np.uint32))
                    v = _mixed(_mixed(h ^ k) + np.uint32(1))
                    # 62 bits, so that places are even for any number of units
                    places.append((((h & np.uint32(0x3FFFFFFF)).astype(np.int64) << 32) | v) % n)
                    of.append(np.full(len(j), r, np.int32))
                    now, size = key, size + len(j)
        if size:
            yield packed(now, places, of)

    return run


def _attach(left: pa.Table, right: pa.Table) -> pa.Table:
    """Units of a block, each with the replicates that its dealt draws belong to."""
    n = left.num_rows
    place = np.full(BLOCK, n)
    place[np.asarray(left.column("__i")) % BLOCK] = np.arange(n)
    lists = [[np.frombuffer(x.as_buffer(), np.int32) for x in right.column(c)] for c in ("__at", "__of")]
    at, of = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in lists)
    rows = place[at]
    order = np.argsort(rows, kind="stable")
    edges = np.searchsorted(rows[order], np.arange(n + 1))
    extra = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * 4).astype(np.int32).tobytes()), pa.py_buffer(of[order].tobytes())])
    return left.append_column("__extra", extra)


# ---- draws --------------------------------------------------------------------------------------

def _arrow(fields: Sequence[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(list(fields)))


def _sums(rows: DataFrame, keys: Sequence[str], values: Sequence[str], replicates: int, seed: int, dealt: bool = False) -> DataFrame:
    """Sums of weight x value per group and replicate of units that carry their draws, or of
    value over their ``dealt`` draws alone."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    real = [c for c in values if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    whole = [c for c in values if c not in real]
    carried = ["__extra"] if dealt else ["__a", "__b", "__level", *[c for c in ("__extra", "__over") if c in kinds]]
    slim = rows.select(*keys, *carried,
                       *[F.coalesce(F.col(c).cast("double" if c in real else "long"), F.lit(0.0 if c in real else 0)).alias(c) for c in values])
    out = [*[T.StructField(c, kinds[c]) for c in keys], T.StructField(REPLICATE, T.LongType()),
           *[T.StructField(c, T.LongType()) for c in whole], *[T.StructField(c, T.DoubleType()) for c in real]]
    parts = slim.mapInArrow(_summing(list(keys), whole, real, replicates, seed, _arrow(out), dealt), T.StructType(out))
    return parts.groupBy(*keys, REPLICATE).agg(*[F.sum(c).alias(c) for c in values])


def _stratum(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return keyed(df, strata) if strata else df.withColumn(KEY, F.struct(F.lit(0)))


def _numbered(units: DataFrame, strata: Sequence[str], identity: str, seed: int, kept: bool) -> DataFrame:
    """Units with their place and stratum size and with the hashes and the level of their
    Poisson numbers. Units are read twice: ``kept`` says that they are no plan any more."""
    ship_package(units.sparkSession)
    label = F.concat_ws("|", *[F.col(c).cast("string") for c in strata]) if strata else F.lit("all")
    first, second = hash_halves(F.lit(seed), label, F.col(identity))
    level = sum((F.when(F.col("__n") >= least_units(k), 1).otherwise(0) for k in range(1, LEVELS + 1)), F.lit(0))
    return cut_lineage(hash_index(units if kept else cut_lineage(units), strata, [identity], "__i", size="__n").select(
        *units.columns, "__i", "__n", first.alias("__a"), second.alias("__b"), level.alias("__level")))


def _missing(numbered: DataFrame, strata: Sequence[str], taken: DataFrame, replicates: int) -> DataFrame:
    """Draws ``__m`` that each (stratum, replicate) still misses; ``__gone`` where the Poisson
    numbers, whose sums ``__t`` are ``taken``, exceed the stratum and are given up."""
    sizes = _stratum(numbered, strata).groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in strata])
    each = sizes.select(KEY, *strata, "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias(REPLICATE))
    missing = each.join(_stratum(taken, strata).select(KEY, REPLICATE, "__t"), [KEY, REPLICATE], "left").withColumn("__t", F.coalesce("__t", F.lit(0).cast("long")))
    over = F.col("__t") > F.col("__n")
    return cut_lineage(missing.select(KEY, *strata, REPLICATE, "__n", over.alias("__gone"), F.when(over, F.col("__n")).otherwise(F.col("__n") - F.col("__t")).alias("__m")))


def _with_dealt(numbered: DataFrame, strata: Sequence[str], missing: DataFrame, seed: int) -> DataFrame:
    """Units with the dealt draws that fall to them, ``__extra``, under their stratum's key."""
    # dealt out by replicate: adaptive execution can't see how many draws a row stands for
    kinds = {f.name: f.dataType for f in numbered.schema.fields}
    fields = [*[T.StructField(c, kinds[c]) for c in strata], T.StructField("__block", T.LongType()),
              T.StructField("__at", T.BinaryType()), T.StructField("__of", T.BinaryType())]
    wanted = spread(missing.where("__m > 0").select(*strata, REPLICATE, "__n", "__m"), *strata, REPLICATE)
    dealt = wanted.mapInArrow(_dealing(strata, seed, _arrow(fields)), T.StructType(fields))
    left = numbered.withColumn("__block", F.floor(F.col("__i") / F.lit(BLOCK)).cast("long"))
    left = spread(left if KEY in left.columns else _stratum(left, strata), KEY, "__block")
    right = _stratum(dealt, strata)
    out = T.StructType([*left.schema.fields, T.StructField("__extra", T.BinaryType())])
    return (left.groupBy(KEY, "__block").cogroup(right.groupBy(KEY, "__block")).applyInArrow(_attach, out)
            .drop(KEY, "__block", "__i", "__n"))


def placed_draws(units: DataFrame, strata: Sequence[str], identity: str, replicates: int, seed: int, kept: bool = False) -> DataFrame:
    """Units, each with all that decides how often a replicate draws it. They are read twice:
    ``kept`` says that they are no plan any more."""
    strata = list(strata)
    numbered = _numbered(units, strata, identity, seed, kept)
    taken = _sums(_evenly(numbered.where("__level > 0").select(*strata, *_DRAWN, F.lit(1).alias("__t"))), strata, ["__t"], replicates, seed)
    missing = _missing(numbered, strata, taken, replicates)
    gone = missing.where("__gone")
    if not gone.isEmpty():  # next to never
        listed = gone.groupBy(KEY).agg(F.collect_list(REPLICATE).alias("__r"))
        listed = listed.mapInArrow(_packed_lists, T.StructType([listed.schema[KEY], T.StructField("__over", T.BinaryType())]))
        numbered = _stratum(numbered, strata).join(listed, KEY, "left")
    return _with_dealt(numbered, strata, missing, seed)


def unit_sums(units: DataFrame, strata: Sequence[str], identity: str, keys: Sequence[str], values: Sequence[str],
              replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED, kept: bool = False, spread_keys: bool = False) -> DataFrame:
    """``drawn_sums`` of ``placed_draws``, whose Poisson numbers are made once and not twice:
    one pass counts them and sums the values, and the sums over the dealt draws are added."""
    strata, keys = list(strata), list(keys)
    own = list(dict.fromkeys([*keys, *strata]))
    numbered = _numbered(units, strata, identity, seed, kept)
    needed = list(dict.fromkeys([*own, *values]))
    beside = numbered.where("__level > 0").select(*needed, *_DRAWN, F.lit(1).cast("long").alias("__t"))
    beside = cut_lineage(_sums(_by_key(beside, keys, own) if spread_keys else _evenly(beside), own, ["__t", *values], replicates, seed))
    missing = _missing(numbered, strata, beside.groupBy(*strata, REPLICATE).agg(F.sum("__t").alias("__t")), replicates)
    gone = missing.where("__gone")
    if not gone.isEmpty():  # next to never
        beside = _stratum(beside, strata).join(gone.select(KEY, REPLICATE), [KEY, REPLICATE], "left_anti")
    extra = _with_dealt(numbered.select(*needed, "__a", "__i"), strata, missing, seed).where(F.octet_length("__extra") > 0)
    dealt = _sums(_by_key(cut_lineage(extra), keys, own) if spread_keys else extra, own, values, replicates, seed, dealt=True)
    wanted = [*own, REPLICATE, *values]
    return beside.select(*wanted).unionByName(dealt.select(*wanted)).groupBy(*keys, REPLICATE).agg(*[F.sum(c).alias(c) for c in values])


def _evenly(rows: DataFrame) -> DataFrame:
    """Units in even shares, as many as there are shuffle partitions: adaptive execution merges
    partitions by their bytes and can't see the replicates that a unit stands for."""
    return spread(rows, "__a")


def _by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in slices of the keys' order, so that many keys make no more partial sums than keys and tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys, "__a").sortWithinPartitions(*order)


def _packed_lists(batches):
    for batch in batches:
        lists = [np.array(x, np.int32).tobytes() for x in batch.column("__r").to_pylist()]
        yield pa.record_batch([batch.column(KEY), pa.array(lists, pa.binary())], names=[KEY, "__over"])


def drawn_sums(placed: DataFrame, keys: Sequence[str], values: Sequence[str], replicates: int = BOOTSTRAP_REPLICATES,
               seed: int = SEED, spread_keys: bool = False) -> DataFrame:
    """``(keys, replicate, values)``: sums of the values of ``placed_draws`` over the draws of a
    replicate, null counted as 0. With ``spread_keys`` rows are first sorted by the keys, so that
    many keys make no more partial sums than keys and tasks."""
    if spread_keys:
        carried = [c for c in ("__a", "__b", "__level", "__extra", "__over") if c in placed.columns]
        placed = cut_lineage(placed.select(*dict.fromkeys([*keys, *values, *carried])))
        placed = _by_key(placed, keys, keys)
    return _sums(placed, keys, values, replicates, seed)


def draw_weights(units: DataFrame, strata: Sequence[str], identity: str,
                 replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    """How often each unit is drawn: ``(replicate, weight)`` and all columns of ``units``,
    a row per unit and replicate that draws it. Metrics use ``drawn_sums``, which makes no such rows.

    Sampling with replacement inside each stratum, as many draws as units. Without
    strata the whole table is one stratum; a null stratum is a stratum.
    """
    placed = placed_draws(units, strata, identity, replicates, seed)
    out = T.StructType([T.StructField(REPLICATE, T.LongType()), T.StructField(WEIGHT, T.LongType()), *units.schema.fields])
    return placed.mapInArrow(_weighing(units.columns, replicates, seed), out)


def _mean_parts(values: dict[str, Column]) -> list[Column]:
    """Columns whose sums over the draws make the mean of each named value."""
    return [c for n, v in values.items() for c in (v.alias(f"_s_{n}"), v.isNotNull().cast("long").alias(f"_n_{n}"))]


def _mean_names(values: dict[str, Column]) -> list[str]:
    return [f"_{part}_{n}" for n in values for part in "sn"]


def _weighted(values: dict[str, Column]) -> list[Column]:
    return [F.when(F.col(f"_n_{n}") > 0, F.col(f"_s_{n}") / F.col(f"_n_{n}")).alias(n) for n in values]


def drawn_means(units: DataFrame, strata: Sequence[str], identity: str, values: dict[str, Column],
                replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    """``(strata, replicate, values)``: means over the draws of a replicate, of the non-null
    values; null when there are none."""
    needed = units.select(*dict.fromkeys([*strata, identity]), *_mean_parts(values))
    sums = unit_sums(needed, strata, identity, strata, _mean_names(values), replicates, seed)
    return sums.select(*strata, REPLICATE, *_weighted(values))


def replicate_metrics(cases: DataFrame, strata: Sequence[str], identity: str, means: dict[str, Column],
                      label: str | None = None, score: str | None = None, replicates: int = BOOTSTRAP_REPLICATES,
                      seed: int = SEED) -> DataFrame:
    """One row per replicate: weighted means and, with ``label`` and ``score``,
    AUC and average precision.

    Everything comes from one grouping of the draws by (replicate, score): the
    ranking metrics accumulate over the scores, the means just add up.
    """
    ranks = [F.col(score).alias("_s"), (F.col(label) == 1).cast("long").alias("_pos"), (F.col(label) == 0).cast("long").alias("_neg")] if label else []
    needed = cases.select(*dict.fromkeys([*strata, identity]), *_mean_parts(means), *ranks)
    sums = _mean_names(means)
    if not label:
        return unit_sums(needed, strata, identity, [], sums, replicates, seed).select(REPLICATE, *_weighted(means))
    needed = cut_lineage(needed)
    grouped = unit_sums(needed, strata, identity, ["_s"], ["_pos", "_neg", *sums], replicates, seed, kept=True, spread_keys=True)
    # a replicate has at most as many score groups as the undrawn table has scores
    return ranked_sums(grouped, None, [REPLICATE], sums, rows_per_key=needed.select("_s").distinct().count()).select(
        REPLICATE, *_weighted(means), "auc", "average_precision")


def percentile_intervals(replicates: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (),
                         strict: bool = False, level: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval per metric over the replicates: ``(metric, lower, upper, used)``.

    Lenient form: missing and non-finite replicates are dropped. Strict form:
    any such replicate fails the query. A group holds one value per replicate,
    a number set by the caller, so the built-in exact percentile is safe here.
    """
    long = replicates.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m")).select(
        *keys, "_m.metric", "_m.v")
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    if strict:
        long = long.where(F.when(finite, True).otherwise(
            F.raise_error(F.concat(F.lit("non-finite replicate of "), "metric"))))
    else:
        long = long.withColumn("v", F.when(finite, F.col("v")))
    return long.groupBy(*keys, "metric").agg(
        F.percentile("v", F.array(F.lit(level[0]), F.lit(level[1]))).alias("_q"), F.count("v").alias("used")).select(
        *keys, "metric", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "used")


def mean_interval(rows: DataFrame, keys: Sequence[str], identity: str, value: str,
                  replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    """Mean of one column per group with its bootstrap interval; null for empty groups.

    Serves proportions as well (a 0/1 column). Each group is a stratum of its own.
    """
    return mean_intervals(rows, keys, identity, {"": F.col(value)}, replicates, seed)


def mean_intervals(rows: DataFrame, keys: Sequence[str], identity: str, values: dict[str, Column],
                   replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED, within: Sequence[str] = ()) -> DataFrame:
    """For each named value its mean per group and the limits of its interval: columns
    ``mean``, ``lower``, ``upper``, behind the name and an underscore where it has one.

    ``within`` names columns that divide a group into strata, each of which is drawn to its
    own size; without, a group is drawn as a whole. All values share their draws; a null or NaN value leaves its row out of that value's
    mean in every replicate. Means do not depend on the order of rows (``steady_mean``).
    """
    keys = list(keys)
    strata = [*keys, *within]
    parts = {str(i): billionths(c) for i, c in enumerate(values.values())}
    usable = cut_lineage(rows.select(*dict.fromkeys([*strata, identity]), *_mean_parts(parts)))
    point = usable.groupBy(*keys).agg(*[_ratio(F.sum(f"_s_{i}"), F.sum(f"_n_{i}")).alias(f"_p{i}") for i in parts])
    per = unit_sums(usable, strata, identity, keys, _mean_names(parts), replicates, seed, kept=True).select(
        *keys, REPLICATE, *[_ratio(F.col(f"_s_{i}"), F.col(f"_n_{i}")).alias(f"_m{i}") for i in parts])
    bands = per.groupBy(*keys).agg(*[F.percentile(f"_m{i}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"_q{i}") for i in range(len(values))])
    joined = keyed(point, keys).join(keyed(bands, keys).drop(*keys), KEY, "left") if keys else point.join(F.broadcast(bands))  # one row
    named = []
    for i, name in enumerate(values):
        dash = f"{name}_" if name else ""
        named += [F.col(f"_p{i}").alias(f"{dash}mean"), F.col(f"_q{i}")[0].alias(f"{dash}lower"), F.col(f"_q{i}")[1].alias(f"{dash}upper")]
    return joined.select(*keys, *named)


def _ratio(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count / F.lit(BILLION))


def cluster_differences(paired: DataFrame, cluster: str, first: str, second: str, lesion: str, organ: str,
                        score: str, label: str = "label_binary", replicates: int = BOOTSTRAP_REPLICATES,
                        seed: int = SEED, weights_of: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Patient bootstrap of ``first - second``: selection score and AUC per replicate.

    Patients are drawn, and all rows of a patient follow. A patient is one row: sums of
    overlap per arm, and a histogram of (arm, label, score) that is as long as the patient
    has rows. An AUC undefined on either side gives a null difference, which the interval
    leaves out.
    """
    pos, long = F.col(label) == 1, F.lit(0).cast("long")
    cols = {}
    for arm in (first, second):
        cols[f"_l_{arm}"] = F.coalesce(F.sum(F.when(pos, billionths(F.col(f"{lesion}_{arm}")))), long)
        cols[f"_o_{arm}"] = F.coalesce(F.sum(billionths(F.col(f"{organ}_{arm}"))), long)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(label).alias("y"), F.col(f"{score}_{a}").alias("s")) for a in (first, second)])
    patients = paired.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.sum(pos.cast("long")).alias("_p"),
                                           F.flatten(F.collect_list(arms)).alias("_scores"), *[c.alias(n) for n, c in cols.items()])
    placed = cut_lineage(placed_draws(patients, [], cluster, replicates, seed))
    sums = drawn_sums(placed, [], [*cols, "_n", "_p"], replicates, seed)

    def selection(arm: str) -> Column:
        return (_ratio(F.col(f"_l_{arm}"), F.col("_p")) * weights_of[0] + _ratio(F.col(f"_o_{arm}"), F.col("_n")) * weights_of[1])

    carried = [c for c in ("__a", "__b", "__level", "__extra", "__over") if c in placed.columns]
    rows = placed.select(*carried, F.explode("_scores").alias("_x")).select(
        *carried, F.col("_x.arm").alias("arm"), F.col("_x.s").alias("_s"),
        (F.col("_x.y") == 1).cast("long").alias("_pos"), (F.col("_x.y") == 0).cast("long").alias("_neg"))
    grouped = drawn_sums(rows, ["arm", "_s"], ["_pos", "_neg"], replicates, seed, spread_keys=True)
    most = rows.select("arm", "_s").distinct().groupBy("arm").count().agg(F.max("count")).first()[0] or 0
    auc = ranked_sums(grouped, None, [REPLICATE, "arm"], rows_per_key=most).groupBy(REPLICATE).agg(
        (F.max(F.when(F.col("arm") == first, F.col("auc")))
         - F.max(F.when(F.col("arm") == second, F.col("auc")))).alias("auc_difference"))
    return (sums.select(REPLICATE, (selection(first) - selection(second)).alias("selection_difference"))
            .join(auc, REPLICATE, "left"))
