"""Operator 3, n-gram Jaccard join by signature trees.

Equal shingle sets are one class. The shingles of a set are dealt by hash into
parts, as many for all sets of a range of sizes and more than two linked sets can
differ in: such sets agree in some parts wholly, and share one of the first parts
of each, the fullest first. Those are a set's *tokens*. Unlike a single shingle, a
full part is hardly ever shared by unrelated texts, however many there are. Classes
that share a token are one family. Inside a family the texts meet: leaves of few
sets, nodes that hold the OR of their bitmaps and the range of their sizes. Two
trees are walked at once, and a pair of nodes is left out when the largest overlap
its bitmaps and sizes allow is too small, or when all below it is linked already.
What is left is compared exactly. A large family is cut into units by size band and
hash, and pairs of units are the tasks: first each with one unit of its band, then
those that are not yet linked to one component.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import components, few, filled, forest, query, saved, ship, spare, table
from .words import mix, text_buffers, words

#: Members of a component whose units need not meet each other: they are linked.
COMPARED = 1024
#: Members and shingles of a unit; sets of a leaf; children of a node; bits of a tree's bitmaps.
UNIT_ROWS, UNIT_SHINGLES, LEAF, FAN, TREE_BITS = 256, 1 << 20, 16, 4, 4096
#: Bits of the filter that keeps rows that no join needs from moving (4 MB whatever the input).
FILTER_BITS = 1 << 25
#: Bits of a token, and of a set's number where tokens meet: what they share by chance meets once more.
SHORT = np.uint64((1 << 48) - 1)

_W = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    h, _, _, at = words(data, offs)
    weights = mix(_W[0] * np.arange(1, 2 * width, 2, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        full += h[i:len(h) - width + 1 + i] * weights[i] if len(full) else full
    full = mix(full)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(full[lo:hi - width + 1]))
        elif hi > lo:
            out.append(mix((h[lo:hi] * weights[:hi - lo] + _W[1]).sum(keepdims=True)))
        else:
            out.append(h[:0])
    return out


def least_overlap(a, b, num: int, den: int):
    """Smallest intersection with which den * intersection >= num * union, sizes given."""
    return -(-num * (a + b) // (num + den))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:6], "little")


def size_ranges(largest: int, num: int, den: int) -> np.ndarray:
    """First sizes of ranges; a set links with sets of its own range and the next ones to it."""
    out, wide = [1], max(2, -(-den // num))
    while out[-1] <= largest:
        out.append(out[-1] * wide)
    return np.array(out, np.int64)


def tokens(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, token), at least one of them common to any two different sets that link.

    Linked sets of sizes a and b differ in (a + b) * (den - num) / (den + num) shingles
    at most, d say, and so in d of k parts: of either's parts in one order, the first
    d + 1 have one in common. Their order, by number of shingles from the largest and
    by hash, depends on nothing but the part. A set is dealt once for sets of its range
    of sizes and once more, if it can link with larger ones, for those of the next.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    first = size_ranges(int(sizes.max(initial=1)), num, den)
    own = np.searchsorted(first, sizes, "right") - 1
    reach = sizes * den // num
    places, found = [], []
    for step in (0, 1):
        at = own + step
        first = size_ranges(int(first[-1]), num, den) if at.max(initial=0) + 1 >= len(first) else first
        low, top = first[at], first[at + 1] - 1
        partner = np.minimum(reach, top)
        differ = (sizes + partner) * (den - num) // (den + num)
        use = np.flatnonzero((sizes > 0) & (differ > 0) & ((step == 0) | (reach >= low)))
        if not len(use):
            continue
        most = 2 * top[use] * (den - num) // (den + num)
        parts = most + most // 10 + 2
        start = np.concatenate([[0], np.cumsum(parts)])
        flat = np.concatenate([sets[i] for i in use.tolist()])
        of = np.repeat(np.arange(len(use)), sizes[use])
        dealt = mix(flat ^ mix(at[use].astype(np.uint64) + _W[0])[of])
        part = start[of] + (dealt % parts[of].astype(np.uint64)).astype(np.int64)
        n = start[-1]
        full = np.bincount(part, minlength=n)
        # sums of halves are exact as floats
        sums = np.bincount(part, (dealt & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64) \
            + (np.bincount(part, (dealt >> np.uint64(32)).astype(np.float64), n).astype(np.uint64) << np.uint64(32))
        of = np.repeat(np.arange(len(use)), parts)
        which = (np.arange(n) - start[of]).astype(np.uint64)
        token = mix(sums + mix(which + _W[1] * (at[use].astype(np.uint64) + np.uint64(1))[of]))
        order = np.lexsort((token, -full, of))
        kept = order[np.arange(n) - start[of] <= differ[use][of]]
        places.append(use[of[kept]])
        found.append(token[kept])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(found)


def _sets(width: int):
    """A row per text: its id, set and hashes."""
    def run(batches):
        for batch in few(batches):
            data, offs = text_buffers(batch.column(1))
            sets = shingle_sets(data, offs, width)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array([short_key(k) for k in keys], pa.int64()), batch.column(2)], ["doc_id", "n", "set_key", "no", "tkey"])

    return run


def _tokens(width: int, num: int, den: int):
    """Rows (token, set number). A token that several sets of a part of a batch have is sent
    for the first; the others are tied to that one by a token of their own, once."""
    def run(batches):
        for batch in few(batches):
            data, offs = text_buffers(batch.column(0))
            sets = shingle_sets(data, offs, width)
            distinct = {set_key(s): s for s in sets}
            sets, no = list(distinct.values()), np.array([short_key(k) for k in distinct], np.int64)
            place, token = tokens(sets, num, den)
            order = np.lexsort((place, token))
            place, token = place[order], (token[order] & SHORT).astype(np.int64)
            again = np.flatnonzero(token[1:] == token[:-1]) + 1
            a, b = forest(no[place[again - 1]], no[place[again]])
            tie = (mix(a.astype(np.uint64) * _W[0] + b.astype(np.uint64)) & SHORT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.delete(token, again), tie, tie])),
                                              pa.array(np.concatenate([np.delete(no[place], again), a, b]))], ["token", "no"])

    return run


def _ties(batches):
    """From rows sorted by token (token, set number): edges that join the sets of each token."""
    last = None
    for batch in batches:
        token, no = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(token):
            continue
        if last is not None:
            token, no = np.concatenate([last[0], token]), np.concatenate([last[1], no])
        last = token[-1:], no[-1:]
        same = np.flatnonzero(token[1:] == token[:-1])
        a, b = forest(no[same], no[same + 1])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


class Tree:
    """Sets in leaves; a node: OR of bitmaps, least and largest size, most shingles that share a bit."""

    def __init__(self, sets: list[np.ndarray], order: list[int]):
        def bitmap(s):
            bits = np.zeros(TREE_BITS, np.uint8)
            bits[(s >> np.uint64(20)) & np.uint64(TREE_BITS - 1)] = 1
            packed = np.packbits(bits).view(np.uint64)
            return packed, len(s) - int(bits.sum())

        level = []
        for lo in range(0, len(order), LEAF):
            mine = order[lo:lo + LEAF]
            maps = [bitmap(sets[i]) for i in mine]
            sizes = [len(sets[i]) for i in mine]
            level.append((np.bitwise_or.reduce([m[0] for m in maps]), min(sizes), max(sizes), max(m[1] for m in maps), mine, None))
        while len(level) > 1:
            level = [(np.bitwise_or.reduce([c[0] for c in part]), min(c[1] for c in part), max(c[2] for c in part), max(c[3] for c in part),
                      [i for c in part for i in c[4]], part) for part in (level[i:i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0]


def linked(sets: list[np.ndarray], left: list[int], right: list[int] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join whatever links between ``left`` and ``right`` (or inside
    ``left``) connect: pairs already connected are not compared."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def ordered(which):
        return sorted(which, key=lambda i: (len(sets[i]), int(sets[i][0])))

    tokens = np.unique(np.concatenate([sets[i] for i in {*left, *(right or ())}]))
    at = {i: np.searchsorted(tokens, sets[i]) for i in {*left, *(right or ())}}
    mark, found = np.zeros(len(tokens), bool), []
    one = Tree(sets, ordered(left)).root
    two = one if right is None else Tree(sets, ordered(right)).root
    stack = [(one, two)]
    while stack:
        x, y = stack.pop()
        need = least_overlap(x[1], y[1], num, den)
        if den * x[2] < num * y[1] or den * y[2] < num * x[1]:
            continue
        if int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3]) < need:
            continue
        if len({root(i) for i in x[4]} | {root(i) for i in y[4]}) == 1:
            continue
        if x[5] is None and y[5] is None:
            for i in x[4]:
                mark[at[i]] = True
                for j in y[4]:
                    if (x is not y or i < j) and (ri := root(i)) != (rj := root(j)):
                        both = int(np.count_nonzero(mark[at[j]]))
                        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                            parent[rj] = ri
                            found.append((i, j))
                mark[at[i]] = False
        elif x is y:
            stack += [(c, d) for k, c in enumerate(x[5]) for d in x[5][k:]]
        else:
            stack += [(c, d) for c in (x[5] or [x]) for d in (y[5] or [y])]
    return found


def _link_unit_pair(width: int, num: int, den: int):
    def run(rows: pa.Table) -> pa.Table:
        data, offs = text_buffers(rows.column("text"))
        sets = shingle_sets(data, offs, width)
        no, side, want = (rows.column(c).to_pylist() for c in ("no", "side", "set_key"))
        # texts that share the hash of a class but not its set are no part of it
        use = {(side[i], no[i]): i for i in range(len(no)) if len(sets[i]) and set_key(sets[i]) == want[i]}
        left, right = ([i for (s, _), i in use.items() if s == k] for k in (0, 1))
        same = rows.column("same")[0].as_py()
        hits = linked(sets, left, None if same else right, num, den) if left and (same or right) else []
        return pa.table({"a": pa.array([no[i] for i, _ in hits], pa.int64()), "b": pa.array([no[j] for _, j in hits], pa.int64())})

    return run


def _filter_of(ids: DataFrame, key: str) -> np.ndarray:
    """FILTER_BITS bits with those set that the hashes name; its size doesn't grow with them."""
    at = F.pmod(key, F.lit(FILTER_BITS))
    pages = ids.select(at.alias("at")).select(F.expr("bitmap_bucket_number(at)").alias("page"), F.expr("bitmap_bit_position(at)").alias("bit")) \
        .groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in pages:
        body = np.frombuffer(bytes(r["bits"]), np.uint8)
        start = (r["page"] - 1) * 4096  # pages of 32,768 bits, counted from 1; bit 0 is in page 0
        if r["page"] == 0:
            out[-1] |= body[0] & 1
        else:
            out[start:start + len(body)] |= body
    return out


def _hits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits are set: position p > 0 is bit (p - 1) % 32768 of page (p - 1) // 32768 + 1."""
    return np.where(at > 0, bits[np.maximum(at - 1, 0) >> 3] >> ((at - 1) & 7) & 1, bits[-1] & 1).astype(bool)


def _passing(bits):
    """Texts whose bit is set, each once a task: copies collapse before they move."""
    def run(batches):
        mine, seen = bits.value, set()
        for batch in batches:
            where = []
            for i in np.flatnonzero(_hits(mine, np.array(batch.column(2)))).tolist():
                key = batch.column(0)[i].as_py()
                digest = hash((key, batch.column(1)[i].as_py()))  # two texts of one hash both pass
                if digest not in seen:
                    seen.add(digest)
                    where.append(i)
            if where:
                out = batch.take(pa.array(where))
                yield pa.RecordBatch.from_arrays(out.columns, ["text_key", "text", "at"])

    return run


def _linked(slim: DataFrame, placed: DataFrame, which: str, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found in the pairs of units that ``which`` names. ``placed``: classes
    (no, n, tkey, set_key, family, band, group), cut into units by family, band and group."""
    cell = ["family", "band", "group"]
    cuts = placed.groupBy(*cell).agg(F.greatest(F.ceil(F.count("*") / UNIT_ROWS), F.ceil(F.sum("n") / UNIT_SHINGLES)).alias("units"))
    cuts = cut_lineage(cuts)
    nodes = cuts.select(*cell, F.explode(F.sequence(F.lit(0), (F.col("units") - 1).cast("int"))).alias("unit"))
    # a size and those it can link with lie in one band or in neighbours (one more for rounding)
    to = nodes.select(F.col("family").alias("f2"), F.col("band").alias("b2"), F.col("group").alias("g2"), F.col("unit").alias("u2"))
    reach = nodes.withColumn("b", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") + 2)))
    pairs = reach.join(to, (F.col("family") == F.col("f2")) & (F.col("b") == F.col("b2"))).where("b2 > band or g2 > group or (g2 = group and u2 >= unit)").where(which) \
        .withColumn("pair", F.concat_ws(":", *cell, "unit", "b2", "g2", "u2")).withColumn("same", F.expr("band = b2 and group = g2 and unit = u2"))
    tasks = pairs.select(*cell, "unit", "pair", F.lit(0).alias("side"), "same") \
        .union(pairs.where("not same").select("family", "b2", "g2", "u2", "pair", F.lit(1), "same"))
    tasks = tasks.withColumnsRenamed({"family": "f4", "band": "b4", "group": "g4", "unit": "u4"})
    mine = placed.join(cuts.withColumnsRenamed({"family": "f3", "band": "b3", "group": "g3"}), (F.xxhash64(*cell) == F.xxhash64("f3", "b3", "g3"))
                       & (F.col("family") == F.col("f3")) & (F.col("band") == F.col("b3")) & (F.col("group") == F.col("g3"))) \
        .withColumn("unit", F.pmod(F.xxhash64("no"), F.col("units")))
    mine = cut_lineage(mine.join(tasks, (F.col("family") == F.col("f4")) & (F.col("band") == F.col("b4")) & (F.col("group") == F.col("g4")) & (F.col("unit") == F.col("u4")))
                       .select("pair", "side", "same", "no", "tkey", "set_key"))

    if mine.isEmpty():
        return mine.select(F.col("no").alias("a"), F.col("no").alias("b"))
    # only texts that are compared move
    bits = slim.sparkSession.sparkContext.broadcast(_filter_of(mine, "tkey"))
    texts = slim.select("tkey", "text", F.pmod("tkey", F.lit(FILTER_BITS)).alias("at")).mapInArrow(_passing(bits), "text_key long, text string, at long")
    dealt = mine.join(texts.select("text_key", "text"), F.col("tkey") == F.col("text_key")).select("pair", "side", "same", "no", "set_key", "text")
    return cut_lineage(dealt.groupBy("pair").applyInArrow(_link_unit_pair(width, num, den), "a long, b long"))


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs of non-blank bytes. Two rows link when
    den * intersection >= num * union of their sets of ``width``-word shingles; a text
    of fewer words is one shingle; a null or blank text has none and links with
    nothing: its component is its own doc_id. component_id is the smallest doc_id
    reachable by links; null doc_ids count as larger than any, so a component of
    nulls alone has null. Repeated rows have equal sets and so one component. No
    rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text"))
    # texts are told apart by a hash of their own: ids may be null or repeat
    slim = slim.withColumn("tkey", F.xxhash64("text"))
    signed = saved(slim.select("doc_id", "text", "tkey").mapInArrow(_sets(width), "doc_id long, n long, set_key binary, no long, tkey long"), "signed")

    # one class per distinct set; "no" is part of the set's hash, so that two sets may have one
    classes = saved(signed.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("no").alias("short"),
                                                                F.min("tkey").alias("tkey")).withColumn("no", F.monotonically_increasing_id()), "classes")

    # families: classes that share a token
    met = slim.select("text").mapInArrow(_tokens(width, num, den), "token long, no long").repartition("token").sortWithinPartitions("token")
    families = cut_lineage(components(cut_lineage(met.mapInArrow(_ties, "a long, b long").distinct())))

    # units of families; the first of a band meets all others of it, and those of the next bands meet each other
    members = classes.join(families.select(F.col("id").alias("short"), F.col("component").alias("family")), "short").select("no", "n", "tkey", "set_key", "family")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")) \
        .select(F.col("family").alias("f"), ((F.col("size") > UNIT_ROWS) | (F.col("shingles") > UNIT_SHINGLES)).alias("large"))
    band = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9)).otherwise(F.lit(0))
    placed = members.withColumn("fk", F.xxhash64("family")).join(sizes.withColumn("k", F.xxhash64("f")), (F.col("fk") == F.col("k")) & (F.col("family") == F.col("f"))) \
        .select("no", "n", "tkey", "set_key", "family", "large", band.alias("band"), F.lit(-1).cast("long").alias("group"))
    placed = cut_lineage(placed)
    links = _linked(slim, placed, "(band = b2 and unit = 0) or (unit = 0 and u2 = 0)", width, num, den)

    # members of a large family by component: those of a large one are linked, all others meet
    part = cut_lineage(components(links)).select(F.col("id").alias("no"), "component")
    part = placed.where("large").join(part, "no", "left").withColumn("component", F.coalesce("component", "no"))
    held = part.groupBy("component").agg(F.count("*").alias("held")).where(F.col("held") > COMPARED).select(F.col("component").alias("group"))
    rest = part.drop("group").join(held, F.col("component") == F.col("group"), "left").withColumn("group", F.coalesce("group", F.lit(-1)))
    rest = cut_lineage(rest.select(placed.columns))
    joined = components(links.union(_linked(slim, rest, "group <> g2 or group = -1", width, num, den)))

    # components named by their smallest doc_id
    named = classes.select("no", "set_key", "doc_id").join(joined.select(F.col("id").alias("no"), "component"), "no", "left") \
        .withColumn("component", F.coalesce("component", "no"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id")).select(F.xxhash64("component").alias("ck"), F.col("component").alias("c"), "component_id")
    verdict = named.withColumn("nk", F.xxhash64("component")).join(least, (F.col("nk") == F.col("ck")) & (F.col("component") == F.col("c"))) \
        .select(F.xxhash64("set_key").alias("vk"), F.col("set_key").alias("vs"), "component_id")
    rows = signed.select("doc_id", "n", "set_key").withColumn("sk", F.xxhash64("set_key"))
    return rows.join(verdict, (F.col("sk") == F.col("vk")) & (F.col("set_key") == F.col("vs")), "left") \
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id, all columns
    as they were. A null doc_id counts as larger than any other; among rows that share
    one, that whose text has the smallest SHA-256 stays. Texts without words all stay."""
    own = spare(docs)
    spark = docs.sparkSession
    rows = saved(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    verdict = cut_lineage(jaccard_components(rows.select(F.col(own).alias("doc_id"), "text"), width, num, den).select(F.col("doc_id").alias("row"), F.col("component_id").alias("c")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(filled(), 256), F.col(own).alias("row"))
    first = verdict.join(rows.select(F.col(own).alias("row"), order.alias("order")), "row").groupBy("c").agg(F.min("order")["row"].alias("first"), F.count("*").alias("held"))
    first = first.where("held > 1").select(F.xxhash64("c").alias("ck"), F.col("c").alias("c2"), "first")
    gone = cut_lineage(verdict.join(first, (F.xxhash64("c") == F.col("ck")) & (F.col("c") == F.col("c2"))).where("row <> first").select(F.col("row").alias(own + "gone")))

    # only rows that the filter doesn't clear move
    bits = spark.sparkContext.broadcast(_filter_of(gone.select(F.xxhash64(own + "gone").alias("at")), "at"))
    hit = F.arrow_udf(lambda at: pa.array(_hits(bits.value, np.array(at))), "boolean")(F.pmod(F.xxhash64(own), F.lit(FILTER_BITS)))
    told = rows.withColumn(own + "hit", hit)
    stay = told.where(~F.col(own + "hit"))
    return stay.union(told.where(own + "hit").join(gone, F.col(own) == F.col(own + "gone"), "left_anti")).drop(own, own + "hit")


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
