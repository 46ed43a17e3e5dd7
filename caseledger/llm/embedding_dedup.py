"""Operator 7, embedding near-dedup with a small-world graph per shard.

Equal vectors are one class. Classes are dealt to shards by hash, a graph is built
over each shard and stored in the shared folder, and every class is searched in
every shard. Similarities of what is met are recomputed in double precision. A block
of queries hands on how many vectors each links with and a spanning forest of the
links, not the links themselves, whose number grows with the square of a group.

Recall is measured before that, at a cost that grows with the table and no faster: a
block of classes is compared with all vectors, and each of them is turned by a known
angle into a probe whose source the graphs must find. Beams are widened until both
suffice. Where the widest one fails, all vectors are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, fresh_path
from .common import components, forest, query, saved, ship, table
from .files import opened
from .hnsw import Graph

#: Fewest shards; most vectors of a shard (more vectors make more shards).
SHARDS, SHARD_ROWS = 8, 250_000
#: Classes of the recall audit (as many probes are made of them), the recall that both must reach, the first beam.
AUDITED, RECALL, BEAM = 512, 0.99, 32
#: Cosines of the probes with their sources, dealt in turn.
TURNED = (0.9, 0.92, 0.94, 0.96, 0.98, 0.99)
#: Room for the single precision of the search.
SLACK = 1e-5
BLOCK = 8192


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    v = v / np.abs(v).max(1, keepdims=True)  # sums of squares can't overflow
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _build(dims: int):
    def run(rows: pa.Table) -> pa.Table:
        v = _matrix(rows.column("v"), dims)
        g = Graph(v).build()
        return pa.table({"shard": rows.column("shard").slice(0, 1), "no": [np.array(rows.column("no"), np.int64).tobytes()],
                         "copies": [np.array(rows.column("copies"), np.int64).tobytes()], "vectors": [v.tobytes()],
                         "links": [[x.tobytes() for x in g.links]], "entry": pa.array([g.entry], pa.int64())})

    return run


def _load(path: str, shard: int, dims: int):
    """(numbers, copies, vectors, graph) of a shard; None if it holds nothing."""
    where, at = opened(f"{path}/shard={shard}")
    from pyarrow import fs

    if where.get_file_info(at).type == fs.FileType.NotFound:
        return None
    files = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")]
    row = pa.concat_tables([pq.ParquetFile(where.open_input_file(f)).read(["no", "copies", "vectors", "links", "entry"]) for f in files]).to_pylist()[0]
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, dims)
    links = [np.frombuffer(x, np.int32).reshape(len(v), -1) for x in row["links"]]
    return np.frombuffer(row["no"], np.int64), np.frombuffer(row["copies"], np.int64), v, Graph(v, links, None, row["entry"])


def _met(path: str, shards, dims: int, least: float, beam: int, v: np.ndarray):
    """(query, numbers, copies) of what the given vectors meet in each shard with a cosine of at least ``least``."""
    for shard in shards:
        held = _load(path, shard, dims)
        if held is not None:
            names, copies, own, graph = held
            i, j = graph.within(v, least - SLACK, beam)
            ok = np.einsum("ij,ij->i", v[i], own[j]) >= least
            i, j = i[ok], j[ok]
            yield i, names[j], copies[j]


def _blocks(batches, dims: int, rows: int = BLOCK):
    """(numbers, vectors) of the batches, so many rows at a time."""
    no, v, n = [], [], 0
    for batch in batches:
        no.append(np.array(batch.column(0), np.int64))
        v.append(_matrix(batch.column(1), dims))
        n += batch.num_rows
        if n >= rows:
            yield np.concatenate(no), np.concatenate(v)
            no, v, n = [], [], 0
    if n:
        yield np.concatenate(no), np.concatenate(v)


LINKED = "a long, b long, others long"


def _rows(a: np.ndarray, b: np.ndarray | None, others: np.ndarray | None) -> pa.RecordBatch:
    """Forest edges (a, b), or counts (a, others)."""
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if others is None else pa.array(others, pa.int64())],
                                      ["a", "b", "others"])


def _search(path: str, shards, dims: int, least: float, beam: int):
    """For each query the vectors that it links with, others than itself, as a count, and
    a spanning forest of all links of the task."""
    def run(batches):
        x, y, held = [], [], 0
        for no, v in _blocks(batches, dims):
            others = np.zeros(len(no), np.int64)
            for i, names, copies in _met(path, shards, dims, least, beam, v):
                apart = names != no[i]
                i, names, copies = i[apart], names[apart], copies[apart]
                np.add.at(others, i, copies)
                x.append(no[i])
                y.append(names)
                held += len(i)
                if held > 1 << 20:
                    low, high = forest(np.concatenate(x), np.concatenate(y))
                    x, y, held = [low], [high], len(low)
            some = others > 0
            yield _rows(no[some], None, others[some])
        if held:
            yield _rows(*forest(np.concatenate(x), np.concatenate(y)), None)

    return run


def exact_links(classes: DataFrame, others: DataFrame, dims: int, least: float) -> DataFrame:
    """Rows as those of the search (a, b, others), from comparing all ``classes`` with all of
    ``others``, a stored table, in blocks: the work is the product of both."""
    spark, path = classes.sparkSession, fresh_path(classes.sparkSession, "compared")
    others.write.parquet(path)

    def run(batches):
        for no, v in _blocks(batches, dims, 1024):
            count, x, y = np.zeros(len(no), np.int64), [], []
            for names, copies, own in _stored(path, dims):
                sims = v @ own.T
                i, j = np.nonzero(sims >= least - 1e-9)
                close = np.flatnonzero(sims[i, j] < least + 1e-9)  # as the search sums them
                ok = names[j] != no[i]
                ok[close] &= np.einsum("ij,ij->i", v[i[close]], own[j[close]]) >= least
                i, j = i[ok], j[ok]
                np.add.at(count, i, copies[j])
                a, b = forest(no[i], names[j])
                x.append(a)
                y.append(b)
            some = count > 0
            yield _rows(no[some], None, count[some])
            yield _rows(*forest(np.concatenate(x), np.concatenate(y)), None)

    return classes.select("no", "v").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, LINKED)


def _stored(path: str, dims: int):
    """(numbers, copies, vectors) of a stored table, some thousand rows at a time."""
    from pyarrow import fs

    where, at = opened(path)
    for f in where.get_file_info(fs.FileSelector(at)):
        if f.path.endswith(".parquet"):
            for batch in pq.ParquetFile(where.open_input_file(f.path)).iter_batches(BLOCK, columns=["no", "copies", "v"]):
                yield np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64), _matrix(batch.column(2), dims)


def _probes(no: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each vector turned to a cosine of ``TURNED`` in a direction that its number draws."""
    out = v.copy()
    for i, name in enumerate(no.tolist()):
        t = TURNED[i % len(TURNED)]
        side = np.random.default_rng(name).standard_normal(v.shape[1])
        side -= (side @ v[i]) * v[i]
        size = np.sqrt(side @ side)
        if size > 1e-9:  # one dimension has no other direction
            out[i] = t * v[i] + np.sqrt(1 - t * t) * side / size
    return out


def _audit(path: str, shards, dims: int, least: float, beam: int):
    """Of audited classes (no, v): vectors that the search links each with, and whether its probe meets it."""
    def run(batches):
        for no, v in _blocks(batches, dims, AUDITED):
            others, met = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
            for i, names, copies in _met(path, shards, dims, least, beam, v):
                np.add.at(others, i, np.where(names != no[i], copies, 0))
            # a probe turned to just the least cosine may fall below it by rounding
            for i, names, _ in _met(path, shards, dims, min(TURNED) - 1e-6, beam, _probes(no, v)):
                met[i[names == no[i]]] = 1
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(others), pa.array(met)], ["no", "others", "met"])

    return run


def _comparison(path: str, dims: int, least: float):
    """Of every audited class, stored in ``path``, how many vectors of the batches link with it."""
    def run(batches):
        audited = list(_stored(path, dims))
        if not audited:
            return
        names, own = np.concatenate([a[0] for a in audited]), np.concatenate([a[2] for a in audited])
        count = np.zeros(len(names), np.int64)
        for batch in batches:
            v, copies, no = _matrix(batch.column(1), dims), np.array(batch.column(2), np.int64), np.array(batch.column(0), np.int64)
            sims = own @ v.T
            i, j = np.nonzero(sims >= least - 1e-9)
            ok = (np.einsum("ij,ij->i", own[i], v[j]) >= least) & (names[i] != no[j])
            np.add.at(count, i[ok], copies[j[ok]])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(count)], ["no", "wanted"])

    return run


def links_of(classes: DataFrame, dims: int, least: float) -> tuple[DataFrame, float, int]:
    """(rows (a, others) of linked classes and (a, b) of spanning forests; recall; beam) of
    classes (no, v, copies).

    About AUDITED classes, those of least hash, are compared with all vectors. Recall is
    the lesser of two means: the share of its links that an audited class finds (over
    those that have links), and the share of probes that find the class they are made of,
    which is known for any table, however few links it holds.
    """
    spark = classes.sparkSession
    total = classes.count()
    spread = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK))
    shards = max(SHARDS, -(-total // SHARD_ROWS))
    path = fresh_path(spark, "graphs")
    sharded = classes.select("no", "v", "copies", F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int").alias("shard"))
    sharded.groupBy("shard").applyInArrow(_build(dims), "shard int, no binary, copies binary, vectors binary, links array<binary>, entry long") \
        .write.partitionBy("shard").parquet(path)
    widest = sharded.groupBy("shard").count().agg(F.max("count")).first()[0]
    audited = saved(classes.where(F.pmod(F.xxhash64("v"), F.lit(max(1, total // AUDITED))) == 0), "audited")
    listed = fresh_path(spark, "audited-list")
    audited.write.parquet(listed)
    wanted = cut_lineage(classes.select("no", "v", "copies").mapInArrow(_comparison(listed, dims, least), "no long, wanted long")
                         .groupBy("no").agg(F.sum("wanted").alias("wanted")))
    beam = BEAM
    while True:
        got = audited.select("no", "v").repartition(spark.sparkContext.defaultParallelism) \
            .mapInArrow(_audit(path, range(shards), dims, least, beam), "no long, others long, met long")
        r = got.join(wanted, "no").agg(F.avg(F.when(F.col("wanted") > 0, F.col("others") / F.col("wanted"))).alias("links"), F.avg("met").alias("probes")).first()
        recall = min(x for x in (r["links"], r["probes"], 1.0) if x is not None)
        if recall >= RECALL:
            return classes.select("no", "v").repartition(spread).mapInArrow(_search(path, range(shards), dims, least, beam), LINKED), recall, beam
        if beam >= widest:
            return exact_links(classes, classes.select("no", "copies", "v"), dims, least), 1.0, beam
        beam *= 2


def embedding_links(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (as its own search counts them), component_id, kept.

    Vectors link when their cosine, in double precision, is at least ``least``. A
    null vector, a zero one and one that holds a null or non-finite number link with
    nothing; vectors of different lengths don't link. component_id is the smallest
    vec_id reachable by links; a null vec_id counts as larger than any other. Equal
    vectors link; repeated rows count as vectors of their own. kept marks the row
    whose vec_id is its component. No rows give no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    low, high = F.lit(-1.7976931348623157e308), F.lit(1.7976931348623157e308)
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high)) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = slim.where(fine)
    classes = good.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("no", F.monotonically_increasing_id()).withColumn("dims", F.size("v")), "vectors")
    rows = None
    for (dims,) in sorted(classes.select("dims").distinct().collect()):
        more = links_of(classes.where(F.col("dims") == dims).select("no", "v", "copies"), dims, least)[0]
        rows = more if rows is None else rows.union(more)
    if rows is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = saved(rows, "links")
    joined = cut_lineage(components(rows.where("b is not null").select("a", "b")))
    degree = rows.where("others is not null").select(F.col("a").alias("d"), "others")
    named = classes.join(joined.select(F.col("id").alias("i"), "component"), F.col("no") == F.col("i"), "left").withColumn("component", F.coalesce("component", "no"))
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id")).select(F.col("component").alias("c"), F.xxhash64("component").alias("ck"), "component_id")
    told = named.withColumn("nk", F.xxhash64("component")).join(least_id, (F.col("nk") == F.col("ck")) & (F.col("component") == F.col("c"))) \
        .join(degree, F.col("no") == F.col("d"), "left") \
        .select(F.xxhash64("v").alias("k"), F.col("v").alias("u"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.withColumn("vk", F.xxhash64("v")).join(told, (F.col("vk") == F.col("k")) & (F.col("v") == F.col("u"))) \
        .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = slim.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
