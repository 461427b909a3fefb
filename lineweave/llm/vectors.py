"""Embedding near-duplicates: a neighbour graph refined by NN-descent, then exact links within its components."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import cut, drop, partitions, release, settled, spread
from lineweave.llm.components import components
from lineweave.llm.simhash import paired

#: Vectors that share a bucket of a hash table on average, share of pairs at the threshold that the tables bring together, and
#: tables that are in the shared folder at once.
BUCKET, MEET, TABLES = 64, 0.999, 10
#: Neighbours of a list, all in other components, and vectors of one side of a local join.
NEIGHBOURS, LOCAL = 8, 256
#: Vectors that the audit compares with all others at first and at most, how many of them must have links for it to stop drawing,
#: the recall below which more tables are added, and how often.
AUDITED, MOST_AUDITED, ENOUGH, RECALL, REPAIRS = 200, 3200, 50, 0.97, 2
_log = logging.getLogger(__name__)
#: Vectors of one side of an exact comparison within a component.
TILE = 512


def units(column, kind: str) -> np.ndarray:
    """Unit vectors in double precision of a binary column of equally long vectors."""
    x = np.stack([np.frombuffer(v, kind) for v in column.to_pylist()]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def proposals(t: pa.Table, at: np.ndarray, kind: str, threshold: float, k: int) -> tuple[list, list, list]:
    """For each group of rows (id, vec, c): each row's k nearest of the group that are of another component c, whatever their
    cosine, and links at the threshold that connect what all links of the group connect."""
    from lineweave.llm.simhash import forest

    us, vs, ss = [], [], []
    ids, label = t["id"].to_numpy(), t["c"].to_numpy()
    vec = t["vec"].combine_chunks()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a < 2:
            continue
        own, first = np.unique(ids[a:b], return_index=True)
        c = label[a + first]
        if (c == c[0]).all():
            continue
        x = units(vec.take(pa.array(a + first)), kind)
        s = x @ x.T
        s[c[:, None] == c[None, :]] = -2
        root = forest(len(own), *np.nonzero(s >= threshold))
        link = np.flatnonzero(root != np.arange(len(own)))
        us.append(own[link])
        vs.append(own[root[link]])
        ss.append(np.full(len(link), 2.0))  # joined, be it by others
        m = min(k, len(own) - 1)
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        sims = np.take_along_axis(s, near, axis=1)
        i, j = np.nonzero(sims > -2)
        us.append(own[i])
        vs.append(own[near[i, j]])
        ss.append(sims[i, j])
    return us, vs, ss


def _edges(us: list, vs: list, ss: list) -> pa.RecordBatch:
    cat = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((us, np.int64), (vs, np.int64), (ss, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cat], ["u", "v", "sim"])


def plane_bits(n: int) -> int:
    return max(1, int(np.log2(max(2, n / BUCKET))))


def table_count(n: int, threshold: float, meet: float = MEET) -> int:
    """Tables of n vectors after which a pair at the threshold has met in a bucket with probability `meet`."""
    p = max(1e-9, 1 - np.arccos(min(1.0, threshold)) / np.pi) ** plane_bits(n)
    return 1 if p >= meet else int(np.ceil(np.log(1 - meet) / np.log1p(-p)))


def first_neighbours(nodes: DataFrame, kind: str, threshold: float, k: int, tables: range, seed: int, bits: int) -> DataFrame:
    """(u, v, sim): proposals() from those that fall on the same side of a table's random hyperplanes. Buckets hold about BUCKET
    vectors whatever their number; any two of a larger one meet in one of its pairs of parts."""

    def buckets(batches):
        planes: dict = {}
        for b in batches:
            dims = np.array(b.column("dim").to_pylist())
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                x = units(b.column("vec").take(rows), kind)
                for t in tables:
                    p = planes.setdefault((dim, t), np.random.default_rng([seed, int(dim), t]).standard_normal((int(dim), bits)))
                    bucket = ((x @ p > 0) << np.arange(bits)).sum(axis=1)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), pa.array(np.full(n, dim), pa.int32()), pa.array(bucket, pa.int64()), b.column("id").take(rows), b.column("c").take(rows), b.column("vec").take(rows)], ["table", "dim", "bucket", "id", "c", "vec"])

    rows = nodes.select("id", "c", "dim", "vec").mapInArrow(buckets, "table int, dim int, bucket long, id long, c long, vec binary")
    keys = ["table", "dim", "bucket"]

    def kernel(t, at):
        yield _edges(*proposals(t, at, kind, threshold, k))

    return spread(paired(rows, keys, LOCAL, "id"), partitions(nodes), [*keys, "p", "q"], kernel, "u long, v long, sim double")


def merged(edges: DataFrame, label: DataFrame, k: int) -> DataFrame:
    """The k best of each list that are of other components. Lists are cut in two steps, so that the many proposals of a
    frequent neighbour don't meet at once."""

    def best(rows: DataFrame, keys: list[str]) -> DataFrame:
        lists = rows.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "v")), asc=False), 1, k).alias("l"))
        return lists.select("u", F.explode("l").alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.sim").alias("sim"))

    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    apart = edges.where("sim < 2").join(a, "u", "left").join(b, "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
    return best(best(apart.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(16))), ["u", "salt"]), ["u"])


def descend(graph: DataFrame, nodes: DataFrame, kind: str, threshold: float, k: int) -> DataFrame:
    """proposals() of one round: at each node its neighbours, those that have it as neighbour and itself are compared."""
    pairs = graph.select(F.col("u").alias("m"), F.col("v").alias("id")).unionByName(graph.select(F.col("v").alias("m"), F.col("u").alias("id")))
    pairs = pairs.unionByName(graph.select(F.col("u").alias("m"), F.col("u").alias("id"))).distinct()
    rows = pairs.join(nodes.select("id", "c", "vec", "dim"), "id")

    def kernel(t, at):
        yield _edges(*proposals(t, at, kind, threshold, k))

    return spread(paired(rows, ["m"], LOCAL, "id"), partitions(nodes), ["m", "p", "q"], kernel, "u long, v long, sim double")


def audit(label: DataFrame, nodes: DataFrame, kind: str, threshold: float, number: int) -> tuple[float | None, int]:
    """Mean over audited vectors that have links of the share of them that lie within a component of label, and how many such
    vectors were found; the truth is by brute force. `number` vectors are drawn, then four times as many until ENOUGH have links, all
    are drawn or MOST_AUDITED; without one that has links the mean is None."""
    known = nodes.join(label, nodes.id == label.node, "left").select("id", "dim", "vec", F.coalesce("component", "id").alias("c"))

    def counted(sent):
        def run(batches):
            by: dict = {}
            for row in sent.value:
                by.setdefault(row[1], []).append(row)
            for b in batches:
                dims = np.array(b.column("dim").to_pylist())
                for dim in np.unique(dims):
                    if dim in by:
                        rows = pa.array(np.flatnonzero(dims == dim))
                        ids, c = b.column("id").take(rows).to_numpy(), b.column("c").take(rows).to_numpy()
                        q, cq = np.array([r[0] for r in by[dim]]), np.array([r[3] for r in by[dim]])
                        s = units(pa.array([r[2] for r in by[dim]], pa.binary()), kind) @ units(b.column("vec").take(rows), kind).T
                        link = (s >= threshold) & (q[:, None] != ids[None, :])
                        some = np.flatnonzero(link.any(axis=1))
                        hit = link & (cq[:, None] == c[None, :])
                        yield pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(link[some].sum(axis=1)), pa.array(hit[some].sum(axis=1))], ["u", "links", "hits"])

        return run

    while True:
        chosen = known.orderBy(F.xxhash64("id", F.lit(3))).limit(number).collect()
        sent = nodes.sparkSession.sparkContext.broadcast([(r[0], r[1], bytes(r[2]), r[3]) for r in chosen])  # a bounded number of vectors
        per = known.mapInArrow(counted(sent), "u long, links long, hits long").groupBy("u").agg((F.sum("hits") / F.sum("links")).alias("recall"))
        found, mean = per.agg(F.count("*"), F.avg("recall")).first()
        if found >= ENOUGH or len(chosen) < number or number >= MOST_AUDITED:
            _log.warning("audit of %d vectors, %d of them with links: mean recall %s", len(chosen), found, mean)
            return mean, found
        number = min(4 * number, MOST_AUDITED)


def exact_links(nodes: DataFrame, label: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links within components, by comparing each pair of their vectors once: (id, others) with the number of linked vectors,
    copies counted, and (u, v) links that connect what all links connect. Components are dealt out as pairs of parts."""
    rows = nodes.join(label, nodes.id == label.node).select("component", "id", "dim", "n", "vec")
    size = rows.groupBy("component").count().select(F.col("component").alias("c"), F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    rows = rows.join(size, F.col("component") == F.col("c")).drop("c").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def kernel(t, at):
        from lineweave.llm.simhash import forest

        ids, own, n = t["id"].to_numpy(), t["own"].to_numpy(), t["n"].to_numpy()
        p, q, dim = t["p"].to_numpy(), t["q"].to_numpy(), t["dim"].to_numpy()
        vec = t["vec"].combine_chunks()
        kinds, us, vs = [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            for d in np.unique(dim[a:b]):
                rows = a + np.flatnonzero(dim[a:b] == d)
                x = units(vec.take(pa.array(rows)), kind)
                s = x @ x.T >= threshold
                np.fill_diagonal(s, False)
                root = forest(len(rows), *np.nonzero(s))
                link = np.flatnonzero(root != np.arange(len(rows)))
                if p[a] != q[a]:
                    s &= own[rows][:, None] != own[rows][None, :]  # the pairs within a part have their own tile
                count = s @ n[rows]
                some = np.flatnonzero(count)
                kinds += [np.zeros(len(some), np.int32), np.ones(len(link), np.int32)]
                us += [ids[rows][some], ids[rows][link]]
                vs += [count[some], ids[rows][root[link]]]
        cat = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((kinds, np.int32), (us, np.int64), (vs, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(cat, (np.int32, np.int64, np.int64))], ["kind", "u", "v"])

    found = cut(spread(rows, partitions(nodes), ["component", "p", "q"], kernel, "kind int, u long, v long"))
    counts = found.where("kind = 0").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("others"))
    return counts, found.where("kind = 1").select("u", "v")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, seed: int = 11, tables: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id long, embedding array of float or double).

    Vectors with a cosine of at least the threshold, in double precision, link. Null, empty and zero vectors and such with
    null or non-finite components link with nothing, nor do vectors of different lengths; equal vectors are one node of the
    graph and link with each other. Rows that repeat a vec_id each link by their own vector; an empty table gives an empty one.
    Fails when the audited recall stays below RECALL. tables: hash tables, by default as many as table_count() says. Other
    columns are not looked at.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)["embedding"] else "<f4"
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)

    def pack(batches):
        for b in batches:
            e = b.column("embedding")
            at = np.concatenate([[0], np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False))])
            data = e.flatten().to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([data[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()), pa.array(np.diff(at), pa.int32())], ["vec_id", "vec", "dim"])

    members = cut(vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "vec_id long, vec binary, dim int"))
    classes = members.groupBy("vec", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = cut(classes.withColumn("id", F.monotonically_increasing_id()))  # written, so it stays the same

    size = nodes.count()
    bits = plane_bits(size)
    tables = table_count(size, threshold) if tables is None else tables
    links = nodes.limit(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    graph = links.withColumn("sim", F.lit(0.0))
    label = links.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def grown(propose: Callable) -> int:
        """Takes proposals in; how many links between components they had."""
        nonlocal links, graph, label
        known = nodes.join(label, nodes.id == label.node, "left").select("id", "vec", "dim", F.coalesce("component", "id").alias("c"))
        more = cut(propose(known))
        new = more.where("sim >= 2").select("u", "v")
        n = new.count()
        if n:
            # a component is as good as its star: links to its smallest node
            stars = label.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            label = cut(components(stars.unionByName(new)))
        graph = cut(merged(graph.unionByName(more), label, NEIGHBOURS))
        drop(more)
        release(spark)
        return n

    def hashed(first: int, last: int) -> None:
        for t in range(first, last, TABLES):
            grown(lambda known: first_neighbours(known, kind, threshold, NEIGHBOURS, range(t, min(last, t + TABLES)), seed, bits))

    hashed(0, tables)
    for repair in range(REPAIRS + 1):
        while grown(lambda known: descend(graph, known, kind, threshold, NEIGHBOURS)):
            pass
        recall, audited = audit(label, nodes, kind, threshold, AUDITED)
        if recall is None or recall >= RECALL:
            break
        if repair == REPAIRS:
            raise RuntimeError(f"recall {recall:.4f} of {audited} audited vectors is below {RECALL} after {REPAIRS} repairs")
        hashed(tables * (repair + 1), tables * (repair + 2))

    counts, links = exact_links(nodes, label, kind, threshold)
    found = components(links)
    per = nodes.join(counts, "id", "left").join(found, nodes.id == found.node, "left").select("vec", "dim", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    named = per.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "r")
    per = cut(per.join(named, F.col("c") == F.col("r")).select("vec", "dim", "n_links", "component_id"))
    linked = members.join(per, ["vec", "dim"]).select("vec_id", "n_links", "component_id").withColumn("kept", F.col("vec_id") == F.col("component_id"))
    rest = vectors.where(F.col("vec_id").isNull() | ~F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return settled(linked.unionByName(rest), members, nodes, per, graph, label)
