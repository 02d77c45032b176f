"""Near-duplicate vectors: robust-pruned graphs on overlapping cluster shards, searched greedily and then by range."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, small_enough

#: Vectors of a shard that its clusters are fitted on, about; those with the smallest hashes.
SAMPLE = 20_000
#: Vectors a cluster is meant to hold, the most that one graph holds, and the most clusters made of a shard at once.
CLUSTER, MAX_GRAPH, FAN = 1_000, 4_000, 256
#: Clusters that a vector joins at most at each split, and how much less near than its nearest one they may be.
OVERLAP, MARGIN = 3, 0.15
#: Centres nearer to each other than this are one, so that a dense group of vectors is not taken apart.
SAME_CENTRE = 0.8
#: Bytes of centres that are sent to the executors at once; the shards of more are split in several jobs.
MAX_CENTRE_BYTES = 32 << 20
MAX_LEVELS = 8
DEGREE, BEAM, ALPHA, SLACK, BACK = 24, 48, 1.2, 0.12, 6


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector scaled to length 1 (null if it links with nothing) and 128 bits of what it holds."""
    for batch in batches:
        unit, a, b, dim = [], [], [], []
        for v in batch.column("v"):
            x = None
            values = v.values
            if values is not None and len(values) and values.null_count == 0:
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    raw = x.tobytes()
                    x = x / top  # else the squares of very small or large numbers are lost
                    x = x / np.sqrt((x * x).sum())
                else:
                    x = None
            unit.append(None if x is None else x.tobytes())
            h = 0 if x is None else xxhash.xxh3_128_intdigest(raw)
            a.append((h >> 64) - (1 << 63))
            b.append((h & ((1 << 64) - 1)) - (1 << 63))
            dim.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], names=["id", "d1", "d2", "dim", "unit"])


def _unpack(column) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    return np.stack(rows) if rows else np.zeros((0, 0))


def fit_clusters(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Directions that a sample of vectors gathers around."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def spread(centres: np.ndarray) -> np.ndarray:
    """Of the centres, those that are not nearly the same as one before."""
    kept: list[int] = []
    for i in range(len(centres)):
        if not kept or (centres[kept] @ centres[i]).max() < SAME_CENTRE:
            kept.append(i)
    return centres[kept]


def _fit(cluster: int):
    def run(t: pa.Table) -> pa.Table:
        """The centres of one shard, from a sample of it; none if they are all one."""
        x = _unpack(t.column("unit").combine_chunks())
        c = spread(fit_clusters(x, max(2, min(FAN, -(-t.column("n")[0].as_py() // cluster)))))
        some = len(c) > 1
        return pa.table({"shard": t.column("shard").slice(0, some), "k": pa.array([len(c)] * some, pa.int32()), "centres": pa.array([c.astype(np.float32).tobytes()] * some, pa.binary())})

    return run


def _split(centres: dict[int, np.ndarray], overlap: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("shard").to_numpy()
            source, child = [], []
            for shard in np.unique(own).tolist():
                at, c = np.flatnonzero(own == shard), centres[shard]
                names = np.array([xxhash.xxh64_intdigest(b"%d %d" % (shard, k)) - (1 << 63) for k in range(len(c))], dtype=np.int64)
                for k in range(0, len(at), 2048):
                    rows = at[k : k + 2048]
                    s = _unpack(batch.column("unit").take(pa.array(rows))).astype(np.float32) @ c.T
                    near = np.argsort(-s, axis=1, kind="stable")[:, :overlap]
                    top = np.take_along_axis(s, near, 1)
                    r, j = np.nonzero(top >= top[:, :1] - margin)
                    source.append(rows[r])
                    child.append(names[near[r, j]])
            if source:
                taken = batch.take(pa.array(np.concatenate(source)))
                yield pa.RecordBatch.from_arrays([taken.column("rep"), taken.column("mult"), taken.column("unit"), pa.array(np.concatenate(child))], names=["rep", "mult", "unit", "shard"])

    return run


def shard_rows(nodes: DataFrame, scratch: Scratch, id_type: str, max_graph: int, cluster: int, overlap: int, margin: float) -> DataFrame:
    """(rep, mult, unit, shard) of every node (rep, mult, unit, dim), once for each shard that it joins.

    All vectors of one length are a shard at first. One of more than max_graph is split over clusters fitted
    on a sample of it, and its parts are split again; the fits run as tasks, one a shard. A shard that has
    only one centre, as a dense group has, stays as it is.
    """
    names = ["rep", "mult", "unit", "shard"]
    schema = f"rep {id_type}, mult long, unit binary, shard long"
    some = lambda t: F.broadcast(t) if small_enough(t, 100_000) else t  # noqa: E731  two numbers a row
    rows, done = nodes.select("rep", "mult", "unit", F.col("dim").cast("long").alias("shard")), []
    for level in range(MAX_LEVELS):
        sizes = scratch.keep(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > max_graph), "sizes")
        sample = rows.join(some(sizes), "shard").where(F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n")) < SAMPLE)
        fits = scratch.keep(sample.select("shard", "n", "unit").groupBy("shard").applyInArrow(_fit(cluster), "shard long, k int, centres binary"), "fits")
        size = fits.agg(F.coalesce(F.sum(F.octet_length("centres")), F.lit(0))).first()[0]
        if not size:
            break
        split = some(fits.select("shard"))
        done.append(rows.join(split, "shard", "left_anti").select(*names))
        jobs, parts = -(-size // MAX_CENTRE_BYTES), []
        for j in range(jobs):
            here = F.pmod(F.xxhash64("shard"), F.lit(jobs)) == j
            centres = {r["shard"]: np.frombuffer(r["centres"], np.float32).reshape(r["k"], -1) for r in fits.where(here).collect()}
            its = rows.where(here).join(split, "shard", "left_semi").select(*names)
            parts.append(scratch.keep(its.mapInArrow(_split(centres, overlap, margin), schema), "split"))
        rows = reduce(DataFrame.unionByName, parts)
    return reduce(DataFrame.unionByName, done, rows)


class Graph:
    """A flat graph over unit vectors, grown by inserting batches that double in size."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, adjacency: list[np.ndarray] | None = None):
        self.x, self.degree = x.astype(np.float32), degree
        n = len(x)
        mean = self.x.mean(axis=0) if n else np.zeros(0, np.float32)
        starts = [int((self.x @ mean).argmax())] if n else []
        for _ in range(min(3, n - 1)):  # the medoid, and vectors far from those before
            starts.append(int((self.x @ self.x[starts].T).max(axis=1).argmin()))
        self.starts = np.array(list(dict.fromkeys(starts)), dtype=np.int64)
        if adjacency is not None:
            width = max((len(a) for a in adjacency), default=0) or 1
            self.adj = np.full((n, width), -1, dtype=np.int64)
            for i, a in enumerate(adjacency):
                self.adj[i, : len(a)] = a
            return
        self.adj = np.full((n, 2 * degree), -1, dtype=np.int64)
        rest = np.setdiff1d(np.random.default_rng(3).permutation(n), self.starts, assume_unique=True) if n else np.zeros(0, int)
        rest = np.random.default_rng(4).permutation(rest)
        done = self.starts
        if n:
            self._link(done, np.tile(done, (len(done), 1)))
        at = 0
        while at < len(rest):
            batch = rest[at : at + max(32, min(512, len(done)))]
            pool, _ = self.search(self.x[batch], beam)
            self._link(batch, np.concatenate((pool, np.tile(self.starts, (len(batch), 1))), axis=1))
            done = np.concatenate((done, batch))
            at += len(batch)
        # a second pass sees all others
        for at in range(0, n, 512):
            batch = np.arange(at, min(n, at + 512))
            pool, _ = self.search(self.x[batch], beam)
            self._link(batch, np.concatenate((pool, self.adj[batch]), axis=1))

    def _prune(self, nodes: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
        """Of each node's pool, in order of nearness, those that no kept one is ALPHA times nearer to than the node."""
        out = np.full((len(nodes), degree), -1, dtype=np.int64)
        pool = np.sort(np.where(pool == nodes[:, None], -1, pool), axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        far = 1 - np.matmul(self.x[pool], self.x[nodes][:, :, None])[:, :, 0]
        far[pool < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        pool, far = np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)
        v = self.x[pool]
        between = 1 - np.matmul(v, v.transpose(0, 2, 1))
        open_ = np.isfinite(far)
        rows = np.arange(len(nodes))
        for k in range(degree):
            some = open_.any(axis=1)
            if not some.any():
                break
            best = open_.argmax(axis=1)
            out[some, k] = pool[rows, best][some]
            open_ &= ALPHA * between[rows, best] > far
            open_[rows, best] = False
        return out

    def _link(self, nodes: np.ndarray, pool: np.ndarray) -> None:
        """Gives nodes their pruned neighbours, and these a way back."""
        kept = np.concatenate([self._prune(nodes[a : a + 256], pool[a : a + 256], self.degree) for a in range(0, len(nodes), 256)])
        self.adj[nodes] = -1
        self.adj[nodes, : self.degree] = kept
        src, dst = np.repeat(nodes, self.degree), kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]).tolist() if len(dst) else []
        full: list[tuple[int, np.ndarray]] = []
        for a, b in zip(starts, [*starts[1:], len(dst)], strict=False):
            node = dst[a]
            row = self.adj[node]
            have = row[row >= 0]
            new = src[a:b]
            new = new[(new[:, None] != have).all(axis=1)]
            if len(have) + len(new) > len(row):
                both = np.concatenate((have, new))
                full.append((node, both[np.argsort(-(self.x[both] @ self.x[node]), kind="stable")[:128]]))
            else:
                row[len(have) : len(have) + len(new)] = new
                row[: len(have)] = have
        for k in range(0, len(full), 256):
            some = full[k : k + 256]
            pool = np.full((len(some), max(len(p) for _, p in some)), -1, dtype=np.int64)
            for i, (_, p) in enumerate(some):
                pool[i, : len(p)] = p
            rows = np.array([n for n, _ in some])
            self.adj[rows] = -1
            self.adj[rows, : self.degree] = self._prune(rows, pool, self.degree)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy search of all queries at once from the medoids: (beam nearest found, which nodes were seen)."""
        m, n = len(q), len(self.x)
        q = q.astype(np.float32)
        seen = np.zeros((m, n), dtype=bool)
        ids = np.full((m, beam), -1, dtype=np.int64)
        sims = np.full((m, beam), -np.inf, dtype=np.float32)
        todo = np.zeros((m, beam), dtype=bool)
        s = self.starts[:beam]
        ids[:, : len(s)], sims[:, : len(s)], todo[:, : len(s)] = s, q @ self.x[s].T, True
        seen[:, s] = True
        active = np.arange(m)
        while len(active):
            best = np.where(todo[active], sims[active], -np.inf).argmax(axis=1)
            todo[active, best] = False
            near = self.adj[ids[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            node, query = near[r, c], active[r]
            seen[query, node] = True
            new = np.full(near.shape, -np.inf, dtype=np.float32)
            new[r, c] = np.einsum("ij,ij->i", self.x[node], q[query])
            all_s = np.concatenate((sims[active], new), axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_s, top, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), top, 1)
            todo[active] = np.take_along_axis(np.concatenate((todo[active], fresh), axis=1), top, 1) & np.isfinite(sims[active])
            active = active[todo[active].any(axis=1)]
        return np.where(np.isfinite(sims), ids, -1), seen

    def within(self, q: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of about the threshold or more: a greedy search, then every node nearer than threshold - slack is expanded.

        A query that has met a quarter of the nodes is compared with the rest directly, which is cheaper then.
        """
        x = q.astype(np.float32)
        _, seen = self.search(x, beam)
        query, node = np.nonzero(seen)
        low = np.float32(threshold - slack)
        s = np.concatenate([np.einsum("ij,ij->i", self.x[node[k : k + 100_000]], x[query[k : k + 100_000]]) for k in range(0, len(query), 100_000)]) if len(query) else np.zeros(0, np.float32)
        query, node, s = query[s >= low], node[s >= low], s[s >= low]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        full = np.zeros(len(x), dtype=bool)
        while len(query):
            hit = s >= threshold - 1e-4
            out.append((query[hit], node[hit]))
            many = ~full & (seen.sum(axis=1) > max(64, len(self.x) // 4))
            for i in np.flatnonzero(many):
                rest = np.flatnonzero(~seen[i])
                rest = rest[self.x[rest] @ x[i] >= threshold - 1e-4]
                out.append((np.full(len(rest), i), rest))
            full |= many
            query, node = query[~full[query]], node[~full[query]]
            waves = []
            for k in range(0, len(query), 50_000):
                near = self.adj[node[k : k + 50_000]]
                who = np.broadcast_to(query[k : k + 50_000, None], near.shape)
                ok = (near >= 0) & ~seen[who, near]
                if ok.any():
                    pairs = np.unique(who[ok] * len(self.x) + near[ok])
                    a, b = pairs // len(self.x), pairs % len(self.x)
                    seen[a, b] = True
                    t = np.einsum("ij,ij->i", self.x[b], x[a])
                    waves.append((a[t >= low], b[t >= low], t[t >= low]))
            query, node, s = (np.concatenate([w[i] for w in waves]) if waves else np.zeros(0, np.int64) for i in range(3))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _build(t: pa.Table) -> pa.Table:
    """The adjacency lists of one shard's graph, by representative."""
    reps = np.array(t.column("rep").to_pylist())
    g = Graph(_unpack(t.column("unit").combine_chunks()))
    lists = [reps[row[row >= 0]].tolist() for row in g.adj]
    # pruning leaves some nodes on nobody's list; so each is put on those of the nearest on its own
    cut = [slice(k, k + 512) for k in range(0, len(g.x), 512)]
    near = np.concatenate([np.where(g.adj[c] >= 0, np.matmul(g.x[g.adj[c]], g.x[c][:, :, None])[:, :, 0], -np.inf) for c in cut])
    for i, k in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :BACK]):
        for p in g.adj[i, k]:
            if p >= 0:
                lists[p].append(reps[i].item())
    return pa.table({"rep": t.column("rep"), "shard": t.column("shard"), "near": pa.array(lists, pa.list_(t.schema.field("rep").type))})


def _blocks(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that a table of booleans marks, a few rows of it at a time."""
    for k in range(0, len(hit), 128):
        a, b = np.nonzero(hit[k : k + 128])
        yield a + k, b


def _labels(size: int, hit: np.ndarray) -> np.ndarray:
    """The smallest number that each of size is linked with, directly or not; hit marks links of all with the first."""
    label = np.arange(size)
    while True:
        new = label.copy()
        for a, b in _blocks(hit):
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(threshold: float, target: float = 0.98, exact: bool = False):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("in_graph", "descending"), ("rep", "ascending")])
        shard = t.column("shard")[0].as_py()
        x, mult = _unpack(t.column("unit").combine_chunks()), t.column("mult").to_numpy()
        n = int(t.column("in_graph").to_numpy().sum())
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(asks)
        reps = t.column("rep").to_pylist()
        place = {r: i for i, r in enumerate(reps[:n])}
        lists = [np.array(sorted({place[r] for r in near or () if r in place}), dtype=np.int64) for near in t.column("near").to_pylist()[:n]]
        g = None if exact else Graph(x[:n], adjacency=lists)
        # one byte for each pair that may be linked, at most two graphs' nodes by one's
        hit = np.zeros((len(x), n), dtype=bool)
        some = rows[:: max(1, len(rows) // 32)]
        want = x[some] @ x[:n].T >= threshold
        beam, slack = BEAM, SLACK
        for _ in range(0 if exact else 4):
            for k in range(0, len(rows), 512):
                query, node = g.within(x[rows[k : k + 512]], threshold, beam, slack)
                query = rows[query + k]
                for m in range(0, len(query), 100_000):
                    a, b = query[m : m + 100_000], node[m : m + 100_000]
                    ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    hit[a[ok], b[ok]] = True
            # the audit: some queries against all of the graph
            if (hit[some] & want).sum() >= target * want.sum():
                break
            beam, slack = 2 * beam, 1.5 * slack
        else:
            for k in range(0, len(rows), 512):
                hit[rows[k : k + 512]] = x[rows[k : k + 512]] @ x[:n].T >= threshold
        # links are mutual: within the graph, each is known from either end
        for k in range(0, n, 512):
            both = hit[k : min(n, k + 512)] | hit[:n, k : k + 512].T
            hit[k : min(n, k + 512)], hit[:n, k : k + 512] = both, both.T
        hit[np.arange(n), np.arange(n)] = False
        label = _labels(len(x), hit)
        # a pair with several shards in common counts in the least of them
        lists = [sorted(s) for s in t.column("shards").to_pylist()]
        wide = np.full((len(x), max(map(len, lists))), shard, dtype=np.int64)
        for i, s in enumerate(lists):
            wide[i, : len(s)] = s
        links = np.zeros(len(x), dtype=np.int64)
        for a, b in _blocks(hit):
            here = asks[a]
            for w in range(wide.shape[1]):
                lower = wide[a, w] < shard
                here &= ~(lower & (wide[b] == wide[a, w][:, None]).any(axis=1))
            np.add.at(links, a[here], mult[b[here]])
        return pa.table({"rep": t.column("rep"), "links": links, "root": pa.array([reps[i] for i in label], t.schema.field("rep").type)})

    return run


def _joined_lists(each: DataFrame, scratch: Scratch, id_type: str) -> DataFrame:
    """(rep, near, shards): a node's lists from the graphs of all its shards, joined, and these shards."""
    lists = each.select("shard", "part", "rep", "unit").groupBy("shard", "part").applyInArrow(_build, f"rep {id_type}, shard long, near array<{id_type}>")
    return scratch.keep(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_sort(F.collect_set("shard")).alias("shards")), "lists")


def _linked(nodes: DataFrame, scratch: Scratch, id_type: str, threshold: float, max_graph: int, cluster: int, overlap: int, margin: float, exact: bool = False) -> DataFrame:
    """(rep, links, root) of every node in each of its shards.

    If exact, all nodes of one length are a shard, and each of its parts is compared with each, in full and without graphs.
    """
    shards = nodes.select("rep", "mult", "unit", F.col("dim").cast("long").alias("shard")) if exact else shard_rows(nodes, scratch, id_type, max_graph, cluster, overlap, margin)
    rows = scratch.keep(shards, "placed")
    parts = rows.groupBy("shard").agg(F.ceil(F.count("*") / max_graph).cast("int").alias("parts")).where("parts > 1")
    parts = scratch.keep(parts, "parts")
    each = rows.join(F.broadcast(parts) if small_enough(parts, 100_000) else parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = each.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    if exact:
        each = each.withColumns({"near": F.array().cast(f"array<{id_type}>"), "shards": F.array("shard")})
    else:
        each = each.join(_joined_lists(each, scratch, id_type), "rep")

    # each part's graph meets the queries of every part
    asked = each.withColumn("graph", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("in_graph", (F.col("graph") == F.col("part")).cast("int"))
    asked = asked.withColumn("asker", F.col("part")).withColumn("near", F.when(F.col("in_graph") == 1, F.col("near")))
    copies = asked.where("in_graph = 1 and parts > 1").withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("asker <> part").withColumn("asks", F.lit(False))
    tasks = asked.withColumn("asks", F.lit(True)).unionByName(copies)
    found = tasks.select("shard", "graph", "asker", "rep", "mult", "unit", "shards", "near", "in_graph", "asks").groupBy("shard", "graph", "asker").applyInArrow(_search(threshold, exact=exact), f"rep {id_type}, links long, root {id_type}")
    return scratch.keep(found, "found")


def _recall(nodes: DataFrame, links: DataFrame, threshold: float, queries: int) -> float:
    """The share of links found of some nodes compared with all: those with the smallest hashes, of all and of the linked ones."""
    of = lambda t: t.orderBy(F.xxhash64("rep"), "rep").limit(queries)
    asks = of(nodes.select("rep")).unionByName(of(links.where("links > 0").select("rep"))).distinct()
    asks = nodes.join(F.broadcast(asks), "rep").select("rep", "unit", "dim").collect()  # twice queries at most
    ids, q = [r["rep"] for r in asks], [np.frombuffer(r["unit"], np.float64) for r in asks]
    dims = np.array([len(x) for x in q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dim, mult = np.zeros(len(ids), dtype=np.int64), batch.column("dim").to_numpy(), batch.column("mult").to_numpy()
            for d in np.unique(dim).tolist():
                mine, rows = np.flatnonzero(dims == d), np.flatnonzero(dim == d)
                for k in range(0, len(rows), 4096):
                    at = rows[k : k + 4096]
                    if len(mine):
                        total[mine] += (np.stack([q[i] for i in mine]) @ _unpack(batch.column("unit").take(pa.array(at))).T >= threshold) @ mult[at]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int32()), pa.array(total)], names=["i", "n"])

    true = {r["i"]: r["n"] for r in nodes.select("unit", "dim", "mult").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    got = {r["rep"]: r["links"] for r in links.join(F.broadcast(nodes.sparkSession.createDataFrame([(i,) for i in ids], links.select("rep").schema)), "rep").collect()} if ids else {}
    own = {r["rep"]: r["mult"] for r in nodes.join(F.broadcast(nodes.sparkSession.createDataFrame([(i,) for i in ids], nodes.select("rep").schema)), "rep").select("rep", "mult").collect()} if ids else {}
    want = {r: true[i] - own[r] for i, r in enumerate(ids)}
    return sum(min(n, got.get(r, 0)) for r, n in want.items()) / max(1, sum(want.values())) if sum(want.values()) else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", max_graph: int = MAX_GRAPH, cluster: int = CLUSTER, target: float = 0.95, queries: int = 128) -> DataFrame:
    """id_col, n_links, component_id and kept of every row of vectors.

    Two vectors are linked if found with a cosine of threshold or more in double precision. Those that are null,
    empty, zero or hold null or non-finite components link with nothing; nor do vectors of different
    lengths. n_links counts other rows linked directly, copies included; component_id is the smallest id
    that links lead to; kept whether it is the row's own. Rows with a null id are linked as copies of others
    only. Extra columns are left out; repeated rows are each reported and link with each other.

    Equal vectors are one node. Nodes are dealt to overlapping cluster shards of max_graph at most (shard_rows). In
    each a graph is grown and its lists pruned; a node's lists from all its shards are joined. Every node is
    then searched for in its shards over the joined lists: greedily from the medoids, then on through all
    that lies within a slack of the threshold. Each shard audits some of its queries against all its nodes, and
    searches wider until the recall is reached; if it never is, all its queries are compared with all its nodes. A
    dense group that cannot be split is dealt to several graphs, and all its nodes are searched for in each. A shard
    reports counts and one root a node, not pairs, and holds one byte for each two of its nodes.

    At the end some nodes are compared with all others, whatever their shards. If less than target of their links
    were found, all is done again with shards that overlap more; if that does not help twice, every part of max_graph nodes is
    compared with every other in full. A target above 1 asks for that at once.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = scratch.keep(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_read, f"id {id_type}, d1 long, d2 long, dim int, unit binary"), "rows")
    nodes = rows.where("unit is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("unit").alias("unit")).where("rep is not null")
    nodes = scratch.keep(nodes, "nodes")
    for wider in range(3 if target > 1 else 0, 4):
        found = _linked(nodes, scratch, id_type, threshold, max_graph, cluster, OVERLAP * 2**wider, MARGIN * 2**wider, exact=wider == 3)
        links = scratch.keep(found.groupBy("rep").agg(F.sum("links").alias("links")), "links")
        if wider == 3 or _recall(nodes, links, threshold, queries) >= target:
            break
        scratch.drop(found, links)
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    info = nodes.select("d1", "d2", "rep", "mult").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    info = info.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = rows.where("unit is not null").join(info, ["d1", "d2"], "left").select("id", "n_links", "component")
    out = out.unionByName(rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.9, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Links of the rows with ids divisible by every, as result counts them, over those of a comparison with all rows."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(_read, "id long, d1 long, d2 long, dim int, unit binary").where("unit is not null")
    asks = rows.where(F.col("id") % every == 0).select("id", "unit").collect()
    ids, q = [r["id"] for r in asks], np.stack([np.frombuffer(r["unit"], np.float64) for r in asks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                hits = (q @ _unpack(batch.column("unit")).T >= threshold).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits.astype(np.int64))], names=["id", "n"])

    true = rows.select("unit").mapInArrow(run, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    a, b = true.join(result, F.col("id") == F.col(id_col)).agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return a / b if b else 1.0
