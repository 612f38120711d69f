"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors a graph of nearest neighbours is cut into parts of balanced size, and a small
network learns where a vector's neighbours lie. The number of parts grows with the square root of the number of rows. Every row is indexed under its most probable part; a
query is sent to its most probable parts until they hold PROBABILITY of the mass (and enough candidates), and is
ranked there by exact inner products. Parts are dealt into blocks of bounded size for the ranking. Beyond MOST_PARTS
parts each part is cut again in the same way, by a network of its own that is learned from a sample of its rows in a
task of its own; a small part's probability is then the product of both.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.llm.common import forget, save, table

#: Least parts, and most before each is cut again; there is one for every ROOT units of the square root of the number of rows.
PARTS, MOST_PARTS, ROOT = 32, 512, 4
#: The partition is learned from so many vectors for each part, SAMPLE at least (and so 32,768 at most); a part's from as many
#: for each small part, SAMPLE / 4 at least, about.
SAMPLE, SAMPLE_PART = 4096, 64
NEIGHBOURS, SWEEPS, SLACK = 20, 8, 1.1
UNITS, PASSES, BATCH, RATE = 96, 30, 128, 3e-3
PROBABILITY, LEAST_PARTS = 0.995, 4
#: Most candidates and queries that a block has, about.
CANDIDATES, QUERIES = 8192, 1024


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, without itself."""
    n = len(x)
    k = min(k, n - 1)
    out = np.zeros((n, k), np.int64)
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), i + np.arange(len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Cut the graph: start from balanced nearest centres, then move rows to the part of most neighbours while it has room."""
    n, r = len(x), np.random.default_rng(seed)
    room = int(np.ceil(n / parts * SLACK))
    centres = x[r.choice(n, parts, replace=False)]
    own = np.zeros(n, np.int64)
    for _ in range(8):
        s = x @ centres.T - 0.5 * (centres**2).sum(1)
        ranked = np.argsort(-s, axis=1)
        sure = s[np.arange(n), ranked[:, 0]] - (s[np.arange(n), ranked[:, 1]] if parts > 1 else 0)
        size = np.zeros(parts, np.int64)
        for i in np.argsort(-sure):
            for p in ranked[i]:
                if size[p] < room:
                    own[i] = p
                    size[p] += 1
                    break
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums / np.maximum(1, np.bincount(own, minlength=parts))[:, None]
    for _ in range(SWEEPS):
        seen = np.zeros((n, parts))
        np.add.at(seen, (np.arange(n)[:, None], own[graph]), 1)
        np.add.at(seen, (graph, own[:, None]), 1)
        gain = seen.max(1) - seen[np.arange(n), own]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            p = int(seen[i].argmax())
            if size[p] < room:
                size[own[i]] -= 1
                size[p] += 1
                own[i] = p
                moved += 1
        if not moved:
            break
    return own


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    layers: list[np.ndarray]

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        a, b, *_ = self.layers
        return np.maximum(x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True)) @ a + b, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self._hidden(x) @ self.layers[2] + self.layers[3])

    @classmethod
    def train(cls, x: np.ndarray, goal: np.ndarray, seed: int = 5) -> Router:
        """goal: for each row the shares of the parts among its neighbours."""
        r = np.random.default_rng(seed)
        d, p = x.shape[1], goal.shape[1]
        net = cls([r.standard_normal((d, UNITS)) / np.sqrt(d) * 1.4, np.zeros(UNITS), r.standard_normal((UNITS, p)) / np.sqrt(UNITS), np.zeros(p)])
        moment = [[np.zeros_like(w), np.zeros_like(w)] for w in net.layers]
        unit = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
        step, total = 0, PASSES * -(-len(x) // BATCH)
        for _ in range(PASSES):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                own = order[i : i + BATCH]
                h = net._hidden(x[own])
                g = (_softmax(h @ net.layers[2] + net.layers[3]) - goal[own]) / len(own)
                back = (g @ net.layers[2].T) * (h > 0)
                step += 1
                for w, dw, (a, b) in zip(net.layers, (unit[own].T @ back, back.sum(0), h.T @ g, g.sum(0)), moment, strict=True):
                    a += 0.1 * (dw - a)
                    b += 0.001 * (dw * dw - b)
                    w -= RATE * (1 - step / (total + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
        return net


def parts_for(n: int) -> tuple[int, int]:
    """Parts of an index over n rows, and small parts of each."""
    wanted = max(PARTS, -(-math.isqrt(n) // ROOT))
    first = min(MOST_PARTS, wanted)
    return first, -(-wanted // first)


@dataclass
class Tree:
    """A router to parts and, where these are cut again, one for each part."""

    top: Router
    #: Small parts of a part, 1 if it isn't cut.
    width: int
    inner: dict[int, Router]

    def size(self) -> int:
        return len(self.top.layers[3]) * self.width

    def own(self, x: np.ndarray) -> np.ndarray:
        """The small part under which each row is indexed: the most probable one of its most probable part."""
        part = self.top.probabilities(x).argmax(axis=1)
        out = part * self.width
        for p in np.unique(part) if self.inner else ():
            if p in self.inner:
                out[part == p] += self.inner[p].probabilities(x[part == p]).argmax(axis=1)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of every small part; those of parts that hold next to nothing of the mass share it evenly."""
        p = self.top.probabilities(x)
        if not self.inner:
            return np.repeat(p / self.width, self.width, axis=1) if self.width > 1 else p
        out = np.repeat(p / self.width, self.width, axis=1)
        order = np.argsort(-p, axis=1, kind="stable")
        mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        telling = np.zeros(p.shape, bool)
        np.put_along_axis(telling, order, np.concatenate((np.zeros((len(p), 1)), mass[:, :-1]), axis=1) < PROBABILITY, axis=1)
        for part, net in self.inner.items():
            rows = np.flatnonzero(telling[:, part])
            if len(rows):
                q = net.probabilities(x[rows])
                out[rows, part * self.width : (part + 1) * self.width] = 0
                out[rows[:, None], part * self.width + np.arange(q.shape[1])[None, :]] = p[rows, part][:, None] * q
        return out


def _cut_again(width: int):
    """For a sample of one part's rows: the layers of its own router."""

    def train(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("vec_id", "ascending")]))
        net = learn(_matrix(rows["vector"].combine_chunks()), width)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "net": pa.array([pickle.dumps([w.astype(np.float32) for w in net.layers])], pa.binary())})

    return train


def draw(rows: DataFrame, n: int, size: int) -> DataFrame:
    """The size rows of least id hash, out of n; a bound on the hash keeps most others from being sorted at all."""
    share = 2 * size / max(1, n)
    if share < 1:
        rows = rows.where(F.xxhash64("vec_id") < F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size)


def learn(x: np.ndarray, parts: int = PARTS) -> Router:
    parts = max(1, min(parts, len(x) // 8))
    scaled = x / max(1e-300, float(np.abs(x).max())) if len(x) else x
    graph = neighbour_graph(scaled, NEIGHBOURS)
    own = balanced_parts(scaled, graph, parts) if parts > 1 else np.zeros(len(x), np.int64)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], own[graph]), 1)
    goal[np.arange(len(x)), own] += 2
    return Router.train(scaled, goal / goal.sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _ranked(k: int):
    def rank(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The block's k nearest rows of each query, all ties at the end included in the choice."""
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q, c = _matrix(queries["vector"].combine_chunks()), _matrix(rows["vector"].combine_chunks())
            q_id, c_id = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ c.T
                s[q_id[i : i + 256, None] == c_id[None, :]] = -np.inf
                n = min(k, s.shape[1])
                edge = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                slack = 1e-9 * (np.abs(q[i : i + 256]) @ np.abs(c).max(axis=0)) + 1e-300
                a, b = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
                exact = np.concatenate([(q[i + a[j : j + 65536]] * c[b[j : j + 65536]]).sum(axis=1) for j in range(0, len(a), 65536)] or [np.zeros(0)])
                order = np.lexsort((c_id[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                first = np.searchsorted(a, np.arange(len(s)))
                keep = np.arange(len(a)) - first[a] < k
                out[0].append(q_id[i + a[keep]])
                out[1].append(c_id[b[keep]])
                out[2].append(exact[keep])
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    return rank


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, parts: int | tuple[int, int] | None = None) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (inner product, in double).

    rows and queries: columns vec_id, vector. A vector that is null, zero or has null or non-finite components
    takes no part, nor one of another length than most, nor one without id. A query doesn't find rows of its own
    id; queries that repeat an id count once (with the least vector). Ties go to the smaller vec_id. With fewer
    than k candidates all are returned; an empty table gives an empty result. parts: None for as many as the number
    of rows asks for; a pair for parts and small parts of each.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = usual["d"] if usual else 0
    rows, queries = rows.where(F.size("vector") == d), queries.where(F.size("vector") == d)
    n = usual["count"] if usual else 0
    first, small = parts_for(n) if parts is None else parts if isinstance(parts, tuple) else (parts, 1)
    size = max(SAMPLE, SAMPLE_PART * first)
    drawn = draw(rows, n, size).toPandas()
    if usual and not len(drawn):  # few ids, often repeated, all beyond the bound
        drawn = draw(rows, size, size).toPandas()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(learn(np.array(drawn.vector.tolist(), np.float64), first), 1, {})

    def index(tree: Tree):
        sent = spark.sparkContext.broadcast(tree)  # its size doesn't grow with the rows, but with their square root

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = sent.value.own(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), *batch.columns], ["part", "vec_id", "vector"])

        made = save(rows.mapInArrow(indexed, "part int, vec_id long, vector array<double>"))
        held = np.zeros(tree.size(), np.int64)
        for r in made.groupBy("part").count().collect():  # a row for each part
            held[r["part"]] = r["count"]
        return sent, made, held

    sent, indexed, held = index(tree)
    if small > 1:
        each = max(SAMPLE // 4, SAMPLE_PART * small)
        bound = F.array(*[F.lit(min(2**64 - 1, 2 * each * 2**64 // max(1, h)) - 2**63) for h in held.tolist()])
        sample = indexed.where(F.xxhash64("vec_id", F.lit(7)) <= F.element_at(bound, F.col("part") + 1))
        nets = sample.groupBy("part").applyInArrow(_cut_again(small), "part int, net binary").collect()  # a row for each part
        coarse, tree = indexed, Tree(tree.top, small, {r["part"]: Router(pickle.loads(r["net"])) for r in nets})
        sent, indexed, held = index(tree)
        forget(coarse)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = lambda x: np.concatenate((np.zeros((len(x), 1)), x[:, :-1]), axis=1)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                p = sent.value.probabilities(_matrix(batch.column(1)))
                order = np.argsort(-p, axis=1, kind="stable")
                mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                there = np.cumsum(held[order], axis=1)
                wanted = (before(mass) < PROBABILITY) | (before(there) < k + 1) | (np.arange(p.shape[1]) < LEAST_PARTS)[None, :]
                wanted &= held[order] > 0
                chosen = [order[j, wanted[j]].astype(np.int32) for j in range(len(p))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], ["query_id", "vector", "parts"])

    once = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    routed = save(once.mapInArrow(route, "query_id long, vector array<double>, parts array<int>"))
    asked = np.zeros(len(held), np.int64)
    for r in routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    rows_of = [(i, int(max(1, -(-h // CANDIDATES))), int(max(1, -(-q // QUERIES)))) for i, (h, q) in enumerate(zip(held, asked, strict=True))]
    blocks = F.broadcast(spark.createDataFrame(rows_of, "part int, cs int, qs int"))  # a row for each part
    left = routed.select("query_id", "vector", F.explode("parts").alias("part")).join(blocks, "part").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int"))
    left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("cs") - 1))).drop("cs", "qs")
    right = indexed.join(blocks, "part").withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("cs")).cast("int"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("cs", "qs")
    found = left.groupBy("part", "qb", "cb").cogroup(right.groupBy("part", "qb", "cb")).applyInArrow(_ranked(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.where("vec_id % 20 = 0"))
