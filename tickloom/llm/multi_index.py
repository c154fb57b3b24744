"""Nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a pair of
centroids is a cell (Babenko and Lempitsky, "The Inverted Multi-Index", 2012).
For a query the cells are visited by the sum of both halves' squared distances,
with a heap over the two sorted lists, until they hold enough candidates, and the
entries of the visited cells are ranked by exact distance. How many candidates
are enough is measured: PROBED queries are answered by brute force, and the count
that would have reached the share TARGET of their true neighbours holds for all.

The codebooks are fitted on a bounded sample (SAMPLE vectors, taken by hash) and
grow with the index, so that a cell holds HELD entries on average up to CENTROIDS a
half; every vector is indexed. Equal vectors are one entry that keeps the few smallest
ids which any result can need, and equal queries are searched once. Cells are
worked on in blocks; a block with many entries or many visits is split into parts
of bounded size, so neither a frequent vector nor a crowded cell meets in one
task, and only each part's best rows leave it. Within a part, distances of all
queries are one matrix product; what it puts near is measured again, exactly.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; rows without id neither; equal rows
count once; if there are fewer candidates than k, all are returned; ties go to
the smaller id; an empty table gives an empty one; further columns of the table are
not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

#: Vectors that the codebooks are fitted on, and centroids of a half, at most; entries of a cell on average.
SAMPLE, CENTROIDS, HELD = 20_000, 1024, 16
#: Queries answered by brute force, the share of their neighbours to reach, and the fewest candidates.
PROBED, TARGET, CANDIDATES = 64, 0.96, 2048
#: Entries, or visits, of one part of a block of cells; visits of one matrix product.
PART, CHUNK = 4096, 256
ROUNDS, SEED = 12, 5


def usable(table: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, once each."""
    rows = table.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vector}`").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0))


def lowest(rows: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group; each task sends k rows of a group at most."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of the rows of x; at most k, fewer if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centers = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers)
        sums = np.stack([np.bincount(near, x[:, j], len(centers)) for j in range(x.shape[1])], axis=1)
        counts = np.bincount(near, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[lo : lo + 4096], centers).argmin(1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def visits(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (numbers i * len(second) + j) by rising first[i] + second[j], until they hold `wanted` entries; empty ones left out."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest_rows(d: np.ndarray, ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, id, distance) of the k nearest rows, ties by id; entry i stands for all its ids."""
    some = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    entry = np.repeat(some, [len(ids[i]) for i in some])
    flat = np.array([x for i in some for x in ids[i]], np.int64)
    order = np.lexsort((flat, d[entry]))[:k]
    return entry[order], flat[order], d[entry[order]]


def distances(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = entries - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def near_sets(entries: np.ndarray, at: np.ndarray, queries: np.ndarray, visited: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the entries that can be among its k nearest in the cells it visits, with their exact distances.

    at: the cell of each entry. A matrix product gives squared distances up to rounding; all within that of the k-th are measured.
    """
    cells, place = np.unique(at, return_inverse=True)
    norms = np.einsum("ij,ij->i", entries, entries)
    for lo in range(0, len(queries), CHUNK):
        part = queries[lo : lo + CHUNK]
        own = np.einsum("ij,ij->i", part, part)
        rough = own[:, None] + norms[None] - 2 * part @ entries.T
        for i, q in enumerate(part):
            open_ = np.zeros(len(cells), bool)
            found = np.searchsorted(cells, visited[lo + i])
            inside = found < len(cells)
            open_[found[inside][cells[found[inside]] == visited[lo + i][inside]]] = True
            some = np.flatnonzero(open_[place])
            if len(some) > k:
                row = rough[i, some]
                slack = 1e-9 * (own[i] + norms[some].max())
                some = some[row <= np.partition(row, k - 1)[k - 1] + slack]
            yield some, distances(entries[some], q)


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def search(table: DataFrame, queries: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row of `table` that `queries` picks.

    queries is a condition on the column `id`.
    """
    rows = materialize(usable(table, ident, vector).distinct())
    keep = lowest(rows, ["v"], k + 1, [F.col("id")])  # a query's own row is left out later
    entries = materialize(keep.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.filter(queries)
    searched = materialize(asked.groupBy("v").agg(F.min("id").alias("qid")))
    found = _searched(entries, searched, k + 1, target)
    pairs = asked.select(F.col("id").alias("query_id"), "v").join(searched, "v").select("query_id", "qid").join(found, "qid")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = pairs.filter("id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _enough(placed: DataFrame, queries: DataFrame, k: int, target: float, sums, sizes: np.ndarray) -> int:
    """Candidates that a query must see to meet `target` of its k nearest rows, measured on PROBED queries by brute force."""
    asked = _matrix(_one(queries.orderBy(F.xxhash64("v"), "qid").limit(PROBED).select("v").toArrow(), "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, cells = _matrix(batch.column("v")), batch.column("ids").to_pylist(), batch.column("cell").to_numpy()
            every = [np.unique(cells)] * len(asked)
            for q, (some, d) in enumerate(near_sets(x, cells, asked, every, k) if len(x) else ()):
                entry, ident, score = nearest_rows(d, [ids[i] for i in some], k)
                yield pa.record_batch([pa.array([q] * len(entry), pa.int64()), pa.array(ident), pa.array(score), pa.array(cells[some[entry]])], ["q", "id", "score", "cell"])

    near = lowest(placed.mapInArrow(run, "q long, id long, score double, cell long"), ["q"], k, [F.col("score"), F.col("id")]).select("q", "cell").toArrow()
    need = []
    for i, q in enumerate(asked):
        order = np.argsort(sums(q), kind="stable")
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(sizes[order])
        need += seen[near["cell"].to_numpy()[near["q"].to_numpy() == i]].tolist()
    return max(CANDIDATES, int(np.quantile(need, target, method="higher")) if need else 0)


def _searched(entries: DataFrame, queries: DataFrame, k: int, target: float) -> DataFrame:
    """(qid, id, score): k nearest rows of each of the queries (qid, v) among the visited cells of the entries (v, ids)."""
    sample = _matrix(_one(entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow(), "v"))
    if not len(sample):
        return queries.select("qid", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    half, n = max(1, sample.shape[1] // 2), entries.count()
    centroids = max(1, min(CENTROIDS, len(sample), round((n / HELD) ** 0.5)))
    one = kmeans(sample[:, :half], centroids)
    two = kmeans(sample[:, half:], centroids) if sample.shape[1] > half else np.zeros((1, 0))
    blocks = max(1, min(len(one), -(-n // PART)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            first = nearest(x[:, :half], one) if len(x) else np.zeros(0, np.int64)
            second = nearest(x[:, half:], two) if len(x) else first
            columns = [*batch.columns, pa.array(first * len(two) + second), pa.array(first * blocks // len(one))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "block"])

    kind = entries.schema["v"].dataType.simpleString()
    placed = materialize(entries.mapInArrow(place, f"v {kind}, ids array<long>, cell long, block long"))
    sizes = np.zeros(len(one) * len(two), np.int64)  # bounded by the codebooks
    for r in placed.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    halves = lambda q: (squared(q[None, :half], one)[0], squared(q[None, half:], two)[0])
    wanted = _enough(placed, queries, k, target, lambda q: np.add.outer(*halves(q)).ravel(), sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where, cells = [], [], []
            for i, q in enumerate(_matrix(batch.column("v")) if batch.num_rows else ()):
                seen = np.array(visits(*halves(q), sizes, wanted), np.int64)
                block = seen // len(two) * blocks // len(one)
                for b in np.unique(block).tolist():
                    at.append(i), where.append(b), cells.append(seen[block == b].tolist())
            at = pa.array(at, pa.int64())
            columns = [batch.column("qid").take(at), batch.column("v").take(at), pa.array(where, pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "q", "block", "cells"])

    spread = queries.select("qid", "v").repartition(parallelism(queries.sparkSession), "qid")  # visits cost more than reading
    probes = materialize(spread.mapInArrow(visit, f"qid long, q {kind}, block long, cells array<long>"))
    parts = placed.groupBy("block").agg(F.ceil(F.count("*") / PART).alias("parts"))
    rounds = probes.groupBy("block").agg(F.ceil(F.count("*") / PART).alias("rounds"))
    counts = F.broadcast(parts.join(rounds, "block"))  # a row for each block, bounded by the codebooks
    own = F.pmod(F.xxhash64("v"), F.col("parts"))
    left = placed.join(counts, "block").select("v", "ids", "cell", "block", own.alias("part"), F.explode(F.expr("sequence(0L, rounds - 1)")).alias("round"))
    asked = F.pmod(F.xxhash64("qid"), F.col("rounds"))
    right = probes.join(counts, "block").select("qid", "q", "cells", "block", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), asked.alias("round"))

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(a) and len(b):
            x, ids, at = _matrix(_one(a, "v")), a["ids"].to_pylist(), a["cell"].to_numpy()
            visited = [np.sort(cells.values.to_numpy()) for cells in b["cells"]]
            for qid, (some, d) in zip(b["qid"].to_pylist(), near_sets(x, at, _matrix(_one(b, "q")), visited, k), strict=True):
                if len(some):
                    _, ident, score = nearest_rows(d, [ids[i] for i in some], k)
                    out[0] += [qid] * len(ident)
                    out[1] += ident.tolist()
                    out[2] += score.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qid", "id", "score"])

    key = ["block", "part", "round"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, "qid long, id long, score double")
    return lowest(near, ["qid"], k, [F.col("score"), F.col("id")])


def search_report(table: DataFrame) -> DataFrame:
    """The 10 nearest of each row whose vec_id is divisible by 100."""
    return search(table, F.col("id") % 100 == 0)
