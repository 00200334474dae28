"""Exact top-k by inner product: a ball tree for each shard, branch and bound, shared k-th scores.

Rows are ordered by random projections, so that near rows stand together, and each run of about `shard_rows` rows becomes
one packed ball tree; on large tables neighbouring trees make a team. A node bounds the inner product of a query q with any row below it by q.c + |q| r (c its centre, r its
radius); nodes are visited in the order of that bound, and a search ends when the best bound left is below
the query's current k-th score. A query first searches the team it lies in, where its tree is built; the k-th score found
there goes with it, and it is sent, once, only to teams with a root bound that reaches that score: a k-th score over any
subset is a lower bound for the whole, so no result can be lost. Neither queries nor trees nor copies of roots pass through the driver.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_bytes, drop_saved, save
from .vectors import finite, one_row_an_id, stack

HITS = "query_id long, vec_id long, score long"
TEAM = f"dim int, team long, trees array<binary>, centres binary, radii binary, queries binary, hits array<struct<{HITS.replace(' long', ': long')}>>"
TEAM_BYTES, SLICE_BYTES = 32 << 20, 1 << 20


def upper_bounds(centres: np.ndarray, radii: np.ndarray, norms: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """queries x nodes: no row of a node has a larger inner product, rounding allowed for."""
    lengths = np.sqrt((queries**2).sum(axis=1))[:, None]
    return queries @ centres.T + radii * lengths + 1e-9 * (norms + radii) * lengths + 1e-6


def narrow(rows: np.ndarray) -> np.ndarray:
    """The same integers in the smallest of three types that holds them all."""
    low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
    return rows.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class BallTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 64) -> None:
        """rows: int64 matrix."""
        points = rows.astype(np.float64)
        order = np.arange(len(ids))
        self.low, self.high, self.left, self.right, centres, radii = [], [], [], [], [], []
        todo = [(0, len(ids), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            me = len(self.low)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = me
            own = points[order[a:b]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            self.low.append(a), self.high.append(b), self.left.append(-1), self.right.append(-1)
            centres.append(centre), radii.append(float(np.sqrt(away.max())))
            if b - a > leaf and away.max() > 0:
                one = own[away.argmax()]
                two = own[((own - one) ** 2).sum(axis=1).argmax()]
                by = np.argsort(own @ (two - one), kind="stable")
                order[a:b] = order[a:b][by]
                mid = (a + b) // 2
                todo += [(a, mid, me, False), (mid, b, me, True)]
        self.ids, self.rows = ids[order], narrow(rows[order])
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.top = int(np.abs(rows).max()) if rows.size else 0

    def search(self, query_id: int, q: np.ndarray, k: int, floor: float, seen: list[int] | None = None) -> list[tuple[int, int]]:
        """(score, id) of up to k rows other than the query's own that score at least `floor`, best first."""
        q, x = q.astype(np.int64), q.astype(np.float64)
        bound = upper_bounds(self.centres, self.radii, self.norms, x[None, :])[0]
        exact = float(self.top) * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53
        heap = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        while heap:
            upper, node = heapq.heappop(heap)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -upper < least:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.low[node], self.high[node]
            if seen is not None:
                seen.append(b - a)
            scores = (self.rows[a:b].astype(np.float64) @ x).astype(np.int64) if exact else self.rows[a:b].astype(np.int64) @ q
            good = np.flatnonzero(scores >= least)
            for s, i in zip(scores[good].tolist(), self.ids[a:b][good].tolist()):
                if i != query_id:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _place(bits: int, seed: int):
    """An order in which near rows stand together: signs against `bits` random directions, then one more projection."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            code, fine = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.float64)
            for dim, own in pdf.groupby("dim").indices.items():
                p = stack(pdf["v"].iloc[own], np.float64) @ np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits + 1))
                code[own] = ((p[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                fine[own] = p[:, bits]
            yield pdf.assign(code=code, fine=fine)

    return run


def _search_trees(trees: list[BallTree], ids: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query its id and (score, id) of up to k rows of all trees that score at least its floor, best first."""
    centres, radii = np.array([t.centres[0] for t in trees]), np.array([t.radii[0] for t in trees])
    bounds = upper_bounds(centres, radii, np.sqrt((centres**2).sum(axis=1)), rows.astype(np.float64))
    for i, q, least, bound in zip(ids.tolist(), rows, floors.tolist(), bounds):
        best: list[tuple[int, int]] = []
        for j in np.argsort(-bound):
            if bound[j] < least:
                break
            best = sorted(best + trees[j].search(i, q, k, least), key=lambda hit: (-hit[0], hit[1]))[:k]
            if len(best) == k:
                least = max(least, best[-1][0])
        yield i, best


def _shards(frames: Iterator[pd.DataFrame], shard_rows: int) -> Iterator[pd.DataFrame]:
    """Runs of `shard_rows` rows of one length; the last of a length holds what is left, below twice as many."""
    held = None
    for pdf in frames:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        while len(held) >= 2 * shard_rows or (len(held) and held["dim"].iloc[0] != held["dim"].iloc[-1]):
            n = min(shard_rows, int((held["dim"] == held["dim"].iloc[0]).sum()))
            yield held.iloc[:n]
            held = held.iloc[n:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _grow_teams(shard_rows: int, team: int, k: int, every: int):
    """Each shard becomes a tree, `team` trees of one length in a row a team, which answers its own queries at once."""
    def grown(trees: list[BallTree], dim: int, number: int) -> pd.DataFrame:
        asked = [np.flatnonzero(t.ids % every == 0) for t in trees]
        ids, rows = np.concatenate([t.ids[a] for t, a in zip(trees, asked)]), np.concatenate([t.rows[a] for t, a in zip(trees, asked)])
        hits, floors = [], np.full(len(ids), -np.inf)
        for place, (i, best) in enumerate(_search_trees(trees, ids, rows, floors, k)):
            hits += [{"query_id": i, "vec_id": v, "score": s} for s, v in best]
            if len(best) == k:
                floors[place] = best[-1][0]
        queries = pickle.dumps((number, ids, rows, floors), protocol=5) if len(ids) else None
        roots, radii = np.array([t.centres[0] for t in trees], np.float64), np.array([t.radii[0] for t in trees], np.float64)
        return pd.DataFrame({"dim": [dim], "team": [number], "trees": [[pickle.dumps(t, protocol=5) for t in trees]], "centres": [roots.tobytes()], "radii": [radii.tobytes()], "queries": [queries], "hits": [hits]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, dim, number = [], 0, TaskContext.get().partitionId() << 32
        for own in _shards(frames, shard_rows):
            if trees and (len(trees) == team or own["dim"].iloc[0] != dim):
                yield grown(trees, dim, number)
                trees, number = [], number + 1
            dim = int(own["dim"].iloc[0])
            trees.append(BallTree(own["vec_id"].to_numpy(np.int64), stack(own["v"], np.int64)))
        if trees:
            yield grown(trees, dim, number)

    return run


def _pack_roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """The roots of whole teams, one team after the other."""
    dim, radii = int(pdf["dim"].iloc[0]), [np.frombuffer(r, np.float64) for r in pdf["radii"]]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in radii])[:-1]])
    packed = pickle.dumps((pdf["team"].to_numpy(np.int64), starts, np.frombuffer(b"".join(pdf["centres"]), np.float64).reshape(-1, dim), np.concatenate(radii)), protocol=5)
    return pd.DataFrame({"dim": [dim], "pack": [pdf["pack"].iloc[0]], "roots": [packed]})


def _prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For a slice of the queries and a pack of roots: the teams with a bound that reaches a query's k-th score, with those queries."""
    for pdf in frames:
        for dim, blocks, roots in zip(pdf["dim"], pdf["asked"], pdf["roots"]):
            teams, starts, centres, radii = pickle.loads(roots)
            homes, ids, rows, floors = zip(*map(pickle.loads, blocks))
            homes, ids, rows, floors = np.repeat(homes, [len(i) for i in ids]), np.concatenate(ids), np.concatenate(rows), np.concatenate(floors)
            bounds = upper_bounds(centres, radii, np.sqrt((centres**2).sum(axis=1)), rows.astype(np.float64))
            reach = np.logical_or.reduceat(bounds >= floors[:, None], starts, axis=1) & (teams[None, :] != homes[:, None])
            sizes = reach.sum(axis=0)
            some = np.flatnonzero(sizes)
            for a, b in by_bytes((sizes[some] * rows[:1].nbytes).tolist(), 4 * SLICE_BYTES):
                out = [pickle.dumps((ids[reach[:, j]], rows[reach[:, j]], floors[reach[:, j]]), protocol=5) for j in some[a:b]]
                yield pd.DataFrame({"dim": dim, "team": teams[some[a:b]], "data": out})


def _search(k: int):
    """Over rows sorted by team, the trees (kind 0) of each before its blocks of queries: a tree is unpacked once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trees = None, []
        for pdf in frames:
            for dim, team, kind, data in zip(pdf["dim"], pdf["team"], pdf["kind"], pdf["data"]):
                if at != (dim, team):
                    at, trees = (dim, team), []
                if kind == 0:
                    trees.append(pickle.loads(data))
                    continue
                ids, rows, floors = pickle.loads(data)
                out = [(i, hit, s) for i, best in _search_trees(trees, ids, rows, floors, k) for s, hit in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim) with components floor(scale * x), x as double, of the rows that take part."""
    ints = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(finite(column)).select(F.col(key).cast("long").alias("vec_id"), ints.alias("v"), F.size(column).alias("dim"))
    return one_row_an_id(rows, "vec_id")


def top_k(rows: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 4096, together: int = 16, pack: int = 1024, seed: int = 5, team: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: ids divisible by `every`; candidates: all rows but the query's own.

    rows: (vec_id, v array<long>, dim), as `quantised` gives them. Vectors of another length than the
    query's are no candidates. Ties go to the smaller id; fewer candidates than k are all returned; an
    empty table gives no row. Scores are exact as long as they fit in 64 bits. `team` shards are searched at once (by default
    one up to 127 shards, then a 64th of them, up to about 32 MB); `together` blocks of queries, each of about a MB at most, are
    read at once; about `pack` roots meet a slice of the queries at once.
    """
    spark = rows.sparkSession
    n, asks, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.avg("dim"), F.lit(1.0))).first()
    bits = int(min(40, max(0, np.ceil(np.log2(max(1, n / shard_rows))))))
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // shard_rows))
    team = team or max(1, min(n // shard_rows // 64, int(TEAM_BYTES / (8 * width * shard_rows))))
    slices = max(1, int(np.ceil(8 * width * asks / SLICE_BYTES)))
    order = ["dim", "code", "fine", "vec_id"]
    placed = save(rows.select("vec_id", "v", "dim").mapInPandas(_place(bits, seed), "vec_id long, v array<long>, dim int, code long, fine double"), 4096)
    near = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("vec_id", "v", "dim")
    teams = save(near.mapInPandas(_grow_teams(shard_rows, team, k, every), TEAM), 4096, 4)
    own = teams.select(F.explode("hits").alias("h")).select("h.*")
    # Centres are a row a team; a copy of each pack of them goes to every slice of the queries, so no task takes all of either. Spark takes the
    # size of these copies for that of the packs, so they must not be broadcast.
    packs = F.pmod(F.xxhash64("team"), F.lit(max(1, -(-n // shard_rows // pack)))).cast("int")
    roots = save(teams.select("dim", "team", "centres", "radii", packs.alias("pack")).groupBy("dim", "pack").applyInPandas(_pack_roots, "dim int, pack int, roots binary"))
    part = F.pmod(F.xxhash64("team"), F.lit(slices)).cast("int")
    asked = teams.where(F.col("queries").isNotNull()).groupBy("dim", part.alias("slice")).agg(F.collect_list("queries").alias("asked"))
    dealt = roots.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    pairs = asked.join(dealt.hint("merge"), ["dim", "slice"]).select("dim", "asked", "roots")
    reach = save(pairs.mapInPandas(_prune, "dim int, team long, data binary"), 4, together)
    trees = teams.select("dim", "team", F.lit(0).alias("kind"), F.explode("trees").alias("data"))
    both = trees.unionByName(reach.withColumn("kind", F.lit(1)))
    lined = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "team").sortWithinPartitions("dim", "team", "kind")
    far = save(lined.mapInPandas(_search(k), HITS), 1)
    out = save(best_of(own.unionByName(far), k).select("query_id", "rank", "vec_id", "score"))
    drop_saved(placed, teams, roots, reach, far)
    return out


def best_of(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
