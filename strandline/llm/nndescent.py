"""Approximate nearest neighbours by cosine: NN-descent builds the graph, greedy search answers queries.

Start: several random projections order the rows; each run of `block` rows in such an order is compared
within itself, and every row keeps its `degree` best. Descent: a row's neighbours and the rows that have it
as a neighbour are neighbours of neighbours of each other; a join brings their vectors together at the row
between them, which offers each pair to both ends if it beats their worst neighbour so far; a batch reduces its offers
to each row's best before they are shuffled. Pairs that were
both neighbours of that row a round ago have been compared there and are not again, and rows with no new link send
nothing. Rounds end when few links are new. Rows with many
in-links are dealt to several groups, so no group is large and no in-link is dropped.
Queries search greedily: each round joins the best rows not yet opened to their neighbours in the graph,
scores those, and keeps the `beam` best. Scores are recomputed at the end from the original vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_saved, free_shuffles, save
from .vectors import finite, one_row_an_id, stack

LISTS = "id long, ids array<long>, sims array<float>, fresh array<boolean>"


def unit_rows(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, dim, unit, raw): unit vectors as float32 bytes, of the rows that take part."""
    doubles = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.where(finite(column)).select(F.col(key).cast("long").alias("id"), F.size(column).alias("dim"), doubles.alias("raw"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            units = []
            for v in pdf["raw"]:
                v = np.asarray(v, np.float64)
                top = np.abs(v).max()
                units.append(None if top == 0 else (v / top / np.linalg.norm(v / top)).astype(np.float32).tobytes())
            yield pdf.assign(unit=units)

    return one_row_an_id(rows, "id").mapInPandas(run, "id long, dim int, raw array<double>, unit binary").where(F.col("unit").isNotNull())


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    order = np.take_along_axis(-sims, part, axis=1).argsort(axis=1)
    return np.take_along_axis(part, order, axis=1)


def _compare_blocks(block: int, degree: int):
    def lists(ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        sims = x @ x.T
        np.fill_diagonal(sims, -2.0)
        best = _top(sims, min(degree, len(ids) - 1))
        return pd.DataFrame({"id": ids, "ids": list(ids[best]), "sims": list(np.take_along_axis(sims, best, axis=1)), "fresh": list(np.ones(best.shape, bool))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= 2 * block or held["dim"].iloc[0] != held["dim"].iloc[-1]:
                n = min(block, int((held["dim"] == held["dim"].iloc[0]).sum()))
                if n > 1:
                    yield lists(held["id"].to_numpy()[:n], stack(held["unit"][:n], np.float32))
                held = held.iloc[n:].reset_index(drop=True)
        if held is not None and len(held) > 1:
            yield lists(held["id"].to_numpy(), stack(held["unit"], np.float32))

    return run


def _project(trees: int, bits: int, seed: int):
    """For each projection an order: `bits` signs against random directions, then one more projection."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            codes = np.zeros((len(pdf), trees), np.int64)
            fine = np.zeros((len(pdf), trees), np.float32)
            for dim, own in pdf.groupby("dim").indices.items():
                x = stack(pdf["unit"].iloc[own], np.float32)
                for t in range(trees):
                    rng = np.random.default_rng([seed, t, int(dim)])
                    planes = rng.standard_normal((int(dim), bits + 1)).astype(np.float32)
                    p = x @ planes
                    codes[own, t] = ((p[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                    fine[own, t] = p[:, bits]
            yield pd.DataFrame({"id": pdf["id"], "dim": pdf["dim"], "unit": pdf["unit"], "codes": list(codes), "fine": list(fine)})

    return run


def _merge(parts: pd.Series, degree: pd.Series, own: pd.Series) -> pd.DataFrame:
    out = []
    for cell, k, me in zip(parts, degree, own):
        ids = np.concatenate([np.asarray(p["ids"], np.int64) for p in cell])
        sims = np.concatenate([np.asarray(p["sims"], np.float32) for p in cell])
        fresh = np.concatenate([np.asarray(p["fresh"], bool) for p in cell])
        known = ids[~fresh]
        order = np.lexsort((ids, -sims))
        ids, sims = ids[order], sims[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first[ids[first] != me])[:k]
        out.append((ids[first], sims[first], ~np.isin(ids[first], known)))
    return pd.DataFrame(out, columns=["ids", "sims", "fresh"])


def _best_lists(parts: DataFrame, degree: int) -> DataFrame:
    merged = parts.groupBy("id").agg(F.collect_list(F.struct("ids", "sims", "fresh")).alias("parts"))
    merge = F.pandas_udf(_merge, "ids array<long>, sims array<float>, fresh array<boolean>")
    return merged.select("id", merge("parts", F.lit(degree), "id").alias("m")).select("id", "m.ids", "m.sims", "m.fresh")


def _best_offers(seen: list[tuple], degree: int) -> pd.DataFrame:
    """One row for each id of a batch, with the `degree` best of all that was offered to it."""
    ids = np.repeat(np.array([s[0] for s in seen]), [len(s[1]) for s in seen])
    others, sims = np.concatenate([s[1] for s in seen]), np.concatenate([s[2] for s in seen])
    order = np.lexsort((-sims, others, ids))
    ids, others, sims = ids[order], others[order], sims[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (others[1:] != others[:-1]))
    ids, others, sims = ids[new], others[new], sims[new]
    order = np.lexsort((others, -sims, ids))
    ids, others, sims = ids[order], others[order], sims[order]
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    size = np.diff(np.append(start, len(ids)))
    cut = [slice(a, a + min(n, degree)) for a, n in zip(start, size)]
    return pd.DataFrame({"id": ids[start], "ids": [others[c] for c in cut], "sims": [sims[c] for c in cut], "fresh": [np.ones(c.stop - c.start, bool) for c in cut]})


def _local_join(offer: int, degree: int):
    def offers(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, fresh: np.ndarray, seen: list) -> None:
        sims = x @ x.T
        sims[~(fresh[:, None] | fresh[None, :])] = -2.0
        np.fill_diagonal(sims, -2.0)
        best = _top(sims, offer)
        got = np.take_along_axis(sims, best, axis=1)
        for i in np.flatnonzero(got[:, 0] > worst):
            good = got[i] > worst[i]
            seen.append((ids[i], ids[best[i][good]], got[i][good]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = held["center"].to_numpy() * 31 + held["part"].to_numpy()
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            yield from done(held.iloc[: cut[-1]], cut)
            held = held.iloc[cut[-1] :].reset_index(drop=True)
        if held is not None:
            yield from done(held, np.array([0, len(held)]))

    def done(pdf: pd.DataFrame, cut: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        ids, x, worst, fresh, seen = pdf["member"].to_numpy(), stack(pdf["unit"], np.float32), pdf["worst"].to_numpy(), pdf["fresh"].to_numpy(bool), []
        for a, b in zip(cut, cut[1:]):
            if b - a > 1:
                offers(ids[a:b], x[a:b], worst[a:b], fresh[a:b], seen)
        if seen:
            yield _best_offers(seen, degree)

    return run


def build_graph(rows: DataFrame, degree: int = 32, trees: int = 4, block: int = 512, rounds: int = 8, settled: float = 0.1, group: int = 96, seed: int = 11) -> DataFrame:
    """rows: (id, dim, unit). Gives (id, ids, sims, fresh): each row's neighbours found, best first. Descent ends when no more than
    a share `settled` of the links is new, after `rounds` at the latest."""
    spark = rows.sparkSession
    n = rows.count()
    bits = int(min(40, max(0, np.ceil(np.log2(max(1, n / block))))))
    coded = save(rows.select("id", "dim", "unit").mapInPandas(_project(trees, bits, seed), "id long, dim int, unit binary, codes array<long>, fine array<float>"), 4096)
    # A range of one row has nothing to compare: no more ranges than blocks, so fewer than 2 * block rows are one range.
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // block))
    lists = None
    for t in range(trees):
        order = ["dim", "code", "place", "id"]
        run = coded.select("id", "dim", "unit", F.col("codes")[t].alias("code"), F.col("fine")[t].alias("place")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        own = run.select("id", "dim", "unit").mapInPandas(_compare_blocks(block, degree), LISTS)
        lists = own if lists is None else lists.unionByName(own)
    graph = save(_best_lists(lists, degree), 4096)
    drop_saved(coded)
    free_shuffles(spark)
    for _ in range(rounds):
        counts = graph.select(F.sum(F.size("ids")).alias("links"), F.sum(F.size(F.filter("fresh", lambda x: x))).alias("fresh")).first()
        if not counts.fresh or counts.fresh <= settled * counts.links:
            break
        links = graph.select("id", F.explode(F.arrays_zip("ids", "fresh")).alias("z")).select("id", F.col("z.ids").alias("other"), F.col("z.fresh").alias("fresh"))
        ends = links.select(F.col("id").alias("center"), F.col("other").alias("member"), "fresh").unionByName(links.select(F.col("other").alias("center"), F.col("id").alias("member"), "fresh"))
        # A link known from either end was there a round ago.
        pairs = ends.groupBy("center", "member").agg(F.min("fresh").alias("fresh"))
        sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("parts"), F.max("fresh").alias("moved")).where("moved").drop("moved")
        dealt = pairs.join(sizes, "center").select("center", "member", "fresh", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"))
        known = rows.select(F.col("id").alias("member"), "unit").join(graph.select(F.col("id").alias("member"), F.when(F.size("sims") < degree, F.lit(-2.0)).otherwise(F.array_min("sims")).cast("float").alias("worst")), "member")
        met = dealt.join(known, "member").repartition("center", "part").sortWithinPartitions("center", "part")
        offered = met.select("center", "part", "member", "unit", "worst", "fresh").mapInPandas(_local_join(8, degree), LISTS)
        old = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
        new = save(_best_lists(old.unionByName(offered), degree), 4096)
        drop_saved(graph)
        free_shuffles(spark)
        graph = new
    return graph


def _score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        if len(pdf):
            a, b = stack(pdf["q"], np.float32), stack(pdf["unit"], np.float32)
            yield pd.DataFrame({"query": pdf["query"], "id": pdf["id"], "sim": np.einsum("ij,ij->i", a, b), "opened": False})


def search(rows: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = 160, open_each: int = 40, rounds: int = 5) -> DataFrame:
    """Greedy search for queries (query, q unit bytes) that are rows themselves, from their own neighbours.
    Gives (query, id, sim) for each query's beam. Rows never opened cost nothing."""
    own = graph.select(F.col("id").alias("query"), F.arrays_zip("ids", "sims").alias("z"))
    beams = save(queries.join(own, "query").select("query", F.explode("z").alias("z")).select("query", F.col("z.ids").alias("id"), F.col("z.sims").alias("sim"), F.lit(False).alias("opened")))
    # Links as rows, in both directions: a hub's in-links are no list that one task must hold.
    links = graph.select("id", F.explode("ids").alias("other"))
    around = save(links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    for _ in range(rounds):
        rank = Window.partitionBy("query").orderBy("opened", F.desc("sim"), "id")
        marked = beams.withColumn("r", F.row_number().over(rank)).withColumn("now", ~F.col("opened") & (F.col("r") <= open_each))
        near = marked.where("now").select("query", "id").join(around, "id").select("query", F.col("other").alias("id")).distinct()
        fresh = near.where("query <> id").join(beams.select("query", "id"), ["query", "id"], "left_anti")
        scored = fresh.join(queries, "query").join(rows.select("id", "unit"), "id").select("query", "q", "id", "unit").mapInPandas(_score, "query long, id long, sim float, opened boolean")
        both = marked.select("query", "id", "sim", (F.col("opened") | F.col("now")).alias("opened")).unionByName(scored)
        best = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
        after = save(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"), 4096)
        drop_saved(beams)
        beams = after
    drop_saved(around)
    return beams.select("query", "id", "sim")


def _cosine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In double precision, on the original vectors."""
    for pdf in frames:
        out = []
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            out.append(float(x @ y / np.sqrt((x @ x) * (y @ y))))
        yield pd.DataFrame({"query_id": pdf["query"], "vec_id": pdf["id"], "score": out})


def nearest(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 5, every: int = 50, **graph_options) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every` its k nearest other rows found.

    Ties go to the smaller id, however many there are among the rows found. Vectors null, empty, zero, or with null or non-finite components take no part,
    nor do rows without id; of rows that repeat an id one takes part; vectors of another length than the
    query's are no candidates. With at most k other rows all are returned. An empty table gives no row.
    """
    rows = save(unit_rows(vectors, key, column), 4096)
    graph = build_graph(rows, **graph_options)
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("unit").alias("q"))
    found = search(rows, graph, queries)
    # Single precision is off by no more than about dim * 2**-23, so whatever lies that close to the k-th is scored exactly, however many.
    top = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    whole = Window.partitionBy("query")
    dim = int(rows.agg(F.max("dim")).first()[0] or 0)
    ranked = found.withColumn("r", F.row_number().over(top)).withColumn("kth", F.min(F.when(F.col("r") <= k, F.col("sim"))).over(whole))
    few = ranked.where(F.col("sim").cast("double") >= F.col("kth").cast("double") - 2 * (dim + 8) * 2.0**-23)
    raw = rows.select("id", "raw")
    pairs = few.join(raw.withColumnsRenamed({"id": "query", "raw": "a"}), "query").join(raw.withColumnRenamed("raw", "b"), "id")
    scored = pairs.select("query", "a", "id", "b").mapInPandas(_cosine, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = save(scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), 4096)
    drop_saved(graph)
    return out
