"""Repeated byte strings across a corpus, by sorting suffixes in range-partitioned buckets.

A suffix matters only if its first `width` bytes (a window) start somewhere else too. Shipping every suffix
would move `width` bytes for each byte of text, so suffixes travel in runs, found in two passes:

1. Anchors. Within each window, the k-byte string of smallest hash (k = width // 2) is its anchor; it depends on
   the window's bytes alone, so equal windows have equal anchors, and neighbouring windows mostly share one.
   A window whose anchor occurs in one text only, and once there, is unique.
2. Runs. For anchors that occur elsewhere, the windows that share the anchor travel as one run of bytes.
   Equal runs are merged with their count: all their windows repeat.

Distinct runs are range-partitioned by leading tokens (the head of the anchor, its hash, then what follows
the anchor and the run's id, so that one very common anchor is spread over many buckets while runs that go
on alike stay together), with splitters that Spark samples.
Each bucket sorts its suffixes by multikey quicksort on their bytes: by the first eight, then each group of ties
by the next eight, and so on to the end of the window; what still ties is equal. Suffixes of the anchor at either end
of a bucket may have equals across the boundary. Of those, each bucket gives out one digest a group of ties,
in blocks of 16 neighbours with the digest of the bytes that the block's windows share; only blocks whose
core occurs in another place too are opened, and digests of two buckets mark what was alone in its own.

No window is sampled, capped or dropped. Within a bucket equality is that of the bytes; whole texts, runs and windows of different
buckets are compared by 128 bits of SHA-256 or BLAKE2. The rolling hashes only choose anchors: if two strings had the same, that would add candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import by_bytes, free_shuffles, prefix_hash, save, text_key, tidy, window_hash

PART = 1 << 18
ANCHORS = "key binary, anchor long, n int, at long"
RUNS = "key binary, at long, run binary, bytes binary, lead binary, anchor long, tail binary, lead_at int"
SORTED = "run binary, starts array<int>, c1 long, c2 long, h1 array<long>, h2 array<long>, off array<int>, alone array<boolean>"
BLOCK = 16


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = len(a)
    pad = np.concatenate([a, np.full((-n) % width, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def parts(texts: list[bytes], width: int) -> list[tuple[int, int, bytes]]:
    """(row, offset, bytes): rows of at least `width` bytes, long ones in parts that share width - 1 bytes."""
    out = []
    for i, t in enumerate(texts):
        for at in range(0, len(t) - width + 1, PART):
            out.append((i, at, t if len(t) <= PART else t[at : at + PART + width - 1]))
    return out


def anchor_runs(pieces: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (piece, first start, end of starts, anchor hash, whether the
    anchor occurs twice within the run, offset of its first occurrence); positions are within the piece."""
    k = width // 2
    room = width - k + 1
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    hashes = window_hash(prefix_hash(data), k)
    least = _sliding_min(hashes, room)
    edge = np.zeros(len(least) + 1, np.int32)
    edge[ends - sizes] += 1
    stop = ends - width + 1
    edge[stop[stop <= len(least)]] -= 1
    ok = np.cumsum(edge[:-1]) > 0
    change = ok.copy()
    change[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    a = np.flatnonzero(change)
    breaks = np.append(np.flatnonzero(change | ~ok), len(least))
    b = breaks[np.searchsorted(breaks, a, side="right")]
    value = least[a]
    twice = (b - a) > room
    first = np.zeros(len(a), np.int64)
    span = np.arange(2 * room)
    last = len(hashes) - 1
    for i in range(0, len(a), 1024):
        rows = slice(i, i + 1024)
        grid = a[rows, None] + span[None, :]
        hit = (hashes[np.minimum(grid, last)] == value[rows, None]) & (grid < (b[rows] + room - 1)[:, None])
        twice[rows] |= hit.sum(axis=1) > 1
        first[rows] = hit.argmax(axis=1) + a[rows]
    piece = np.searchsorted(ends, a, side="right")
    base = (ends - sizes)[piece]
    return piece, a - base, b - base, value.view(np.int64), twice, first - base


def _encode(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _find_anchors(width: int):
    """A row for each anchor of a text and chunk: n is 2 if it occurs more than once there, `at` its first offset in
    the text. A long text is several chunks, so an anchor may also repeat between rows of one key, at another offset."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, texts = list(pdf["key"]), _encode(pdf["text"])
            cut = parts(texts, width)
            for a, b in by_bytes([len(p) for _, _, p in cut], PART):
                piece, _, _, value, twice, lead = anchor_runs([p for _, _, p in cut[a:b]], width)
                row = np.array([r for r, _, _ in cut[a:b]])[piece]
                at = np.array([x for _, x, _ in cut[a:b]])[piece] + lead
                order = np.lexsort((at, value, row))
                row, value, twice, at = row[order], value[order], twice[order], at[order]
                new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
                head = np.flatnonzero(new)
                if len(head):
                    n = np.maximum(np.diff(np.append(head, len(row))), 1 + np.maximum.reduceat(twice.astype(np.int64), head))
                    yield pd.DataFrame({"key": [keys[r] for r in row[head]], "anchor": value[head], "n": np.minimum(n, 2).astype(np.int32), "at": at[head]})

    return run


def _cut_runs(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = _encode(pdf["text"])
            keys, anchors = list(pdf["key"]), list(pdf["anchors"])
            cut = parts(texts, width)
            for a, b in by_bytes([len(p) for _, _, p in cut], PART):
                own = cut[a:b]
                piece, first, end, value, twice, lead = anchor_runs([p for _, _, p in own], width)
                rows = np.array([r for r, _, _ in own])[piece]
                hot = np.concatenate([np.asarray(anchors[r], np.int64) for r in sorted({r for r, _, _ in own})])
                out = []
                for j in np.flatnonzero(np.isin(value, hot)).tolist():
                    _, at, data = own[piece[j]]
                    text = data[first[j] : end[j] + width - 1]
                    out.append((keys[rows[j]], at + int(first[j]), hashlib.blake2b(text, digest_size=16).digest(), text, data[lead[j] : lead[j] + 16], int(value[j]), data[lead[j] + width // 2 : min(lead[j] + width // 2 + 64, end[j] + width - 1)], -1 if twice[j] else int(lead[j] - first[j])))
                if out:
                    yield pd.DataFrame(out, columns=["key", "at", "run", "bytes", "lead", "anchor", "tail", "lead_at"])

    return run


def multikey_groups(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Multikey quicksort of the windows that start at `at`, by characters of eight bytes (words[i]: those at i): sort by
    the first character, then each group of ties by the next. The group of each window: -1 for one without an equal."""
    out = np.full(len(at), -1, np.int64)
    n = len(at) if len(at) > 1 else 0
    rows, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(-(-width // 8)):
        if not len(rows):
            break
        c = words[at[rows] + min(8 * depth, width - 8)]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        differs = c != c[head][group]
        if not differs.any():
            continue  # all groups tie in this character
        split = np.zeros(len(head), bool)
        split[group[differs]] = True
        part = np.flatnonzero(split[group])
        order = part[np.lexsort((c[part], group[part]))]
        rows[part], c[part] = rows[order], c[order]
        new = np.append(True, (group[1:] != group[:-1]) | (c[1:] != c[:-1]))
        label = np.cumsum(new) - 1
        many = np.bincount(label)[label] > 1
        rows, group = rows[many], np.cumsum(new[many]) - 1
    out[rows] = group
    return out


class _Windows:
    """The windows of some runs: for each its run (owner), its offset there and its place in `data`."""

    def __init__(self, runs: list[bytes], width: int) -> None:
        self.bytes = b"".join(runs)
        self.data = np.frombuffer(self.bytes, np.uint8)
        sizes = np.array([len(r) for r in runs])
        count = sizes - width + 1
        self.base = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(runs)), count)
        self.off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.at = self.base[self.owner] + self.off

    def words(self) -> np.ndarray:
        """At each place the next eight bytes as a number that sorts as they do."""
        out = np.zeros(len(self.data) - 7, np.uint64)
        for i in range(8):
            out = (out << np.uint64(8)) | self.data[i : len(out) + i]
        return out

    def digests(self, start: np.ndarray, size: int) -> np.ndarray:
        """128 bits, as two numbers, for `size` bytes from each start."""
        view = memoryview(self.bytes)
        return np.frombuffer(b"".join(hashlib.blake2b(view[a : a + size], digest_size=16).digest() for a in start.tolist()), np.int64).reshape(-1, 2)

    def anchors(self, rows: np.ndarray, values: np.ndarray, sizes: np.ndarray, k: int, step: int = 1 << 17) -> np.ndarray:
        """Positions at which the k-byte anchors (`values`) of these runs occur, ascending as `rows` are."""
        count = sizes - k + 1
        ends = np.cumsum(count)
        prefix = prefix_hash(self.data)
        out = [np.zeros(0, np.int64)]
        for a in range(0, int(count.sum()), step):
            n = np.arange(a, min(a + step, int(ends[-1])))
            row = np.searchsorted(ends, n, side="right")
            at = self.base[rows[row]] + n - (ends - count)[row]
            out.append(at[shared.span_hash(prefix, at, at + k).view(np.int64) == values[row]])
        return np.concatenate(out)


def _ranges(flags: np.ndarray) -> list[int]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).ravel().tolist()


def _sort_bucket(width: int, chunk: int = 1 << 19, most: int = 2 << 20):
    """Rows come sorted by (lead, anchor, tail, run). Chunks end between anchors if they can; suffixes of the anchor
    at the end of a chunk that cannot, and of the first and last anchor, are also given out as hashes."""

    def sort(rows: list[tuple], edge: set) -> Iterator[pd.DataFrame]:
        w = _Windows([r[1] for r in rows], width)
        many = np.array([r[3] for r in rows])
        group = multikey_groups(w.words(), w.at, width)
        tied = (group >= 0) | many[w.owner]
        bounds = np.searchsorted(w.owner, np.arange(len(rows) + 1))
        out = [(r[0], found) for i, r in enumerate(rows) if (found := _ranges(tied[bounds[i] : bounds[i + 1]]))]
        if out:
            yield pd.DataFrame({"run": [x[0] for x in out], "starts": [x[1] for x in out]} | {c: None for c in ("c1", "c2", "h1", "h2", "off", "alone")})
        pick = np.flatnonzero(np.array([r[2] in edge for r in rows])[w.owner])
        if not len(pick):
            return
        _, first = np.unique(group[pick], return_index=True)
        pick = np.sort(np.concatenate([pick[group[pick] < 0], pick[first][group[pick[first]] >= 0]]))
        # Blocks are counted from the first anchor within the window, so that they depend on the window's bytes alone:
        # equal windows fall into equal blocks, whether their runs hold the anchor once or more often.
        own, at = w.owner[pick], w.at[pick]
        lead = w.base[own] + np.array([r[4] for r in rows])[own]
        twice = lead < w.base[own]
        if twice.any():
            several = np.unique(own[twice])
            hits = w.anchors(several, np.array([rows[i][2][1] for i in several], np.int64), np.array([len(rows[i][1]) for i in several]), width // 2)
            lead[twice] = hits[np.searchsorted(hits, at[twice])]
        start = lead - (lead - at) // BLOCK * BLOCK
        head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (start[1:] != start[:-1])))
        first, start = pick[head], start[head]
        core, whole = w.digests(start, width - (BLOCK - 1)), w.digests(at, width)
        parts = lambda x: np.split(x, head[1:])
        yield pd.DataFrame({
            "run": [rows[i][0] for i in w.owner[first]], "starts": None, "c1": core[:, 0], "c2": core[:, 1],
            "h1": parts(whole[:, 0]), "h2": parts(whole[:, 1]), "off": parts(w.off[pick].astype(np.int32)), "alone": parts(~tied[pick]),
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held, edge, first = 0, set(), True
        for pdf in frames:
            for r, data, lead, anchor, many, lead_at in zip(*(pdf[c] for c in ("run", "bytes", "lead", "anchor", "many", "lead_at"))):
                group = (lead, anchor)
                if first:
                    edge, first = {group}, False
                if rows and held >= chunk and rows[-1][2] != group:
                    yield from sort(rows, edge)
                    rows, held = [], 0
                elif held >= most:
                    edge.add(group)
                    yield from sort(rows, edge)
                    rows, held = [], 0
                rows.append((r, data, group, bool(many), int(lead_at)))
                held += len(data)
        if rows:
            edge.add(rows[-1][2])
            yield from sort(rows, edge)

    return run


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(key, text, copies): one row for each different text."""
    return docs.select(text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def repeated_windows(docs: DataFrame, text: str = "text", width: int = 400) -> DataFrame:
    """(key, starts): for each different text in which some window of `width` bytes starts that also starts
    elsewhere in the corpus (another text, or another place of the same), the flat list of ranges
    [from, to) of such starts. Windows that repeat only because whole texts do are not listed: see
    `copies` in distinct_texts."""
    if width < 16:
        raise ValueError("width must be at least 16 bytes")
    spark = docs.sparkSession
    plain = docs.select(text_key(text).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") >= width)
    anchors = save(plain.mapInPandas(tidy(_find_anchors(width)), ANCHORS))
    elsewhere = anchors.groupBy("anchor").agg(F.min("key").alias("_a"), F.max("key").alias("_b"), F.max("n").alias("_n"), F.min("at").alias("_from"), F.max("at").alias("_to")).where("_a <> _b OR _n > 1 OR _from <> _to").select("anchor")
    hot = anchors.select("key", "anchor").join(elsewhere, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    runs = save(distinct_texts(docs, text).join(hot, "key").select("key", "text", "anchors").mapInPandas(tidy(_cut_runs(width)), RUNS))
    shared.drop_saved(anchors)
    free_shuffles(spark)
    merged = runs.groupBy("run").agg(F.first("bytes").alias("bytes"), F.first("lead").alias("lead"), F.first("anchor").alias("anchor"), F.first("tail").alias("tail"), F.first("lead_at").alias("lead_at"), (F.count("*") > 1).alias("many"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["lead", "anchor", "tail", "run"]
    found = save(merged.repartitionByRange(buckets, *order).sortWithinPartitions(*order).mapInPandas(tidy(_sort_bucket(width)), SORTED), 2048)
    blocks = found.where("starts IS NULL")
    cores = blocks.groupBy("c1", "c2").agg(F.count("*").alias("_n")).where("_n > 1").select("c1", "c2")
    opened = F.explode(F.arrays_zip("h1", "h2", "off", "alone"))
    across = blocks.join(cores, ["c1", "c2"]).select("run", opened.alias("w")).select("run", "w.h1", "w.h2", "w.off", "w.alone")
    pairs = across.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").select("h1", "h2")
    late = across.where("alone").join(pairs, ["h1", "h2"]).select("run", F.array(F.col("off"), F.col("off") + 1).alias("starts"))
    repeats = found.where("starts IS NOT NULL").select("run", "starts").unionByName(late)
    moved = runs.select("key", "at", "run").join(repeats, "run").select("key", F.transform("starts", lambda x: x.cast("long") + F.col("at")).alias("starts"))
    out = save(moved.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    shared.drop_saved(runs, found)
    free_shuffles(spark)
    return out


def cover(starts: np.ndarray | None, n_bytes: int, copies: int, width: int) -> np.ndarray:
    """Merged byte spans (rows [from, to)) that the windows at `starts` cover."""
    if n_bytes < width:
        return np.zeros((0, 2), np.int64)
    if copies > 1:
        return np.array([[0, n_bytes]], np.int64)
    if starts is None or not len(starts):
        return np.zeros((0, 2), np.int64)
    pairs = np.asarray(starts, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1] - 1 + width)
    new = np.append(True, pairs[1:, 0] > end[:-1])
    return np.column_stack([pairs[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)]])


def without(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def whole_characters(data: bytes, spans: np.ndarray) -> np.ndarray:
    """Shrink spans to whole UTF-8 characters, so that what stays is text."""
    out = []
    for a, b in spans.tolist():
        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def removal(docs: DataFrame, text: str = "text", width: int = 400) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `width` bytes that also starts anywhere else covers it. Null text: empty.
    Texts shorter than `width` stay whole; texts of which there are exact copies of that length go whole. Rows that
    repeat are copies of each other, whatever their doc_id, which may be null. Very long texts are read in parts that overlap, so nothing is lost at a cut.
    Only `text` and doc_id are looked at; an empty table gives no row.
    """
    starts = repeated_windows(docs, text, width)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, data, copies, own in zip(pdf["key"], _encode(pdf["text"]), pdf["copies"], pdf["starts"]):
                spans = cover(own, len(data), int(copies), width)
                out.append((key, len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
            yield pd.DataFrame(out, columns=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = distinct_texts(docs, text).join(starts, "key", "left").select("key", "text", "copies", "starts")
    results = save(texts.mapInPandas(tidy(run), "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return docs.select("doc_id", text_key(text).alias("key")).join(results, "key").drop("key")


def strip_repeats(docs: DataFrame, text: str = "text", width: int = 200) -> DataFrame:
    """`docs` with repeated strings of `width` bytes or more taken out of their texts, at whole characters.
    Rows whose text does not change are kept as they are (null and empty texts too); rows that repeat, and texts of that length that
    have exact copies, lose their whole text. Other columns stay, whatever their names; an empty table stays empty."""
    starts = repeated_windows(docs, text, width)
    copies = docs.groupBy(text_key(text).alias("key")).agg(F.count("*").alias("copies"))
    marks = copies.join(starts, "key", "left").where(F.col("starts").isNotNull() | (F.col("copies") > 1))

    def rest(t: str | None, n: float, s: np.ndarray | None) -> str | None:
        if t is None or (s is None and not n > 1):
            return t
        data = t.encode("utf-8", "surrogatepass")
        return without(data, whole_characters(data, cover(s, len(data), int(n) if n == n else 1, width))).decode("utf-8", "replace")

    @F.pandas_udf("string")
    def strip(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([rest(*row) for row in zip(*batch)], dtype=object)
        shared.release()

    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = {c: shared.unused(docs, c) for c in ("key", "copies", "starts")}
    joined = docs.withColumn(own["key"], text_key(text)).join(marks.withColumnsRenamed(own), own["key"], "left")
    return joined.withColumn(text, strip(F.col(text), F.col(own["copies"]), F.col(own["starts"]))).select(*columns)
