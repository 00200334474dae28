"""Near-duplicate texts by BagMinHash, banding and verified multiset overlap.

A text is the bag of its shingles of `size` words (lower-cased runs of letters, digits and '_'), a shingle's
count being its weight; shorter texts are one shingle of all their words. Signature: weights are whole numbers, so their levels are the leaves of
a binary tree whose top nodes are the ranges [0,1), [1,2), [2,4), [4,8) ... Each shingle has a Poisson process in time for each range, seeded by shingle
and range. A range that a bag's weight covers is one process, however many levels it has; the one in which the weight ends is split: each of its points
goes down a random path of halves, one bit a level, to its own weight level, and is kept if that lies below the weight. So bags of any
weights see the same points where both have weight. A point has a random component, whose value is its earliest kept point. Two bags agree in a component with
probability sum(min) / sum(max), their weighted Jaccard similarity, without bias; a process stops once its time is past the bag's slowest component.

Texts that agree on all components of a band are candidates; candidates are verified on the texts
themselves. No pair within a bucket is emitted as such:

1. each member is compared with its bucket's smallest member (first with the smallest over its bands, then
   with the others if they are not in one class yet);
2. buckets that still hold several classes are compared in blocks of bounded size, each pair of blocks in
   one task, which gives out only the links that join classes.

So every candidate pair is either within one class or was compared and found below the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import by_bytes, drop_saved, free_shuffles, mix, prefix_hash, save, span_hash, text_key, tidy

NOT_WORD = re.compile(r"\W+")


@dataclass(frozen=True)
class Params:
    """125 components in 25 bands of 5: a pair at 0.8 is a candidate with probability 0.99995."""

    size: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    block: int = 256
    block_bytes: int = 2 << 20

    @property
    def components(self) -> int:
        return self.bands * self.rows


def canonical(text: str | None) -> str:
    """The words of a text, each after one space."""
    return NOT_WORD.sub(" ", text.lower()).strip() if text else ""


def shingle_bags(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of canonical texts, sorted by row."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    prefix = prefix_hash(data)
    stop = np.flatnonzero(data == 32)  # the end of each word; an empty text gives an empty word
    start = np.append(0, stop[:-1] + 1)
    row = np.searchsorted(begin, start, side="right") - 1
    full = stop > start
    start, stop, row = start[full], stop[full], row[full]
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.bincount(row, minlength=len(texts))
    nth = np.arange(n) - (np.cumsum(words) - words)[row]
    have = words[row]
    first = (nth == 0) | (nth + size <= have)
    i = np.flatnonzero(first)
    last = i + np.minimum(size, have[i]) - 1
    hashes, row = span_hash(prefix, start[i], stop[last]), row[i]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    head = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
    return row[head], hashes[head], np.diff(np.append(head, len(row)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def path(bits: np.ndarray, width: int) -> np.ndarray:
    """The level, counted from the start of a range of `width` levels (a power of two), that a point reaches by choosing a half again and again."""
    at, half = np.zeros(len(bits), np.int64), width >> 1
    for depth in range(width.bit_length() - 1):
        at += np.where((bits >> np.uint64(depth)) & np.uint64(1), half, 0)
        half >>= 1
    return at


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """BagMinHash: for each row, m 64-bit values (0 in rows without shingles)."""
    best = np.full(n_rows * m, np.inf)
    owner = np.zeros(n_rows * m, np.uint64)
    limit = np.full(n_rows, np.inf)
    top = int(weight.max()) if len(weight) else 0
    low, high = 0, 1
    while low < top:
        on = weight > low
        r, w = row[on], weight[on]
        seed = mix(shingle[on] + np.uint64((high * 0xD6E8FEB86659FD93) & (2**64 - 1)))
        time = np.zeros(len(r))
        rate, width, point = float(high - low), high - low, 0
        while len(r):
            point += 1
            bits = mix(seed + np.uint64((point * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            time = time - np.log(_uniform(bits)) / rate
            alive = time <= limit[r]
            if not alive.all():
                r, w, seed, time, bits = r[alive], w[alive], seed[alive], time[alive], bits[alive]
            more = mix(bits ^ np.uint64(0xA0761D6478BD642F))
            cell = r * m + (more % np.uint64(m)).astype(np.int64)
            keep = low + path(mix(more), width) < w
            c, t, b = cell[keep], time[keep], bits[keep]
            np.minimum.at(best, c, t)
            won = best[c] == t
            owner[c[won]] = b[won]
            limit = best.reshape(n_rows, m).max(axis=1)
        low, high = high, 2 * high
    return owner.reshape(n_rows, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band, different for different bands."""
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), np.uint64(b + 1))
        for j in range(rows):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, b * rows + j])
        out[:, b] = h
    return out


def _band_rows(p: Params):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [canonical(t).encode("utf-8", "replace") for t in pdf["text"]]
            keys = list(pdf["key"])
            for a, b in by_bytes([len(t) + 200 for t in texts], 1 << 19):
                row, shingle, weight = shingle_bags(texts[a:b], p.size)
                bands = band_hashes(signatures(row, shingle, weight, b - a, p.components), p.bands, p.rows)
                have = np.unique(row)
                yield pd.DataFrame({"key": [keys[a + i] for i in have], "bands": list(bands[have].view(np.int64))})

    return run


def bag(text: str, size: int) -> Counter:
    """A text's shingles by the definition; the operator counts their hashes."""
    words = canonical(text).split(" ")
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of smaller over sum of larger counts."""
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _bags(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_bags of texts as they are, in chunks: a worker's tables of powers grow with the longest chunk and stay."""
    plain = [canonical(t).encode("utf-8", "replace") for t in texts]
    parts = [(a, *shingle_bags(plain[a:b], size)) for a, b in by_bytes([len(t) for t in plain], 1 << 19)]
    return tuple(np.concatenate(x) for x in zip(*[(row + a, shingle, count) for a, row, shingle, count in parts]))


def overlap(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> int:
    """Sum of the smaller counts of two bags: sorted shingle hashes and their counts."""
    if len(a) > len(b):
        a, n_a, b, n_b = b, n_b, a, n_a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = np.flatnonzero(b[at] == a)
    return int(np.minimum(n_a[hit], n_b[at[hit]]).sum())


def overlaps(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int, width: int = 1024) -> np.ndarray:
    """The same for all pairs of some bags, as a matrix. The smaller of two counts is the number of levels
    that both reach, so each (shingle, level) is a feature that a bag has or not, and the overlaps are the products of
    the bags' feature rows. Features of one bag only are left out; the others go `width` at a time."""
    each = np.repeat(np.arange(len(row)), count)
    level = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    feature = mix(shingle[each] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], row[each][order]
    head = np.append(True, feature[1:] != feature[:-1])[: len(feature)]
    ident = np.cumsum(head) - 1
    many = np.bincount(ident)[ident] > 1
    owner, ident = owner[many], np.cumsum(head[many]) - 1
    out = np.zeros((n_rows, n_rows))
    for base in range(0, int(ident[-1]) + 1 if len(ident) else 0, width):
        a, b = np.searchsorted(ident, [base, base + width])
        has = np.zeros((n_rows, width), np.float32)
        has[owner[a:b], ident[a:b] - base] = 1.0
        out += has @ has.T
    return out


def verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Of (a, b) those whose texts are similar enough. texts: (key, text)."""
    def alike(keys: list[tuple[bytes, bytes]], whole: dict[bytes, str]) -> list[bool]:
        place = {k: i for i, k in enumerate(whole)}
        row, shingle, count = _bags(list(whole.values()), p.size)
        edge = np.searchsorted(row, np.arange(len(whole) + 1))
        total = np.bincount(row, count, len(whole))
        out = []
        for a, b in keys:
            x, y = place[a], place[b]
            if min(total[x], total[y]) < p.threshold * max(total[x], total[y]):
                out.append(False)
                continue
            own, other = slice(edge[x], edge[x + 1]), slice(edge[y], edge[y + 1])
            both = overlap(shingle[own], count[own], shingle[other], count[other])
            out.append(both / (total[x] + total[y] - both) >= p.threshold)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            a, ta, b, tb = (list(pdf[c]) for c in ("a", "ta", "b", "tb"))
            ok: list[bool] = []
            for i, j in by_bytes([len(x) + len(y) for x, y in zip(ta, tb)], 1 << 20):
                ok += alike(list(zip(a[i:j], b[i:j])), dict(zip(a[i:j], ta[i:j])) | dict(zip(b[i:j], tb[i:j])))
            yield pdf.loc[ok, ["a", "b"]]

    first = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a")
    both = first.join(texts.withColumnsRenamed({"key": "b", "text": "tb"}), "b")
    return save(both.select("a", "ta", "b", "tb").mapInPandas(tidy(run), "a binary, b binary"), 256)


def _labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the class of `column`: itself where labels has none."""
    own = labels.withColumnsRenamed({"node": column, "root": "_root"})
    return df.join(own, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def _blocks(members: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """members: (bucket, key, label), buckets with several classes. Compares the pairs of different classes."""
    whole = members.join(texts, "key")
    full = F.greatest(F.count("*") / F.lit(p.block), F.sum(F.octet_length("text")) / F.lit(p.block_bytes))
    sizes = whole.groupBy("bucket").agg(F.ceil(full).cast("int").alias("parts"))
    place = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    # A pair of blocks is a task; a member of block i goes to the pairs (i, 0..) and (.., i), so it is sent as
    # often as its bucket has blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = members.join(sizes, "bucket").withColumn("part", place).withColumn("other", other)
    dealt = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "label").join(texts, "key")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        at = None

        def done() -> pd.DataFrame:
            parent: dict[bytes, bytes] = {}

            def find(x: bytes) -> bytes:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            n = len(rows)
            row, shingle, count = _bags([r[3] for r in rows], p.size)
            both, total = overlaps(row, shingle, count, n), np.bincount(row, count, n)
            either = total[:, None] + total[None, :] - both
            alike = np.triu(both / np.maximum(either, 1.0) >= p.threshold, 1)
            if at[1] != at[2]:  # pairs within a block are compared where the block meets itself
                part = np.array([r[0] for r in rows])
                alike &= part[:, None] != part[None, :]
            links = []
            for x, y in np.argwhere(alike):
                one, other = find(rows[x][2]), find(rows[y][2])
                if one != other:
                    links.append((rows[x][1], rows[y][1]))
                    parent[one] = other
            return pd.DataFrame(links, columns=["a", "b"])

        for pdf in frames:
            for bucket, i, j, part, key, label, text in pdf[["bucket", "i", "j", "part", "key", "label", "text"]].itertuples(index=False, name=None):
                if at is not None and at != (bucket, i, j):
                    yield done()
                    rows = []
                at = (bucket, i, j)
                rows.append((part, key, label, text))
        if rows:
            yield done()

    spread = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return save(spread.mapInPandas(tidy(compare), "a binary, b binary"), 256)


def text_classes(docs: DataFrame, text: str = "text", p: Params = Params()) -> DataFrame:
    """(node, root) for texts in a class with other texts; both are text keys (see text_key), the root being the
    smallest of its class. Exact copies have one key and are no pair here. Texts without a word take no part."""
    spark = docs.sparkSession
    keyed = docs.select(text_key(text).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    bands = save(keyed.mapInPandas(tidy(_band_rows(p)), "key binary, bands array<long>").dropDuplicates(["key"]))
    exploded = bands.select("key", F.explode("bands").alias("bucket"))
    buckets = save(exploded.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("_last"), F.count("*").alias("members")).where("pivot <> _last").drop("_last"))
    members = save(exploded.join(buckets, "bucket"))
    drop_saved(bands)
    free_shuffles(spark)
    # Copies become one row a task before anything is dealt by key, so a text with very many copies is no heavy key.
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"))
    texts = save(distinct.join(members.select("key").distinct(), "key", "left_semi"))
    free_shuffles(spark)
    stars = members.where("key <> pivot").select(F.col("key").alias("b"), F.col("pivot").alias("a")).distinct()
    nearest = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = verified(nearest, texts, p)
    labels = components(found)
    left = stars.join(nearest, ["a", "b"], "left_anti")
    left = _labelled(_labelled(left, labels, "a", "_la"), labels, "b", "_lb").where("_la <> _lb").select("a", "b")
    found = found.unionByName(verified(left, texts, p))
    labels = components(found)
    # Every member was compared with the pivot; pairs among the others are open where they differ in class.
    rest = _labelled(members.where("key <> pivot").select("bucket", "key"), labels, "key", "label")
    sums = [F.sum(F.xxhash64("key", F.lit(i)).cast("decimal(20,0)")).alias(f"_sum{i}") for i in range(2)]
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("_n"), *sums).where("_a <> _b")
    # Buckets of several bands with the very same members (equal in number and in two independent 64-bit sums) are compared once.
    once = mixed.groupBy("_n", "_sum0", "_sum1").agg(F.min("bucket").alias("bucket"))
    open_members = save(rest.join(once.select("bucket"), "bucket"))
    extra = _blocks(open_members, texts, p)
    if not extra.isEmpty():
        labels = components(found.unionByName(extra))
    free_shuffles(spark)
    return labels


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest doc_id of its class), class_size.

    Exact copies (empty texts too) are always in one class; a null text is in a class of its own, together with other
    rows of the same doc_id that are null too. A null doc_id belongs to its text's class. Texts without a
    word are alike only if equal. Very long texts are compared whole; rows that repeat, also with different ids, are in one class, and class_size counts rows.
    Only the columns `text` and `key` are looked at. An empty table gives no row.
    """
    labels = text_classes(docs, text, p)
    lone = F.concat(F.lit("null"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")
    keyed = docs.select(F.col(key).alias("doc_id"), F.when(F.col(text).isNull(), lone).otherwise(text_key(text)).alias("_key"))
    copies = keyed.groupBy("_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    rooted = _labelled(copies, labels, "_key", "_class")
    sizes = rooted.groupBy("_class").agg(F.min("_first").alias("class_id"), F.sum("_n").alias("class_size"))
    by_text = save(rooted.join(sizes, "_class").select("_key", "class_id", "class_size"))
    return save(keyed.join(by_text, "_key").select("doc_id", "class_id", "class_size"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """`docs` with one row of each class: the one with the smallest doc_id among those of the class's first
    text; rows with a null text all stay, and of rows that repeat one stays. A null doc_id is the largest. An empty table gives no row; other columns come along,
    whatever their names but those of this function's own: _key, _id, _class, _root, _f and r."""
    clash = {"_key", "_id", "_class", "_root", "_f", "r"} & set(docs.columns)
    if clash:  # other names meanwhile
        inner = [f"{c}_{i}_" if c in clash else c for i, c in enumerate(docs.columns)]
        return keep_one(docs.toDF(*inner), text, key, p).toDF(*docs.columns)
    labels = text_classes(docs, text, p)
    keyed = docs.withColumn("_key", text_key(text))
    firsts = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.min(F.struct(F.coalesce(F.col(key), F.lit(2**63 - 1)).alias("id"))).alias("_f"))
    rooted = _labelled(firsts, labels, "_key", "_class")
    best = rooted.groupBy("_class").agg(F.min(F.struct("_f.id", "_key")).alias("b")).select("b._key", F.col("b.id").alias("_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    full = keyed.where(F.col(text).isNotNull()).join(best, "_key").where(F.coalesce(F.col(key), F.lit(2**63 - 1)) == F.col("_id"))
    one = full.groupBy("_key", "_id").agg(F.first(F.struct(*columns)).alias("r")).select("r.*")
    return one.unionByName(docs.where(F.col(text).isNull()))
