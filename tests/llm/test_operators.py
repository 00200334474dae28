"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import base64
import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import balltree, chat, graph, langid, mixing, neardup, nndescent, packing, suffixes, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
WORDS = [f"w{i}" for i in range(400)]


def rng_text(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rng = np.random.default_rng(5)
    base = rng_text(rng, 120)
    near = base.replace(" ", "  ", 3).replace(base.split()[60], "changed", 1)
    passage = rng_text(rng, 90)
    rows = [
        (1, base, "en", "src1", 1, "k", 1.0), (2, base, "en", "src1", 1, "k", 1.0), (3, near, None, "src2", 1, None, None), (4, None, "en", None, None, "k", 0.0), (5, "", "en", "src1", 0, "", 0.0),
        (6, "", None, "src3", 0, "k", 0.0), (None, rng_text(rng, 50), "de", "src2", 1, "k", 0.0), (8, rng_text(rng, 30) + " " + passage + " " + rng_text(rng, 40), "de", "srcx", 1, "k", 0.0),
        (9, passage + " " + rng_text(rng, 25), "en", "src9", 1, "k", 0.0), (10, "é!! ?? ", "fr", "src1", 1, "k", 0.0), (11, "!!! ...", "fr", "src1", 1, "k", 0.0), (12, rng_text(rng, 30_000), "en", "src2", 1, "k", 0.0),
        (13, "ab " * 3000, "en", "src2", 1, "k", 0.0), (14, rng_text(rng, 60), "en", "src1", 1, "k", 0.0), (14, rng_text(rng, 60), "en", "src1", 1, "k", 0.0), (2, base, "en", "src1", 1, "k", 1.0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def classes_of(pairs):
    by = defaultdict(set)
    for node, c in pairs:
        by[c].add(node)
    return sorted(map(sorted, by.values()))


# -- op 1

def test_bagminhash_is_unbiased():
    a = {i: 1 + i % 4 for i in range(200)}
    b = {i: 1 + (i + i % 3) % 5 for i in range(40, 240)}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    agree = total = 0
    for salt in range(30):
        h = lambda k: int.from_bytes(hashlib.blake2b(f"{salt}/{k}".encode(), digest_size=8).digest(), "big")
        row = np.array([0] * len(a) + [1] * len(b))
        sig = neardup.signatures(row, np.array([h(k) for k in [*a, *b]], np.uint64), np.array([*a.values(), *b.values()]), 2, 125)
        agree += int((sig[0] == sig[1]).sum())
        total += 125
    assert abs(agree / total - true) < 4 * np.sqrt(true * (1 - true) / total)


def test_near_duplicates_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(12):
        words = rng_text(rng, 150).split()
        for _ in range(9):
            own = list(words)
            for i in rng.integers(0, 150, rng.integers(0, 7)):
                own[i] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(own))
    bags = [neardup.bag(t, 5) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(bags[i], bags[j]) >= 0.8]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.classes(df, p=neardup.Params(block=4)).collect()
    assert classes_of([(r.doc_id, r.class_id) for r in got]) == classes_of(enumerate(root))


def test_near_duplicates_odd(odd, none):
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(odd).where("doc_id IS NOT NULL AND doc_id <> 14").collect()}
    assert got[1] == got[2] == got[3] == (1, 4) and got[5] == got[6] == (5, 2) and got[4] == (4, 1) and got[8] == (8, 1)
    kept = neardup.keep_one(odd).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 4, 5, None, 8, 9, 10, 11, 12, 13, 14, 14]) and neardup.keep_one(odd).columns == odd.columns
    assert neardup.classes(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


# -- op 2 and 8

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[300:400] = x[300] + 0.01 * rng.standard_normal((100, 16))
    x[500] = x[450]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [None] + [1.0] * 15, 1), (1300, [float("nan")] + [1.0] * 15, 1), (1400, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (1500, [1.0, 2.0], 1), (1600, [], 1)]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")


def test_nn_descent_recall(vectors):
    x, df = vectors
    got = defaultdict(dict)
    for r in nndescent.nearest(df, block=64, degree=16).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    queries = [i for i in range(700) if i % 50 == 0]
    hit = 0
    for q in queries:
        s = u @ u[q]
        s[q] = -2
        want = np.lexsort((np.arange(700), -s))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for v, c in got[q].values())
        hit += len({v for v, _ in got[q].values()} & set(want.tolist()))
    assert hit >= 0.9 * 5 * len(queries) and set(got) == set(queries)


def test_nearest_of_small_tables(spark):
    rng = np.random.default_rng(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for n, every in ((3, 1), (6, 1), (150, 10)):
            x = rng.standard_normal((n, 8))
            got = defaultdict(list)
            for r in nndescent.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=every).orderBy("rank").collect():
                got[r.query_id].append(r.vec_id)
            unit = x / np.linalg.norm(x, axis=1)[:, None]
            assert got == {i: sorted(set(range(n)) - {i}, key=lambda j: -(unit[i] @ unit[j]))[:5] for i in range(0, n, every)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ball_tree_exact(vectors):
    x, df = vectors
    got = defaultdict(list)
    for r in sorted(balltree.top_k(balltree.quantised(df), shard_rows=100, together=2, pack=2).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    ints = np.vstack([np.floor(1024 * x.astype(np.float64)).astype(np.int64), np.zeros((1, 16), np.int64)])
    ids = np.array([*range(700), 1100])
    for q in [0, 100, 200, 300, 400, 500, 600, 1100]:
        s = ints @ ints[list(ids).index(q)]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:10]
        assert got[q] == list(zip(ids[keep][order].tolist(), s[keep][order].tolist())), q
    assert got[1500] == []
    tree, seen = balltree.BallTree(np.arange(2000), np.sort(np.random.default_rng(0).integers(0, 1 << 20, (2000, 2)), axis=0)), []
    tree.search(-1, np.array([1, 1]), 5, float("-inf"), seen)
    assert sum(seen) < 1000  # bounds cut most of the tree


def test_ball_tree_deals_without_the_driver(spark, monkeypatch):
    """Nothing is broadcast, however small Spark takes a table for; several trees a team and vectors of two lengths give brute force's rows."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-9, 9, 6 if i % 3 else 4).tolist()) for i in range(1500)] + [(1500, [1 << 20] * 4), (1503, [1 << 33, 0, -5, 1])]
    df = spark.createDataFrame([(i, v, len(v)) for i, v in rows], "vec_id long, v array<long>, dim int")
    plans, save = [], balltree.save
    monkeypatch.setattr(balltree, "save", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, *a))
    got = defaultdict(list)
    for r in sorted(balltree.top_k(df, every=50, shard_rows=40, team=4, pack=3).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    assert len(plans) == 6 and sum("Join" in p for p in plans) == 1 and not any("Broadcast" in p for p in plans)
    for i, q in rows[::50]:
        others = [(sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q)]
        assert got[i] == sorted(others, key=lambda h: (-h[0], h[1]))[:10], i
    assert set(got) == {i for i, _ in rows if i % 50 == 0}


def test_nearest_with_many_ties(spark):
    x = np.zeros((120, 4))
    x[:, 0], x[60:, 1] = 1.0, np.arange(60) + 1  # 60 equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["rank"]: r.vec_id for r in nndescent.nearest(df).where("query_id = 50").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4} or set(got.values()) <= set(range(60)) and list(got.values()) == sorted(got.values())


def test_searches_on_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nndescent.nearest(df).count() == 0 and balltree.top_k(balltree.quantised(df)).count() == 0


# -- op 3

def test_chat(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", "c <|end|>"), (4, 0, "user", "a"), (4, 1, "bot", "x"), (5, 0, "user", "a"), (5, 1, "bot", "x"),
            (6, None, None, None), (None, 0, "user", "z"), (7, 0, "bot", "b"), (7, 1, "user", "a"), (8, 0, "u", "t"), (8, 0, "u", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {3, 4, 6, 7, 8} and got[3].n_turns == 3 and got[8].n_turns == 2
    assert got[3].rendered == "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n<|user|>\nc < |end| ><|end|>\n"
    assert chat.render(df.limit(0)).count() == 0


# -- op 4 and 6

def test_tokens_are_those_of_the_tokenizer(odd):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    encode = tokens.encoder(path)
    for t in [r.text or "" for r in odd.collect()] + ["Ünï <|endoftext|> \n\n  1234 don't\t  x", "   ", "日本語 テキスト", "a" * 3000]:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


def check_pieces(docs, rows, limit):
    encode = tokens.encoder(tokens.default_tokenizer())
    want = Counter((d, tuple(encode(t) if t else []) + (0,)) for d, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    for (d, ids), n in want.items():
        if sum(k[0] == d for k in want) > 1:
            continue
        pieces = Counter((r.start, r.length, r.ids_crc32) for r in by_doc[d])
        start = 0
        for s, length, crc in sorted(pieces):
            assert s == start and crc == zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes()) and pieces[s, length, crc] == n
            start += length
        assert start == len(ids)
    return sum(r.length for r in rows) / (limit * len(by_seq))


def test_packing(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = packing.pack(odd.coalesce(1), limits=packing.Limits(max_tokens=256)).collect()
    assert check_pieces(docs, rows, 256) > 0.97
    assert packing.pack(none).count() == 0
    few = packing.pack(odd.coalesce(1), limits=packing.Limits(max_tokens=256, max_segments=2, max_loss_tokens=100), loss_mask=F.col("doc_id") != 14, pad_power=True).collect()
    by = defaultdict(list)
    for r in few:
        by[r.sequence_id].append(r)
    assert all(len(s) <= 2 and sum(r.loss_tokens for r in s) <= 100 and sum(r.length for r in s) <= s[0].padded_to for s in by.values())


def test_loss_of_tokens(spark):
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(tokens.default_tokenizer()), np.random.default_rng(4)
    rows = []
    for i in range(60):
        ask, reply = "é " + rng_text(rng, int(rng.integers(1, 40))), rng_text(rng, int(rng.integers(1, 90)))
        rows.append((i, ask + "\n" + reply, [(len(ask), len(ask) + 1 + len(reply))] if i % 7 else None if i % 2 else []))
    df = spark.createDataFrame(rows, "doc_id long, text string, loss array<struct<start:int,end:int>>").coalesce(1)
    limits = packing.Limits(max_tokens=256, max_segments=5, max_loss_tokens=150)
    got = packing.pack(df, limits=limits, loss_spans=F.col("loss")).collect()
    masks = {}
    for i, text, spans in rows:
        e = own.encode(text, add_special_tokens=False)
        if spans is None:
            masks[i] = [True] * (len(e.ids) + 1)
        else:
            masks[i] = [any(a <= at < b for a, b in spans) for at, _ in e.offsets] + [any(b == len(text) for _, b in spans)]
    used, segments, loss = Counter(), Counter(), Counter()
    for r in got:
        assert r.loss_tokens == sum(masks[r.doc_id][r.start : r.start + r.length])
        used[r.sequence_id] += r.length
        segments[r.sequence_id] += 1
        loss[r.sequence_id] += r.loss_tokens
    assert sum(used.values()) == sum(map(len, masks.values())) and max(used.values()) <= 256 and max(segments.values()) <= 5
    assert 140 < max(loss.values()) <= 150 and sum(loss.values()) == sum(map(sum, masks.values()))


def test_very_long_runs_of_blanks(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["a" + " " * 1_200_000 + "b", "\n" * 1_100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.doc_tokens for r in packing.pack(df).select("doc_id", "doc_tokens").distinct().collect()}
    assert got == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r.length for r in tokens.length_histogram(df).collect()} == set(got.values())


def test_length_histogram(odd, none):
    encode = tokens.encoder(tokens.default_tokenizer())
    lengths = np.array([len(encode(r.text)) + 1 if r.text else 1 for r in odd.collect()])
    hist = tokens.length_histogram(odd)
    for r in hist.collect():
        assert r.n_docs == (lengths == r.length).sum() and r.tokens_from == lengths[lengths >= r.length].sum() and r.docs_below == (lengths < r.length).sum()
        assert r.share_up_to == pytest.approx((lengths <= r.length).mean()) and r.tokens_at_limit == np.minimum(lengths, r.length).sum()
    for r in tokens.at_limits(hist, [1, 2, 64, 10**6]).collect():
        assert (r.n_docs, r.n_tokens, r.docs_fit) == (len(lengths), lengths.sum(), (lengths <= r.limit).sum())
        assert r.tokens_kept == np.minimum(lengths, r.limit).sum() and r.docs_cut == (lengths > r.limit).sum()
    for r in tokens.quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.length == np.sort(lengths)[int(np.ceil(r.q * len(lengths))) - 1]
    assert tokens.length_histogram(none).count() == 0


def test_added_tokens_inside_texts(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n  don't", "<|endoftext| >", "Ünï plain"]
    ids = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in ids[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.length, r.ids_crc32) for r in packing.pack(df).collect()}
    assert got == {i: (0, len(x) + 1, zlib.crc32(np.array(x + [0], "<u4").tobytes())) for i, x in enumerate(ids)}
    assert {r.length: r.n_docs for r in tokens.length_histogram(df).collect()} == Counter(len(x) + 1 for x in ids)


# -- op 5

def test_warc_round_trip(spark):
    rows = [(1, "http://a/1\r\nX: y", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "lone"), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 50), (8, "u", "x" * 300_000), (9, "v", "again"), (9, "v", "again")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int")
    for least in (0, 5):
        got = warc.round_trip(df, min_bytes=least).collect()
        assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
        for r in got:
            body = {(p, h or "") for p, _, h in rows if p == r.page_id}.pop()[1].encode()
            same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
            last = max(same) if same and len(body) >= least else r.page_id
            assert (r.payload_bytes, r.record_type, r.refers_to) == (len(body), "revisit" if r.page_id != last else "response", last if r.page_id != last else None)
    assert warc.round_trip(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:AA\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"))
    assert gzip.decompress(gzip.compress(b"x")) == b"x"


def test_warc_hashes_a_payload_once_a_pass(spark, monkeypatch):
    rows = [(i, f"u{i}", f"page {i // 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    hashed, save = [], warc.save

    def note(frame):
        hashed.append(frame._jdf.queryExecution().optimizedPlan().toString().count("sha1("))
        return frame

    union = type(df).unionByName
    monkeypatch.setattr(type(df), "unionByName", lambda one, other: note(union(one, other)))
    monkeypatch.setattr(warc, "save", lambda frame, *options: save(note(frame), *options))
    got = warc.round_trip(df).collect()
    assert {r.page_id: r.payload_digest for r in got} == {i: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, _, h in rows}
    assert max(hashed) == 1 and sum(hashed) == 2


def test_base32_of_hex(spark):
    digests = ["00" * 20, "ff" * 20, "0000000001" * 4, "00000000ff" * 2 + "8000000000" * 2] + [hashlib.sha1(bytes([i])).hexdigest() for i in range(256)]
    got = spark.createDataFrame([(d,) for d in digests], "h string").select("h", warc.base32(F.col("h")).alias("b")).collect()
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in got) and len(got) == len(digests)


# -- op 7

def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.with_language(docs, langid.train(docs)).withColumn("held", langid.held_out())
    held = out.where("held").collect()
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    got = {r.doc_id: r.lang_pred for r in langid.with_language(odd, langid.train(odd)).collect()}
    assert got[4] == got[5] == got[11] == "und" and got[10] != "und"
    assert langid.with_language(odd, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.with_language(none, langid.train(none)).count() == 0


def test_numerals_are_no_letters(spark):
    model = langid.fit(["en", "de"], [np.unique(np.concatenate(langid.gram_ids(np.frombuffer(t, np.uint8)))) for t in (b"the house", b"das haus")])
    texts = ["\u00b2 \u00bd", "\u2460", "\u2167", "12", "_", "", None, "the house", "das haus", "\u4e2d"]
    got = [r.lang_pred for r in langid.with_language(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, prediction int").coalesce(1), model).orderBy("id").collect()]
    assert got[:7] == ["und"] * 7 and "und" not in got[7:]


def test_folded_matrix_is_the_kernel_ridge():
    """Scores against an explicit kernel: Nystroem features and regression without folding."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS[:60] if i % 3 else WORDS[40:110], 30)).encode() for i in range(80)]
    labels = ["a" if i % 3 else "b" for i in range(80)]
    ids = [np.unique(np.concatenate(langid.gram_ids(np.frombuffer(t, np.uint8)))) for t in texts]
    model = langid.fit(labels, ids, landmarks=20, ridge=1e-2)
    known = set(model.grams.tolist())
    sets = [set(x.tolist()) & known for x in ids]
    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    chosen = [[i for i in range(80) if labels[i] == n][:10] for n in ("a", "b")]
    chosen = chosen[0] + chosen[1]
    kll = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    values, vectors = np.linalg.eigh(kll)
    keep = values > 1e-6 * values.max()
    z = np.array([[kernel(x, sets[j]) for j in chosen] for x in sets]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    z = np.column_stack([z, np.ones(80)])
    y = np.where(np.array(labels)[:, None] == np.array(["a", "b"])[None], 1.0, -1.0)
    w = np.array([80 / (2 * labels.count(n)) for n in labels])
    ridge = 1e-2 * 80 * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9 * 80
    want = z @ np.linalg.solve(z.T @ (z * w[:, None]) + ridge, z.T @ (y * w[:, None]))
    x = np.array([[float(g in s) for g in model.grams.tolist()] for s in sets])
    got = x @ model.weights / np.sqrt(x.sum(axis=1))[:, None] + model.bias
    assert np.abs(got - want).max() < 1e-3 and (got.argmax(axis=1) == (np.array(labels) == "b")).mean() > 0.95


# -- op 9

def test_multikey_groups():
    rng = np.random.default_rng(0)
    for width in (16, 23, 100):
        base = bytes(rng.integers(97, 100, 900).astype(np.uint8))
        runs = [base[a : a + width + int(rng.integers(0, 200))] for a in rng.integers(0, 500, 20)] + [b"a" * (width + 50), bytes(rng.integers(97, 123, width).astype(np.uint8))]
        w = suffixes._Windows(runs, width)
        strings = [w.bytes[a : a + width] for a in w.at]
        groups, count = suffixes.multikey_groups(w.words(), w.at, width), Counter(strings)
        assert all((g >= 0) == (count[s] > 1) for g, s in zip(groups, strings))
        assert len({(g, s) for g, s in zip(groups, strings) if g >= 0}) == sum(n > 1 for n in count.values()) == len({g for g in groups if g >= 0})
    assert suffixes.multikey_groups(np.zeros(9, np.uint64), np.zeros(1, np.int64), 16).tolist() == [-1]


def brute_removal(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("buckets", ["2", "60"])
def test_repeats(spark, odd, none, buckets, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 5000)
    rng = np.random.default_rng(3)
    shared = [rng_text(rng, n) for n in (16, 30, 60)]
    texts = [rng_text(rng, int(rng.integers(0, 60))) + " " + shared[i % 3] + rng_text(rng, int(rng.integers(0, 60))) for i in range(90)] + ["é" * 300, "é" * 300 + "x", "abc" * 200, "a" * 999, ""]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: tuple(r)[1:] for r in suffixes.removal(df, width=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i] for i in range(len(texts))] == list(brute_removal(texts, 100))
    if buckets == "2":
        rows = odd.where("doc_id IS NOT NULL AND doc_id NOT IN (14, 2)")
        want = dict(zip([r.doc_id for r in rows.collect()], brute_removal([r.text for r in rows.collect()], 200)))
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal(rows, width=200).collect()} == want
        kept = suffixes.strip_repeats(odd)
        assert kept.columns == odd.columns and kept.count() == odd.count() and suffixes.removal(none).count() == 0


def test_repeats_between_parts_of_one_text(spark):
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)).decode() for n in (640_000, 560_000, 540_000)]
    places = [(0, 10_000, 600_000), (1, 2_000, 2 * suffixes.PART - 120)]
    for i, a, b in places:
        texts[i] = texts[i][:b] + texts[i][a : a + 250] + texts[i][b + 250 :]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal(df, width=200).collect()}
    assert [got[i] for i in range(3)] == list(brute_removal(texts, 200))
    assert [got[i][1] for i in range(3)] == [500, 500, 0]


@pytest.mark.parametrize("width", [100, 400])
def test_repeats_between_runs_with_one_and_more_anchors(spark, width, monkeypatch):
    sort_bucket = suffixes._sort_bucket
    monkeypatch.setattr(suffixes, "_sort_bucket", lambda width: sort_bucket(width, chunk=1, most=1))
    rng = np.random.default_rng(width)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    texts = []
    for period in (width // 2, width // 2 - 7, 3):
        for _ in range(3):
            line = letters(period)
            few, many = -(-width // period), -(-5 * width // 2 // period)
            texts += [letters(70) + line * n + letters(90) for n in (many, many + 1, many, few)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal(df, width=width).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_removal(texts, width))


# -- op 10

def test_mixing(odd, none):
    rows = mixing.mix(odd, {"lang": {"en": 3}}, budget=700, max_epochs=2).collect()
    assert sum(r.selected_tokens for r in rows) == 700 and all(r.selected_tokens <= 2 * r.tokens for r in rows)
    everything = mixing.mix(odd, {}, budget=10**9, max_epochs=2).collect()
    assert all(r.epochs == 2 and r.prefix_tokens == 0 for r in everything)
    assert mixing.mix(none, {}).count() == 0


def test_shortages_go_to_siblings_first(spark):
    words = lambda n: "w " * n
    rows = [(1, words(10), "a", "src0"), (2, words(500), "a", "src4"), (3, words(500), "b", "src0"), (4, words(500), "a", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.selected_tokens for r in mixing.mix(df, {}, budget=400, max_epochs=1).collect()}
    assert got == {1: 10, 2: 90, 3: 100, 4: 200}


def test_null_and_repeated_ids_are_spread(spark):
    rows = [(None if i % 2 else 5, f"t{i} " + "w " * (1 + i % 9), "en", "src1") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, {}, budget=500, max_epochs=1, range_rows=10).collect()
    assert sum(r.selected_tokens for r in got) == 500 and sum(r.selected_tokens < r.tokens for r in got) <= 1 and {r.doc_id for r in got} == {None, 5}


# -- the registered queries

def test_registered_queries_and_their_sql(spark, sf):
    import duckdb

    from strandline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, query in queries.QUERIES.items():
        df = query(spark, sf)
        rows = df.collect()
        assert rows, name
        if name in queries.ORACLE_SQL:
            want = con.sql(queries.ORACLE_SQL[name])
            at = [want.columns.index(c) for c in df.columns]
            assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in at) for r in want.fetchall()), name
