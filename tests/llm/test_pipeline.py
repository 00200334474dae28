"""The pipeline's stages against brute force on the smallest documents table."""

from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from strandline.llm import langid, mixing, neardup, suffixes
from strandline.llm.shared import save
from strandline.llm.stages import BUDGET_TENTHS, REPEAT_BYTES, mixing_sources

from .test_operators import brute_removal, check_pieces


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, sf))
        seen.append(docs.toPandas())
    raw, lang, near, repeat, mixed, packed = seen
    assert all(list(x.columns) == columns for x in seen[:5])
    assert set(lang.doc_id) == {r.doc_id for r in raw.itertuples() if r.text and langid.LETTER.search(r.text)}

    bags = {r.doc_id: neardup.bag(r.text, 5) for r in lang.itertuples()}
    ids, root = sorted(bags), {}
    for i in ids:
        root[i] = next((root[j] for j in ids if j < i and neardup.similarity(bags[i], bags[j]) >= 0.8), i)
    classes = defaultdict(set)
    for i, r in root.items():
        classes[r].add(i)
    assert all(len(c & set(near.doc_id)) == 1 for c in classes.values()) and len(near) == len(classes)

    want = {}
    for r, (_, removed, _, _) in zip(near.itertuples(), brute_removal(list(near.text), REPEAT_BYTES)):
        want[r.doc_id] = (len(r.text.encode()), removed)
    left = {r.doc_id: len(r.text.encode()) for r in repeat.itertuples()}
    for i, (n, removed) in want.items():
        assert i not in left or 0 <= left[i] - (n - removed) <= 6 * max(1, removed)
        assert removed == 0 or left.get(i, 0) < n
    assert all(i in left for i, (_, removed) in want.items() if removed == 0)

    con = duckdb.connect()
    con.register("documents", repeat)
    chosen = con.sql(mixing.oracle(tenths=BUDGET_TENTHS, max_epochs=1)).df()
    assert set(mixed.doc_id) == set(chosen.doc_id) and 0 < len(mixed) <= len(repeat)
    assert check_pieces(list(zip(mixed.doc_id, mixed.text)), list(packed.itertuples()), 1024) > 0.9


def test_mixing_stage_with_null_and_repeated_ids(spark, sf):
    rows = [(None if i % 3 == 0 else i if i % 3 == 1 else 7, f"t{i} " + "w " * (i % 11), "en" if i % 2 else None, f"src{i % 5}" if i % 4 else None) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    chosen = mixing.mix(docs, mixing.WEIGHTS, budget_tenths=BUDGET_TENTHS, max_epochs=1, seed=mixing.SEED).collect()
    got = mixing_sources(spark, docs, sf).collect()
    name = lambda x: "unknown" if x is None else x
    want = Counter((r.doc_id, r.lang, r.source, r.tokens) for r in chosen)
    assert Counter((r.doc_id, name(r.lang), name(r.source), len(r.text.split())) for r in got) == want
    assert not Counter(map(tuple, got)) - Counter(rows) and {None, 7} <= {r.doc_id for r in got} and len(got) < len(rows)


def test_whole_characters():
    import numpy as np

    text = "aéz".encode()
    assert suffixes.without(text, suffixes.whole_characters(text, np.array([[2, 4]]))).decode() == "aé"
