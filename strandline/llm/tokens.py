"""Token ids, and the exact histogram of encoded lengths.

`encoder()` gives the ids of a public `tokenizers` file. A byte-level BPE file is run by tiktoken, which
gives the same ids from the same vocabulary several times faster (tests compare the two); any other file,
and any text that tiktoken refuses, goes through `tokenizers` itself. So do texts that hold a string of an
added token: the operators give it that token's id, as `tokenizers` does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

# The split pattern of this family of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: A run of more blanks than this goes to `tokenizers`: the pattern engine of tiktoken backtracks over a run and gives up, with an
#: error that is no Exception, at about a million.
LONG_RUN = re.compile(r"\s{10000}")


@lru_cache(maxsize=4)
def _tokenizer(path: str, added: bool):
    """`tokenizers` itself; loaded when a text first needs it."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = not added
    return slow


def _plain(path: str, added: bool) -> Callable[[str], list[int]]:
    return lambda text: _tokenizer(path, added).encode(text, add_special_tokens=False).ids


def bears_loss(text: str | None, spans: list, path: str) -> np.ndarray:
    """For each id of a text, end id included, whether its first character lies in one of the spans [start, end) of characters.
    The end id bears loss if a span reaches the text's end."""
    text = text or ""
    first = np.array([a for a, _ in _tokenizer(path, True).encode(text, add_special_tokens=False).offsets], np.int64)
    out = np.zeros(len(first) + 1, bool)
    for s in spans:
        out[:-1] |= (first >= s["start"]) & (first < s["end"])
        out[-1] |= s["end"] >= len(text)
    return out


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer in `path`, without special tokens around them. Strings of special tokens inside
    a text are ordinary text, or with `added` those tokens, as in a call of `tokenizers` with its default flags."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if not (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"):
        return _plain(path, added)
    import tiktoken

    byte_of, special = _byte_of_char(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    fast._mergeable_ranks = {}  # its Rust core has a copy
    own = sorted(special) if added else []
    del spec, ranks

    def encode(text: str) -> list[int]:
        if any(t in text for t in own) or LONG_RUN.search(text):
            return _plain(path, added)(text)
        try:
            return fast.encode_ordinary(text)
        except (ValueError, UnicodeEncodeError):
            return _plain(path, added)(text)

    return encode


def encoded_length(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """`docs` without its text, with `n_tokens`: the ids of the whole text and the end id. Null text: empty."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        encode = encoder(path, added=True)
        return pd.Series([len(encode(t)) + 1 if t else 1 for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", length(F.col(text))).drop(text)


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums, for each value of the columns `by`.

    One row a length L that occurs: `n_docs`, `n_tokens` (L * n_docs); suffix sums `docs_from` and `tokens_from` (over
    all documents of length L or more); `docs_below`, `tokens_below`; and what they answer: `share_up_to` (part of the
    documents of length L or less, from which quantiles are read) and `tokens_at_limit` (tokens in all when each document is cut to L).
    Limits between two lengths are answered by `at_limits` without reading a text again. Equal texts are encoded as often as they
    occur; rows that repeat count each time; very long texts are encoded whole; a null or empty text has length 1 (its end id); columns
    besides `text` and `by` are not looked at; an empty table gives no row.
    """
    lengths = encoded_length(docs.select(*by, text), text, tokenizer)
    counts = save(lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs")), 1024)
    counts = counts.withColumnRenamed("n_tokens", "length").withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    up = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    out = counts.withColumns({
        "docs_from": F.sum("n_docs").over(up), "tokens_from": F.sum("n_tokens").over(up),
        "_docs": F.sum("n_docs").over(full), "_tokens": F.sum("n_tokens").over(full),
    })
    out = out.withColumns({"docs_below": F.col("_docs") - F.col("docs_from"), "tokens_below": F.col("_tokens") - F.col("tokens_from")})
    out = out.withColumns({"share_up_to": (F.col("docs_below") + F.col("n_docs")) / F.col("_docs"), "tokens_at_limit": F.col("tokens_below") + F.col("length") * F.col("docs_from")})
    return out.drop("_docs", "_tokens")


def at_limits(hist: DataFrame, limits: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """For each context limit: documents and tokens in all, documents that fit, documents cut, and tokens
    kept when each document is cut to the limit. Read from the suffix sums of the first length above the limit: the documents from there on
    are cut, and what lies below them is kept whole."""
    rows = F.array(*[F.struct(F.lit(int(c)).cast("long").alias("limit")) for c in limits])
    above = F.when(F.col("length") > F.col("limit"), F.col("length"))
    sums = hist.withColumn("l", F.explode(rows)).withColumn("limit", F.col("l.limit")).groupBy(*by, "limit").agg(
        F.max_by(F.struct((F.col("docs_below") + F.col("n_docs")).alias("docs"), (F.col("tokens_below") + F.col("n_tokens")).alias("tokens")), "length").alias("all"),
        F.min_by(F.struct("docs_from", "tokens_from"), above).alias("cut"),
    )
    cut = lambda c: F.coalesce(F.col(f"cut.{c}"), F.lit(0))
    return sums.select(
        *by, "limit", F.col("all.docs").alias("n_docs"), F.col("all.tokens").alias("n_tokens"), (F.col("all.docs") - cut("docs_from")).alias("docs_fit"),
        (F.col("all.tokens") - cut("tokens_from") + F.col("limit") * cut("docs_from")).alias("tokens_kept"), cut("docs_from").alias("docs_cut"),
    )


def quantiles(hist: DataFrame, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact length quantiles: the smallest length with at least q of the documents at or below it."""
    base = hist.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    return base.where(F.col("share_up_to") >= F.col("q")).groupBy(*by, "q").agg(F.min("length").alias("length"))


def ids_batches(frames: Iterator[pd.DataFrame], text: str, path: str) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Each batch with the ids of each of its rows, end id included."""
    encode = encoder(path, added=True)
    for pdf in frames:
        yield pdf, [np.array((encode(t) if t else []) + [END_ID], dtype="<u4") for t in pdf[text]]
