"""Language identification with a string kernel.

Kernel: blended spectrum over the 1-, 2- and 3-grams of a text's lower-cased UTF-8 bytes, by presence,
normalised: k(x, y) = |grams(x) & grams(y)| / sqrt(|grams(x)| |grams(y)|), within the n-grams that occur in
at least two training texts. Nystroem features against landmark texts, then one-versus-rest kernel ridge
regression on them. As the kernel is linear in presence, landmarks, Nystroem map and regression fold into
one matrix (n-grams x languages); a batch of texts is scored by one product of its presence matrix.

The fit reads a bounded sample: about `per_language` texts of each language, chosen by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, release, tidy, unused

GRAMS = 256 + (1 << 16) + (1 << 24)
LETTER = regex.compile(r"\p{L}")
UNDECIDED = "und"


def gram_ids(data: np.ndarray) -> list[np.ndarray]:
    """Ids of the 1-, 2- and 3-grams of some bytes."""
    a = data.astype(np.int32)
    two = (a[:-1] << 8) | a[1:]
    return [a, two + 256, ((two[:-1] << 8) | a[2:]) + (256 + (1 << 16))]


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted ids
    weights: np.ndarray  # grams x languages
    bias: np.ndarray
    sharpness: float = 4.0

    def scores(self, presence: np.ndarray) -> np.ndarray:
        """Probabilities from a presence matrix (texts x grams)."""
        if not self.languages:
            return np.zeros((len(presence), 0), np.float32)
        norm = np.sqrt(np.maximum(presence.sum(axis=1), 1.0))
        f = self.sharpness * (presence @ self.weights / norm[:, None] + self.bias)
        e = np.exp(f - f.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None], table: np.ndarray, batch_bytes: int = 1 << 20) -> tuple[list[str], list[float]]:
        data = [t.lower().encode("utf-8", "replace") if t and LETTER.search(t) else b"" for t in texts]
        langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
        width = len(self.grams) + 1  # the last column gathers n-grams outside the vocabulary
        if not self.languages:
            return langs, scores
        for a, b in by_bytes([max(len(d), 4 * width // 8) for d in data], max(batch_bytes, 64 * width)):
            presence = np.zeros((b - a, width), np.float32)
            for i in range(a, b):
                whole = np.frombuffer(data[i], np.uint8)
                for at in range(0, len(whole), 1 << 22):  # long texts in parts that overlap by two bytes
                    for ids in gram_ids(whole[at : at + (1 << 22) + 2]):
                        presence[i - a, table[ids]] = 1.0
            p = self.scores(presence[:, :-1])
            best = p.argmax(axis=1)
            for i in range(a, b):
                if data[i]:
                    langs[i], scores[i] = self.languages[best[i - a]], float(p[i - a, best[i - a]])
        return langs, scores


def fit(languages: list[str], presence_ids: list[np.ndarray], landmarks: int = 192, ridge: float = 1e-2) -> Model:
    """languages[i] is the label of the text whose distinct n-gram ids are presence_ids[i]."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    ids, counts = np.unique(np.concatenate(presence_ids), return_counts=True)
    grams = ids[counts >= min(2, len(languages))]
    each = {n: [i for i, lang in enumerate(languages) if lang == n] for n in names}
    share = max(1, landmarks // len(names))
    chosen = [i for n in names for i in each[n][:share]]

    def rows(which: list[int]) -> np.ndarray:
        """Normalised presence of some texts."""
        x = np.zeros((len(which), len(grams)), np.float32)
        for i, j in enumerate(which):
            own = presence_ids[j]
            x[i, np.searchsorted(grams, own[np.isin(own, grams, assume_unique=True)])] = 1.0
        return x / np.sqrt(np.maximum(x.sum(axis=1), 1.0))[:, None]

    land = rows(chosen)
    values, vectors = np.linalg.eigh(land.astype(np.float64) @ land.T.astype(np.float64))
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    # Kernel values against the landmarks, a block of texts at a time: no matrix of all texts and n-grams is held.
    kernel = np.vstack([rows(list(range(a, min(a + 128, len(languages))))) @ land.T for a in range(0, len(languages), 128)])
    z = np.column_stack([kernel.astype(np.float64) @ half, np.ones(len(kernel))])
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # A language counts the same however many texts of it the sample has.
    w = np.array([len(languages) / (len(names) * len(each[lang])) for lang in languages])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + penalty * len(z), z.T @ (y * w[:, None]))
    return Model(names, grams.astype(np.int32), (land.T.astype(np.float64) @ half @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 400, max_texts: int = 4000, max_languages: int = 2000, landmarks: int = 192) -> Model:
    """Fit on rows with a non-null doc_id, lang and text with a letter that are not held out.

    The driver gets about per_language rows of each language, as distinct n-gram ids, and about max_texts in all. More than
    max_languages languages are refused. Landmarks are at least one a language.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return fit([], [])
    per_language = max(1, min(per_language, max_texts // len(counts)))
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))])
    place = F.xxhash64(F.col("doc_id")).bitwiseAND((1 << 40) - 1) / float(1 << 40)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, t, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                if LETTER.search(t):
                    data = np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8)
                    out.append((int(k), lang, np.unique(np.concatenate(gram_ids(data))).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "ids"])

    sample = rows.where(place < rate[F.col("lang")]).mapInPandas(tidy(grams), "doc_id long, lang string, ids array<int>").collect()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"], r["ids"]))
    return fit([r["lang"] for r in sample], [np.array(r["ids"], np.int32) for r in sample], landmarks)


def _table(model: Model) -> np.ndarray:
    """n-gram id -> column: 32 MB, made by each task anew and freed with it."""
    out = np.full(GRAMS, len(model.grams), np.uint16 if len(model.grams) < (1 << 16) - 1 else np.int32)
    out[model.grams] = np.arange(len(model.grams))
    return out


def with_language(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the predicted language and its probability. Null and empty texts and texts without a letter (a character of Unicode's
    category L), and all texts if nothing could be learned: 'und' with score 0. Only the text is looked at, whole however long; equal texts get equal
    predictions; other columns stay, except that columns called `pred` or `score` are replaced. An empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of a sample of at most about max_texts: a few MB

    @F.pandas_udf("pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        table = _table(m)
        for s in batches:
            langs, scores = m.predict(list(s), table)
            yield pd.DataFrame({"pred": langs, "score": scores})
        del table
        release()

    own = unused(docs, "prediction")
    out = docs.withColumn(own, predict(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (pred, score)], F.col(f"{own}.pred").alias(pred), F.col(f"{own}.score").alias(score))
