"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import langid, mixing, neardup, packing, suffixes
from .shared import small_batches, unused

#: Production parameters. A repeated passage is one of 200 bytes or more (50 words of these languages).
REPEAT_BYTES = 200
#: Of the tokens that reach the mixing stage, nine tenths are asked for, each document once at most.
BUDGET_TENTHS = 9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each text's language; texts without one (null, or no letter) are rejected. `lang` becomes the
    prediction, as every later stage should go by what the text is and not by what it was labelled. Where no row has a usable label nothing
    can be learned: then all texts with a letter stay, and `lang` as it is. Rows keep their other columns, null or repeated ids too."""
    ship(spark)
    small_batches(spark)
    model = langid.train(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = unused(docs, "pred"), unused(docs, "score")
    out = langid.with_language(docs, model, pred=pred, score=score)
    return out.where(F.col(pred) != langid.UNDECIDED).withColumn("lang", F.col(pred)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays; see neardup.keep_one."""
    ship(spark)
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere too are taken out of the texts; documents left without text go. Null and empty texts
    are without text; ids and other columns are not looked at."""
    ship(spark)
    small_batches(spark)
    out = suffixes.strip_repeats(docs, width=REPEAT_BYTES).where(F.length(F.trim("text")) > 0)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes something stay, whole. Rows carry their own selection: ids may be null or repeat.
    Documents without a token go; an empty table stays empty."""
    chosen = mixing.mix(docs, mixing.WEIGHTS, budget_tenths=BUDGET_TENTHS, max_epochs=1, seed=mixing.SEED, carry=True)
    return chosen.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; see packing.pack, which states what becomes of nulls, empty and very long texts."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixing_sources),
    ("packing", packed),
]
