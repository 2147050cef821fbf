"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and all but the last return the columns of
``documents``. Each works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontamination, packing, simhash, suffix_dedup
from tarn.llm import quality_rules as rules
from tarn.plans.materialize import materialize, release, scope
from tarn.registry import table

#: No SQL: learned rules, fingerprints, alignments and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The run that a stage belongs to; stages called by themselves share one.
_run: ContextVar[str] = ContextVar("run", default="")


def _stage(number: int) -> Callable[[Stage], Stage]:
    """Stage ``number``, which first deletes what earlier stages of the same run wrote for themselves: their results
    have been written since. What the last stage writes stays as long as the session, as its result reads it."""

    def decorate(run: Stage) -> Stage:
        @wraps(run)
        def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for earlier in range(1, number):
                release(spark, f"pipeline/{_run.get()}/{earlier}")
            with scope(f"pipeline/{_run.get()}/{number}"):
                return run(spark, docs, sf_dir)

        return wrapped

    return decorate


@_stage(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that a learned rule rejects go."""
    learned = rules.learn_rules(*rules.training_rows(docs, table(spark, sf_dir, "labels")))
    carried = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return rules.apply_rules(carried, learned).where(F.col("kept")).select("_row.*")


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


@_stage(3)
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has, too, are cut out; a document that loses all its text goes.

    A cut may split a character; what is left of it goes as well.
    """
    # The other columns travel as one, so that none can clash with the operator's own.
    rest = [c for c in docs.columns if c != "text"]
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    cut = suffix_dedup.remove_repeats(carried, whole_characters=True).where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    text = F.col("kept").cast("string")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_stage(4)
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage(5)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), carry={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written as Parquet and read again by the next.

    Runs do not disturb one another: each has a name of its own for what its stages write.
    """
    docs = table(spark, sf_dir, "documents")
    token = _run.set(uuid.uuid4().hex)
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = materialize(docs, name.replace(" ", "-"))
        return docs
    finally:
        _run.reset(token)
