"""Five stages over ``documents``, each written as Parquet and read again as the next one's input.

toxicity: rows that the field rejects (score of 0.3 or more) go. line dedup: repeated lines go, and documents left without
a word that had some. n-gram Jaccard join: one document of each component, that of the least id, stays. benchmark
decontamination: documents that hold an item go. SentencePiece: every document with its number of tokens, the digests of
its ids and decoded text, and whether the decoded text equals the text. All but the last return the columns of documents,
whatever their names.

Every stage decides by row or by document, which is a doc_id with a text: a null or repeated doc_id never takes another
text along. Null and empty texts pass all stages; of repeated rows of a document that stays, all stay.

What a stage's result still reads stays as long as the result is referenced; after that it goes when a later stage begins
whose input does not read it. Stages over different inputs do not touch each other's tables.
"""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgraph.llm import toxicity
from haulgraph.llm.common import Scratch, table, unused
from haulgraph.llm.decontam import drop_leaks
from haulgraph.llm.line_dedup import drop_lines
from haulgraph.llm.ngram_join import drop_near_copies
from haulgraph.llm.piece_codec import encode_documents

#: Stages' scratch folders, with what was made of them.
_held: list[tuple[Scratch, weakref.ref]] = []


def _stage(work):
    """``work(spark, docs, sf_dir, scratch)`` as a stage with a scratch of its own, which its result keeps."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = docs.inputFiles() if _held else []
        for held in [x for x in _held if x[1]() is None and not any(x[0].name in file for file in reads)]:
            held[0].close()
            _held.remove(held)
        scratch = Scratch(spark)
        out = work(spark, docs, sf_dir, scratch)
        _held.append((scratch, weakref.ref(out)))
        return out

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), at_least=0.3)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    lines, dropped = unused("n_lines", docs), unused("n_dropped", docs)
    kept = drop_lines(docs, counts=(lines, dropped), scratch=scratch)
    worded = F.col("text").isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]") | (F.col(dropped) == 0)
    if "n_chars" in docs.columns:
        size = F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return kept.filter(worded).drop(lines, dropped)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    return drop_near_copies(docs, n=5, percent=75, scratch=scratch)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), scratch=scratch)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: A trained field, components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_number"):
            scratch.drop(before)
    return docs
