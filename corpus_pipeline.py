"""A corpus from raw documents to packed sequences: five stages, each on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. run() applies them to the documents of sf_dir.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import forest, mixing, packing, suffixes, toxicity
from terraloom.llm.common import materialize, table

#: SQL can't express a learned model: tests/llm/test_pipeline.py holds each stage's rows, and run(), against brute force.
ORACLE_SQL = None


def carrying(stage):
    """A stage that works on doc_id, source and text, whatever the names of the other columns: these travel in one struct."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in ("doc_id", "source", "text") if c in docs.columns]
        others = [c for c in docs.columns if c not in own]
        at = {c: docs[f"`{c}`"] for c in docs.columns}
        packed = docs.select(*own, F.struct(F.lit(1).alias("_"), *(at[c].alias(c) for c in others)).alias("carried"))
        out = stage(spark, packed, sf_dir)
        return out.select(*(F.col(c) if c in own else F.col("carried").getField(c).alias(c) for c in docs.columns))

    return run_stage


@carrying
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among docs, doesn't reject.

    Null and empty texts have the score of a text without words; repeated rows have one score; a null id has no label. With
    labels of one class only, or none, all documents have that class (or none is toxic). Empty input stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(docs.columns)


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Null texts and texts without words are alone in their group and stay. Of rows of equal id and text one stays. Null ids
    are never the smallest; a group of null ids only keeps its distinct texts. Empty input stays empty.
    """
    kept = forest.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that occur earlier. Where a cut splits a character, U+FFFD stands for the rest.

    All documents stay, with what is left of their text, which may be empty; null texts stay null. Rows of equal id and
    text lose the same; null ids come last. n_chars, if there, is that of the new text. Empty input stays empty.
    """
    done = _cut(spark, docs, sf_dir)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


@carrying
def _cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(docs)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    return done.withColumn("text", text)


@carrying
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for, none to three times.

    A null source is a source of its own, the last. Null and empty texts have no words: they come once for each whole epoch
    of their source. Rows of equal id and text are alike. Empty input stays empty.
    """
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty: one piece of the end's id. A document that the mix repeats is packed as often. The ids
    themselves come with packing.pack_documents(docs, with_ids=True). Empty input gives an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("suffix-dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
