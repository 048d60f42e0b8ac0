"""The training-data pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and
read again as the next stage's docs. All stages but the last keep the columns of their
input. Rows are kept whole: a stage removes rows or replaces spans, never samples. Columns
beside doc_id and text are carried, whatever their names. What a stage wrote is deleted
when the next one has been written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.decontaminate import decontaminate
from jobtide.llm.neardup import BROADCAST_IDS, near_duplicates
from jobtide.llm.packing import TOKENIZER, digest, pack
from jobtide.llm.pii import redact
from jobtide.llm.repetition import kept_documents
from jobtide.llm.textkit import drop_written, scratch, written

#: SQL cannot express suffix arrays, MinHash or packing; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def _whole_texts(spark: SparkSession) -> None:
    """Rows here are whole texts: at most 1,000 in an Arrow batch of this application, so that both sides' buffers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject (null and empty texts among them); repeated rows and null ids are judged by their texts."""
    _whole_texts(spark)
    return kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of the smallest id (5-word shingles, 80 percent).

    Texts without words (null, empty) and rows alone in their class stay. A null id, or an
    id that several rows have, says nothing about their texts: such rows are told apart by
    id and text, get keys of their own above all ids, and so stay unless they are
    near-duplicates of another text; of rows equal in id and text the least one stays.
    Long texts count with their whole sets; an empty table gives an empty table.
    Only the keys to drop are moved: broadcast while few, else joined by shuffle.
    """
    names = docs.columns
    with scratch(spark) as kept:
        often = written(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("id")), "often")
        if often.isEmpty():
            found = near_duplicates(docs.select("doc_id", "text"))
            gone = written(found.where(~F.col("kept")).select("doc_id"), "gone")
            kept.append(gone)
            return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*names)
        repeated = docs["doc_id"].eqNullSafe(often["id"])
        few = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
        # the least row of each id and text; the whole row is compared, so that a rerun takes the same one
        rows = docs.join(few, repeated, "left_semi").select("doc_id", "text", F.struct(*[F.col(c) for c in names]).alias("row"))
        rows = rows.groupBy("doc_id", "text").agg(F.min("row").alias("row"))
        top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        keyed = written(rows.select((F.lit(top + 1) + F.monotonically_increasing_id()).alias("key"), "text", "row"), "keyed")
        single = docs.join(few, repeated, "left_anti")
        every = single.select(F.col("doc_id").alias("key"), "text").unionByName(keyed.select("key", "text"))
        gone = written(near_duplicates(every, id_col="key").where(~F.col("kept")).select("key"), "gone")
        kept += [gone, keyed, often]
        small = gone.count() <= BROADCAST_IDS
        gone = F.broadcast(gone) if small else gone
        left = single.join(gone, single["doc_id"] == gone["key"], "left_anti").select(*names)
        return left.unionByName(keyed.join(gone, "key", "left_anti").select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. Texts without words stay, as does all where the benchmark is empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return decontaminate(rows, benchmark, carry=True).where(~F.col("contaminated")).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace spans of personal data by their kind. Null and empty texts stay as they are."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids; a null or empty text is its end token, an empty table has no pieces."""
    _whole_texts(spark)
    return digest(pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as kept:
            after = written(stage(spark, docs, sf_dir), name)
            kept.append(after)
        if i:
            drop_written(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
