"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents that the one before kept; run() writes and reads them between
stages. All stages but the last return the columns of documents.

In every stage a null text is an empty one, a null in another column stays as it is, columns of
any further names go through unchanged, and an empty table gives an empty one. What each does with
null and repeated ids is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, line_dedup, minhash, packing, toxicity


def _row(docs: DataFrame) -> DataFrame:
    """The id and the text, and all columns as one that no name can clash with."""
    return docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go, each row by its own text. Learns from labels.parquet; without toxic and clean examples all stay."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_row(docs).select("row"), net, row_col="row").filter(F.col("score") < 0.7).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents have go, but from the largest id that has them; n_chars follows.

    Rows that repeat an id are one document in the counts, and each is cut. Rows without an id stay whole.
    """
    cut = line_dedup.dedup_lines(_row(docs), keep=("row",))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id (none before all others).

    Rows that repeat an id belong to groups by their texts; of rows that repeat id and text one stays.
    """
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark.parquet go, each row by its own text; null and blank items are none."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document. Each row is packed for itself, with its id or without."""
    import public_tokenizers

    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: A trained network, similarity components and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table goes when the next one's is written; the last is what the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, name.replace(" ", "-"))
        docs = common.written(stage(spark, docs, sf_dir), path)
        if before:
            common.drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
