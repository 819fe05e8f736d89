"""The corpus pipeline: documents that are good, distinct, free of benchmark items and of secrets, and encoded.

Each stage takes the rows that its predecessor kept and returns rows with the
columns of documents; the last one returns what the corpus is trained on. A
stage's result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op3_ngram_join, op4_quality, op7_decontamination, op9_secret_scans, op10_sentencepiece
from tessera.llm.queries import SENTENCEPIECE_MODEL
from tessera.llm.workspace import keep

KEEP_FROM = 0.5


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a digest of every text, and the digest's name: key and digest tell rows apart where a key repeats."""
    name = "digest"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), name


def _same(docs: DataFrame, digest: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col(digest) == F.col("told_text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows among them.

    Rows with a null key or text are scored like others: a null text counts as
    empty. Rows of one key with different texts are judged each by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked, digest = _marked(docs)
    scored = op4_quality.score(marked, labels, also=(digest,)).where(F.col("score") >= KEEP_FROM)
    scored = scored.select(F.col("doc_id").alias("told_id"), F.col(digest).alias("told_text")).distinct()
    return marked.join(scored, _same(marked, digest), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that with the smallest key; null keys come last.

    Rows are told apart by a number that they are written with, so of rows that
    repeat a key, or have none, one stays as well. Texts without words stay.
    """
    number = "row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    rows = keep(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = op3_ngram_join.ngram_join(rows, key=number).where("n_links > 0").select(F.col(number).alias("copy"), "component_id")
    keys = rows.select(F.col(number).alias("copy"), "doc_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("best")
    first = found.join(keys, "copy").groupBy("component_id").agg(best).select(F.col("best.copy").alias("copy"))
    copies = found.select("copy").join(first, "copy", "left_anti")
    return rows.join(copies.withColumnRenamed("copy", number), number, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one key with different texts are judged each by its own."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked, digest = _marked(docs)
    keyed = marked.select(F.struct("doc_id", digest).alias("held"), "text")
    held = op7_decontamination.contaminated(keyed, benchmark, key="held").select("held").distinct()
    held = held.select(F.col("held.doc_id").alias("told_id"), F.col(f"held.{digest}").alias("told_text"))
    return marked.join(held, _same(marked, digest), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark and n_chars counted anew."""
    found, _ = op9_secret_scans.scan(docs)
    leaks = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("leak_id"), "blob", "spans").dropDuplicates(["leak_id", "blob"])
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    joined = docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (blob == F.col("blob")), "left")
    text = F.when(F.col("leak_id").isNull() & F.col("spans").isNull(), F.col("text")).otherwise(op9_secret_scans.redact(F.col("text"), F.col("spans")))
    cleaned = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return cleaned.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, numbers of pieces and byte pieces, whether decoding gives the text back, and the pieces."""
    return op10_sentencepiece.encode(docs, SENTENCEPIECE_MODEL)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding", encoding),
]
# Scores, latent places and merges are no SQL, so no statement gives run()'s rows; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, f"stage-{k}")
    return docs
