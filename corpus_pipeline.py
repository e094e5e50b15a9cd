"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet into the shared folder and rereads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import langid
from wardline.llm.common import shared_folder, stored, table
from wardline.llm.mixing import mix, repeat_documents
from wardline.llm.near_dup import near_duplicates
from wardline.llm.packing import pack_documents
from wardline.llm.pii import redact

#: A text with a smaller share of its letters in the learned languages' scripts
#: is in none of them.
MIN_LANGUAGE_SCORE = 0.4


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and texts written in other scripts than those
    of the learned languages.  How a text's words share out among the learned
    languages says nothing against it: code-switched and ambiguous texts stay.
    So do texts in other languages of the same scripts, and, if no language
    could be learned, all texts with a letter."""
    field = langid.learn(docs)
    if not field.scripts:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    mark = uuid.uuid4().hex  # no column of the input has these names
    lang, written = f"lang-{mark}", f"written-{mark}"
    labelled = langid.predict(docs, field, written_col=written, lang_out=lang, score_out=f"score-{mark}")
    return labelled.where((F.col(f"`{lang}`") != langid.UNKNOWN) & (F.col(f"`{written}`") >= MIN_LANGUAGE_SCORE)).select(*_names(docs))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays.  Groups are told by row, so rows that
    repeat an id are judged by their texts.  The rows are stored with their
    numbers first: a table that is read again may be packed into other
    partitions, which would number its rows anew."""
    row = f"row_{uuid.uuid4().hex}"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    kept = near_duplicates(rows, id_col=row).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*_names(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null texts, and every column but
    the text and its length, stay as they are."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last copy of a source in
    part; documents without words are not taken.  An empty table gives no rows."""
    return repeat_documents(docs, mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; null texts are their end id alone,
    other columns play no part, and an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate_groups),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("packing", packing),
]

#: Tokenizers, hashed features and learned weights are beyond SQL; the stages
#: are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
