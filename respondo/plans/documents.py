"""``labelled_documents``: documents LEFT JOIN labels. Unlabelled documents
carry NULL labels, which makes it the natural input for imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.sources.tables import load


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id", "left")
    return j.withColumn("verdict", F.when(F.col("toxic") == 1, "toxic")
                        .when(F.col("toxic") == 0, "clean"))


LABELLED_SQL = ("docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, "
                "CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' END AS verdict "
                "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
