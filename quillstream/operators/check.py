"""Two scorers on one draft: a sentence is as bad as the worse of its windows' and its paragraph's verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments


def union(sents: DataFrame, paras: DataFrame) -> DataFrame:
    """``sents`` (doc_id, sent_idx, para_idx, severity, ...) and ``paras`` (doc_id, para_idx, severity).

    Adds para_severity and own_severity; severity becomes the worse of both. Paragraphs that were not scored count
    as clean.
    """
    other = paras.select("doc_id", "para_idx", F.col("severity").alias("para_severity"))
    met = sents.withColumnRenamed("severity", "own_severity").join(other, ["doc_id", "para_idx"], "left")
    return met.withColumn("severity", segments.worse(F.col("own_severity"), F.col("para_severity")))
