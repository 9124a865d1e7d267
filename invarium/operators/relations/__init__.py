"""Relations: what may hold between calls, variables and values.

Every relation offers *examples* (labelled occurrences of all its hypotheses in
one plan) and *hypotheses* (their counts); a check reads the negatives of the
hypotheses that invariants name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hypotheses(examples: DataFrame, keys: list[str]) -> DataFrame:
    """Positive and negative examples of each hypothesis."""
    return examples.groupBy(*keys).agg(F.count_if("positive").alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"))
