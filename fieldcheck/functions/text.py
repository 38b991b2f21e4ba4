"""Numbers and labels as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks for thousands and decimals by language.
MARKS = {"en": ",.", "fr": " ,"}


def number_text(value: Column, language: str = "en", decimals: int = 2) -> Column:
    """The number with a fixed count of decimals and the marks of the language."""
    if language not in MARKS:
        raise ValueError(f"no number format for language {language!r}; there are {sorted(MARKS)}")
    return F.translate(F.format_number(value, decimals), MARKS["en"], MARKS[language])


def with_label(df: DataFrame, labels: DataFrame, variable: str, column: str, out: str) -> DataFrame:
    """Add the label of a coded column; a code without a label gives the code itself as text.

    ``labels`` has variable, code, label. No join hint: Spark broadcasts the labels if their size allows.
    """
    own = labels.where(F.col("variable") == variable).select(F.col("code").cast("double").alias("_code"), F.col("label").alias("_label"))
    joined = df.withColumn("_value", F.col(column).cast("double")).join(own, F.col("_value") == F.col("_code"), "left")
    return joined.withColumn(out, F.coalesce("_label", F.col(column).cast("string"))).drop("_value", "_code", "_label")
