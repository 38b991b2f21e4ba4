"""Texts of issues by path and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("en", "fr")

#: path -> language -> text; {var} is filled in when a check is set up.
TEXTS: dict[str, dict[str, str]] = {
    "outlier.desc": {"en": "{var} is far from the usual range of its group", "fr": "{var} est loin des valeurs habituelles de son groupe"},
    "outlier.comment": {"en": "Please confirm or correct {var}:", "fr": "Veuillez confirmer ou corriger {var} :"},
    "outlier.limit": {"en": "usual values end at", "fr": "les valeurs habituelles vont jusqu'à"},
    "no_head.desc": {"en": "Household without a head", "fr": "Ménage sans chef"},
    "no_head.comment": {"en": "ERROR: nobody is listed as head of the household.", "fr": "ERREUR : aucun membre n'est déclaré chef de ménage."},
    "several_heads.desc": {"en": "Household with several heads", "fr": "Ménage avec plusieurs chefs"},
    "several_heads.comment": {"en": "ERROR: more than one member is listed as head.", "fr": "ERREUR : plus d'un membre est déclaré chef."},
    "no_food.desc": {"en": "No food eaten", "fr": "Aucun aliment consommé"},
    "no_food.comment": {"en": "ERROR: no food was eaten, neither at home nor elsewhere.", "fr": "ERREUR : rien n'a été mangé, ni à domicile ni ailleurs."},
    "no_non_food.desc": {"en": "No other goods bought", "fr": "Aucun autre bien acheté"},
    "no_non_food.comment": {"en": "ERROR: nothing but food was bought in any period.", "fr": "ERREUR : aucun achat hors aliments, quelle que soit la période."},
    "no_assets.desc": {"en": "No assets owned", "fr": "Aucun bien possédé"},
    "no_assets.comment": {"en": "ERROR: the household owns none of the listed goods.", "fr": "ERREUR : le ménage ne possède aucun des biens cités."},
    "unanswered.desc": {"en": "Questions left open", "fr": "Questions sans réponse"},
    "unanswered.comment": {"en": "ERROR: questions without an answer:", "fr": "ERREUR : questions sans réponse :"},
}


def text(path: str, language: str = "en") -> str:
    """The text; KeyError names a missing path or language."""
    if path not in TEXTS:
        raise KeyError(f"no message {path!r}")
    if language not in TEXTS[path]:
        raise KeyError(f"message {path!r} has no text in {language!r}; it has {sorted(TEXTS[path])}")
    return TEXTS[path][language]


def catalogue(spark: SparkSession) -> DataFrame:
    """(path, lang, text) of all messages."""
    return spark.createDataFrame([(p, k, t) for p, by in TEXTS.items() for k, t in by.items()], "path string, lang string, text string")


def with_message(df: DataFrame, messages: DataFrame, path: str, language: str, out: str) -> DataFrame:
    """Add the text of each row's message path (column ``path``); a missing one gives null."""
    own = messages.where(F.col("lang") == language).select(F.col("path").alias("_path"), F.col("text").alias(out))
    return df.join(own, F.col(path) == F.col("_path"), "left").drop("_path")


def missing_messages(df: DataFrame, messages: DataFrame, path: str, language: str) -> DataFrame:
    """(path, problem) of the distinct paths of ``df`` that have no text at all, or none in the language."""
    state = messages.groupBy("path").agg(F.bool_or(F.col("lang") == language).alias("has"))
    asked = df.select(F.col(path).alias("path")).distinct().join(state, "path", "left").where("has is null or not has")
    return asked.select("path", F.when(F.col("has").isNull(), "no such message").otherwise(f"no text in {language}").alias("problem"))
