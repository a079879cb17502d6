"""The language of a text by the words it holds, learned from texts whose language is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LETTERS = 12  # a shorter text is in no language
MOST_WORDS = 20_000  # words of a model, those in most texts; with the languages they bound what is broadcast


def words(text: Column) -> Column:
    """The distinct words of a text, lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")


def learn(rows: DataFrame, text: str = "document", label: str = "lang", most_words: int = MOST_WORDS) -> DataFrame:
    """(word, lang, weight): the logarithm of the share of a language's texts that hold a word, one text more in two assumed to.

    Rows without a label or text teach nothing.
    """
    taught = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("lang"), words(F.col(text)).alias("words"))
    held = taught.select("lang", F.explode("words").alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    most = held.groupBy("word").agg(F.sum("n").alias("texts")).orderBy(F.desc("texts"), "word").limit(most_words).select("word")
    texts = taught.groupBy("lang").agg(F.count("*").alias("texts"))
    every = most.crossJoin(F.broadcast(texts))  # words times languages
    weight = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("texts") + 2))
    return every.join(held, ["word", "lang"], "left").select("word", "lang", weight.alias("weight"))


def guess(rows: DataFrame, model: DataFrame, id_col: str = "id", text: str = "document") -> DataFrame:
    """(id, lang): the language whose words a text holds most likely, ties by name; null below twelve letters or without a known word."""
    enough = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= LEAST_LETTERS
    held = rows.where(enough).select(id_col, F.explode(words(F.col(text))).alias("word")).join(F.broadcast(model), "word")
    sums = held.groupBy(id_col, "lang").agg(F.round(F.sum("weight"), 9).alias("score"))
    best = sums.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("s"), "lang"))["lang"].alias("lang"))
    return rows.select(id_col).join(best, id_col, "left")
