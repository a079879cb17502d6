"""From raw documents to packed sequences: the stages of the training-data pipeline.

Each stage takes all rows that the one before it kept, and its decisions take
effect: rejected documents go, repeated passages are cut out of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language, ngram_join, packing, substring_dedup
from siltstone.llm.common import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text this far from every profile is in no language that was learned.
LEAST_SCORE = 0.3
#: Repeated strings this long are cut out. 51 words of natural text with a blank
#: after each rarely have fewer bytes, as words of it average four letters or more.
PASSAGE_BYTES = 200


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language.

    A null or empty text, or one without a letter, is in none and goes; so does
    every text if no row is labelled. The columns of documents are kept; extra
    ones are dropped here. Repeated rows are judged alike; no rows give none.
    """
    found = language.identify(docs.select(COLUMNS), language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingles: the smallest doc_id.

    A null id stays only where the group has no other; of rows equal in id and
    text one stays. Texts without words, null ones too, all stay. An empty
    table gives no rows.
    """
    return ngram_join.keep_one(docs.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages of ``PASSAGE_BYTES`` that occur elsewhere too, in the same text or another.

    Every row stays, be its text null, empty or cut down to nothing; rows
    repeated in full lose what they share. An empty table gives no rows.
    """
    return substring_dedup.strip_repeats(docs.select(COLUMNS), length=PASSAGE_BYTES, gram=PASSAGE_BYTES // 4)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in the sequences.

    A null or empty text is the end id alone; repeated rows and null ids are
    packed each on its own. An empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: Suffix sorting and packing cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
