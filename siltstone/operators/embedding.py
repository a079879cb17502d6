"""Vectors for a whole collection: embedding that can be taken up again, and what a model's input holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list]


def embedded(rows: DataFrame, embed: Embed, text: str = "document", batch: int = 64) -> DataFrame:
    """``rows`` with a new ``embedding``, asked for ``batch`` texts at a time; a null text gets none."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None]
        for lo in range(0, len(known), batch):
            part = known[lo: lo + batch]
            found = embed([texts.iloc[i] for i in part])
            if len(found) != len(part):
                raise ValueError(f"{len(found)} vectors for {len(part)} texts")
            for i, v in zip(part, found):
                out[i] = [float(x) for x in v]
        return pd.Series(out)

    return rows.drop("embedding").withColumn("embedding", vectors(text))


def reembed(rows: DataFrame, path: str, embed: Embed, parts: int = 64, text: str = "document") -> DataFrame:
    """Embed a collection anew into ``path``, a part of its ids at a time.

    Parts that an earlier run finished are kept, so a run that broke off goes on
    where it stopped; an unfinished part is written again. The result is
    checked: as many rows as before, and vectors of one dimension. Rows keep
    their ids; a new dimension needs a new collection, so ``rows`` is only read.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f"{path}/part={k}" for k in range(parts)]
    for k, name in enumerate(names):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{name}/_SUCCESS")):
            own = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
            embedded(own, embed, text).write.mode("overwrite").parquet(name)
    out = spark.read.parquet(*names)
    was, now = rows.count(), out.agg(F.count("*").alias("n"), F.count_distinct(F.size("embedding")).alias("dims")).first()
    if now["n"] != was or now["dims"] > 1:
        raise ValueError(f"{now['n']} of {was} rows, {now['dims']} dimensions")
    return out


def input_limit(embed: Embed, text: str, least: float = 0.9999) -> int:
    """How many characters of ``text`` a model takes in: the shortest beginning whose vector is as good as the whole's."""

    def cosine(a, b):
        a, b = np.asarray(a, float), np.asarray(b, float)
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    whole, low, high = embed([text])[0], 0, len(text)
    while low + 1 < high:
        middle = (low + high) // 2
        if cosine(embed([text[:middle]])[0], whole) >= least:
            high = middle
        else:
            low = middle
    return high


def with_context(chunks: DataFrame, complete: Callable[[str, str], str], whole: str = "whole", text: str = "document", most: int = 400) -> DataFrame:
    """Chunks headed by a model's sentence on their place in the ``whole``; where it fails or says nothing they stay as they are."""

    @F.pandas_udf("string")
    def headed(wholes: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for w, t in zip(wholes, texts):
            try:
                said = " ".join((complete(w, t) or "").split())[:most]
            except Exception:  # a model that fails costs the context, not the chunk
                said = ""
            out.append(f"{said}\n\n{t}" if said and t is not None else t)
        return pd.Series(out)

    return chunks.withColumn(text, headed(whole, text))
