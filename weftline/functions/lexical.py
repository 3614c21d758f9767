"""Lexical scores. Neither claims to equal a database's full-text rank: no stemming, no stop words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

K1, B = 1.2, 0.75


def occurrences(text: Column, terms: list[str]) -> list[Column]:
    """How often each term is a token of the text; one pattern pass a term, without building the list of tokens."""
    low = F.lower(text)
    return [F.regexp_count(low, F.lit(f"(?<![a-z0-9_]){w}(?![a-z0-9_])")) if re.fullmatch("[a-z0-9_]+", w) else F.lit(0) for w in terms]


def cover_score(text: Column, terms: list[str]) -> Column:
    """0.1 for each occurrence of the rarest term where all terms occur, else 0: the cover count of single-word queries."""
    if not terms:
        return F.lit(0.0)
    n = occurrences(text, terms)
    return F.coalesce(F.round(F.lit(0.1) * (F.least(*n) if len(n) > 1 else n[0]), 6), F.lit(0.0))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of the documents (id, content) that hold a term: corpus counts over all documents, term counts summed where they are."""
    terms = sorted({t.lower() for t in terms})
    n = [c.alias(f"tf{k}") for k, c in enumerate(occurrences(F.col("content"), terms))]
    per = docs.where(F.col("content").isNotNull()).select("id", F.regexp_count(F.lower("content"), F.lit("[a-z0-9_]+")).alias("len"), *n)
    per = materialize(per, "bm25-counts")  # numbers only: the texts are read once for both the corpus counts and the scores
    stats = per.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{k}") > 0).cast("int")).alias(f"df{k}") for k in range(len(terms))])
    j = per.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return j.select("id", F.round(score, 6).alias("score")).where("score > 0")
