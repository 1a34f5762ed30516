"""Shared building blocks of the registered queries, per (session, data folder).

Lazily-built DataFrames that several queries reuse, but for ``tokens``: the
token table is written when first touched, which runs a job.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as TXT
from ..session import written
from ..sources import tables as S


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, label_col: str = "quality"):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.label_col = label_col

    def table(self, name: str) -> DataFrame:
        return S.load(self.spark, self.sf_dir, name)

    @cached_property
    def reviews(self) -> DataFrame:
        """(doc_id, text, lang, source, label) of the labelled documents."""
        return S.scan_reviews(self.spark, self.sf_dir, self.label_col)

    @cached_property
    def all_reviews(self) -> DataFrame:
        """The same over all documents; label is null where there is none."""
        return S.scan_reviews(self.spark, self.sf_dir, self.label_col, "left")

    @cached_property
    def sreviews(self) -> DataFrame:
        """reviews + split column ('train' / 'test')."""
        return S.with_split(self.reviews)

    def split(self, name: str) -> DataFrame:
        return self.sreviews.where(F.col("split") == name)

    @cached_property
    def tokens(self) -> DataFrame:
        """Long form (doc_id, label, split, pos, token) of the preprocessed reviews.

        Written when first touched, as Parquet by split in the shared folder,
        so the main plan and its scalar subqueries read the same rows, each
        only its columns and its split.
        """
        long = TXT.corpus_tokens(self.sreviews, "text", keep=("doc_id", "label", "split"))
        return written(long.select("doc_id", "label", "pos", "token", "split"), "tokens", ("split",))

    def split_tokens(self, name: str) -> DataFrame:
        return self.tokens.where(F.col("split") == name)

    @cached_property
    def corpus(self) -> DataFrame:
        """(doc_id, label, split, tokens, processed_text, token_count)."""
        return TXT.assemble_corpus(self.sreviews, self.tokens, keep=("doc_id", "label", "split"))
