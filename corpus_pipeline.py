"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns
the columns of documents (the last: the packed pieces). Stages are written as Parquet
in the shared folder and read again, so none is computed twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import langid, mixing, packing, partenum
from tidelog.llm.cluster import column, free, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those that language ID rejects go.

    Null, empty and letterless texts are rejected; without labelled rows every document
    is, and an empty table stays empty. Very long texts are judged whole, repeated rows
    alike. Extra columns stay, whatever their names.
    """
    own = free(docs, "lid_lang", "lid_score", "lid_accepted")
    model = langid.fit(langid.sample(docs))
    return langid.classify(docs, model, names=tuple(own)).where(own[2]).select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a Jaccard similarity of 0.8: that with the least id.

    Documents without words are in no group and stay; of rows that repeat id and text one
    stays; null ids come first. Texts of any length are compared whole; an empty table
    stays empty; extra columns stay, whatever their names.
    """
    return partenum.representatives(docs, width=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them.

    Null and empty texts have size 0 and are taken like others of their place; a null
    source is one of its own; repeated rows are taken all or none, as often as each other;
    an empty table stays empty. Rows are carried whole, so extra columns stay, whatever their names.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*map(column, docs.columns)).alias("row"))
    mixed = mixing.mix(rows, keep=("row",)).where("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048.

    Null and empty texts are their end token; longer texts than a sequence are cut; a
    document taken several times is packed as often; an empty table packs into nothing;
    extra columns go.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: No stage but mixing can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
