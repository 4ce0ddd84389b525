"""A corpus pipeline over the documents table: toxicity, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs. Null texts and keys, empty tables and extra
columns are handled as the operators' modules say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parqyard.llm import mixing, ngram_join, pieces, substring_dedup, toxicity
from parqyard.llm.common import drop_table, identity, scratch_root, sieve, sifted, table, write_table
from parqyard.llm.queries import TARGETS, TOPIC

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7
KEEP_TOKENS = 0.7


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns beyond those of documents under names that no operator uses, and the names by the old ones."""
    names = {c: c if c in COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier fitted on the labelled ones scores 0.7 or more."""
    rows, names = _apart(docs)
    model = toxicity.train(toxicity.labelled(rows, table(spark, sf_dir, "labels")))
    scored = toxicity.score(rows, model, out="toxic_score", keep_text=True)
    return _back(scored.filter(F.col("toxic_score") < TOXIC_FROM), names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of five-word shingles (Jaccard 0.8 or more) connect, the one of smallest id.

    Just one row stays of each group, also where ids are null (they come last) or repeated. Of rows with the same id and
    text, the one whose other columns come first stays, also where the text has no words and so links with nothing.
    Only rows of groups of more than one are moved; the others stay as they lie.
    """
    rows, names = _apart(docs)
    linked = ngram_join.link(rows, n=5, num=4, den=5)
    grouped = write_table(linked.select("doc_id", "rid", F.coalesce(F.col("label").cast("string"), "rid").alias("group")), "grouped")
    for t in linked.scratch:
        drop_table(t)
    first = grouped.groupBy("group").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("rid"), F.count("*").alias("size"))
    first = write_table(first, "first")
    several = grouped.join(first.filter("size > 1").select("group"), "group").select("rid")
    may = sieve(several)
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    named = rows.withColumn("rid", identity("doc_id", "text"))
    own = sifted(named, "rid", may).groupBy("rid").agg(F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*others))).alias("row"))
    kept = own.join(first.select("rid"), "rid", "left_semi").select("row.*")
    return _back(kept.unionByName(sifted(named, "rid", may, keep=False).select(*rows.columns)), names)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 50 words or more that a document of smaller id has; documents left empty go."""
    rows, names = _apart(docs)
    got = substring_dedup.dedup(rows)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    left = got.filter((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _back(left.withColumns({"text": text, "n_chars": chars}), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of up to 70 % of the tokens, as far as the source, language and topic targets allow, in the raked mixture."""
    rows, names = _apart(docs)
    got = mixing.mix(rows, {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr(TOPIC)}, TARGETS, keep=KEEP_TOKENS)
    return _back(got.filter("selected"), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, by merge-dropout, instead of the text."""
    return pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_join", one_of_each_group), ("substring_dedup", drop_passages), ("mixing", mix), ("sentencepiece", encode)]
#: A classifier and a tokenizer are beyond SQL: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared scratch folder and read again."""
    docs, root = table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
