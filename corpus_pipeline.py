"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the documents of the next one. All but the last return the
columns of the documents:

1. documents that the quality classifier rejects go;
2. of equal texts one stays;
3. of documents linked by a Jaccard similarity of their five-word n-grams of 0.8 or more
   one stays;
4. documents with a benchmark passage go;
5. what is left is tokenised and packed into sequences: a row for each piece, with its
   token ids (little-endian, unsigned, 32 bits), its sequence and its place there. A
   sequence has at most ``DOCUMENTS`` pieces, so that its attention mask stays small.
"""

from pyspark.sql import DataFrame, SparkSession

from scriptflow.llm import decontamination, exact, jaccard, packing, quality
from scriptflow.sources.storage import release, stage

#: Pieces of documents in a sequence. The attention cost needs no bound of its own: the
#: squares of lengths that sum to 2,048 never sum to more than 2,048 squared.
DOCUMENTS = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, threshold=(80, 100), n=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(docs, packing.word_bpe())
    return packing.pack(pieces, documents=DOCUMENTS)


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", deduplicate),
    ("ngram_jaccard_join", join_similar),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No SQL: a classifier is trained and a tokenizer runs. Tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = _table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        release(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
