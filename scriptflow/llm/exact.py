"""Exact deduplication with a stateful stream; built-in functions only.

A stream reads the documents and keeps one row of state for each digest of a
normalised text, in RocksDB and without expiry: how many texts have it, and the one
that stays, with its identifier and the place where its text is found (file and row).
State never ends, so documents that arrive in a later run, with the same ``state``
folder, are held against all earlier ones.

A digest is only a hit. For each group of more than one document the full normalised
texts are compared with the text at the locator's place; texts that differ from it
leave the group and form groups of their own. When the hits are more than Spark
broadcasts, that comparison shuffles the normalised texts of all documents once.

Two texts are equal if they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. The text with the most code points stays; ties go to the
smallest ``doc_id``.

Defined cases: a null text counts as empty, and all empty texts are equal; a null
``doc_id`` comes after all others; of rows that repeat an id and a text, each is
counted and the first by file and row is kept, so of every group exactly one row stays.
"""

from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.storage import exists, file_system, fresh_dir, release, stage
from ..streaming.logs import file_stream

_BLANK = r"[\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: after all others.
_LAST = 2**63 - 1
#: Files of one micro-batch of the stream.
FILES_PER_BATCH = 100_000
#: Input for which the state gets a partition of its own, and bounds of their number.
#: It is fixed when a state is new, so it follows the input and not the session.
BYTES_PER_STATE = 256 << 20
STATES = (12, 8192)

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # All stores of an executor share this much memory.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank() -> list[Column]:
    """What decides which text of a group stays: the smallest of these."""
    return [
        (-F.char_length(F.coalesce("text", F.lit("")))).alias("neg_length"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
    ]


def _state_partitions(spark: SparkSession, path: str) -> int:
    fs, where = file_system(spark, path)
    size = fs.getContentSummary(where).getLength()
    return min(max(STATES[0], size // BYTES_PER_STATE), STATES[1])


def watch(docs: DataFrame, digest: Column, state: str, partitions: int) -> None:
    """Take a stream of documents into the state at ``state``, which has so many
    partitions if it is new.

    Every batch writes the rows of state that it changed to ``state/changes``; a
    batch that runs again replaces its own. ``docs`` needs ``doc_id, text, _file,
    _row``.
    """
    groups = (
        docs.select(
            digest.alias("digest"),
            F.struct(*_rank(), "_file", "_row").alias("best"),
        )
        .groupBy("digest")
        .agg(F.min("best").alias("best"), F.count("*").alias("size"))
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/changes/batch_id={batch_id}")

    number = {"spark.sql.streaming.internal.stateStore.partitions": str(partitions)}
    with _settings(docs.sparkSession, _STATE | number):
        query = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        query.awaitTermination()


def latest(spark: SparkSession, state: str) -> DataFrame:
    """``digest, size, keep_id, file, row`` of every group so far."""
    changes = spark.read.schema(
        "digest binary, best struct<neg_length int, id bigint, _file string, _row bigint>, "
        "size bigint, batch_id bigint"
    ).parquet(f"{state}/changes")
    newest = changes.groupBy("digest").agg(F.max("size").alias("size"), F.min("best").alias("best"))
    return newest.select(
        "digest",
        "size",
        F.col("best.id").alias("keep_id"),
        F.col("best._file").alias("file"),
        F.col("best._row").alias("row"),
    )


def _located(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "text",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )


def deduplicate(
    spark: SparkSession,
    path: str,
    digest_bytes: int = 32,
    files_per_batch: int = FILES_PER_BATCH,
    state: str | None = None,
) -> DataFrame:
    """For each of the Parquet documents at ``path``: ``document``, a struct of its
    columns, and ``keep_id, group_size, kept, text_sha256``.

    ``digest_bytes`` shortens the digest, to try what happens when digests collide.
    """
    state = state or fresh_dir(spark, "exact_state")
    digest = F.substring(F.unhex(sha256(normalised(F.col("text")))), 1, digest_bytes)
    stream = _located(file_stream(spark, path, files_per_batch))
    watch(stream, digest, state, _state_partitions(spark, path))
    groups = stage(latest(spark, state), "exact_groups")

    docs = spark.read.parquet(path)
    located = _located(docs)

    # Full texts of hits against the text at the locator.
    hits = groups.filter("size > 1")
    texts = located.select(
        digest.alias("digest"), normalised(F.col("text")).alias("norm"), *_rank(), "_file", "_row"
    )
    members = stage(
        texts.join(hits.select("digest", "file", "row"), "digest"), "exact_members"
    )
    first = members.filter("_file = file and _row = row").select(
        "digest", F.col("norm").alias("kept_norm")
    )
    odd = members.join(first, "digest").filter("norm <> kept_norm")
    odd_rows = stage(odd.select("digest", "norm", *("neg_length", "id", "_file", "_row")), "exact_odd")
    release(members)
    best = F.min(F.struct("neg_length", "id", "_file", "_row"))
    odd_groups = odd_rows.groupBy("digest", "norm").agg(
        best.alias("best"), F.count("*").alias("odd_size")
    )
    odd_rows = odd_rows.join(odd_groups, ["digest", "norm"]).select(
        "_file",
        "_row",
        F.col("best.id").alias("odd_keep_id"),
        F.col("best._file").alias("odd_file"),
        F.col("best._row").alias("odd_row"),
        "odd_size",
    )
    left_out = odd_groups.groupBy("digest").agg(F.sum("odd_size").alias("left_out"))
    groups = groups.join(left_out, "digest", "left").select(
        "digest",
        "keep_id",
        "file",
        "row",
        (F.col("size") - F.coalesce("left_out", F.lit(0))).alias("group_size"),
    )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        digest.alias("digest"),
        sha256(normalised(F.col("text"))).alias("text_sha256"),
        *_rank(),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    joined = rows.join(groups, "digest").join(odd_rows, ["_file", "_row"], "left")
    keep_id = F.coalesce("odd_keep_id", "keep_id")
    is_kept = (F.col("_file") == F.coalesce("odd_file", "file")) & (
        F.col("_row") == F.coalesce("odd_row", "row")
    )
    return joined.select(
        "document",
        F.when(keep_id != _LAST, keep_id).alias("keep_id"),
        F.coalesce("odd_size", "group_size").alias("group_size"),
        is_kept.alias("kept"),
        "text_sha256",
    )


def _folder(docs: DataFrame) -> str | None:
    """The folder of Parquet files that ``docs`` is a plain read of, if it is one."""
    files = docs.inputFiles()
    folders = {f.rpartition("/")[0] for f in files}
    if len(folders) != 1:
        return None
    (folder,) = folders
    for path in (folder, unquote(urlsplit(folder).path)):
        if not set(path) & set("*?[]{}\\") and exists(docs.sparkSession, path):
            plain = docs.sparkSession.read.parquet(path)
            if plain.sameSemantics(docs) and set(plain.inputFiles()) == set(files):
                return path
    return None


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns. Documents that do not lie in a folder
    as they are get copied to one."""
    spark = docs.sparkSession
    path = _folder(docs)
    if path is None:
        path = fresh_dir(spark, "exact_input")
        docs.write.option("compression", "zstd").parquet(path)
    return deduplicate(spark, path).filter("kept").select("document.*")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet").select(
        "document.doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, k AS keep_id, size AS group_size, doc_id = k AS kept, sha256(norm) AS text_sha256
FROM (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS k
  FROM d
)
"""
