"""Run-scoped Parquet storage: relative paths live under the run's own directory."""

from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import escapes_one, resolve_one
from .storage import exists, file_system, fresh_dir

# The input that scripts expect to find, and the prefix of run
# directories.
DEFAULT_INPUT = "dados_entrada_raw.parquet"
BASE_PREFIX = "run_"


def run_id(key) -> Column:
    """32 characters, the same for the same key on every evaluation. Shorter ids
    would meet: of eight characters, three pairs of 150,000 keys do."""
    return F.md5(F.col(key).cast("string"))


def run_ids(df: DataFrame, key: str) -> DataFrame:
    """Run id and name of the run's base directory for every row."""
    return df.select(key, run_id(key).alias("run_id")).withColumn(
        "base_name", F.concat(F.lit(BASE_PREFIX), "run_id")
    )


def url_path(url: str) -> str:
    """The path of a file's URL, decoded."""
    return unquote(urlsplit(url).path)


class Workspace:
    """Reads and writes Parquet under one base directory and can remove it.

    ``inputs`` lists the relative paths read and ``mapping`` how every relative
    path was resolved, in the order of first use.
    """

    def __init__(self, spark: SparkSession, base: str):
        _, path = file_system(spark, base)
        if not path.isAbsolute() or path.isRoot():
            raise ValueError(f"base must be absolute and not a root: {base!r}")
        self.spark = spark
        self.base = base.rstrip("/")
        self.inputs: list[str] = []
        self.mapping: dict[str, str] = {}

    @classmethod
    def fresh(cls, spark: SparkSession) -> "Workspace":
        """A workspace of its own in shared storage."""
        return cls(spark, fresh_dir(spark, BASE_PREFIX.rstrip("_")))

    def resolve(self, path: str) -> str:
        if escapes_one(path, self.base):
            raise ValueError(f"path leaves the workspace: {path!r}")
        resolved = resolve_one(path, self.base)
        if resolved != path:
            self.mapping[path] = resolved
        return resolved

    def read(self, path: str) -> DataFrame:
        resolved = self.resolve(path)
        if resolved != path and path not in self.inputs:
            self.inputs.append(path)
        return self.spark.read.parquet(resolved)

    def _target(self, df: DataFrame, path: str) -> str:
        """Where ``path`` is written; refused if ``df`` still has to read files there, which
        would be lost."""
        target = self.resolve(path)
        if exists(self.spark, target):
            fs, hadoop_path = file_system(self.spark, target)
            root = fs.makeQualified(hadoop_path).toUri().getPath() + "/"
            # The names come from the JVM one by one, which takes time with very many files.
            if any((url_path(file) + "/").startswith(root) for file in df.inputFiles()):
                raise ValueError(f"the frame reads its own target: {path!r}")
        return target

    def write(self, df: DataFrame, path: str) -> None:
        """Write ``df``, replacing what is there."""
        df.write.mode("overwrite").parquet(self._target(df, path))

    def write_partitions(self, df: DataFrame, path: str, *by: str) -> None:
        """Write ``df`` in a folder for each value of ``by``, replacing those folders that
        it has rows for and no others. Rows of a folder are brought together first, but a
        large one is split, so that files are few and no task has a whole folder."""
        rows = df.hint("rebalance", *by)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *by
        ).parquet(self._target(df, path))

    def stage(self, df: DataFrame, path: str) -> DataFrame:
        """Write ``df`` and continue from the written table."""
        self.write(df, path)
        return self.read(path)

    def close(self) -> None:
        """Remove the base directory and nothing else."""
        fs, hadoop_path = file_system(self.spark, self.base)
        fs.delete(hadoop_path, True)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def prepare_input(
    workspace: Workspace, df: DataFrame, name: str = DEFAULT_INPUT
) -> DataFrame:
    """Put a script's expected input in place and check it before use."""
    prepared = workspace.stage(df, name)
    if prepared.dtypes != df.dtypes:
        raise RuntimeError(f"{name} came back as {prepared.dtypes}, not {df.dtypes}")
    return prepared
