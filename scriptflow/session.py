"""Session set-up: a builder with this library's defaults, and S3A settings.

Library functions take the caller's session and never stop it. A job started by
``spark-submit`` has its own for the length of a ``with job(...)`` block.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution stays on: it sizes shuffle partitions, splits skewed joins
# and picks a broadcast by measured size.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; the settings in ``conf`` win over them.

    ``master`` is for tests and local work. On a cluster, leave master and memory
    to ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def job(app_name: str, **conf: str) -> Iterator[SparkSession]:
    """A session for one job; stopped at its end, also after an error."""
    spark = build(app_name, **conf)
    try:
        yield spark
    finally:
        spark.stop()


def s3a_conf(
    hadoop_version: str,
    access_key: str | None = None,
    secret_key: str | None = None,
    region: str | None = None,
) -> dict[str, str]:
    """Settings that let ``s3a://`` paths be read and written.

    ``hadoop_version`` must equal the cluster's Hadoop version; the matching AWS
    SDK comes with the package. Without keys the default provider chain applies:
    ``AWS_ACCESS_KEY_ID`` and ``AWS_SECRET_ACCESS_KEY``, or the host's role.
    """
    if (access_key is None) != (secret_key is None):
        raise ValueError("give both keys or neither")
    conf = {
        "spark.jars.packages": f"org.apache.hadoop:hadoop-aws:{hadoop_version}",
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }
    if access_key is not None:
        conf["spark.hadoop.fs.s3a.access.key"] = access_key
        conf["spark.hadoop.fs.s3a.secret.key"] = secret_key
    if region is not None:
        conf["spark.hadoop.fs.s3a.endpoint"] = f"s3.{region}.amazonaws.com"
    return conf
