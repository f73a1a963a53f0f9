"""Path rules: columns equal the one-path helpers, and both the expected answers."""

import pytest
from pyspark.sql import functions as F

from scriptflow.functions import paths

BASE = "/work/base"
# path, resolved, escapes
CASES = [
    ("in.parquet", "/work/base/in.parquet", False),
    ("a/b", "/work/base/a/b", False),
    ("./a//b/", "/work/base/a/b", False),
    ("", "/work/base", False),
    (".", "/work/base", False),
    ("/abs/x", "/abs/x", False),
    ("/work/base/x", "/work/base/x", False),
    ("/work/base/../x", "/work/base/../x", True),
    ("/work/base2/../x", "/work/base2/../x", False),
    ("../x", "/work/base/../x", True),
    ("a/../x", "/work/base/a/../x", False),
    ("a/../../x", "/work/base/a/../../x", True),
    ("../base/x", "/work/base/../base/x", True),
    ("s3a://bucket/../x", "s3a://bucket/../x", False),
    ("hdfs:/x", "hdfs:/x", False),
    ("HDFS://n/x", "HDFS://n/x", False),
    ("2024:x", "/work/base/2024:x", False),
]


def test_columns(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES] + [(None,)], "path string")
    path = F.col("path")
    for base in (F.lit(BASE), F.concat(F.lit("/work/"), F.lit("base"))):
        rows = df.select(
            "path", paths.resolve(path, base), paths.escapes(path, base)
        ).collect()
        assert [tuple(r) for r in rows] == [*CASES, (None, None, False)]


@pytest.mark.parametrize("path, resolved, escapes", CASES)
def test_one_path(path, resolved, escapes):
    assert paths.resolve_one(path, BASE) == resolved
    assert paths.escapes_one(path, BASE) == escapes
    assert paths.resolve_one(resolved, BASE) == resolved
