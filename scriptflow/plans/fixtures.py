"""Inputs derived from the test tables, in SQL that Spark and DuckDB both run.

Tables stand in braces. ``load`` runs a block in Spark over the Parquet files;
``sql`` gives its text for the oracle.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TRANSACTIONS = """
SELECT o_orderkey AS id_registro,
       c_name AS nome_cliente,
       CAST(o_orderdate AS DATE) AS data_transacao,
       o_totalprice AS valor_transacao
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

SCRIPTS = """
SELECT p_partkey AS script_id,
       CASE p_partkey % 8
         WHEN 0 THEN 'df = spark.read.parquet("in_' || CAST(p_partkey AS STRING)
                  || '.parquet")' || chr(10)
                  || 'df.write.mode("overwrite").parquet("out/'
                  || CAST(p_partkey AS STRING) || '.parquet")'
         WHEN 1 THEN 'df = spark.read.parquet(path="in_' || CAST(p_partkey AS STRING) || '")'
         WHEN 2 THEN 'df = spark.read.parquet("/abs/' || CAST(p_partkey AS STRING) || '")'
         WHEN 3 THEN 'p = "x"' || chr(10) || 'df = spark.read.parquet(p)'
         WHEN 4 THEN 'x = 1' || chr(10) || 'y = (1,'
         WHEN 5 THEN 'df = spark.read.parquet("s3a://bucket/' || CAST(p_partkey AS STRING) || '")'
         WHEN 6 THEN 'df = spark.read.parquet("../up_' || CAST(p_partkey AS STRING) || '")'
         ELSE 'a = spark.read.parquet("l").join(spark.read.parquet("r"), "id")'
       END AS code
FROM {part}
"""

# Scripts whose paths are put together before they are used.
BUILT_PATHS = """
SELECT p_partkey AS script_id,
       CASE p_partkey % 6
         WHEN 0 THEN 'root = "data"' || chr(10) || 'day = "d' || CAST(p_partkey AS STRING) || '"'
                  || chr(10) || 'df = spark.read.parquet(root + "/" + day)'
         WHEN 1 THEN 'base = "in"' || chr(10) || 'n = ' || CAST(p_partkey AS STRING) || chr(10)
                  || 'df = spark.read.option("a", 1).parquet(f"' || chr(123) || 'base'
                  || chr(125) || '/n=' || chr(123) || 'n' || chr(125) || '")'
         WHEN 2 THEN 'p = "a' || CAST(p_partkey AS STRING) || '"' || chr(10) || 'if flag:' || chr(10)
                  || '    p = "b"' || chr(10) || 'df = spark.read.parquet(p)'
         WHEN 3 THEN 'OUT = "../out_' || CAST(p_partkey AS STRING) || '"' || chr(10)
                  || 'def main(df):' || chr(10) || '    df.write.parquet(path=OUT)' || chr(10) || 'main(x)'
         WHEN 4 THEN 'for name in names:' || chr(10) || '    df = spark.read.parquet("x/" + name)'
         ELSE 'df = spark.read.parquet("in_' || CAST(p_partkey AS STRING) || '")'
       END AS code
FROM {part}
"""

# Scripts that read what others write: a tree, a table that all read, some cycles, and
# paths that nobody writes.
LINKED_SCRIPTS = """
SELECT p_partkey AS script_id,
       'a = spark.read.parquet("t/' || CAST(CAST(FLOOR(p_partkey / 2) AS BIGINT) AS STRING) || '")' || chr(10)
       || 'a.write.mode("overwrite").parquet("t/' || CAST(p_partkey AS STRING) || '")' || chr(10)
       || CASE WHEN p_partkey <= 2 THEN 'a.write.parquet("hub")' ELSE 'h = spark.read.parquet("hub")' END
       || CASE WHEN p_partkey % 32 = 31
               THEN chr(10) || 'b = spark.read.parquet("t/' || CAST(2 * p_partkey AS STRING) || '")' ELSE '' END
       || CASE WHEN p_partkey % 5 = 0
               THEN chr(10) || 'c = spark.read.parquet("raw/' || CAST(p_partkey AS STRING) || '")' ELSE '' END
       AS code
FROM {part}
"""

# Suggestions that add, drop and replace lines.
EDITS = """
SELECT p_partkey AS run_id, 1 AS attempt,
       CASE p_partkey % 5 WHEN 3 THEN NULL
         ELSE 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' END AS code,
       CASE p_partkey % 5
         WHEN 0 THEN 'a' || chr(10) || 'b' || CAST(p_partkey AS STRING) || chr(10) || 'c' || chr(10) || 'd'
         WHEN 1 THEN 'a' || chr(10) || 'x' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd'
         WHEN 2 THEN 'a' || chr(10) || 'c' || chr(10) || 'e'
         WHEN 3 THEN 's' || CAST(p_partkey AS STRING)
         ELSE 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' END AS suggestion
FROM {part}
"""

PATHS = """
SELECT p_partkey AS path_id,
       CASE p_partkey % 8
         WHEN 0 THEN 'in_' || CAST(p_partkey AS STRING) || '.parquet'
         WHEN 1 THEN './nested//in_' || CAST(p_partkey AS STRING) || '/'
         WHEN 2 THEN '/abs/' || CAST(p_partkey AS STRING)
         WHEN 3 THEN '/work/base/in_' || CAST(p_partkey AS STRING)
         WHEN 4 THEN 'a/../../up_' || CAST(p_partkey AS STRING)
         WHEN 5 THEN 's3a://bucket/' || CAST(p_partkey AS STRING)
         WHEN 6 THEN '../up_' || CAST(p_partkey AS STRING)
         ELSE 'a/../in_' || CAST(p_partkey AS STRING)
       END AS path
FROM {part}
"""

# Every seven orders are a run of five attempts and a run of two. Attempts are
# numbered from the key, so no run has to be sorted in one task.
ATTEMPTS = """
SELECT CAST(2 * FLOOR(o_orderkey / 7) + CASE WHEN o_orderkey % 7 < 5 THEN 0 ELSE 1 END AS BIGINT)
         AS run_id,
       CAST(CASE WHEN o_orderkey % 7 < 5 THEN 1 + o_orderkey % 7 ELSE o_orderkey % 7 - 4 END AS INT)
         AS attempt,
       CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_custkey % 13 = 0 THEN NULL ELSE 1 END
         AS exit_code,
       CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS code,
       CASE WHEN o_custkey % 11 = 0 THEN NULL
            WHEN o_custkey % 23 = 0 THEN ''
            WHEN o_custkey % 5 = 0 THEN '  ' || o_orderpriority || '  '
            ELSE o_orderpriority || ' ' || CAST(o_custkey AS STRING) END AS suggestion,
       CASE WHEN o_custkey % 97 = 0 THEN 'analysis' WHEN o_custkey % 101 = 0 THEN 'save'
            WHEN o_custkey % 43 = 0 THEN 'stream' END AS stage_error
FROM {orders}
"""

LOG_LINES = """
SELECT user_id AS run_id,
       CAST(1 + FLOOR((DAY(ts) - 1) / 10) AS INT) AS attempt,
       event_id AS seq,
       ts,
       CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
       CASE WHEN user_id % 13 = 5
              THEN CASE WHEN event_id % 2 = 0 THEN ' ' || chr(9) ELSE '' END || chr(10)
            WHEN user_id % 13 = 6 THEN ''
            WHEN event_id % 29 = 0 THEN 'SUCESSO'
              || CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(10) END
            WHEN event_id % 31 = 0 THEN event_type
            ELSE event_type || ' ' || props || chr(10) END AS line
FROM {events}
"""

# Log lines with tracebacks, so that errors can be read from them.
ERROR_LINES = """
SELECT user_id AS run_id,
       CAST(1 + FLOOR((DAY(ts) - 1) / 10) AS INT) AS attempt,
       event_id AS seq,
       ts,
       CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
       CASE WHEN event_type <> 'error' THEN event_type || ' done'
            WHEN event_id % 5 = 0 THEN 'Traceback (most recent call last):'
            WHEN event_id % 5 = 1 THEN '  File "job.py", line ' || CAST(event_id % 90 AS STRING)
            WHEN event_id % 5 = 2 THEN 'ValueError: ' || props
            WHEN event_id % 5 = 3 THEN 'pyspark.errors.AnalysisException: column ' || props
            ELSE 'KeyError' END || CASE WHEN event_id % 17 = 0 THEN '' ELSE chr(10) END AS line
FROM {events}
"""

# What running attempts write to their files, one text line each.
RAW_LINES = """
SELECT user_id % 50 AS run_id,
       CAST(1 + FLOOR((DAY(ts) - 1) / 10) AS INT) AS attempt,
       event_id AS seq,
       CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
       event_type || ' ' || props AS line
FROM {events}
"""

RESPONSES = """
SELECT conv_id, turn,
       CASE conv_id % 7
         WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
         WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
         WHEN 2 THEN '  ' || chr(10) || text || '  '
         WHEN 3 THEN '```python' || chr(10) || '```'
         WHEN 4 THEN '```py' || chr(10) || text || chr(10) || '```'
         WHEN 5 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```'
         ELSE '   '
       END AS raw
FROM {conversations} WHERE role = 'assistant'
"""

PEOPLE = """
SELECT s_suppkey AS id, s_name AS name, s_nationkey AS age FROM {supplier}
"""

# The columns of a transaction in another order, with a timestamp for the date.
UNTYPED_ROWS = """
SELECT l_extendedprice AS valor_transacao,
       l_shipdate AS data_transacao,
       l_linenumber AS id_registro,
       l_returnflag AS nome_cliente
FROM {lineitem}
"""

INPUT_ROWS = """
SELECT event_id AS coluna_a, event_type AS coluna_b, ts AS data_evento FROM {events}
"""


def load(spark: SparkSession, sf_dir: str, block: str) -> DataFrame:
    tables = set(re.findall(r"\{(\w+)\}", block))
    return spark.sql(
        block, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    )


def sql(block: str) -> str:
    """The block over tables of the same names."""
    return re.sub(r"\{(\w+)\}", r"\1", block).strip()
