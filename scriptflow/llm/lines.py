"""Removal of lines that many sites share; built-in functions only.

Each line's hash has a small HyperLogLog sketch of the sites it occurs on; sketches
are merged by the aggregation, so a line that a third of all documents have costs one
row for each task. A line whose estimate is above all that fewer sites can give is
boilerplate, a line of one site never is, and the others, near the limit or below it,
get an exact distinct count.

Fewer sites than ``sites`` set at most ``sites - 1`` of the ``m`` registers of a sketch.
Sketches have at least four registers for each of ``sites``; then an estimate of so few
registers is the linear count ``m ln(m / (m - sites + 1))`` at most. What is above that
is decided by the sketch, and no line is wrongly taken for boilerplate.

Lines are the parts of a text between line feeds; they are compared without the
spaces, tabs and carriage returns at their ends, by 128 bits of hashes. Lines that
are empty then are no boilerplate.

Defined cases: a null text has no lines and stays null, an empty one stays empty; a
null source is a site of its own; rows that repeat an id and a text are treated
alike; a text of boilerplate lines only becomes empty.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.storage import stage

#: Sites on which a line must occur to be boilerplate.
SITES = 5
#: Registers of a sketch are a power of two: 32 at least, and so many for each site of
#: the limit.
REGISTERS = (32, 4)

_KEY = ("line_a", "line_b")
_EDGE = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> tuple[Column, Column]:
    line = F.trim(line, F.lit(_EDGE))
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that is not empty: its key, its site, its document."""
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0"))).alias("site"),
        F.explode(_lines(F.col("text"))).alias("line"),
    ).filter(F.trim("line", F.lit(_EDGE)) != "")
    a, b = _key(F.col("line"))
    return rows.select("doc_id", "text_hash", "site", a.alias(_KEY[0]), b.alias(_KEY[1]))


def sketch_bound(sites: int) -> tuple[float, int]:
    """The relative deviation to ask for, so that sketches have the registers they need,
    and the largest estimate that fewer than ``sites`` sites can give."""
    precision = math.ceil(math.log2(max(REGISTERS[0], REGISTERS[1] * sites)))
    m = 2**precision
    # Spark takes the least precision whose deviation, 1.106 / 2^(p/2), is no larger.
    return 1.001 * 1.106 / 2 ** (precision / 2), round(m * math.log(m / (m - sites + 1)))


def shared_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The keys of lines that occur on at least ``sites`` sites."""
    lines = _occurrences(docs).select(*_KEY, "site")
    deviation, bound = sketch_bound(sites)
    sketched = stage(
        lines.groupBy(*_KEY)
        .agg(
            F.approx_count_distinct("site", deviation).alias("about"),
            F.min("site").alias("low"),
            F.max("site").alias("high"),
        )
        .filter("low <> high")
        .select(*_KEY, "about"),
        "line_sketches",
    )
    far = F.col("about") > bound
    near = sketched.filter(~far).select(*_KEY)
    counted = (
        lines.join(near, [*_KEY])
        .distinct()
        .groupBy(*_KEY)
        .count()
        .filter(F.col("count") >= sites)
        .select(*_KEY)
    )
    return stage(sketched.filter(far).select(*_KEY).union(counted), "shared_lines")


def remove_shared_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """For every document: ``document``, a struct of its columns, ``kept_text``,
    ``n_lines`` and ``n_removed``."""
    shared = shared_lines(docs, sites)
    found = (
        _occurrences(docs)
        .join(shared, [*_KEY])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct(*_KEY)).alias("shared"))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.xxhash64("text").alias("text_hash"),
    )
    joined = rows.join(
        found.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash"),
        F.col("document.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")),
        "left",
    )
    lines = _lines(F.col("document.text"))

    def stays(line: Column) -> Column:
        a, b = _key(line)
        return ~F.array_contains("shared", F.struct(a.alias(_KEY[0]), b.alias(_KEY[1])))

    kept = F.when(F.col("shared").isNull(), lines).otherwise(F.filter(lines, stays))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return joined.select("document", kept.alias("kept"), n(lines).alias("n_lines")).select(
        "document",
        F.array_join("kept", "\n").alias("kept_text"),
        "n_lines",
        (F.col("n_lines") - n(F.col("kept"))).alias("n_removed"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_shared_lines(docs).select(
        "document.doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text")
    )


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents
), n AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS norm FROM l
), s AS (
  SELECT norm FROM n WHERE norm <> '' GROUP BY norm
  HAVING count(DISTINCT coalesce(source, chr(1))) >= {SITES}
)
SELECT d.doc_id, coalesce(max(x.n), 0) AS n_lines, coalesce(max(x.r), 0) AS n_removed,
       CASE WHEN max(d.text) IS NULL THEN NULL ELSE coalesce(max(x.t), '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (norm IN (SELECT norm FROM s)) AS r,
         string_agg(line, chr(10) ORDER BY k) FILTER (norm NOT IN (SELECT norm FROM s)) AS t
  FROM n GROUP BY doc_id
) x USING (doc_id)
GROUP BY d.doc_id
"""
