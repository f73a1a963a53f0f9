"""Chat formatting with a grammar round trip; built-in functions only.

The grammar of a formatted conversation::

    conversation := turn*
    turn         := open role "[INST]" text "[/INST]" "</s>"
    open         := "<s>"   (role and text as they are)
                  | "<e>"   (role and text escaped)

A turn is rendered as it is, and escaped if a control string occurs in it. The whole
rendering is parsed again and compared with the source; should they differ, every
turn of that conversation is escaped, which leaves no control string in any text.
Escaping turns ``\\`` into ``\\\\``, ``<`` into ``\\l`` and ``[`` into ``\\b``.

The loss mask is a list of spans of the formatted text: start and length in code
points, one for each assistant turn, and whether the span is escaped.

A conversation is one value, so its turns are gathered; conversations are spread by
their id.

Defined cases: a null role or text counts as empty; turns are ordered by turn, role
and text, nulls first; repeated rows are turns of their own; rows with a null
``conv_id`` are one conversation; no rows give no conversation.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The control strings.
RAW, ESCAPED, CLOSE = "<s>", "<e>", "</s>"
TEXT, TEXT_END = "[INST]", "[/INST]"
_CONTROL = r"</?s>|<e>|\[/?INST\]"

LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    def plain(part: Column) -> Column:
        part = F.replace(part, F.lit("\\l"), F.lit("<"))
        return F.replace(part, F.lit("\\b"), F.lit("["))

    # Every backslash starts a pair, so pairs of them are found from the left.
    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def _turn(opening: str, role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(opening), role, F.lit(TEXT), text, F.lit(TEXT_END), F.lit(CLOSE)
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``role, text``.

    A turn that is not of the grammar has a null role and text.
    """

    def turn(part: Column) -> Column:
        opening = F.substring(part, 1, len(RAW))
        head = F.substring_index(part, TEXT, 1)
        role = F.substr(head, F.lit(len(RAW) + 1))
        text = F.substr(
            part,
            F.char_length(head) + len(TEXT) + 1,
            F.char_length(part) - F.char_length(head) - len(TEXT) - len(TEXT_END),
        )
        valid = (
            opening.isin(RAW, ESCAPED)
            & part.endswith(TEXT_END)
            & (F.char_length(head) + len(TEXT) + len(TEXT_END) <= F.char_length(part))
        )
        plain = lambda c: F.when(opening == ESCAPED, unescape(c)).otherwise(c)
        return F.struct(
            F.when(valid, plain(role)).alias("role"), F.when(valid, plain(text)).alias("text")
        )

    parts = F.split(formatted, CLOSE)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation of ``conv_id, turn,
    role, text``."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumns(
        {"safe_role": escape(F.col("role")), "safe_text": escape(F.col("text"))}
    )
    conflict = F.col("role").rlike(_CONTROL) | F.col("text").rlike(_CONTROL)
    safe = _turn(ESCAPED, F.col("safe_role"), F.col("safe_text"))
    rows = rows.withColumn("conflict", conflict).withColumns(
        {
            "first": F.when(F.col("conflict"), safe).otherwise(
                _turn(RAW, F.col("role"), F.col("text"))
            ),
            "second": safe,
        }
    )
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {f"{c}_end": F.sum(F.char_length(c)).over(so_far) for c in ("first", "second")}
    )

    def span(end: str, text: Column, escaped: Column) -> Column:
        n = F.char_length(text)
        start = F.col(end) - len(TEXT_END) - len(CLOSE) - n
        return F.struct(
            start.alias("start"), n.cast("bigint").alias("length"), escaped.alias("escaped")
        )

    first_text = F.when(F.col("conflict"), F.col("safe_text")).otherwise(F.col("text"))
    item = F.struct(
        "turn",
        "role",
        "text",
        "first_end",
        "first",
        "second",
        span("first_end", first_text, F.col("conflict")).alias("first_span"),
        span("second_end", F.col("safe_text"), F.lit(True)).alias("second_span"),
    )
    # Ends rise with the order of the turns, also among rows that are alike.
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = whole.withColumns(
        {
            "source": F.transform(
                "items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
            ),
            "first": F.array_join(F.transform("items", lambda x: x["first"]), ""),
        }
    ).withColumn("same", F.col("source").eqNullSafe(parse(F.col("first"))))

    def spans(name: str) -> Column:
        loss = F.filter("items", lambda x: x["role"] == LOSS_ROLE)
        return F.transform(loss, lambda x: x[name])

    again = F.array_join(F.transform("items", lambda x: x["second"]), "")
    return whole.select(
        "conv_id",
        F.when(F.col("same"), F.col("first")).otherwise(again).alias("formatted"),
        F.when(F.col("same"), spans("first_span"))
        .otherwise(spans("second_span"))
        .alias("loss_spans"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""

    def one(s: Column) -> Column:
        text = F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return F.when(s["escaped"], unescape(text)).otherwise(text)

    return F.array_join(F.transform(spans, one), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""
    read = formatted.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    text = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
        "",
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = turns.select("conv_id", "turn", "role", "text").union(extra)
    return digests(format_conversations(turns))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
), u AS (
  SELECT *, CASE WHEN regexp_matches(role, '</?s>|<e>|\[/?INST\]')
                   OR regexp_matches(text, '</?s>|<e>|\[/?INST\]')
                 THEN length(role || text)
                    - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', ''))
                 ELSE 0 END AS more
  FROM t
), v AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                             ORDER BY turn, role, text), '') AS loss,
         CAST(sum(length(role) + length(text) + more + 20) AS BIGINT) AS formatted_chars
  FROM u GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM v
"""
