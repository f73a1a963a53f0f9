"""Jobs over process output, ``(run_id, attempt, seq, stream, line)``.

A row is one line of ``stdout`` or ``stderr`` with its line end. ``seq`` orders the
lines of an attempt and is unique within it; no result depends on arrival.

Every output comes in parts, cut by one rule: ``part_lines`` numbers of ``seq``,
counted from the attempt's first line (of those with text, where outer white space is
dropped). Put together in the order of ``part``, they are the output. A short output
is one part; an attempt that holds a third of the table is as many as it takes, and
no task or value grows with it. Where ``seq`` has gaps, a part holds fewer lines.

No function starts a job. Where the edges of an output are needed, the log is read
twice: once for a few numbers of each attempt, combined before the shuffle, and once
for the lines, which are exchanged by attempt and part. Markers and errors need one
read and the parts' first and last lines.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import (
    fill,
    has_text,
    last_line,
    lstrip_ws,
    rstrip_ws,
)

ATTEMPT = ["run_id", "attempt"]

# The exit code of an attempt that reported none, the word that marks
# success, the ``stage_error`` of an output that broke off, and the formats of
# displayed text.
NO_EXIT_CODE = -99
SUCCESS_MARKER = "SUCESSO"
STDERR_PREFIX = "[STDERR] "
START_FRAME = "--- Iniciando execução da Tentativa %d ---\n"
END_FRAME = "\n--- Fim da execução (Tentativa %d) --- Código de Saída: %d ---\n"
BOTH_STREAMS = "STDOUT:\n%s\n\nSTDERR:\n%s"
STREAM = "stream"
STREAM_ERROR_NOTE = "\nSTREAMING ERROR: the output could not be read to its end"
NO_OUTPUT_NOTE = "[note] the script ended with exit code %d and printed nothing"

# A line that ends a traceback: the type, and the message after a colon.
_ERROR_LINE = r"(?m)^([\w.]*(?:Error|Exception))(?:: (.*))?$"


#: Numbers of ``seq`` that a part of an output covers.
PART_LINES = 10_000


def exit_code(c="exit_code") -> Column:
    return F.coalesce(F.col(c), F.lit(NO_EXIT_CODE))


def log_display(logs: DataFrame) -> DataFrame:
    """The text shown for each line; lines of ``stderr`` are marked."""
    text = F.when(
        F.col("stream") == "stderr", F.concat(F.lit(STDERR_PREFIX), "line")
    ).otherwise(F.col("line"))
    return logs.select(*ATTEMPT, "seq", text.alias("text"))


def log_frames(attempts: DataFrame) -> DataFrame:
    """The texts shown before and after the lines of each attempt."""
    frames = F.array(
        F.struct(
            F.lit("start").alias("place"),
            fill(START_FRAME, "attempt").alias("text"),
        ),
        F.struct(
            F.lit("end").alias("place"),
            fill(END_FRAME, "attempt", exit_code()).alias("text"),
        ),
    )
    return attempts.select(*ATTEMPT, F.inline(frames))


def _bounds(logs: DataFrame) -> DataFrame:
    """Of every attempt its first and last ``seq``, those of lines with text (NULL if
    it has none), and whether it printed anything at all."""
    seq_with_text = F.when(has_text("line"), F.col("seq"))
    return logs.groupBy(*ATTEMPT).agg(
        F.min("seq").alias("start"),
        F.max("seq").alias("end"),
        F.min(seq_with_text).alias("first"),
        F.max(seq_with_text).alias("last"),
        F.bool_or(F.col("line") != "").alias("printed"),
    )


def _placed(
    logs: DataFrame,
    part_lines: int,
    trim: bool = True,
    blank_stdout: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """The lines with the ``part`` they belong to.

    ``trim`` drops the outer white space of every output; of an attempt without text
    one empty line stays. With ``blank_stdout`` such an attempt keeps its ``stdout``,
    and empty lines for the other stream. ``only`` restricts the work to some distinct
    ``(run_id, attempt)``.
    """
    bounds = _bounds(logs)
    if only is not None:
        bounds = bounds.join(only, ATTEMPT, "left_semi")
    # Skewed keys are split only where both sides come straight from an exchange: the
    # lines take part in one join, and the few numbers are dealt out once more.
    bounds = bounds.hint("rebalance")
    lines = logs.select(*ATTEMPT, "seq", "stream", "line").join(bounds, ATTEMPT)
    seq, blank = F.col("seq"), F.col("first").isNull()
    origin, stop = F.col("start"), F.col("end")
    if trim:
        shown = blank & F.col("printed") if blank_stdout else F.lit(False)
        inside = seq.between(F.col("first"), F.col("last"))
        lines = lines.filter(
            F.when(shown, True).when(blank, seq == F.col("start")).otherwise(inside)
        )
        line = F.when(seq == F.col("first"), lstrip_ws("line")).otherwise(F.col("line"))
        line = F.when(seq == F.col("last"), rstrip_ws(line)).otherwise(line)
        kept = shown & (F.col("stream") == "stdout")
        lines = lines.withColumn("line", F.when(blank & ~kept, "").otherwise(line))
        origin = F.coalesce("first", "start")
        stop = F.when(shown, stop).otherwise(F.coalesce("last", "start"))
    lines = lines.withColumns({"origin": origin, "stop": stop})
    return lines.select(
        *ATTEMPT,
        "seq",
        "stream",
        "line",
        F.expr(f"(seq - origin) div {int(part_lines)}").alias("part"),
        F.expr(f"(stop - origin) div {int(part_lines)}").alias("last_part"),
        blank.alias("blank"),
        "printed",
    )


def _unrepeated(lines: Column) -> Column:
    """Lines of a part; an error if two of them have the same ``seq``."""
    n_seq = F.size(F.array_distinct(F.transform(lines, lambda x: x["seq"])))
    return F.when(n_seq == F.size(lines), lines).otherwise(
        F.raise_error(F.lit("seq is not unique within an attempt"))
    )


def _gather(placed: DataFrame, *streams: str) -> DataFrame:
    """The texts of every part: of the given streams, or of both together as
    ``text``.

    Lines are exchanged as they are: collecting them first on the map side would
    not make them fewer. The exchange is stated, since with the one that an
    aggregation brings along, a join before it would have to keep every attempt in
    one task; so it can be split.
    """
    keys = [*ATTEMPT, "part"]
    gathered = (
        placed.repartition(*keys)
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.struct("seq", "stream", "line"))).alias("lines"),
            F.max("last_part").alias("last_part"),
            F.bool_or("blank").alias("blank"),
            F.bool_or("printed").alias("printed"),
        )
    )
    gathered = gathered.withColumn("lines", _unrepeated(F.col("lines")))

    def text(stream: str | None) -> list[Column]:
        own = F.col("lines")
        if stream:
            own = F.filter(own, lambda x: x["stream"] == stream)
        joined = F.array_join(F.transform(own, lambda x: x["line"]), "")
        if not stream:
            return [joined.alias("text")]
        n = F.size(own).cast("bigint")
        return [joined.alias(stream), n.alias(f"{stream}_lines")]

    return gathered.select(
        *keys,
        (F.col("part") == 0).alias("is_first"),
        (F.col("part") == F.col("last_part")).alias("is_last"),
        "blank",
        "printed",
        *[c for stream in streams or (None,) for c in text(stream)],
    )


def log_full_output(logs: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    return _gather(_placed(logs, part_lines)).select(
        *ATTEMPT, "part", F.col("text").alias("full_output")
    )


def log_by_stream(logs: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Text and number of lines of each stream, unstripped."""
    placed = _placed(logs, part_lines, trim=False)
    return _gather(placed, "stdout", "stderr").select(
        *ATTEMPT, "stdout", "stderr", "stdout_lines", "stderr_lines", "part"
    )


def with_output(
    attempts: DataFrame, logs: DataFrame, part_lines: int = PART_LINES, only=None
) -> DataFrame:
    """Attempts with ``output``: what they printed, or a note if that is nothing.

    White space alone is shown by stream; an attempt that failed without printing
    anything gets a note with its exit code; one that succeeded gets an empty text.
    With ``only``, other attempts count as silent.
    """
    only = None if only is None else only.distinct()
    printed = _gather(_placed(logs, part_lines, blank_stdout=True, only=only))
    # An attempt may have any number of parts. Spark can split an inner join on their
    # side, an outer one it cannot.
    keys = logs.select(*ATTEMPT).distinct()
    if only is not None:
        keys = keys.join(only, ATTEMPT, "left_semi")
    silent = attempts.join(keys, ATTEMPT, "left_anti")
    joined = attempts.join(printed, ATTEMPT).unionByName(silent, allowMissingColumns=True)
    is_first = F.coalesce("is_first", F.lit(True))
    is_last = F.coalesce("is_last", F.lit(True))
    # Blank lines of the second stream would end the text, and are stripped there.
    head, middle, _ = BOTH_STREAMS.split("%s")
    by_stream = F.concat(
        F.when(is_first, head).otherwise(""),
        "text",
        F.when(is_last, middle.rstrip()).otherwise(""),
    )
    output = (
        F.when(~F.col("blank"), F.col("text"))
        .when(F.col("printed"), by_stream)
        .when(exit_code() != 0, fill(NO_OUTPUT_NOTE, exit_code()))
        .otherwise("")
    )
    return joined.select(
        *attempts.columns,
        F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        is_first.alias("is_first"),
        is_last.alias("is_last"),
        output.alias("output"),
    )


def output_or_note(
    attempts: DataFrame, logs: DataFrame, part_lines: int = PART_LINES
) -> DataFrame:
    attempts = attempts.select(*ATTEMPT, "exit_code")
    return with_output(attempts, logs, part_lines).select(*ATTEMPT, "part", "output")


def _runs(
    logs: DataFrame, part_lines: int, inner: Callable[[Column], Column]
) -> DataFrame:
    """The output of every attempt as numbered runs of whole lines.

    A line need not have its line end, as at the end of one stream before the other goes
    on; what it says then depends on the next one. The log is exchanged once, by attempt
    and part, and each part is cut in three where it lies: its first line, what begins with
    its last line that has text, and all between. What is between is whole lines, and only
    its ``inner`` goes on. The end of one part and the first line of the next are put
    together as ``text``, with parts between them that end no line. So the second exchange
    carries two lines and one answer for each part of an attempt.

    ``run`` orders the rows: a ``text``, then what follows it (NULL if there is none).
    ``is_last`` marks the run that has the last line with text.
    """
    keys = [*ATTEMPT, "part"]
    parts = (
        logs.select(*ATTEMPT, "seq", "line", F.expr(f"seq div {int(part_lines)}").alias("part"))
        .repartition(*keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    )

    def joined(lines: Column, of: str) -> Column:
        return F.array_join(F.transform(lines, lambda x: x[of]), "")

    text, rest, end = F.col("text"), F.col("rest"), F.col("end")
    core = rstrip_ws(rest)
    before_last = F.length(core) - F.length(F.substring_index(core, "\n", -1))
    parts = (
        parts.select(*keys, joined(_unrepeated(F.col("lines")), "line").alias("text"))
        .withColumn("end", F.locate("\n", text))
        .withColumn("rest", F.when(end > 0, F.substr(text, end + 1)))
        .withColumn("cut", before_last)
        .select(
            *keys,
            (end > 0).alias("ends"),
            F.when(end > 0, F.substring(text, F.lit(1), end)).otherwise(text).alias("head"),
            inner(F.substring(rest, F.lit(1), F.col("cut"))).alias("inner"),
            F.substr(rest, F.col("cut") + 1).alias("tail"),
        )
    )
    earlier = (
        Window.partitionBy(*ATTEMPT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    run = F.coalesce(F.count_if("ends").over(earlier), F.lit(0).cast("bigint"))
    head = F.struct("run", "part", F.col("head").alias("piece"), "inner")
    tail = F.struct(
        (F.col("run") + 1).alias("run"),
        "part",
        F.col("tail").alias("piece"),
        F.nullif("inner", "inner").alias("inner"),
    )
    pieces = parts.withColumn("run", run).select(
        *ATTEMPT, F.inline(F.when(F.col("ends"), F.array(head, tail)).otherwise(F.array(head)))
    )
    lines = F.sort_array(F.collect_list(F.struct("part", "piece")))
    glued = pieces.groupBy(*ATTEMPT, "run").agg(
        joined(lines, "piece").alias("text"), F.max("inner").alias("inner")
    )
    last = F.max(F.when(has_text("text"), F.col("run"))).over(Window.partitionBy(*ATTEMPT))
    is_last = F.coalesce(F.col("run") == last, F.lit(False))
    return glued.withColumn("is_last", is_last)


def success_marker(
    logs: DataFrame, marker: str = SUCCESS_MARKER, part_lines: int = PART_LINES
) -> DataFrame:
    """Whether the last line of the output, and whether any line, has ``marker``.

    A marker anywhere else than on the last line counts for the second only. The marker
    is looked for within lines.
    """

    def marked(text: Column) -> Column:
        return F.contains(text, F.lit(marker))

    text = F.col("text")
    in_last = F.when(marked(text), marked(last_line(rstrip_ws(text)))).otherwise(False)
    return (
        _runs(logs, part_lines, marked)
        .groupBy(*ATTEMPT)
        .agg(
            F.bool_or(F.col("is_last") & in_last).alias("marker_last_line"),
            F.bool_or(marked(text) | F.coalesce("inner", F.lit(False))).alias("marker_any_line"),
        )
    )


def _last_error_line(text) -> Column:
    # The cheap test first: few lines can match.
    return F.when(
        F.contains(text, F.lit("Error")) | F.contains(text, F.lit("Exception")),
        F.try_element_at(
            F.regexp_extract_all(text, F.lit(_ERROR_LINE), F.lit(0)), F.lit(-1)
        ),
    )


def _error_parts(error_line: Column) -> list[Column]:
    return [
        F.regexp_extract(error_line, _ERROR_LINE, 1).alias("error_type"),
        F.nullif(F.regexp_extract(error_line, _ERROR_LINE, 2), F.lit("")).alias(
            "error_message"
        ),
    ]


def error_of(text: Column) -> Column:
    """Type and message of the last error line of a text; NULLs if there is none."""
    return F.struct(*_error_parts(_last_error_line(text)))


def error_type(logs: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """The last error each attempt reports; NULLs if there is none."""
    found = F.coalesce("inner", _last_error_line(F.col("text")))
    return (
        _runs(logs, part_lines, _last_error_line)
        .select(*ATTEMPT, "run", found.alias("found"))
        .groupBy(*ATTEMPT)
        .agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("run"))).alias("found"))
        .select(*ATTEMPT, *_error_parts(F.col("found")))
    )


def attempt_verdict(attempts: DataFrame) -> DataFrame:
    return attempts.select(*ATTEMPT, "exit_code", (exit_code() == 0).alias("exit_ok"))
