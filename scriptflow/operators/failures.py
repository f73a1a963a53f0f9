"""Kinds of failure: templates of messages from a parse tree of fixed depth.

A message goes down the tree by its error type, its number of words and its first
``DEPTH`` words, where a word with a digit counts as any. The messages of a leaf have one
template: a word stays where all of them have it, and is ``<*>`` elsewhere. A leaf is merged
from the least and the greatest word at each place, so partial results of tasks merge in any
order and a leaf of a third of all messages costs one row for each task and place.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: Words that lead down the tree.
DEPTH = 2
ANY = "<*>"
_LEAF = ["error_type", "n_words", "head"]


def _words(message: Column) -> Column:
    words = F.split(F.trim(F.coalesce(message, F.lit(""))), " +")
    return F.filter(words, lambda w: w != "")


def _masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), ANY).otherwise(word)


def _leaves(errors: DataFrame, depth: int) -> DataFrame:
    words = errors.withColumn("words", _words(F.col("error_message")))
    return words.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "head": F.transform(F.slice("words", 1, depth), _masked),
        }
    )


def failure_kinds(errors: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``error_type, template, n`` of the templates, from ``error_type, error_message``.

    Rows without an error type do not count; a missing message is empty.
    """
    leaves = _leaves(errors.filter("error_type IS NOT NULL"), depth)
    counted = leaves.groupBy(*_LEAF).agg(F.count("*").alias("n"))
    places = (
        leaves.select(*_LEAF, F.posexplode_outer("words").alias("place", "word"))
        .groupBy(*_LEAF, "place")
        .agg(F.min("word").alias("low"), F.max("word").alias("high"))
    )
    # A place of the head that differs only in masked words is masked as well.
    same = F.col("low") == F.col("high")
    word = F.when(F.col("low").isNull(), "").when(same, _masked(F.col("low"))).otherwise(ANY)
    templates = places.groupBy(*_LEAF).agg(
        F.sort_array(F.collect_list(F.struct("place", word.alias("w")))).alias("t")
    )
    text = F.array_join(F.transform("t", lambda x: x["w"]), " ")
    return (
        templates.join(counted, _LEAF)
        .select("error_type", text.alias("template"), "n")
        .groupBy("error_type", "template")
        .agg(F.sum("n").alias("n"))
    )
