"""Python text semantics as built-in Spark expressions.

Spark's ``trim`` removes spaces unless it is told what to remove; Python's
``str.strip`` removes the characters below. Trimming by a list looks at the ends of
a text only, where a pattern would search all of it.
"""

import re

from pyspark.sql import Column, functions as F

# White space as str.strip sees it, and the characters at which
# str.splitlines ends a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip_ws(c) -> Column:
    """``str.strip()``."""
    return F.trim(c, F.lit(WHITE_SPACE))


def lstrip_ws(c) -> Column:
    """``str.lstrip()``."""
    return F.ltrim(c, F.lit(WHITE_SPACE))


def rstrip_ws(c) -> Column:
    """``str.rstrip()``."""
    return F.rtrim(c, F.lit(WHITE_SPACE))


def has_text(c) -> Column:
    """True if any character is not white space."""
    return lstrip_ws(c) != ""


def last_line(c) -> Column:
    """``splitlines()[-1]`` of a text that does not end in a line break."""
    others = LINE_BREAKS[1:]
    return F.substring_index(F.translate(c, others, "\n" * len(others)), "\n", -1)


def fill(template: str, *values) -> Column:
    """``template % values`` for ``%s`` and ``%d``; NULL if a value is.

    A concatenation, where ``format_string`` would run a formatter for every row.
    """
    first, *rest = re.split("%[sd]", template)
    pieces = [F.lit(first)]
    for value, text in zip(values, rest, strict=True):
        pieces += [value, F.lit(text)]
    return F.concat(*pieces)
