"""Line and byte metrics as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, spelled out because \s means less to the regex engine.
SPACE = "[\\x{9}-\\x{d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def lines(text: Column | str) -> Column:
    """Lines without their ends (LF or CRLF); a final line end adds no line, an empty text has none."""
    c = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def line_metrics(text: Column | str) -> Column:
    """struct(total_lines, code_lines, comment_lines, blank_lines, total_bytes).

    A comment line begins, trimmed, with ``//``, ``#``, ``/*`` or ``*`` whatever
    the language.
    """
    c = F.col(text) if isinstance(text, str) else text

    def is_comment(x: Column) -> Column:
        return x.rlike(rf"\A{SPACE}*(?://|#|/\*|\*)")

    # One pass over the lines counts all three kinds.
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("total", "comment", "blank")))
    step = lambda a, x: F.struct(
        (a.total + 1).alias("total"), (a.comment + is_comment(x).cast("long")).alias("comment"), (a.blank + x.rlike(rf"\A{SPACE}*\z").cast("long")).alias("blank"),
    )
    metrics = lambda a: F.struct(
        a.total.alias("total_lines"), (a.total - a.blank - a.comment).alias("code_lines"), a.comment.alias("comment_lines"), a.blank.alias("blank_lines"), F.octet_length(c).cast("long").alias("total_bytes"),
    )
    return F.aggregate(lines(c), zero, step, metrics)


def with_line_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five metrics as columns; all null for a null text."""
    m = F.when(F.col(text).isNotNull(), line_metrics(text))
    return df.withColumn("__m", m).select(*df.columns, *(F.col(f"__m.{x}").alias(x) for x in ("total_lines", "code_lines", "comment_lines", "blank_lines", "total_bytes")))
