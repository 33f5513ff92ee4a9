"""Results as text for people: plans of lines, and an HTML table of the first rows."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chat


def graded_lines(graded: DataFrame) -> DataFrame:
    """A line (``value``) for each graded case (case_id, query, prediction, value, ratio_correct), those not correct marked."""
    mark = F.when(F.col("value") == "CORRECT", " ").when(F.col("value").isNull(), "?").otherwise("x")
    share = F.coalesce(F.format_number("ratio_correct", 2), F.lit("-"))
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), F.lit("-"))
    return graded.select("case_id", F.concat_ws(" | ", mark, share, cell("query"), cell("prediction")).alias("value"))


def token_lines(rows: DataFrame, key: str, tokens: str = "token_ids", scores: str = "token_logprobs") -> DataFrame:
    """(key, pos, value): a line for each generated token with its log probability and probability."""
    each = rows.select(key, F.posexplode(chat.scored_tokens(F.col(tokens), F.col(scores))).alias("pos", "t"))
    return each.select(key, "pos", F.format_string("| %s | %.3f | %.2f%%", F.col("t.token").cast("string"), F.col("t.score").cast("double"), 100 * F.col("t.probability")).alias("value"))


def html_table(rows: DataFrame, limit: int = 100) -> str:
    """The first ``limit`` rows as an HTML table; nulls are empty cells."""
    cell = lambda x: "" if x is None else html.escape(str(x))
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{cell(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + "".join([line("th", rows.columns), *(line("td", r) for r in rows.limit(limit).collect())]) + "</table>"
