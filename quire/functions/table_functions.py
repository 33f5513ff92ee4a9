"""Functions that SQL can call: table functions over texts and over partitions of a table, and scalar ones.

``register(spark)`` puts them under their names into a session. The scalar ones and the questions are the Column
expressions of this library in SQL's clothes, so they run inside Spark's own code; the splitter and the vote are
Python table functions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quire.functions.tokenizers import count_tokens


@udtf(returnType="position int, chunk string")
class RecursiveChunks:
    """``recursive_chunks(text, size, overlap, by)``: the chunks of a text, ``by`` characters or tokens; none for null."""

    def eval(self, text: str, size: int, overlap: int, by: str) -> Iterator[tuple[int, str]]:
        from quire.operators.etl import split_recursively

        if by not in ("characters", "tokens"):
            raise ValueError(f"chunks are measured in characters or tokens, not in {by}")
        yield from enumerate(split_recursively(text, size, overlap, len if by == "characters" else count_tokens(None)) if text else [])


@udtf(returnType="case_id bigint, score int, value string, ratio_correct double, n int")
class ConsensusGrade:
    """``consensus_grade(table(...) partition by case order by sample)``: the vote over the judges' texts (third column) of a case (first column).

    A partition streams: two counts are held, whatever its size.
    """

    def __init__(self):
        self.case, self.read, self.right, self.n = None, 0, 0, 0

    def eval(self, row: Row) -> None:
        verdict = _verdict(row[2])
        self.case, self.n = row[0], self.n + 1
        self.read += verdict is not None
        self.right += verdict == "CORRECT"

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            ratio = self.right / self.read if self.read else 0.0
            yield self.case, int(ratio > 0.5), "CORRECT" if ratio > 0.5 else "INCORRECT", ratio, self.n


def _verdict(text: str | None) -> str | None:
    """What ``functions.text.grade`` reads in a judge's text, without the reasoning."""
    import re
    import string

    if text is None:
        return None
    stripped = text.strip()
    if found := re.compile(r"GRADE:\s*(CORRECT|INCORRECT)", re.I).search(stripped, 2):
        return found[1].upper()
    words = stripped.upper().split()
    ends = [w.strip(string.punctuation) for w in (words[:1] + words[-1:])]
    return next((v for v in ("CORRECT", "INCORRECT") if v in ends), None)


#: SQL functions: name, parameters, what they return, and their body.
SQL_FUNCTIONS = (
    (
        "parse_questions", "said string", "table(position int, question string)",
        r"""select position, trim(regexp_replace(regexp_replace(line, r'(?U)^(Q?\d+[.:]\s+)+', ''), r'(?U)\s+', ' ')) from (select posexplode(filter(split(said, '\n'), x -> rlike(x, r'(?U)^(Q?\d+[.:]\s+)+')))) as t(position, line)""",
    ),
    ("has_sentence_end", "said string", "boolean", r"rlike(said, r'(?U)[.?!]\)?\s*\z')"),
    ("squared_distance", "a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0d, (s, x) -> s + x)"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes all of them known to SQL in this session; their names."""
    python = {"recursive_chunks": RecursiveChunks, "consensus_grade": ConsensusGrade}
    for name, function in python.items():
        spark.udtf.register(name, function)
    for name, parameters, returns, body in SQL_FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {returns} return {body}")
    return [*python, *(f[0] for f in SQL_FUNCTIONS)]
