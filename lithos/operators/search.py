"""Text search by line and ranked subsequence search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import sequences

#: Rows of a ranked list.
TOP = 200


def line_matches(texts: DataFrame, key: list[str], needle: str, text: str = "text") -> DataFrame:
    """Lines that hold ``needle``, without regard to case: key, line_no from 0, matches (not overlapping). An empty needle finds nothing."""
    small = needle.lower()
    if not small:
        return texts.select(*key, F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("matches")).where("false")
    lines = texts.where(F.contains(F.lower(text), F.lit(small))).select(*key, F.posexplode(F.split(F.lower(text), "\n", -1)).alias("line_no", "line"))
    count = (F.length("line") - F.length(F.replace("line", F.lit(small), F.lit("")))) / len(small)
    return lines.where(F.contains("line", F.lit(small))).select(*key, "line_no", count.cast("long").alias("matches"))


def match_offsets(texts: DataFrame, key: list[str], needle: str, text: str = "text") -> DataFrame:
    """Each match's place: key, line_no, start and end as byte offsets in its line."""
    small = needle.lower()

    @F.pandas_udf("array<struct<line_no:int,start:int,end:int>>")
    def places(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [{"line_no": n, "start": a, "end": b} for n, line in enumerate((t or "").split("\n")) for a, b in find(line, small)])

    hit = texts.where(F.contains(F.lower(text), F.lit(small))) if small else texts.where("false")
    return hit.select(*key, F.explode(places(text)).alias("m")).select(*key, "m.line_no", "m.start", "m.end")


def find(line: str, needle: str) -> list[tuple[int, int]]:
    """Byte ranges of a lower-case needle in a line; each character counts by the first of its lower-case form."""
    folded = "".join(c.lower()[:1] for c in line)
    out, at = [], folded.find(needle)
    while at >= 0:
        out.append((len(line[:at].encode()), len(line[: at + len(needle)].encode())))
        at = folded.find(needle, at + len(needle))
    return out


def fuzzy_rank(names: DataFrame, needle: str, name: str = "name", order: str = "position", top: int = TOP) -> DataFrame:
    """The best names by subsequence score, then by position; a top-k report, so each task keeps its own best first."""
    score = F.pandas_udf(lambda s: s.map(lambda x: sequences.fuzzy(needle, x or "")).astype("Int64"), "long")
    return names.select(F.col(name).alias("name"), F.col(order).alias("position"), score(name).alias("score")).where("score is not null").orderBy(F.desc("score"), "position").limit(top)


def match_steps(matches: DataFrame, key: list[str]) -> DataFrame:
    """Each matching line with the next and the previous one of its text; the last is followed by the first."""
    order = Window.partitionBy(*key).orderBy("line_no")
    whole = Window.partitionBy(*key)
    following = F.coalesce(F.lead("line_no").over(order), F.min("line_no").over(whole))
    before = F.coalesce(F.lag("line_no").over(order), F.max("line_no").over(whole))
    return matches.select(*key, "line_no", following.alias("next_line"), before.alias("previous_line"))


def visible_matches(matches: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Matches on lines that a folded view shows as source."""
    shown = rows.where("row = 'source'").select(*key, F.col("first_line").alias("line_no"))
    return matches.join(shown, [*key, "line_no"], "left_semi")


def diff_matches(rows: DataFrame, key: list[str], needle: str) -> DataFrame:
    """Aligned rows that hold ``needle`` on either side, without regard to case: the key, row_no, matches; an equal row counts once."""
    small = needle.lower()
    count = lambda c: F.coalesce((F.length(c) - F.length(F.replace(F.lower(c), F.lit(small), F.lit("")))) / len(small), F.lit(0)).cast("long")
    both = F.when(F.col("kind") == "equal", count("new_text")).otherwise(count("old_text") + count("new_text"))
    return rows.select(*key, "row_no", both.alias("matches")).where("matches > 0")
