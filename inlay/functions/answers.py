"""Reading integer answers out of free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Answer markers. 1 and 2 need a blank or line end behind them so
# that 10 to 22 are not cut after their first digit.
ANSWER_MARKERS = [
    "Answer: 0", "Answer: 1 ", "Answer: 2 ", "Answer: 1\n", "Answer: 2\n",
    "Answer: 3", "Answer: 4", "Answer: 5", "Answer: 6", "Answer: 7",
    "Answer: 8", "Answer: 9", "Answer: 10", "Answer: 11", "Answer: 12",
    "Answer: 13", "Answer: 14", "Answer: 15", "Answer: 16", "Answer: 17",
    "Answer: 18", "Answer: 19", "Answer: 20", "Answer: 21", "Answer: 22",
]
ANSWER_LEAD = "Answer: "
_MARKER = "|".join(re.escape(m) for m in ANSWER_MARKERS)


def cut_after_answer(response: Column) -> Column:
    """The response up to the earliest end of a complete marker; unchanged without one."""
    # no two markers match at one place and none ends inside the next, so the first match ends first
    found = F.regexp_extract(response, _MARKER, 0)
    return F.when(found != "", F.concat(F.call_function("substring_index", response, found, F.lit(1)), found)).otherwise(response)


def parse_answer(response: Column) -> Column:
    """First word behind the first lead-in as bigint, or null when it is not an integer."""
    behind = F.split_part(response, F.lit(ANSWER_LEAD), F.lit(2))
    word = F.regexp_extract(behind, r"^(?U)\s*(\S+)", 1)
    strict = F.when(word.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(word, F.lit("_"), F.lit("")))
    return F.when(F.contains(response, F.lit(ANSWER_LEAD)), strict.try_cast("bigint"))
