"""Table functions callable from SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_compiled = lru_cache(maxsize=256)(re.compile)


class FindSpans:
    """One row per match of each rule (label to pattern) in a text; offsets count code points.

    Rules come in the order of the map; matches of one rule do not overlap. Empty matches, a null text,
    null rules and null patterns give no rows.
    """

    def eval(self, text: str, rules: dict) -> Iterator[tuple[str, int, int, str]]:
        if text is None or rules is None:
            return
        for label, pattern in rules.items():
            if pattern is None:
                continue
            for m in _compiled(pattern).finditer(text):
                if m.end() > m.start():
                    yield label, m.start(), m.end(), m.group()


find_spans = F.udtf(FindSpans, returnType="label string, start int, end int, value string", useArrow=True)


def register(spark: SparkSession) -> None:
    """Make ``find_spans(text, rules)`` known to SQL, for use in a lateral join."""
    spark.udtf.register("find_spans", find_spans)
