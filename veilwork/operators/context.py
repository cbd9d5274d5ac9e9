"""Words before a span that raise its score.

A framework would compare lemmas; here stems stand for them, since Spark has no
lemmatiser.  Looked at are the five words before the span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words looked at, the rise, and the least score after it.
WORDS, RISE, LEAST = 5, 0.35, 0.4


def boosted(text: Column, span: Column, score: Column, stems: tuple[str, ...]) -> Column:
    """The score, raised if one of the words before the span begins with a stem."""
    # read backwards, so that only the last words are looked at, however far they lie
    last = F.regexp_extract(F.reverse(F.substring(text, F.lit(1), span["start"])), rf"(?U)^[^\w.]*+(?:[\w.]++[^\w.]*+){{0,{WORDS}}}", 0)
    near = F.filter(F.split(F.lower(F.reverse(last)), r"(?U)[^\w.]+"), lambda w: F.length(w) > 0)
    hit = F.exists(near, lambda w: F.regexp_like(w, F.lit("^(?:" + "|".join(s.replace(".", r"\.") for s in stems) + ")")))
    return F.when(hit, F.greatest(F.least(score + RISE, F.lit(1.0)), F.lit(LEAST))).otherwise(score)
