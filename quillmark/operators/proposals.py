"""Proposed quotations: a table function that is joined laterally to the texts, a stand-in for a model that reads them.

It proposes sentences that hold a marker of quotation and that no known span covers, from after the last marker that leaves
enough words. Proposals are held against the text: what isn't there verbatim is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import orthography as O

# Markers of a quotation, ends of sentences, what is stripped from a proposal, and its fewest words.
MARKERS = ("ﷺ", "تعالى", "رواه", "أخرجه", "صلى الله عليه وسلم", "عز وجل", "سبحانه")
ENDS, EDGES, LEAST = ".!?؟\n؛", " :،,-–\t", 4

_SENTENCE = re.compile(f"(?<=[{ENDS}])\\s+|\\n+")
_WORDS = {True: re.compile(O.ARABIC_TOKEN), False: re.compile(r"[^\W_]+")}


class Proposer:
    """The table function: a row for each sentence that is proposed."""

    def eval(self, text: str | None, covered: list | None, markers: list[str], arabic: bool) -> Iterator[tuple[int, int, str]]:
        known = sorted((c["start"], c["end"]) for c in covered or [])
        count = lambda part: sum(1 for _ in _WORDS[arabic].finditer(part))
        at = reach = k = 0
        for cut in [*_SENTENCE.finditer(text or ""), None]:
            start, end, at = at, cut.start() if cut else len(text or ""), cut.end() if cut else 0
            while k < len(known) and known[k][0] < end:  # of the spans that begin before this end, the one that reaches farthest
                reach, k = max(reach, known[k][1]), k + 1
            sentence = (text or "")[start:end]
            if not sentence or reach > start or not any(m in sentence for m in markers) or count(sentence) < LEAST:
                continue
            after = (i + len(m) for m in markers if (i := sentence.rfind(m)) >= 0 and count(sentence[i + len(m) :]) >= LEAST)
            body = sentence[max(after, default=0) :]
            first = end - len(body.lstrip(EDGES))
            body = body.strip(EDGES + ".")
            if body and sentence[first - start :].startswith(body) and count(body) >= LEAST:
                yield first, first + len(body), "unknown"


def proposed(texts: DataFrame, covered: DataFrame, markers: tuple[str, ...] = MARKERS, arabic: bool = True) -> DataFrame:
    """(id, start, end, kind) of sentences of ``texts`` (id, text) that may be quotations; ``covered``: (id, start, end) known spans."""
    propose = F.udtf(Proposer, returnType="start int, end int, kind string")
    known = covered.groupBy("id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("covered"))
    rows = texts.where("text is not null").select("id", "text").join(known, "id", "left")
    found = propose(F.col("text").outer(), F.col("covered").outer(), F.array(*map(F.lit, markers)), F.lit(arabic))
    return rows.lateralJoin(found).select("id", "start", "end", "kind")
