"""Quality rules as a short-circuit cascade, ordered by what a sample shows.

Each rule is a Spark SQL expression that is true for a text to reject. The time of
each is taken on a sample, and which rules reject which of its texts; the next rule of
the cascade is the one with most rejections per second among texts that the rules
before it leave. The cascade is one CASE expression, so that a text pays only for
the rules up to the first that rejects it. The order changes the cost, never
the decision.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dittograph.storage import dropped, written

_COUNT = r"regexp_count(text, '\\S+')"


def _once(value: str, name: str, test: str) -> str:
    """``test`` with ``value`` as ``name``, worked out once."""
    return f"transform(array({value}), {name} -> {test})[0]"


_WORDS = r"regexp_extract_all(text, '\\S+', 0)"
_LINES = r"filter(split(text, '\n'), x -> trim(x) <> '')"
_GRAMS = "transform(sequence(1, size(w) - 2), i -> xxhash64(w[i - 1], w[i], w[i + 1]))"
_SAME = "aggregate(zip_with(slice(w, 2, greatest(size(w) - 1, 0)), w, (a, b) -> int(a = b)), 0, (s, x) -> s + coalesce(x, 0))"

#: name -> expression; a null counts as false.
RULES = {
    "no_letters": r"text is null or not regexp_like(text, '\\p{L}')",
    "symbols": r"20 * (length(text) - length(translate(text, '*&%$#@^~|<>{}[]=_+', ''))) > length(text)",
    "separators": rf"instr(text, '|') > 0 and 10 * (length(text) - length(replace(text, '|', ''))) > {_COUNT}",
    "exclamations": rf"instr(text, '!') > 0 and 5 * (length(text) - length(replace(text, '!', ''))) > {_COUNT}",
    "shouting": rf"10 * regexp_count(text, '\\p{{Lu}}') > 6 * regexp_count(text, '\\p{{L}}') and {_COUNT} >= 5",
    "repeated_words": _once(_WORDS, "w", f"size(w) >= 10 and 5 * {_SAME} > size(w)"),
    "repeated_lines": _once(_LINES, "l", "size(l) >= 4 and 10 * (size(l) - size(array_distinct(l))) > 4 * size(l)"),
    "bullets": _once(_LINES, "l", r"size(l) >= 4 and 10 * size(filter(l, x -> regexp_like(x, '^\\s*[•*‣◦-]'))) > 9 * size(l)"),
    "ellipses": _once(_LINES, "l", "size(l) >= 4 and 10 * size(filter(l, x -> rtrim(x) like '%...' or rtrim(x) like '%…')) > 3 * size(l)"),
    "repeated_ngrams": _once(_WORDS, "w", f"size(w) >= 20 and 2 * size(array_distinct({_GRAMS})) < size(w) - 2"),
}
SAMPLE = 2000


@dataclass(frozen=True)
class Measured:
    """A rule on the sample: seconds a text, and the share of all texts that it rejects of those that reach it."""

    name: str
    seconds: float
    rejects: float

    @property
    def rank(self) -> float:
        return self.rejects / max(self.seconds, 1e-9)


def _expr(rule: str) -> Column:
    return F.coalesce(F.expr(rule), F.lit(False))


def ordered(seconds: dict[str, float], hits: dict[frozenset[str], int]) -> list[Measured]:
    """Rules in the order to apply them; ``hits`` has how many texts are rejected by which rules.

    Next comes the rule with most rejections per second of what is left, ties by name.
    """
    out, total, open_ = [], max(1, sum(hits.values())), dict(seconds)
    while open_:
        found = [Measured(name, s, sum(n for rules, n in hits.items() if name in rules) / total) for name, s in open_.items()]
        out.append(min(found, key=lambda m: (-m.rank, m.name)))
        del open_[out[-1].name]
        hits = {rules: n for rules, n in hits.items() if out[-1].name not in rules}
    return out


def measured(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> list[Measured]:
    """Rules in the order to apply them, by :func:`ordered`.

    About ``sample`` documents, drawn row by row so that no id draws more than its share, are written once; each
    rule then runs over them alone, and the shorter of two runs counts, less that of no rule.
    """
    share = min(1.0, sample / max(docs.count(), 1))
    table = written((docs.sample(share, 7) if share < 1 else docs).select("text").repartition(1), "sample")

    def run(rule: str) -> tuple[float, int]:
        best = (float("inf"), 0)
        for _ in range(2):
            began = time.perf_counter()
            n, _ = table.agg(F.count(F.lit(1)), F.count_if(_expr(rule))).first()
            best = min(best, (time.perf_counter() - began, n))
        return best

    idle = run("length(text) < 0")[0]
    seconds = {}
    for name, rule in rules.items():
        took, n = run(rule)
        seconds[name] = max(took - idle, 1e-4) / max(n, 1)
    # a row for each set of rules that reject the same text, at most 2 ** rules
    each = table.select(*[_expr(rule).alias(name) for name, rule in rules.items()]).groupBy(*rules).agg(F.count(F.lit(1)).alias("_n")).collect()
    dropped(table)
    return ordered(seconds, {frozenset(name for name in rules if r[name]): r["_n"] for r in each})


def judged(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, order: list[str] | None = None) -> DataFrame:
    """``docs`` with ``keep`` and ``reason``, the first rule in the given dict that rejects the text.

    The cascade decides ``keep``; only for a rejected text is ``reason`` looked up,
    so that it doesn't depend on measured times. ``order`` overrides measuring.

    A null, empty or wordless text is rejected (``no_letters``); nothing else
    depends on it. Ids may be null or repeat; rows are judged one by one. Columns
    keep and reason of ``docs`` are replaced, others stay. An empty table gives
    an empty one. A map without any shuffle.
    """
    order = order or [m.name for m in measured(docs, rules, sample)]
    text = docs.withColumn("text", F.col("text").cast("string"))
    cascade = F.expr("case " + " ".join(f"when coalesce({rules[n]}, false) then false" for n in order) + " else true end")
    reason = F.expr("case " + " ".join(f"when coalesce({rule}, false) then '{n}'" for n, rule in rules.items()) + " end")
    return text.withColumn("keep", cascade).withColumn("reason", F.when(~F.col("keep"), reason))


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a rule rejects, with the columns they came with.

    Null, empty and wordless texts go (``no_letters``); a very long text is judged whole. Rows are judged one by one, so null or
    repeated ids, repeated rows and clashing names don't matter, and ties can't arise. An empty table gives an empty one.
    """
    order = [m.name for m in measured(docs)]
    cascade = F.expr("case " + " ".join(f"when coalesce({RULES[n]}, false) then false" for n in order) + " else true end")
    return docs.filter(cascade)


SQL = r"""
WITH f AS (
  SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '\S+')) AS words, regexp_extract_all(text, '\S+') AS w,
    length(text) - length(translate(text, '*&%$#@^~|<>{}[]=_+', '')) AS symbols,
    length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, '!', '')) AS bangs,
    len(regexp_extract_all(text, '\p{Lu}')) AS upper, len(regexp_extract_all(text, '\p{L}')) AS letters,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines
  FROM documents
), r AS (
  SELECT doc_id, CASE
    WHEN text IS NULL OR letters = 0 THEN 'no_letters'
    WHEN 20 * symbols > n THEN 'symbols'
    WHEN 10 * bars > words THEN 'separators'
    WHEN 5 * bangs > words THEN 'exclamations'
    WHEN 10 * upper > 6 * letters AND words >= 5 THEN 'shouting'
    WHEN words >= 10 AND 5 * len(list_filter(range(2, words + 1), lambda i: w[i] = w[i - 1])) > words THEN 'repeated_words'
    WHEN len(lines) >= 4 AND 10 * (len(lines) - len(list_distinct(lines))) > 4 * len(lines) THEN 'repeated_lines'
    WHEN len(lines) >= 4 AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[•*‣◦-]'))) > 9 * len(lines) THEN 'bullets'
    WHEN len(lines) >= 4 AND 10 * len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) > 3 * len(lines) THEN 'ellipses'
    WHEN words >= 20 AND 2 * len(list_distinct(list_transform(range(1, words - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) < words - 2 THEN 'repeated_ngrams'
  END AS reason FROM f
)
SELECT doc_id, reason IS NULL AS keep, reason FROM r
"""
