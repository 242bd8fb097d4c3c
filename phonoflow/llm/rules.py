"""7. Quality rules as a short-circuit cascade.

Every rule's cost and selectivity are estimated on a sample; then the rules are ordered by rejection per cost, each counted
on what the rules before it let through, and nested CASEs evaluate them in that order, so that most bad documents never
reach a dear rule. The words of a text are made where the first rule that needs them is reached, and not before. A document
is rejected when any rule rejects it: the order, and so the sample, changes the speed and never the result. All rules are
Spark expressions; nothing but the sample is shuffled.

Defined results: a null or empty text, or one of white space only, is rejected. A null in any other column is no reason to
reject. Repeated rows are judged alike. An empty table gives an empty one. Extra columns stay as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions.common import let
from phonoflow.plans.register import source
from phonoflow.session import cut_lineage

SAMPLE_ROWS = 1000
SPACE = "[ \t\r\n]+"


class Document:
    """What rules see: t (text), c (characters) and, once bound, w (words) and n (their number)."""

    def __init__(self, t: Column, w: Column | None = None) -> None:
        self.t, self.w = t, w

    @property
    def c(self) -> Column:
        return F.length(self.t)

    @property
    def n(self) -> Column:
        return F.size(self.w)

    def with_words(self, use: Callable[[Document], Column]) -> Column:
        """``use`` of the document with its words, which are made once."""
        return use(self) if self.w is not None else let(F.filter(F.split(self.t, SPACE), lambda x: x != ""), lambda w: use(Document(self.t, w)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes a Document; ``words`` tells that it needs w or n."""

    name: str
    words: bool
    rejects: Callable[[Document], Column]
    sql: str


def _share(count: Column, of: Column, limit: float) -> Column:
    return count > of * F.lit(limit)


def _no_letter(x: Column) -> Column:
    """Whether a word has no letter; the pattern is asked only about words without case."""
    return (F.lower(x) == F.upper(x)) & ~x.rlike("\\p{L}")


def _repeated_lines(t: Column) -> Column:
    return let(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), lambda x: (F.size(x) >= 5) & (F.size(F.array_distinct(x)) < F.size(x) * F.lit(0.6)))


def _word_length(d: Document) -> Column:
    return (d.n > 0) & let(F.length(F.array_join(d.w, "")), lambda c: (c < d.n * 2) | (c > d.n * 15))


RULES = [
    Rule("no_words", False, lambda d: ~d.t.rlike("[^ \t\r\n]"), "n = 0"),
    Rule("word_length", True, _word_length, "n > 0 AND (length(regexp_replace(t, '[ \\t\\r\\n]+', '', 'g')) < n * 2 OR length(regexp_replace(t, '[ \\t\\r\\n]+', '', 'g')) > n * 15)"),
    Rule("symbols", False, lambda d: _share(F.regexp_count(d.t, F.lit("[#$%&*|<>{}~^=_@]")), d.c, 0.08), "len(regexp_extract_all(t, '[#$%&*|<>{}~^=_@]')) > c * 0.08::DOUBLE"),
    Rule("exclamations", True, lambda d: _share(F.regexp_count(d.t, F.lit("[!?]")), d.n, 0.5), "len(regexp_extract_all(t, '[!?]')) > n * 0.5::DOUBLE"),
    Rule("capitals", False, lambda d: _share(F.regexp_count(d.t, F.lit("[A-Z]")), d.c, 0.4), "len(regexp_extract_all(t, '[A-Z]')) > c * 0.4::DOUBLE"),
    Rule("words_without_letters", True, lambda d: (d.n >= 20) & _share(F.size(F.filter(d.w, _no_letter)), d.n, 0.3), "n >= 20 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '\\pL'))) > n * 0.3::DOUBLE"),
    Rule("word_runs", True, lambda d: (d.n >= 20) & _share(F.size(F.filter(F.slice(d.w, F.lit(2), F.greatest(d.n - 1, F.lit(0))), lambda x, i: x == F.get(d.w, i))), d.n, 0.15), "n >= 20 AND len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) > n * 0.15::DOUBLE"),
    Rule("few_distinct_words", True, lambda d: (d.n >= 50) & (F.size(F.array_distinct(d.w)) < d.n * F.lit(0.1)), "n >= 50 AND len(list_distinct(w)) < n * 0.1::DOUBLE"),
    Rule("repeated_lines", False, lambda d: _repeated_lines(d.t), "len(l) >= 5 AND len(list_distinct(l)) < len(l) * 0.6::DOUBLE"),
    Rule("endless_word", True, lambda d: F.exists(d.w, lambda x: F.length(x) > 1000), "len(list_filter(w, lambda x: length(x) > 1000)) > 0"),
]


def bound(text: Column, use: Callable[[Document], Column]) -> Column:
    """``use`` of the text with its words; a null counts as empty."""
    return let(F.coalesce(text, F.lit("")), lambda t: Document(t).with_words(use))


def estimate(texts: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of what reaches it) in the order of the cascade. ``texts`` has one column, text.

    One job over the sample tells what each rule rejects, one a rule how long it takes. Making the words is part of the
    cost of the first rule that needs them, and of that one alone.
    """
    total = texts.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = cut_lineage(texts.sample(min(1.0, sample_rows / total), seed=seed).repartition(1))
    hits = [r[0] for r in sample.select(bound(F.col("text"), lambda d: F.array(*[r.rejects(d) for r in rules]))).collect()]

    def seconds(needs_words: bool, f: Callable[[Document], Column]) -> float:
        d = Document(F.coalesce(F.col("text"), F.lit("")))
        began = time.perf_counter()
        sample.agg(F.sum((d.with_words(f) if needs_words else f(d)).cast("int"))).collect()
        return time.perf_counter() - began

    seconds(False, lambda d: d.c >= 0)  # the first job is slower
    base, splitting = seconds(False, lambda d: d.c >= 0), seconds(True, lambda d: d.n >= 0)
    taken = [max(seconds(r.words, r.rejects) - (splitting if r.words else base), 1e-3) for r in rules]
    order, todo, split = [], list(range(len(rules))), max(splitting - base, 1e-3)
    while todo:
        cost = {i: taken[i] + (split if rules[i].words else 0.0) for i in todo}
        best = max(todo, key=lambda i: (sum(h[i] for h in hits) / cost[i], -cost[i]))
        order.append((rules[best], cost[best], sum(h[best] for h in hits) / max(1, len(hits))))
        hits = [h for h in hits if not h[best]]
        split = 0.0 if rules[best].words else split
        todo.remove(best)
    return order


def keep_expression(text: Column, order: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated, and words are made, only where the rules before didn't reject."""

    def cascade(d: Document, rest: list[Rule]) -> Column:
        if not rest:
            return F.lit(True)
        if rest[0].words and d.w is None:
            return d.with_words(lambda bound: cascade(bound, rest))
        return F.when(rest[0].rejects(d), F.lit(False)).otherwise(cascade(d, rest[1:]))

    return cascade(Document(F.coalesce(text, F.lit(""))), order)


def accepted(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; columns as they were."""
    order = [r for r, _, _ in estimate(docs.select("text"), rules, sample_rows)]
    return docs.where(keep_expression(docs["text"], order))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all rules accept."""
    return accepted(source(spark, sf_dir, "documents")).select("doc_id")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM d),
b AS (SELECT *, len(w) AS n, length(t) AS c FROM s)
SELECT doc_id FROM b WHERE NOT ({" OR ".join(f"({r.sql})" for r in RULES)})
"""
