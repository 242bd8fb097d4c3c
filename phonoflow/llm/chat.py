"""3. Chat formatting, relational: Spark expressions only.

Turns are collected as structs per conversation (partial aggregation, one shuffle by conv_id), sorted by (turn, role,
text), adjacent turns of one role are merged by array expressions, gaps and islands over the array's places, and everything
is concatenated into a template. A conversation is one row by nature, as its text is; the work is linear in its turns.

Defined results: turns whose text is null or empty are left out, and so are rows without conv_id; a null role is "user";
a null turn comes first. Of equal turn numbers the smaller role, then text, comes first; rows that repeat a turn in full
count once. A conversation without any turn left gives no row. Other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions.common import let
from phonoflow.session import table

OPEN, MIDDLE, CLOSE, JOIN = "<|", "|>\n", "<|end|>\n", "\n"


def _islands(turns: Column) -> Column:
    """Runs of adjacent turns of one role as (role, texts) structs, in time linear in the turns.

    The places where a run starts are found first; each run is then a slice between two of them. Turns that equal the one
    before, as sorted ones that repeat do, are left out.
    """
    places = lambda a, starts: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | starts(F.get(a, i - 1), F.get(a, i)))
    once = let(turns, lambda a: F.transform(places(a, lambda x, y: x != y), lambda i: F.get(a, i)))
    run = lambda a, s: F.transform(s, lambda i, k: F.struct(F.get(a, i).role.alias("role"), F.slice(a, i + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - i).text.alias("texts")))
    return let(once, lambda a: let(places(a, lambda x, y: x.role != y.role), lambda s: run(a, s)))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): one row per conversation; n_turns counts merged turns."""
    rows = turns.where("conv_id is not null and text is not null and text <> ''")
    one = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.col("text").alias("text"))
    # structs compare field by field, nulls alike, so no comparison of two turns is null
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    merged = grouped.select("conv_id", _islands(F.col("turns")).alias("m"))
    piece = F.transform("m", lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), F.array_join(t.texts, JOIN), F.lit(CLOSE)))
    return merged.select("conv_id", F.size("m").alias("n_turns"), F.array_join(piece, "").alias("text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as training text."""
    return formatted(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, text FROM conversations
           WHERE conv_id IS NOT NULL AND text IS NOT NULL AND text <> ''),
p AS (SELECT *, row_number() OVER w AS pos, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS starts FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM p),
m AS (SELECT conv_id, run, min(role) AS role, string_agg(text, chr(10) ORDER BY pos) AS text FROM r GROUP BY conv_id, run)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY run) AS text
FROM m GROUP BY conv_id
"""
