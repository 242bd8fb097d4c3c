"""Dictionary operators: lookups, coverage filters, vote and funnel filters, confusion filter, regeneration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoflow.functions import phonemes as P
from phonoflow.functions import text as X

#: Entries of a word that meet its rows in one task, and rows that a block may hold.
ENTRIES, BLOCK_ROWS = 4096, 1 << 14


def numbered(entries: DataFrame, order: str = "pos") -> DataFrame:
    """pron_idx: the place of a pronunciation among those of its word."""
    return entries.withColumn("pron_idx", F.row_number().over(Window.partitionBy("word").orderBy(order)) - 1)


def first_pronunciation(rows: DataFrame, dictionary: DataFrame, word: str = "w") -> DataFrame:
    """The first pronunciation of each row's word; rows without one go."""
    d = dictionary.where("pron_idx = 0").select(F.col("word").alias("_w"), "phonemes")
    return rows.join(d, F.col(word) == F.col("_w")).drop("_w")


def all_pronunciations(rows: DataFrame, dictionary: DataFrame, word: str = "w") -> DataFrame:
    """Every pronunciation of each row's word.

    Rows are gathered in blocks of a word, an entry meets a block at a time, and a word's entries are dealt out by
    ENTRIES of them: no task has a whole word, and what is written repeats an entry behind itself and a block's rows within
    some kilobytes, so it packs well however many there are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in rows.columns if c != word]
    d = dictionary.select(F.col("word").alias("_w"), "reading", "phonemes", "pron_idx", F.expr(f"pron_idx div {ENTRIES}").alias("_deal"))
    deals = d.groupBy(F.col("_w").alias("_v")).agg(F.max("_deal").alias("_most"))
    blocks = rows.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("_v"), F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}").alias("_block")).agg(F.collect_list(F.struct(F.lit(0).alias("_"), *rest)).alias("_rows"))
    blocks = blocks.join(deals, "_v").select("_v", "_rows", F.explode(F.sequence(F.lit(0).cast("long"), "_most")).alias("_to"))
    met = d.repartition(parts, "_w", "_deal").join(blocks.repartition(parts, "_v", "_to"), (F.col("_w") == F.col("_v")) & (F.col("_deal") == F.col("_to")))
    each = met.select(F.col("_w").alias(word), "reading", "phonemes", "pron_idx", F.explode("_rows").alias("_row"))
    return each.select(*(F.col(word) if c == word else F.col(f"_row.{c}") for c in rows.columns), "reading", "phonemes", "pron_idx")


def words_of(dictionary: DataFrame) -> DataFrame:
    """The distinct words of a dictionary."""
    return dictionary.select("word").distinct()


def all_in_dictionary(sentences: DataFrame, dictionary: DataFrame, key: str, words: str = "words", min_words: int = 0) -> DataFrame:
    """Sentences of at least ``min_words`` words, all of them in the dictionary; an empty sentence passes.

    Two anti-joins on words and keys, so neither side has to fit anywhere.
    """
    bad = sentences.select(key, F.explode(words).alias("_w")).join(dictionary.select(F.col("word").alias("_w")), "_w", "left_anti").select(key).distinct()
    return sentences.where(F.size(words) >= min_words).join(bad, key, "left_anti")


def missing_words(corpus: DataFrame, dictionary: DataFrame, word: str = "w") -> DataFrame:
    """Distinct corpus words that the dictionary lacks."""
    return corpus.select(F.col(word).alias("word")).distinct().join(dictionary.select("word"), "word", "left_anti")


def missing_report(corpus: DataFrame, dictionary: DataFrame, shown: int = 20) -> tuple[list[str], int]:
    """The first words that are missing, and how many there are."""
    m = missing_words(corpus, dictionary)
    return [r[0] for r in m.orderBy("word").limit(shown).collect()], m.count()


def utterance_phonemes(manifest: DataFrame, dictionary: DataFrame, key: str = "utt_id", words: str = "words") -> DataFrame:
    """(key, phonemes) of utterances whose every word has a pronunciation; silence at both ends."""
    tokens = manifest.select(key, F.size(words).alias("_n"), F.posexplode(words).alias("_pos", "w"))
    found = first_pronunciation(tokens, dictionary)
    whole = found.groupBy(key, "_n").agg(F.sort_array(F.collect_list(F.struct("_pos", "phonemes"))).alias("_p")).where(F.size("_p") == F.col("_n"))
    return whole.select(key, X.with_silence(F.flatten(F.transform("_p", lambda x: x.phonemes))).alias("phonemes")).where(F.size("phonemes") > 2)


def vote_filter(rows: DataFrame, at_least: int, votes: str = "up_votes") -> DataFrame:
    """F1."""
    return rows.where(F.col(votes) >= at_least)


def speakers(rows: DataFrame, by: str = "client_id") -> DataFrame:
    """How many distinct speakers there are."""
    return rows.agg(F.countDistinct(by).alias("n_speakers"))


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """In one pass, how many rows pass each step and all before it, and the share in percent."""
    total, held = F.count("*"), None
    columns = [total.alias("total")]
    for name, ok in steps.items():
        held = ok if held is None else held & ok
        n = F.count_if(held)
        columns += [n.alias(name), X.safe_percent(n, total).alias(f"{name}_pct")]
    return rows.agg(*columns)


def distinct_entries(entries: DataFrame) -> DataFrame:
    """Whole rows once, by word and reading."""
    return entries.dropDuplicates().orderBy("word", "reading")


def regenerated(dictionary: DataFrame) -> DataFrame:
    """Phonemes from the readings, and the silence entry behind."""
    new = dictionary.select("word", "reading", P.kana_to_phonemes(F.col("reading")).alias("phonemes"))
    sil = dictionary.sparkSession.createDataFrame([("<sil>", "SIL", ["sil"])], "word string, reading string, phonemes array<string>")
    return new.unionByName(sil)


def _deletions(code: Column, most: int) -> Column:
    """The string and what is left of it after up to ``most`` deletions, each once."""
    out = F.array(code)
    for _ in range(most):
        shorter = lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.when(F.char_length(s) > 0, shorter(s)).otherwise(F.array().cast("array<string>"))))))
    return out


def too_close_pairs(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """Pairs (word_a, word_b, dist) of entries nearer than ``distance``. Exact.

    Two sequences within d edits share what is left of them after at most d deletions each. So for d up to 2 both sides
    are spread over those and joined on them, an equi-join that grows with the entries; beyond that on lengths that can match.
    """
    most = distance - 1
    spell = lambda d, s: d.select(F.col("word").alias(f"word_{s}"), P.phoneme_code(F.col("phonemes")).alias(f"code_{s}"))
    left, right = spell(a, "a"), spell(b, "b")
    if 0 <= most <= 2:
        spread = lambda d, s: d.withColumn("key", F.explode(_deletions(F.col(f"code_{s}"), most)))
        met = spread(left, "a").join(spread(right, "b"), "key").drop("key").distinct()
    else:
        length = F.char_length
        met = left.withColumn("n", F.explode(F.sequence(length("code_a") - most, length("code_a") + most))).join(right.withColumn("n", length("code_b")), "n")
    dist = F.levenshtein("code_a", "code_b", max(most, 0))
    return met.withColumn("dist", dist).where((F.col("dist") >= 0) & (F.col("dist") < distance)).select("word_a", "word_b", "dist")


def _levenshtein_below(a: tuple, b: tuple, k: int) -> bool:
    if abs(len(a) - len(b)) >= k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) >= k:
            return False
    return row[-1] < k


def greedy_selection(candidates: DataFrame, accepted: DataFrame, budget: int, min_distance: int) -> DataFrame:
    """Candidates by (phonemes, characters, position), each taken if it is at least ``min_distance`` from all taken.

    Every pick changes the filter, so this is one sequential task by nature; its input is a dictionary, not the corpus.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, list[tuple]] = {}
        for p in pdf.loc[pdf["kind"] == 0, "phonemes"]:
            taken.setdefault(len(p), []).append(tuple(p))
        rows, left = [], budget
        for r in pdf[pdf["kind"] == 1].sort_values(["n_phones", "n_chars", "pos"], kind="stable").itertuples():
            if left <= 0:
                break
            ph = tuple(r.phonemes)
            near = (q for n in range(len(ph) - min_distance + 1, len(ph) + min_distance) for q in taken.get(n, ()))
            if min_distance > 0 and len(ph) and any(_levenshtein_below(ph, q, min_distance) for q in near):
                continue
            if ph:
                taken.setdefault(len(ph), []).append(ph)
            rows.append((r.word, r.phonemes, r.pos))
            left -= 1
        return pd.DataFrame(rows, columns=["word", "phonemes", "pos"])

    c = candidates.select(F.lit(1).alias("kind"), "word", "phonemes", F.size("phonemes").alias("n_phones"), F.char_length("word").alias("n_chars"), F.col("pos").cast("long").alias("pos"))
    a = accepted.where(F.size("phonemes") > 0).select(F.lit(0).alias("kind"), "word", "phonemes", F.size("phonemes").alias("n_phones"), F.char_length("word").alias("n_chars"), F.lit(-1).cast("long").alias("pos"))
    return c.unionByName(a).groupBy(F.lit(0).alias("one")).applyInPandas(pick, "word string, phonemes array<string>, pos long")


def filtered_dictionary(full: DataFrame, must: DataFrame, corpus_words: DataFrame, max_words: int, max_runes: int = 8, min_distance: int = 2) -> DataFrame:
    """(grp, pos, word, phonemes): must entries, then corpus words, then as many filtered candidates as the budget allows.

    ``full`` and ``must`` have (pos, word, phonemes); the first entry of a word counts that passes its filter (Q12).
    """
    rest = full.join(must.select("word").distinct(), "word", "left_anti")
    first = Window.partitionBy("word").orderBy("pos")
    in_corpus = rest.join(corpus_words.select("word").distinct(), "word", "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("pos", "word", "phonemes")
    ok = X.is_japanese(F.col("word")) & X.at_most_runes(F.col("word"), max_runes) & (F.size("phonemes") >= 2)
    others = rest.join(corpus_words.select("word").distinct(), "word", "left_anti").where(ok).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("pos", "word", "phonemes")
    budget = max(0, max_words - must.count() - in_corpus.count())
    accepted = must.select("word", "phonemes").unionByName(in_corpus.select("word", "phonemes"))
    chosen = greedy_selection(others, accepted, budget, min_distance)
    rank = chosen.select(F.lit(2).alias("grp"), F.row_number().over(Window.orderBy(F.size("phonemes"), F.char_length("word"), "pos")).cast("long").alias("pos"), "word", "phonemes")
    part = lambda d, g: d.select(F.lit(g).alias("grp"), F.col("pos").cast("long").alias("pos"), "word", "phonemes")
    return part(must, 0).unionByName(part(in_corpus, 1)).unionByName(rank)


def union_manifests(augmented: DataFrame, plain: DataFrame) -> DataFrame:
    """Both manifests, flagged."""
    return augmented.withColumn("no_augment", F.lit(False)).unionByName(plain.withColumn("no_augment", F.lit(True)))


def existing_only(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose wav_path is among the files (path)."""
    return manifest.join(files.select(F.col("path").alias("wav_path")), "wav_path", "left_semi")


def tokenised(lines: DataFrame, command: list[str] | None = None, batch: int = 1000) -> DataFrame:
    """(id, words) of lines (id, line): white space by default, or an external tokeniser that answers a line with a line.

    Lines go to a child process in batches; ids stay beside them, so a lost line is an error and not a shift.
    """
    if command is None:
        return lines.select("id", X.fields_u(F.col("line")).alias("words"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                text = "".join(f"{' '.join(s.split())}\n" for s in part["line"])
                got = subprocess.run(command, input=text, capture_output=True, text=True, check=True).stdout.split("\n")
                if not got[-1]:
                    got.pop()
                if len(got) != len(part):
                    raise ValueError("the tokeniser lost a line")
                yield pd.DataFrame({"id": part["id"], "words": [x.split() for x in got]})

    return lines.select("id", "line").mapInPandas(run, f"id {lines.schema['id'].dataType.simpleString()}, words array<string>")
