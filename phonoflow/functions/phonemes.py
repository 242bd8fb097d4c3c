"""Phoneme inventory, kana table and phoneme-sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions.common import let

#: The value of log(0) in scores; a sentinel that stays finite under addition.
LOG_ZERO = -1e30

PHONEMES = "sil sp a i u e o k g t d p b s z h f ch ts j m n ng r y w sh q long".split()


def _kana_table() -> dict[str, list[str]]:
    """Katakana to phonemes, by rows of the syllabary."""
    table: dict[str, list[str]] = {}
    rows = {"": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダヂヅデド", "n": "ナニヌネノ", "h": "ハヒフヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "r": "ラリルレロ"}
    shifted = {"シ": "sh", "ジ": "j", "チ": "ch", "ツ": "ts", "ヂ": "j", "ヅ": "z", "フ": "f"}
    for onset, row in rows.items():
        for kana, vowel in zip(row, "aiueo", strict=True):
            c = shifted.get(kana, onset)
            table[kana] = [c, vowel] if c else [vowel]
    table |= {k: ["y", v] for k, v in zip("ヤユヨ", "auo", strict=True)} | {"ワ": ["w", "a"], "ヲ": ["o"], "ヴ": ["b", "u"]}
    table |= {k: [v] for k, v in zip("ァィゥェォ", "aiueo", strict=True)} | {"ン": ["ng"], "ッ": ["q"], "ー": ["long"]}
    glides = list(zip("ャュョ", "auo", strict=True))
    for kana, onset in zip("キギニヒビピミリ", "kgnhbpmr", strict=True):
        table |= {kana + g: [onset, "y", v] for g, v in glides}
    for kana, onset in (("シ", "sh"), ("ジ", "j"), ("チ", "ch")):
        table |= {kana + g: [onset, v] for g, v in glides} | {kana + "ェ": [onset, "e"]}
    small = dict(zip("ァィゥェォ", "aiueo", strict=True))
    for kana, onset, with_ in (("フ", ["f"], "ァィェォ"), ("ツ", ["ts"], "ァィェォ"), ("ヴ", ["b"], "ァィェォ"), ("ウ", ["u"], "ィェォ"), ("テ", ["t"], "ィ"), ("デ", ["d"], "ィ"), ("ト", ["t"], "ゥ"), ("ド", ["d"], "ゥ"), ("イ", ["i"], "ェ"), ("ク", ["k", "w"], "ァ"), ("グ", ["g", "w"], "ァ")):
        table |= {kana + x: [*onset, small[x]] for x in with_}
    return table | {"フュ": ["f", "y", "u"], "デュ": ["d", "y", "u"], "テュ": ["t", "y", "u"]}


KANA = _kana_table()


def phoneme_table(spark: SparkSession) -> DataFrame:
    """(phoneme, class_base): the closed inventory; three state classes each."""
    return spark.createDataFrame([(p, 3 * i) for i, p in enumerate(PHONEMES)], "phoneme string, class_base int")


def kana_table(spark: SparkSession) -> DataFrame:
    """(kana, phonemes)."""
    return spark.createDataFrame([(k, v) for k, v in KANA.items()], "kana string, phonemes array<string>")


def kana_to_phonemes(kana: Column) -> Column:
    """Greedy longest match of two, then one character; unknown characters are skipped."""
    pairs = "|".join(sorted(k for k in KANA if len(k) == 2))
    singles = "".join(k for k in KANA if len(k) == 1)
    lookup = F.create_map(*[x for k, v in KANA.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(F.regexp_extract_all(kana, F.lit(f"({pairs}|[{singles}])"), 1), lambda m: lookup[m]))


def triphone(left: Column, center: Column, right: Column) -> Column:
    """Left-center+right."""
    return F.concat(left, F.lit("-"), center, F.lit("+"), right)


def word_triphones(phonemes: Column) -> Column:
    """The triphones of a word, '#' at its edges."""
    edge = F.lit("#")
    return let(phonemes, lambda s: F.transform(s, lambda p, i: triphone(F.coalesce(F.get(s, i - 1), edge), p, F.coalesce(F.get(s, i + 1), edge))))


def center_phoneme(tri: Column) -> Column:
    """What stands between the first '-' and the last '+'; the whole string where there is no such place."""
    inner = F.regexp_extract(tri, r"^[^-]*-(.*)\+[^+]*$", 1)
    return F.when(tri.rlike(r"^[^-]*-.*\+[^+]*$"), inner).otherwise(tri)


def phoneme_code(phonemes: Column) -> Column:
    """A sequence as a string, a character for each phoneme: a private one for those of the inventory, else its first."""
    table = F.create_map(*[x for i, p in enumerate(PHONEMES) for x in (F.lit(p), F.lit(chr(0xE000 + i)))])
    return F.array_join(F.transform(phonemes, lambda p: F.coalesce(F.try_element_at(table, p), F.substring(p, 1, 1))), "")


def phoneme_edit_distance(a: Column, b: Column, threshold: int | None = None) -> Column:
    """X11: Levenshtein distance of phoneme arrays; -1 beyond ``threshold``."""
    pair = phoneme_code(a), phoneme_code(b)
    return F.levenshtein(*pair, threshold) if threshold is not None else F.levenshtein(*pair)


def parse_phonemes(s: Column) -> Column:
    """Phonemes of a space-separated string."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def phoneme_string(p: Column) -> Column:
    """Phonemes joined by spaces."""
    return F.array_join(p, " ")


def state_class(phoneme: Column, state: Column, phonemes: list[str] = PHONEMES) -> Column:
    """Phoneme number * 3 + state - 1; -1 for an unknown phoneme."""
    at = F.array_position(F.array(*map(F.lit, phonemes)), phoneme)
    return F.when(F.coalesce(at, F.lit(0)) > 0, (at - 1) * 3 + state - 1).otherwise(F.lit(-1)).cast("int")
