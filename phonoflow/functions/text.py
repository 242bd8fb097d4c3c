"""Text expressions: trimming, tokenising, cleaning, splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "。、？！.,"


def trim_u(s: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fields_u(s: Column) -> Column:
    """The fields between runs of Unicode white space."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def split_sentences(s: Column, stop: str = "。") -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(s, F.lit("\\Q" + stop + "\\E")), trim_u), lambda x: x != "")


def strip_punctuation(s: Column, chars: str = PUNCTUATION) -> Column:
    """Without the given characters."""
    return F.translate(s, chars, "")


#: (pattern, replacement) in the order in which they have to run; the last three need no pattern.
MARKUP = [
    (r"\{\{\{[^{}]*\}\}\}", ""),
    *[(r"\{\{[^{}]*\}\}", "")] * 3,
    (r"\[\[(?:Category|カテゴリ):[^\]]+\]\]", ""),
    (r"\[\[(?:File|Image|ファイル|画像):[^\]]+\]\]", ""),
    (r"<ref[^>]*/>|<ref[^>]*>[\s\S]*?</ref>", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"\[https?://[^\]]*\]", ""),
    (r"<[^>]+>", ""),
    (r"={2,}[^=]+=+", ""),
    (r"(?m)^[*#:;|!]+", ""),
    (r"'''", ""),
    (r"''", ""),
    (r"\s+", " "),
]


def clean_markup(s: Column) -> Column:
    """Wiki markup to plain text; a chain of replacements in one projection."""
    for pattern, by in MARKUP:
        s = F.regexp_replace(s, pattern, by)
    return s


def is_tag_line(s: Column) -> Column:
    """a line that is one <doc ...> or </doc> tag."""
    return s.rlike(r"^</?doc[^>]*>$")


def sentence_bytes_between(s: Column, low: int = 4, high: int = 200) -> Column:
    """length in UTF-8 bytes."""
    return F.octet_length(s).between(low, high)


def is_japanese(word: Column) -> Column:
    """Hiragana, Katakana, Han, the long mark and the iteration mark only."""
    return word.rlike(r"^[\p{IsHiragana}\p{IsKatakana}\p{IsHan}ー々]+$")


def at_most_runes(word: Column, n: int = 8) -> Column:
    """at most n characters."""
    return F.char_length(word) <= n


def pronunciation(pron: Column, reading: Column) -> Column:
    """The pronunciation, or the reading where it is empty or '*'; null where both are."""
    given = lambda x: F.nullif(F.nullif(x, F.lit("")), F.lit("*"))
    return F.coalesce(given(pron), given(reading))


def self_referring(words: Column) -> Column:
    """F16: at least four words of which the first is the third."""
    return (F.size(words) >= 4) & (F.get(words, F.lit(0)) == F.get(words, F.lit(2)))


def wav_name(path: Column) -> Column:
    """The path with .wav for its ending."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".wav"))


def fill_template(fmt: str, *slots: Column) -> Column:
    """Printf of the slots."""
    return F.format_string(fmt, *slots)


def numbers(s: Column, kind: str = "double") -> Column:
    """The numbers of a comma-separated string; what doesn't parse is left out."""
    return F.filter(F.transform(F.split(s, ","), lambda x: trim_u(x).try_cast(kind)), lambda x: x.isNotNull())


def safe_percent(part: Column, total: Column) -> Column:
    """100 part / total, 0 for no total."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")) * 100, F.lit(0.0))


def with_silence(phonemes: Column) -> Column:
    """A phoneme sequence between two silences."""
    return F.concat(F.array(F.lit("sil")), phonemes, F.array(F.lit("sil")))


def join_words(words: Column) -> Column:
    """Words with spaces between them."""
    return F.array_join(words, " ")
