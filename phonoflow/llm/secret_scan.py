"""8. Secret scans by token efficiency.

A byte-pair vocabulary spells ordinary words with few tokens and random strings with many. Runs of at least MIN_CHARS
characters of the alphabets that keys are written in are held against it: few characters per token expose a random string.
Excluded first are known digests and identifiers: strings on a given list; UUIDs; numbers; hexadecimal strings of a
digest's length, and strings named as a checksum, digest, commit or id, by a name before a colon, = or =>, unless their
name says key, token, password or the like. A run that passes as a whole is looked at by its parts between / - and _, as words joined to a random string would
hide it: neighbouring parts that each fail, one of them of half of MIN_CHARS or more, are reported as one finding, filled
up to MIN_CHARS with the parts beside them where they are shorter. The exclusions hold for parts, too.

Letters without a digit or a change from lower to upper case may be a long compound word, which a vocabulary spells badly,
too. Such a string is held against the limit where its name says key, token or the like, and against the lower
LETTERS_LIMIT elsewhere: 97 of 100 random ones of 32 letters lie below, compound words in capitals start at 2.0. The alphabet
is none. Of a run of letters joined by separators alone, parts of MIN_CHARS or more are looked at, each by itself.

Plan: a JVM expression finds the documents that hold a candidate at all; only their texts go to Python, in Arrow batches.
No shuffle. Whole texts are scanned.

Defined results: null and empty texts have no findings; overlaps can't occur, as runs are maximal and parts of one are taken once; repeated rows are each
scanned; a null doc_id is reported as null. Redaction changes text, and n_chars where that column exists and the text
changed; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from phonoflow.llm.tokens import TOKENIZER_DIR, encoding
from phonoflow.plans.register import source
from phonoflow.session import bound_batches

MIN_CHARS = 20
#: 999 of 1,000 random hexadecimal strings of 32 lie below; names and paths with digits start at about 2.7.
MAX_CHARS_PER_TOKEN = 2.35
LETTERS_LIMIT = 1.95
MASK = "[SECRET]"
_RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{%d,}={0,2}"
_PART = re.compile(r"[A-Za-z0-9+]+={0,2}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
_NUMBER = re.compile(r"[\d+\-_/=]+")
_NAME = re.compile(r"([A-Za-z][\w.\-]*)[\"']?\s*(=>|[:=]|\s)\s*[\"']?$")
_SECRET_NAME = re.compile(r"(?i)key|token|secret|passw|pwd|auth|credential|bearer|private|signature")
#: an id is a word of its own in the name: id, doc_id, doc-id, docId, docID
_KNOWN_NAME = re.compile(r"^(?:(?i:sha\d*|sha-?\d+|md5|crc\d*|blake\w*|checksum|digest|hash|commit|rev|revision|tree|blob|etag|integrity|fingerprint|(?:.*[_.\-])?id|uuid|guid|isbn|doi|ref)|.*[a-z0-9]I[dD])$")


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _mixed(s: str) -> bool:
    """Whether it is more than one word of letters, or a number."""
    return any(c.isalpha() for c in s) and (any(c.isdigit() for c in s) or any(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)))


def _letters_limit(s: str, named: bool, limit: float) -> float:
    """The limit for a string of letters alone; 0 for the alphabet."""
    return 0.0 if s.lower() in _ALPHABET * 2 else limit if named else min(limit, LETTERS_LIMIT)


def _parts_in(run: str, name: str, known: frozenset[str], folder: str, min_chars: int, limit: float) -> Iterator[tuple[int, int, float]]:
    """(start, length, characters per token) of the random strings between the separators of a run."""
    parts = [m.span() for m in _PART.finditer(run)]
    uuids = [m.span() for m in _UUID.finditer(run)]
    ratio = lambda a, b: (b - a) / len(encoding(folder).encode_ordinary(run[a:b]))

    def fails(i: int) -> bool:
        a, b = parts[i]
        part = run[a:b]
        if part in known or _NUMBER.fullmatch(part) or any(a < y and x < b for x, y in uuids):
            return False
        if _DIGEST.fullmatch(part) and not _SECRET_NAME.search(f"{name} {run[:a]}") and (len(part) in _DIGEST_CHARS or i and _KNOWN_NAME.match(run[slice(*parts[i - 1])])):
            return False
        if not _mixed(part):
            return ratio(a, b) < (_letters_limit(part, bool(_SECRET_NAME.search(name)), limit) if b - a >= min_chars else limit)
        return ratio(a, b) < limit

    bad = [fails(i) for i in range(len(parts))]
    first = i = 0  # parts before `first` are taken
    while i < len(parts):
        if not bad[i]:
            i += 1
            continue
        lo = i
        while i < len(parts) and bad[i]:
            i += 1
        hi = i - 1
        if any(b - a >= (min_chars // 2 if _mixed(run[a:b]) else min_chars) for a, b in parts[lo : hi + 1]):
            size = lambda: parts[hi][1] - parts[lo][0]  # noqa: B023, E731
            while size() < min_chars and lo > first:
                lo -= 1
            while size() < min_chars and hi + 1 < len(parts):
                hi += 1
            a, b = parts[lo][0], parts[hi][1]
            if size() >= min_chars and run[a:b] not in known and not any(a < y and x < b for x, y in uuids) and (r := ratio(a, b)) < limit:
                yield a, b - a, r
                first = i = hi + 1


def secrets_in(text: str, known: frozenset[str] = frozenset(), folder: str = TOKENIZER_DIR, min_chars: int = MIN_CHARS, limit: float = MAX_CHARS_PER_TOKEN) -> Iterator[tuple[int, int, float]]:
    """(start, length, characters per token) of every finding, in order."""
    for m in re.finditer(_RUN % min_chars, text):
        run = m.group()
        if run in known or _NUMBER.fullmatch(run) or _UUID.fullmatch(run):
            continue
        name = _NAME.search(text, max(0, m.start() - 80), m.start())
        name, sign = name.groups() if name else ("", "")
        if not _mixed(run):  # words of letters
            for p in _PART.finditer(run):
                s = p.group()
                if len(s) >= min_chars and s not in known and (sign.isspace() or not sign or _SECRET_NAME.search(name) or not _KNOWN_NAME.match(name)):
                    ratio = len(s) / len(encoding(folder).encode_ordinary(s))
                    if ratio < _letters_limit(s, bool(_SECRET_NAME.search(name)), limit):
                        yield m.start() + p.start(), len(s), ratio
            continue
        if not _SECRET_NAME.search(name) and (not sign.isspace() and _KNOWN_NAME.match(name) or (_DIGEST.fullmatch(run) and len(run) in _DIGEST_CHARS)):
            continue
        ratio = len(run) / len(encoding(folder).encode_ordinary(run))
        if ratio < limit:
            yield m.start(), len(run), ratio
        else:
            for start, length, part in _parts_in(run, name, known, folder, min_chars, limit):
                yield m.start() + start, length, part


def _candidates(text: Column, min_chars: int) -> Column:
    """The text where it holds a candidate, else null, so that it alone goes to Python."""
    return F.when(text.rlike(_RUN % min_chars), text)


def findings(docs: DataFrame, known: frozenset[str] = frozenset(), folder: str = TOKENIZER_DIR, min_chars: int = MIN_CHARS, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """A row per finding: (doc_id, start, length, chars_per_token); start counts characters from 0."""
    bound_batches(docs.sparkSession)
    item = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("ratio", DoubleType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ratio", pa.float64())]))

    @F.arrow_udf(ArrayType(item))
    def scan(text: pa.Array) -> pa.Array:
        keys = ("start", "length", "ratio")
        return pa.array([[dict(zip(keys, x, strict=True)) for x in secrets_in(t, known, folder, min_chars, limit)] if t else [] for t in text.to_pylist()], kind)

    found = docs.where(docs["text"].rlike(_RUN % min_chars)).select(F.col("doc_id"), F.explode(scan(F.col("text"))).alias("f"))
    return found.select("doc_id", F.col("f.start").alias("start"), F.col("f.length").alias("length"), F.round("f.ratio", 6).alias("chars_per_token"))


def redacted(docs: DataFrame, known: frozenset[str] = frozenset(), folder: str = TOKENIZER_DIR, min_chars: int = MIN_CHARS, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with MASK in place of every finding."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def mask(text: pa.Array) -> pa.Array:
        def clean(t: str | None) -> str | None:
            if t is None:
                return None
            parts, at = [], 0
            for start, length, _ in secrets_in(t, known, folder, min_chars, limit):
                parts += [t[at:start], MASK]
                at = start + length
            return "".join([*parts, t[at:]]) if parts else None

        return pa.array([clean(t) for t in text.to_pylist()], pa.string())

    new = mask(_candidates(docs["text"], min_chars))
    out = docs.withColumn("text", F.struct(new.alias("new"), docs["text"].alias("old")))
    changes = {"text": F.coalesce(F.col("text.new"), F.col("text.old"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("text.new").isNotNull(), F.length("text.new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changes)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in all documents."""
    return findings(source(spark, sf_dir, "documents"))
