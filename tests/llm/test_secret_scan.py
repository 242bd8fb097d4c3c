"""Secret scans: planted random strings are found, words, names, digests and identifiers aren't."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from phonoflow.llm import secret_scan as X
from phonoflow.session import table

PLAIN = [
    "an ordinary text without anything", "see https://example.org/some/long/path/to/a/page.html for more", "internationalization and counterrevolutionaries",
    "id 123e4567-e89b-12d3-a456-426614174000 was kept", "commit: 2fd4e1c67a2d28fced849ee1bb76e7391b93eb12", "the sum 9e107d9d372bb6826bd81d3542a419d6 is right",
    "card 4111111111111111 and phone +49-30-1234567890123", "site-packages/python3/some_module_name_2024", "sha256=e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
]


def test_random_strings_are_found_and_others_not():
    rng = random.Random(1)
    for kind in (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"):
        for n in (24, 40, 80):
            for _ in range(40):
                s = "".join(rng.choices(kind, k=n))
                if any(c.isdigit() for c in s):
                    got = list(X.secrets_in(f'token = "{s}" and more'))
                    assert [(a, b) for a, b, _ in got] == [(9, n)], s
    assert not [t for t in PLAIN if list(X.secrets_in(t))]


def test_known_strings_are_left_out():
    s = "q8Zk3vX0pLw7Tn5Rb2Yd9Hc4"
    assert len(list(X.secrets_in(f"key {s}"))) == 1
    assert not list(X.secrets_in(f"key {s}", known=frozenset({s})))


def test_planted_tokens_of_the_given_table(spark, sf="/root/testdata/sf0.01"):
    """Every token of the documents is found whole; brute force is a scan of all texts without the JVM's choice of candidates."""
    docs = table(spark, sf, "documents")
    got = {(r["doc_id"], r["start"], r["length"]) for r in X.op8_secret_scans(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {(r["doc_id"], a, n) for r in rows for a, n, _ in X.secrets_in(r["text"] or "")}
    import re

    planted = {(r["doc_id"], m.start(1), 40) for r in rows for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"] or "")}
    assert planted
    assert planted <= got


def test_odd_rows(spark, odd_docs, no_docs):
    assert X.findings(odd_docs).count() == 0
    assert X.redacted(odd_docs).exceptAll(odd_docs).count() == 0
    assert X.redacted(odd_docs).count() == odd_docs.count()
    assert X.redacted(no_docs).columns == no_docs.columns
    secret = "A8f3kL0qZ7xW2mN5vB9tY4rC"
    text = f"a {secret} b {secret}" + " word" * 30_000 + f" {secret}"
    df = spark.createDataFrame([(1, text, len(text), "n"), (1, text, len(text), "n"), (None, secret, None, None)], "doc_id long, text string, n_chars long, new string")
    assert X.findings(df).count() == 7
    got = X.redacted(df)
    assert got.columns == df.columns
    assert got.where(F.col("text").contains(secret)).count() == 0
    assert all(r["text"].count(X.MASK) == (1 if r["doc_id"] is None else 3) and r["n_chars"] == len(r["text"]) for r in got.collect())
    assert X.redacted(got).exceptAll(got).count() == 0


def test_random_strings_joined_to_words_are_found():
    rng = random.Random(2)
    letters = string.ascii_letters + string.digits
    for before, kind, n, share in [("production/config/database/password/", "0123456789abcdef", 32, 0.97), ("production/config/database/password/", letters, 20, 0.97), ("production/config/database/password/", letters + "+/", 40, 0.97), ("database-connection-password-", letters, 20, 0.97), ("database-connection-password-", letters, 16, 0.9)]:
        for after in ("", "/settings/of/the/application"):
            found = 0
            for _ in range(200):
                text = f"see {before}{''.join(rng.choices(kind, k=n))}{after} there"
                start = 4 + len(before)
                found += any(a <= start and start + n <= a + size for a, size, _ in X.secrets_in(text))
            assert found >= share * 200, (before, n, after, found)


def test_words_digests_and_identifiers_in_long_runs_are_left_out():
    long = "documentation/internationalization/configuration/"
    for s in ("123e4567-e89b-12d3-a456-426614174000", "2fd4e1c67a2d28fced849ee1bb76e7391b93eb12", "commit/2fd4e1c67a2d", "2024/01/02", "version2", "MyVeryLongRoleNameForProductionDeployments2"):
        assert not list(X.secrets_in(f"{long}{s}/{long}{long}")), s
    secret = "q8Zk3vX0pLw7Tn5Rb2Yd9Hc4"
    assert [(a, n) for a, n, _ in X.secrets_in(f"{long}{secret}/{long}")] == [(len(long), len(secret))]
    assert not list(X.secrets_in(f"{long}{secret}/{long}", known=frozenset({secret})))


def test_a_word_before_a_string_is_no_name_of_an_identifier():
    secret = "q8Zk3vX0pLw7Tn5Rb2Yd9Hc4"
    for before in ("she said ", "paid ", "invalid ", "Madrid ", "the tree ", "a ref ", "hash ", "commit ", "id ", "paid: ", "invalid = ", "Madrid => "):
        assert [(a, n) for a, n, _ in X.secrets_in(f"{before}{secret} and more")] == [(len(before), len(secret))], before
    for before in ("id: ", "doc_id = ", "doc-id => ", '"docId": "', "userID=", "commit: ", "etag => ", "ref="):
        assert not list(X.secrets_in(f"{before}{secret} and more")), before


def test_letters_alone():
    """Random letters are found, by name nearly all; long words, names and the alphabet aren't."""
    rng = random.Random(4)
    for kind in (string.ascii_lowercase, string.ascii_uppercase):
        named = alone = joined = 0
        for _ in range(300):
            s = "".join(rng.choices(kind, k=32))
            named += [(a, n) for a, n, _ in X.secrets_in(f"api_key = '{s}'")] == [(11, 32)]
            alone += [(a, n) for a, n, _ in X.secrets_in(f"so {s} it is")] == [(3, 32)]
            joined += [(a, n) for a, n, _ in X.secrets_in(f"configuration/{s}/settings")] == [(14, 32)]
        assert named >= 297, (kind, named)
        assert alone >= 280, (kind, alone)
        assert joined >= 280, (kind, joined)
    words = """donaudampfschifffahrtsgesellschaft Geschwindigkeitsbegrenzungen bundesausbildungsfoerderungsgesetz anticonstitutionnellement
    electroencefalografista STRASSENVERKEHRSORDNUNG GESCHWINDIGKEITSBEGRENZUNG floccinaucinihilipilification abcdefghijklmnopqrstuvwxyz
    some/long/path/to/another/page well-known-and-widely-used-names aaaaaaaaaaaaaaaaaaaaaaaaaaaa""".split()
    assert not [w for w in words if list(X.secrets_in(f"say {w} again"))]
    assert not list(X.secrets_in(f"commit: {'qzxjvkwpqzxjvkwpqzxj'}"))


def test_runs_without_separators_by_another_library(spark, sf="/root/testdata/sf0.1"):
    """The rules written anew for runs of letters and digits, with token counts of another library over the same vocabulary."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    alphabet, joints = set(string.ascii_letters + string.digits), set("+/_-")
    secret = ("key", "token", "secret", "passw", "pwd", "auth", "credential", "bearer", "private", "signature")
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").collect()
    want = set()
    for doc, text in rows:
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in alphabet | joints:
                end += 1
            run = text[at:end]
            if len(run) >= 20 and not joints & set(run):
                stop = end + (text[end : end + 2] == "==" and 2 or text[end : end + 1] == "=" and 1 or 0)
                before = text[max(0, at - 80) : at].rstrip().rstrip("\"'").rstrip()
                sign = before[-1:] if before[-1:] in (":", "=") else "=" if before.endswith("=>") else ""
                word = before[: -2 if before.endswith("=>") else -1].rstrip().rstrip("\"'") if sign else before
                name = ""
                while word and (word[-1].isalnum() or word[-1] in "_.-"):
                    name, word = word[-1] + name, word[:-1]
                named = any(s in name.lower() for s in secret)
                assert not name.lower().endswith("id") or named or not sign, "no planted ids of this kind"
                digest = len(run) in (32, 40, 56, 64, 96, 128) and set(run) <= set("0123456789abcdef")
                digits, turn = any(c.isdigit() for c in run), any(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False))
                limit = 2.35 if named or digits or turn else 1.95
                if not run.isdigit() and not (digest and not named) and not run.lower() in string.ascii_lowercase and name.lower() not in ("sha256", "md5", "commit", "hash"):
                    if (stop - at) / len(tok.encode(text[at:stop], add_special_tokens=False).ids) < limit:
                        want.add((doc, at, stop - at))
            at = max(end, at + 1)
    texts = dict(rows)
    got = {(r["doc_id"], r["start"], r["length"]) for r in X.op8_secret_scans(spark, sf).collect()}
    plain = set()
    for doc, a, n in got:
        t = texts[doc]
        around = t[max(0, a - 1) : a] + t[a : a + n] + t[a + n : a + n + 1]
        if not joints & set(around):
            plain.add((doc, a, n))
    assert len(want) > 100
    assert plain == want
