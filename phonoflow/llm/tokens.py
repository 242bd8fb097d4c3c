"""Tokens of the public byte-level vocabularies."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import tiktoken

TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern has it. The pattern backtracks over a run of it, on a stack that some 600,000 characters fill.
LONG_RUN = 50_000
_LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{%d,}" % LONG_RUN)


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> tiktoken.Encoding:
    """One encoder per process; special tokens are ordinary text."""
    lines = Path(folder, ranks).read_bytes().splitlines()
    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_ids(text: str, folder: str = TOKENIZER_DIR) -> list[int]:
    """The tokens of a text of any length.

    A very long run of white space doesn't go through the pattern: by it, a run that something follows is a piece of its
    own but for its last character, which may join what follows; a run at the end is a piece as a whole.
    """
    enc = encoding(folder)
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + enc.encode_ordinary(text[at:])
