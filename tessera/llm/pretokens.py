"""Byte-level BPE in the tasks: texts cut at spaces, each distinct piece of text worked out once."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: A space inside or at the end of a run of white space: there, cutting before spaces isn't the pattern's cut.
_RUN = re.compile(r"\s (?:\s|\Z)")


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def compiled(pattern: str):
    import regex

    return regex.compile(pattern)


class Memo(dict):
    """``make`` of each key, kept for ``limit`` keys of at most LONGEST characters; then all are forgotten, which bounds the memory."""

    LONGEST = 40

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def cut(text: str) -> tuple[str, list[str]] | None:
    """The text up to its first space, and what follows each space; None where the cut could split a match.

    A match of the pattern starts at every space that follows a character other than white space, and
    at the last space before such a character. So cutting at spaces is safe unless a space has white
    space on both sides (or before it and the end after it).
    """
    if _RUN.search(text):
        return None
    head, *rest = text.split(" ")
    return head, rest
