"""Byte-level BPE ids of whole texts.

The vocabulary is read from the installed tokenizer files; its name is a
parameter. Strings of special tokens in a text are ordinary text, unless the
tokenizer file with these added tokens is named too.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The tokenizer file of the same vocabulary that lists the added tokens.
ADDED = "byte_bpe_50k.json"
#: How the pattern that cuts texts ends: of a run of white space all but the last character, else the run.
BEHIND = r"|\s+(?!\S)|\s+"
#: White space beside white space; Python's has all of Unicode's and four control characters more.
_beside = re.compile(r"\s\s").search


@cache
def encoder(vocabulary: str = VOCABULARY, added: str | None = None):
    """One encoder a worker process: a function from a text to its ids (``uint32``).

    With ``added`` the ids are those of ``tokenizers`` with that file, whose
    added tokens are found in texts, at about a quarter of its time.

    Where no white space stands beside other white space, the pattern needs no
    look-ahead, and without it a text is cut in less time into the same words.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = []
    if added is not None:
        with open(public_tokenizers.path(added), encoding="utf-8") as file:
            tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{added}: added tokens that depend on their surroundings")
    special = {t["content"]: t["id"] for t in tokens}
    # tiktoken looks for special tokens in any text, and in many more steps if it has none; one that is not allowed is ordinary text.
    known = special or {"<|unused|>": max(ranks.values()) + 1}
    made = cache(lambda pattern: tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens=known))
    pattern, names = public_tokenizers.PATTERN, frozenset(special)
    short = pattern.removesuffix(BEHIND) + r"|\s" if pattern.endswith(BEHIND) else None

    def encode(text: str):
        if short is None or _beside(text) or any(n in text for n in names):
            return made(pattern).encode_to_numpy(text, allowed_special=names, disallowed_special=())
        return made(short).encode_to_numpy(text, disallowed_special=())

    return encode
