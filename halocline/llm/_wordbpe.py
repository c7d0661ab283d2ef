"""Fast, exact encoding with a word-end BPE (vocabulary files of the ``tokenizers`` library).

The vocabulary lower-cases, drops white space and marks word ends, so each word is encoded alone. A text of ASCII and
Latin letters is cut into words by a few array passes over its bytes, each word ended by a line feed (no word holds
one), and encoded by a byte-pair encoder over the same merges in which that line feed is the word-end mark. Texts with
apostrophes are cut by the vocabulary's own pattern. Texts with characters for which libraries might disagree (case,
normal form, classes), or with special tokens, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import regex

#: ASCII, and Latin letters for which lower case, normal form and class are beyond doubt.
SAFE = re.compile("[\t-\r -~À-ÖØ-öø-ĮıIJ-ňŊ-ž]*")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE, LETTER, DIGIT, OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    out[list(b" \t\n\r\x0b\x0c")] = SPACE
    out[48:58] = DIGIT
    out[97:123] = LETTER
    out[128:] = LETTER  # in a safe text, parts of letters
    return out


CLASSES = _classes()


def _byte_letters() -> dict[str, int]:
    """The published byte-to-letter table of byte-level BPE, by its rule: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def ended_words(text: str) -> str:
    """Each word of a safe text without apostrophes, lower-case, followed by a line feed."""
    raw = np.frombuffer(text.lower().encode() + b" ", dtype=np.uint8)
    kind = CLASSES[raw]
    raw, kind, after = raw[:-1], kind[:-1], kind[1:]
    keep = kind != SPACE
    ends = ((kind != after) | (kind == DIGIT)) & keep
    width = keep.view(np.uint8) + ends
    until = np.cumsum(width, dtype=np.int64)
    out = np.full(int(until[-1]) if len(until) else 0, 10, dtype=np.uint8)
    out[(until - width)[keep]] = raw[keep]
    return out.tobytes().decode()


class WordBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        to_byte = _byte_letters()
        ranks: dict[bytes, int] = {}
        for token, i in sorted(json.loads(self.whole.to_str())["model"]["vocab"].items(), key=lambda x: x[1]):
            body, end = (token[:-4], b"\n") if token.endswith("</w>") else (token, b"")
            if all(c in to_byte for c in body):
                ranks.setdefault(bytes(to_byte[c] for c in body) + end, i)
        self.words = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids of the text as native unsigned 32-bit numbers."""
        if SAFE.fullmatch(text) is None or "<|" in text:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        words = ended_words(text) if "'" not in text else "".join([f"{w}\n" for w in WORDS.findall(text.lower())])
        return array("I", self.words.encode_ordinary(words)).tobytes()


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each file and Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordBpe(path)
