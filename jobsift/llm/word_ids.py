"""Token ids of whole texts by a public tokenizer file, word by word.

A tokenizer whose pre-tokenizer never crosses white space gives each word the
same ids in every text, so a worker process encodes a word once and keeps its
ids (at most ``MAX_WORDS`` of them; the memory is emptied when full).
"""

from __future__ import annotations

import sys
import types
from struct import pack
from unicodedata import is_normalized

import numpy as np

from jobsift.llm.common import by_value

MAX_WORDS = 400_000
#: Longer words are encoded anew each time.
MAX_WORD_BYTES = 64
MARKS = ".,;:!?|#$%&*"


def worker_memory(owner: str) -> dict:
    """A dictionary that lives as long as the worker process, between tasks; what another operator left in it is dropped."""
    memory = sys.modules.setdefault("_jobsift_worker_memory", types.ModuleType("_jobsift_worker_memory")).__dict__
    if memory.get("owner") != owner:
        memory.clear()
        memory["owner"] = owner
    return memory


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in prints else chr(256 + b - sum(p < b for p in prints)) for b in range(256)]


class Stems(dict):
    """A word of letters only, in lower case and composed -> its ids as bytes, by the vocabulary's model alone."""

    def __init__(self, tokenizer):
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()

    def __missing__(self, stem: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        mapped = stem if stem.isascii() else "".join([self.letters[b] for b in stem.encode()])
        ids = self[stem] = pack(f"<{len(found)}I", *found) if (found := [t.id for t in self.tokenize(mapped)]) else b""
        return ids


class WordIds(dict):
    """UTF-8 word -> its ids as little-endian unsigned 32-bit bytes.

    Where the tokenizer lower-cases and cuts between letters and marks
    (``cuts_marks``, found out by trial), a word's letters and the marks after
    them are encoded apart, the letters by the model alone; else whole words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stems = Stems(self.tokenizer)
        trials = [w + m for w in ("Word", "ÄRA", "Ñandú", "été", "日本", "слово") for m in ("", ".", ",;", "!!", "|")]
        self.cuts_marks = False
        self.cuts_marks = all(self.plain(w) == self.apart(w, w.rstrip(MARKS)) for w in trials)

    def plain(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def apart(self, word: str, stem: str) -> bytes:
        ids = self.stems[stem.lower()]
        return ids if len(stem) == len(word) else ids + self[word[len(stem):].encode()]

    def made(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if (not stem or len(stem) > MAX_WORD_BYTES or not stem.lower().isalpha() or "Σ" in stem or not self.cuts_marks
                or not is_normalized("NFC", stem)):
            return self.plain(word)
        return self.apart(word, stem)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        ids = self.made(word.decode())
        if len(word) <= MAX_WORD_BYTES:
            self[word] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        """Ids of a whole text; bytes.split() cuts at ASCII white space, which the tokenizer drops."""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


def word_ids(path: str) -> WordIds:
    memory = worker_memory("ids")
    if ("ids", path) not in memory:
        memory["ids", path] = WordIds(path)
    return memory["ids", path]


by_value(__name__)
