"""Token ids by a public tokenizer file, a word at a time and remembered."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Words that one worker remembers; then it starts anew.
REMEMBERED = 300_000
#: Letters that are their own composed form and whose small letter is one letter, then ASCII marks, in UTF-8.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> str:
    """The sign that byte-level vocabularies have for each byte: itself if it is visible in Latin-1, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(rest)) for b in range(256))


#: Fixed by the tokenizer's file: the settings under which words can be encoded apart.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}


def splits_words(path: str) -> bool:
    """Whether a tokenizer's file has the settings that let its words be encoded apart and plain ones by the merges alone."""
    import json

    with open(path) as file:
        found = json.load(file)
    alone = all(not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].isalpha()) and a["content"].split() == [a["content"]] for a in found.get("added_tokens") or [])
    return alone and all(found.get(k) == v for k, v in APART.items()) and all(found["model"].get(k, v) == v for k, v in MODEL.items())


class WordIds(dict):
    """Bytes of a word to the bytes of its little-endian unsigned ids.

    For tokenizers that compose and lower-case, drop white space and never join what it parts: the ids of a text
    are then those of its runs of other bytes, one after the other. Only ASCII white space splits here, as every
    such tokenizer counts it as white space; other spaces stay inside a run. A run of plain letters, with marks after it or
    none, goes straight to the tokenizer's merges, as its own splitting would part it there; any other
    goes through the whole tokenizer. A tokenizer of other settings (``splits_words``) gets whole texts.
    """

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.model, self.signs = self.tokenizer.model, str.maketrans(dict(enumerate(byte_signs())))
        self.apart, self.code = splits_words(path), "I" if width == 4 else "H"

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if (m := PLAIN.fullmatch(word)) is None:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        elif m[2] and m[1]:
            known = m[1] in self
            out = self[m[1]] + self[m[2]]
            if known:  # what is met for the first time is seldom met again with the same marks
                self[word] = out
            return out
        else:
            small = word.lower() if word.isascii() else word.decode().lower().encode()
            ids = [t.id for t in self.model.tokenize(small.decode("latin-1").translate(self.signs))]
        out = self[word] = array(self.code, ids).tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null is an empty text."""
        if not self.apart:
            return array(self.code, self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


@lru_cache(1)
def word_ids(path: str, width: int = 4) -> WordIds:
    """One per worker."""
    return WordIds(path, width)
