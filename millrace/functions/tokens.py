"""Token ids of whole texts with the tokenizers library, remembering the ids of words already seen."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from functools import lru_cache

import numpy as np

#: Words whose ids a worker remembers before the older half of them goes; about 170 bytes each.
MAX_WORDS = 1_000_000
#: Longer runs, of which texts without spaces consist, are not remembered: they seldom come again, and have no bound.
LONGEST_WORD = 64
#: Signs after letters that are a piece of their own; not those of special tokens and contractions.
END_SIGNS = ".,;:!?#$%&*)"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: White space of the C0 controls, at which ``str.split`` parts a text but the tokenizer does not.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: itself where it is printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Ids of a run without white space, as little-endian unsigned 32-bit integers.

    Words are remembered in two halves: when the newer is full it becomes the older, from which words that are met again
    move to the newer. So what is frequent stays, and no task need begin with an empty memory.
    """

    def __init__(self, tokenizer, letters_are_pieces: bool):
        super().__init__()
        self.tokenizer, self.letters_are_pieces = tokenizer, letters_are_pieces
        self.letters, self.pieces = byte_letters(), tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(word) <= LONGEST_WORD:
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        # a letter that the normaliser parts into letter and mark leaves a mark before the sign, which then joins it
        if self.letters_are_pieces and (word.isascii() or _lowered(word) is not None):
            if word.isalpha():
                if word == word.lower():
                    bytes_ = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                    return _packed([t.id for t in self.pieces(bytes_)])
            elif word and word[-1] in END_SIGNS:
                letters = word.rstrip(END_SIGNS)
                if letters.isalpha():
                    return self[letters] + self[word[len(letters) :]]
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def age(self) -> None:
        """Called between texts; makes room if the newer half is full."""
        if 2 * len(self) > MAX_WORDS:
            older = dict(self)
            self.clear()
            self.older = older

    def clear(self) -> None:
        super().clear()
        self.older = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _lowered(text: str) -> str | None:
    """The text in small letters, if normal form C keeps it before and after (small letters have composed forms that
    capital ones lack), and lower-casing does the same to it letter by letter and as a whole; else nothing."""
    if text.isascii():
        return text.lower()
    if "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
        return None
    low = text.lower()
    return low if low == text or unicodedata.is_normalized("NFC", low) else None


class TextEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Where the tokenizer drops white space before its model runs, the ids of a text are those of its runs between
    spaces, one after the other, so each different run is encoded once. Other tokenizers get the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            first.get("behavior") == "Removed" and first.get("invert") is True
            and kinds == ["NFC", "Replace", "Lowercase"] and "[^\\s\\p{L}\\p{N}]+" in pattern
            and spec.get("post_processor") is None
        )
        byte_level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1].get("type") == "ByteLevel"
        self.words = _Words(self.tokenizer, self.by_word and "[\\p{L}]+" in pattern and byte_level)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.words.age()
        if "<|" not in text:  # fewer different words; not where it could differ from lower-casing each character
            low = _lowered(text)
            text = text if low is None else low
        if any(c in text for c in CONTROLS):
            runs = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        else:
            runs = text.split()
        return b"".join(map(self.words.__getitem__, runs))


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and tokenizer file."""
    return TextEncoder(path)
