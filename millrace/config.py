"""Parameters of chunking and of token counting."""

from __future__ import annotations

import inspect
import os
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, Protocol


class Tokenizer(Protocol):
    def encode(self, text: str, **options: Any) -> list[int]: ...


@dataclass(frozen=True)
class WordTokens:
    """Counts words: ``per_word`` tokens for each, and ``special`` for each text. Needs no Python on the executors."""

    per_word: int = 1
    special: int = 0


@lru_cache(maxsize=4)
def _tokenizer_of(path: str):
    """One tokenizer for each process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


@dataclass(frozen=True)
class TokenizerFile:
    """Counts with the tokenizer of a ``tokenizer.json`` file, which every executor reaches at ``path``."""

    path: str

    def encode(self, text: str, add_special_tokens: bool = True, truncation: bool = False) -> list[int]:
        library = _tokenizer_of(self.path)
        if not truncation and library.truncation:
            library.no_truncation()
        return library.encode(text, add_special_tokens=add_special_tokens).ids

    def count(self, text: str) -> int:
        """Ids of a text, special ones among them, without truncation; each different word is encoded once where the ids
        of a text are those of its words, one after the other."""
        from millrace.functions.tokens import text_encoder

        encoder = text_encoder(self.path)
        if encoder.by_word and encoder.tokenizer.truncation is None and encoder.tokenizer.padding is None:
            return len(encoder.encode(text)) // 4
        return len(self.encode(text))


@dataclass(frozen=True)
class ChunkingConfig:
    """Limits of chunks. ``tokens`` is WordTokens, TokenizerFile, or an object with ``encode``, which is sent along."""

    chunk_size: int = 400
    chunk_overlap: int = 64
    min_words: int = 20
    max_tokens: int = 512
    tokens: WordTokens | Tokenizer = field(default_factory=WordTokens)

    def __post_init__(self) -> None:
        allowed = {
            "chunk_size": (1, None), "max_tokens": (1, None), "min_words": (0, None),
            "chunk_overlap": (0, self.chunk_size - 1),
        }
        for name, (least, most) in allowed.items():
            value = getattr(self, name)
            if value < least or most is not None and value > most:
                raise ValueError(f"{name} is {value}, but must be {least} or more" + ("" if most is None else f", {most} at most"))


#: What an encoder is told where it has an option of that name.
COUNTED_WITH = {"add_special_tokens": True, "truncation": False, "verbose": False}


def encode_options(tokenizer: Tokenizer) -> dict[str, bool]:
    """The options of COUNTED_WITH that the tokenizer's ``encode`` takes."""
    try:
        named = inspect.signature(tokenizer.encode).parameters
    except (TypeError, ValueError):  # built-in functions may have no signature
        return {}
    takes_all = any(p.kind is p.VAR_KEYWORD for p in named.values())
    return {k: v for k, v in COUNTED_WITH.items() if takes_all or k in named}


def count_tokens(tokenizer: Tokenizer, text: str) -> int:
    """Ids of a text, special ones among them, without truncation."""
    if isinstance(tokenizer, TokenizerFile):
        return tokenizer.count(text)
    found = tokenizer.encode(text, **encode_options(tokenizer))
    return len(getattr(found, "ids", found))
