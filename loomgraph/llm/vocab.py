"""Public tokenizers inside tasks: files by name, and ids of chunks that tokenizers treat alike alone and in a text."""

from __future__ import annotations

import functools
import os

#: Chunks that a task remembers, and the longest of them in characters.
CACHED, CACHED_CHARS = 300_000, 64


def file_of(name: str) -> str:
    """The place of a vocabulary file: a path as it is, a bare name in the package of public tokenizers on the task's machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def tokenizer(name: str, plain: bool):
    """A tokenizer of one thread; ``plain`` takes the strings of special tokens in texts for ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(file_of(name))
    got.encode_special_tokens = plain
    return got


@functools.lru_cache(2)
def pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file_of(name))


class Chunks(dict):
    """What ``make`` gives for each of a list of chunks. Short chunks are remembered until there are too many."""

    def __init__(self, make, most: int = CACHED):
        super().__init__()
        self.make, self.most = make, most

    def of(self, chunks: list[str]) -> list:
        """One value a chunk, in order; those not yet known are made together."""
        got = list(map(self.get, chunks))
        if None not in got:
            return got
        new = list(dict.fromkeys([c for c, v in zip(chunks, got) if v is None]))
        made = dict(zip(new, self.make(new)))
        got = [made[c] if v is None else v for c, v in zip(chunks, got)]
        if len(self) + len(made) > self.most:
            self.clear()
        self.update((c, v) for c, v in made.items() if len(c) <= CACHED_CHARS)
        return got
