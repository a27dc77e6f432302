"""Token ids of whole texts with the public tokenizer files of the tokenizers library.

Words repeat much more than texts do, so a text is split as the tokenizer itself splits it before its merges, and
each different word goes through the tokenizer's model once and is remembered by the worker. Texts with characters for which
two regular-expression engines could disagree are encoded whole. Both ways give the tokenizer's own ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Vocabularies up to this size are kept as two-byte ids.
NARROW = 1 << 16
#: Words that a worker remembers in each of two generations: when the younger is full it becomes the older one, and only
#: words that are met again move on. Bounds memory, not results.
REMEMBERED_WORDS = 400_000
#: Texts outside these characters, which all are below the number beside, are encoded whole.
_PLAIN, _PLAIN_END = re.compile(r"[\t\n\r -~¡-įı-ɏ]*"), 0x250
#: How the two kinds of tokenizer files split a text into words. The first alternative of ByteLevel is the
#: commonest case of its third, which is found sooner this way.
_SPLITS = {
    "ByteLevel": r" \p{L}+|'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "Sequence": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def id_dtype(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= NARROW else np.dtype("<u4")


@cache
def tokenizer(name: str):
    """`name`: a file of the public tokenizers, or a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
    loaded.encode_special_tokens = True  # as the files' own description has it: in a document their strings are ordinary text
    return loaded


@cache
def ids_dtype(name: str) -> np.dtype:
    return id_dtype(tokenizer(name).get_vocab_size(with_added_tokens=True))


@cache
def _letters() -> dict[int, str]:
    """What byte-level vocabularies write for each plain character: a letter for each of its bytes, the byte itself if it
    is visible, else the next one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    of = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {i: "".join(of[b] for b in chr(i).encode()) for i in range(_PLAIN_END)}


def _plain_form(pattern: str) -> str:
    """The same pattern for the standard library's engine, with letters and numbers spelled out for plain texts."""
    import regex

    for kind in "LN":
        held = [c for c in map(chr, range(_PLAIN_END)) if regex.match(rf"\p{{{kind}}}", c)]
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"\\p{{{kind}}}")
        pattern = re.sub(r"(\[[^]]*)\\p{%s}" % kind, lambda m, held=held: m[1] + "".join(held), pattern)
        pattern = pattern.replace(f"\\p{{{kind}}}", f"[{''.join(held)}]")
    return pattern


@cache
def _splitter(name: str):
    """The pattern that splits a plain text, and whether the text is lower-cased first; none for unknown kinds."""
    import json

    kind = json.loads(tokenizer(name).to_str())
    splits, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer") or {}
    steps = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
    if splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space") and not steps:
        return re.compile(_plain_form(_SPLITS["ByteLevel"])), False
    if splits.get("type") == "Sequence" and steps == ["NFC", "Replace", "Lowercase"]:
        if splits["pretokenizers"][0].get("pattern", {}).get("Regex") == _SPLITS["Sequence"]:
            return re.compile(_plain_form(_SPLITS["Sequence"])), True
    return None


class _Words(dict):
    """The ids of words; a word that is not there is taken over from the older generation or encoded."""

    def __init__(self, name: str, older: dict):
        super().__init__()
        self.older, self.merge, self.letters = older, tokenizer(name).model.tokenize, _letters()
        self.code = "H" if ids_dtype(name).itemsize == 2 else "I"

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array(self.code, [t.id for t in self.merge(word.translate(self.letters))]).tobytes()
        self[word] = ids
        return ids


_known: dict[str, _Words] = {}


def _words(name: str) -> _Words:
    held = _known.get(name)
    if held is None or len(held) > REMEMBERED_WORDS:
        if held is not None:
            held.older = {}
        held = _known[name] = _Words(name, held or {})
    return held


def encoded(texts: Sequence[str], name: str) -> Iterator[bytes]:
    """The ids of each text, without special tokens, as little-endian integers of ids_dtype(name)."""
    coder, kind, how = tokenizer(name), ids_dtype(name), _splitter(name)
    for text in texts:
        if how and _PLAIN.fullmatch(text):
            words = how[0].findall(text.lower() if how[1] else text)
            yield b"".join(map(_words(name).__getitem__, words))
        else:
            yield np.array(coder.encode(text, add_special_tokens=False).ids, kind).tobytes()
