"""Token ids of whole texts, by a public vocabulary file and the tokenizers library.

Both vocabularies split a text before merging, and no split reaches across the start of a
space-led word. Words therefore get the same ids alone as in their text, and each worker keeps
the ids of the words it has met. Texts for which this
is not certain (special-token strings, control characters that only Python counts as space)
go to the library whole.
"""

from __future__ import annotations

import array
import os
import re
import string
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
_KEPT = 1_000_000
_UNSURE = ("<|", "\x00", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# ASCII signs behind a Latin letter or digit are always merged apart from it.
_SIGNS = string.punctuation
_ENDS = frozenset(string.ascii_letters + string.digits + "".join(map(chr, range(0xC0, 0x100)))) - {"×", "÷"}

_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SAMPLE = ("a", "The", "ÉTÉ", "straße", "ÿ", "Übermut", "thereof")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by word; a word not yet known is encoded when it is asked for, and kept up to a bound."""

    def __init__(self, encode: Callable[[str], bytes], keep: int):
        self.encode, self.keep = encode, keep

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < self.keep:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned integers of ``dtype``; words seen are remembered up to a bound."""

    def __init__(self, path: str, keep: int = _KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known = _Words(self.one, keep)
        one = [e.ids for e in self.library.encode_batch(["b", " b"], add_special_tokens=False)]
        self.drops_space = one[0] == one[1]
        self.letters = _byte_letters()
        self.lowers = self.library.encode("ABC", add_special_tokens=False).ids == self.library.encode("abc", add_special_tokens=False).ids
        words = [*_SAMPLE, *(f" {w}" for w in _SAMPLE)]
        self.direct = [self.merged(w) for w in words] == self.whole(words)
        self.bare = "" if self.drops_space else "\0"  # leads a word of ``cut`` that no white space leads

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def merged(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters, which is split no further, from the library's merges alone; None for other words."""
        core = word[1:] if word[0] == " " else word
        if core.isascii():
            if not core.isalpha():
                return None
            core = core.lower() if self.lowers else core
        elif _LATIN.fullmatch(core):
            core = (core.lower() if self.lowers else core).encode().decode("latin-1").translate(self.letters)
        else:
            return None
        if word[0] == " " and not self.drops_space:
            core = self.letters[32] + core
        return array.array(self.code, [t.id for t in self.library.model.tokenize(core)]).tobytes()

    def cut(self, text: str) -> list[str] | None:
        """Words of a text, each led by its white space if ids depend on that; None if the text is to go whole."""
        if any(sign in text for sign in _UNSURE):
            return None
        if self.lowers:
            text = lowered(text)
        if self.drops_space:
            return text.split()
        words = text.replace("\n", " \n").split(" ")
        single = "\n\n" not in text and "\n " not in text and text[-1] != "\n" and "" not in words
        if not single or len(text.split()) != len(words):  # other white space than one sign between words
            return [w if w[0] == " " else self.bare + w for w in _PIECES.findall(text)]
        words[0] = self.bare + words[0]
        return words

    def spelled(self, word: str) -> str:
        """What stands in the text for a word of ``cut``."""
        if self.drops_space or word[0] in " \n":
            return word
        return word[1:] if word[0] == "\0" else " " + word

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, words)) if (words := self.cut(t) if t else []) is not None else self.whole([t])[0] for t in texts]

    def one(self, word: str) -> bytes:
        """Ids of a word of ``cut``."""
        core = word.rstrip(_SIGNS)
        if len(core) < len(word) and core and core[-1] in _ENDS:
            return self.known[core] + self.known[self.bare + word[len(core) :]]
        spelled = self.spelled(word)
        ids = self.merged(spelled) if self.direct else None
        return self.whole([spelled])[0] if ids is None else ids


def lowered(text: str) -> str:
    """A text of Latin letters in lower case, one letter for each; others as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=4)
def encoder(path: str, keep: int = _KEPT) -> Encoder:
    """One per worker process; its memory of words outlives a task."""
    return Encoder(path, keep)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``most`` bytes; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i in range(batch.num_rows):
        if i > start and held + sizes[i] > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += sizes[i]
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_batches(path: str, schema: pa.Schema, keep: int = _KEPT):
    """A mapInArrow function, whose workers remember the ids of ``keep`` words: ``text`` becomes ``n_tokens`` and ``ids`` (end id included); other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keep)
        end = np.array([END_ID], encode.dtype).tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [x + end for x in encode(batch.column("text").to_pylist())]
                out = {n: batch.column(n) for n in batch.schema.names if n != "text"}
                out["n_tokens"] = pa.array([len(x) // encode.dtype.itemsize for x in ids], pa.int64())
                out["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run
