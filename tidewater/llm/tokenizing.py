"""Exact token ids of whole texts by the tokenizers library, with a cache of the chunks that the library would never merge across."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

#: White space about which the library's patterns and Python's may differ; texts with it, or with special tokens, take the plain path.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]|<\\|")
#: Its beginnings in UTF-8; a batch with none of them needs no closer look.
_LEADS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf", b"<|")
#: Bytes of a worker's cache of chunks, entries counted at about their real size. It has a new and an old half: what is used again moves
#: to the new one, which becomes the old one when it is full.
CACHE = 112 << 20
_ENTRY = 190
#: The splits that the chunks below are made for. A model with another one, or with other normalisation, takes the plain path.
_KNOWN = {
    "spaced": ("ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)", "None"),
    "words": (r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""", r"""Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])"""),
}
_workers: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian arrays (two bytes each where the vocabulary fits, else four).

    ``kind`` "spaced": a token may begin with one space (byte-level models that keep white space); "words": white space separates
    and is dropped. Chunks are encoded by the library and kept; a text is the concatenation of its chunks.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # Latin letters before an ASCII mark, white space or the end are a chunk of their own; the rest up to white space is another
        letters = r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[\x00-@\[-`{-\x7f]|$)"
        spaced = kind == "spaced"
        self.split = re.compile(rf" ?{letters}| ?\S+|\s+(?!\S)|\s+" if spaced else rf"{letters}|\S+").findall
        # letters are encoded many at a time, between separators of which the id is known
        self.letters = re.compile(rf" ?{letters}").fullmatch
        self.between = "\n" if spaced else " 0 "
        self.mark = self.model.encode(self.between, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.plain = (str(self.model.pre_tokenizer), str(self.model.normalizer)) == _KNOWN[kind]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        easy = [c for c in chunks if self.letters(c)] if len(self.mark) == 1 else []
        for i in range(0, len(easy), 20_000):
            some = easy[i : i + 20_000]
            ids = np.array(self.model.encode_batch_fast([self.between.join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(some) - 1:  # the separator is not what it should be in this model
                self.known.update(zip(some, self._library(some)))
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            self.known.update((c, raw[a * width : b * width]) for c, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]))
        hard = list(chunks.difference(easy))
        self.known.update(zip(hard, self._library(hard)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return self._library(texts)
        whole = "\n".join(texts).encode()
        odd = any(x in whole for x in _LEADS)
        del whole
        plain = [i for i, t in enumerate(texts) if not _ODD.search(t)] if odd else range(len(texts))
        chunks = [self.split(texts[i]) for i in plain]
        here = set(chain.from_iterable(chunks))
        missing = here.difference(self.known)
        if (len(self.known) + len(missing)) * _ENTRY > CACHE // 2:
            self.known, self.old = {c: self.known[c] for c in here.intersection(self.known)}, self.known
        if again := missing.intersection(self.old):
            self.known.update((c, self.old[c]) for c in again)
            missing -= again
        if missing:
            self._learn(missing)
        del here, missing, again
        get = self.known.__getitem__
        out: list[bytes | None] = [None] * len(texts)
        for i, c in zip(plain, chunks):
            out[i] = b"".join(map(get, c))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._library([texts[i] for i in rest])):
            out[i] = x
        return out


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _workers:
        _workers[path] = Encoder(path, kind)
    return _workers[path]
