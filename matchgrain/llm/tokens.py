"""Token ids of the public byte-level BPE vocabulary, fast enough for whole corpora.

A token never crosses from one word into the next other than by the one space it takes along, so a text cut at single
spaces gives the same ids piece by piece. The distinct pieces of a slice of texts are encoded once and gathered with array
operations. Texts that begin or end with a space, or in which two spaces meet or white space stands on both sides of one,
are encoded whole.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from .common import span_hash

END_OF_TEXT = 50256
#: UTF-8 bytes of text encoded at once.
SLICE_BYTES = 2 << 20
#: Distinct words remembered by a worker (about 40 bytes each); when full the table starts anew, which changes no result.
REMEMBERED = 500_000
#: The last byte of a white-space character, a space, and the first byte of one; some other characters share these bytes.
_AMID = re.compile(rb"[\s\x80-\x8a\x9f\xa0\xa8\xa9\xaf] [\s\xc2\xe1\xe2\xe3]")
_EDGES = re.compile(rb"[\s\xc2\xe1\xe2\xe3]|.*[\s\x80-\x8a\x9f\xa0\xa8\xa9\xaf]\Z", re.S)


def vocabulary(path: str | None = None):
    """The encoder of a rank file (the same vocabulary as byte_bpe_50k.json); special strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Slices of UTF-8 texts to token ids."""

    def __init__(self, path: str | None = None):
        coder = vocabulary(path)
        self.whole = coder.encode_ordinary
        #: Whether a token begins with the space before a word; no other token does once words are joined by single spaces.
        self.begins = np.array([coder.decode_single_token_bytes(i).startswith(b" ") for i in range(coder.n_vocab)])
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, kinds: np.ndarray, words) -> np.ndarray:
        """Where the table of known words holds each of ``kinds`` (sorted hashes); ``words`` gives the bytes of some of them."""
        here = np.searchsorted(self.known, kinds)
        new = np.append(self.known, np.uint64(0))[here] != kinds
        if len(self.known) + new.sum() > REMEMBERED:
            self._forget()
            new[:] = True
        if new.any():
            which = np.flatnonzero(new)
            distinct = words(which)
            # White space at a word's edge would run together with its neighbour's: such words go one by one.
            alone = np.fromiter((_EDGES.match(w) is not None for w in distinct), bool, len(distinct))
            plain = [w for w, a in zip(distinct, alone.tolist(), strict=True) if not a]
            ids = np.array(self.whole((b" " + b" ".join(plain)).decode()) if plain else [], np.uint32)
            cut = np.append(np.flatnonzero(self.begins[ids]), len(ids))
            if len(cut) != len(plain) + 1:
                raise AssertionError("a token crossed a word boundary")
            each = [np.array(self.whole((b" " + w).decode()), np.uint32) for w, a in zip(distinct, alone.tolist(), strict=True) if a]
            ids = np.concatenate((ids, *each))
            cut = np.append(cut, cut[-1] + np.cumsum([len(x) for x in each], dtype=np.int64))
            kinds_new = kinds[np.concatenate((which[~alone], which[alone]))]
            hashes = np.concatenate((self.known, kinds_new))
            order = np.argsort(hashes, kind="stable")
            self.known = hashes[order]
            self.at = np.concatenate((self.at, cut[:-1] + len(self.ids)))[order]
            self.size = np.concatenate((self.size, np.diff(cut)))[order]
            self.ids = np.concatenate((self.ids, ids))
            here = np.searchsorted(self.known, kinds)
        return here

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        plain = [bool(t) and b"  " not in t and t[0] != 32 and t[-1] != 32 and not _AMID.search(t) for t in texts]
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, (t, p) in enumerate(zip(texts, plain, strict=True)):
            if t:  # the first word of a plain text, which has no space before it, or else all of the text
                parts[i] = np.array(self.whole((t.split(b" ", 1)[0] if p else t).decode()), np.uint32)
        rest = [t[len(t.split(b" ", 1)[0]) :] if p else b"" for t, p in zip(texts, plain, strict=True)]
        ids, count = self._words(b"".join(rest), np.fromiter((t.count(b" ") for t in rest), np.int64, len(rest)))
        at = np.concatenate(([0], np.cumsum(count)))
        heads = np.fromiter(map(len, parts), np.int64, len(parts))
        pieces = [x for i, head in enumerate(parts) for x in (head, ids[at[i] : at[i + 1]])]
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)), heads + count

    def _words(self, joined: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each follow one space, and how many belong to each text, which has ``words`` of them."""
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        buf = np.frombuffer(joined, dtype=np.uint8)
        gap = buf == 32
        start = np.flatnonzero(gap) + 1
        end = np.append(start[1:] - 1, len(buf))
        kinds, where, kind = np.unique(span_hash(buf, gap, start, end), return_index=True, return_inverse=True)
        where, ends = start[where], end[where]
        here = self._learn(kinds, lambda new: [joined[a:b] for a, b in zip(where[new].tolist(), ends[new].tolist(), strict=True)])
        each = self.size[here][kind]
        to = np.cumsum(each)
        take = np.arange(to[-1]) + np.repeat(self.at[here][kind] - (to - each), each)
        return self.ids[take], np.diff(np.concatenate(([0], to))[np.cumsum(words)], prepend=0)


_ENCODER: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; Spark keeps workers from task to task, and so what it has learnt."""
    if path not in _ENCODER:
        _ENCODER[path] = Encoder(path)
    return _ENCODER[path]
