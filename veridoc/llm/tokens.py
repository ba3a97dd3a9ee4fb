"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pieces of text.

A byte-level tokenizer with the usual split pattern never joins a non-space character and the space after it in one
token, so a text may be cut before such spaces and its pieces encoded once each. Other tokenizers get whole texts.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

# Pieces kept by one Python worker (about 50 MB), and a batch more; the cache starts anew when it is full.
CACHE_PIECES = 250_000
_JOINED = 512
_BATCH_CHARS = 1 << 20
_CUT = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """Encodes texts to little-endian ids of 2 or 4 bytes (`dtype`)."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self._by_piece = self._tokenizer.normalizer is None and re.fullmatch(
            r"ByteLevel\(add_prefix_space=False, .*use_regex=True\)", str(self._tokenizer.pre_tokenizer)) is not None
        # Bytes of text that a token stands for: one letter per byte, but added tokens are plain text.
        self._bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        added = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        for token, i in vocab.items():
            self._bytes[i] = len(token.encode()) if token in added else len(token)
        self._pieces: dict[str, bytes] = {}
        self._limit = cache_pieces
        self._stops = dict(zip(",.", self._whole([",", "."])))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of ' ' + key for keys that end in a non-space character; many are encoded as one text and cut again."""
        texts, groups, out = [], [], {}
        for at in range(0, len(keys), _JOINED):
            groups.append(keys[at:at + _JOINED])
            texts.append(" " + " ".join(groups[-1]))
        for group, e in zip(groups, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = np.cumsum(self._bytes[ids])
            stops = np.cumsum([len(k.encode()) + 1 for k in group])
            cuts = np.searchsorted(ends, stops)
            if len(ends) == 0 or cuts[-1] >= len(ends) or not np.array_equal(ends[cuts], stops):
                out.update(zip(group, self._whole([" " + k for k in group])))
                continue
            raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for key, cut in zip(group, cuts.tolist()):
                out[key] = raw[start * size:(cut + 1) * size]
                start = cut + 1
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        known, missing, work = self._pieces, set(), []
        if len(known) > self._limit:
            known.clear()
        for text in texts:
            parts = text.split(" ")
            found = list(map(known.get, parts))
            found[0] = b""
            holes = [i for i, ids in enumerate(found) if ids is None]
            new = {parts[i] for i in holes}
            # A piece that is empty or ends in white space shows a run of white space, which must stay together.
            if parts[0][-1:].isspace() or any(not k or k[-1].isspace() for k in new):
                first, *rest = _CUT.split(text)
                parts = [first, *(x[1:] for x in rest)]
                found = [b"", *map(known.get, parts[1:])]
                holes = [i for i, ids in enumerate(found) if ids is None]
                new = {parts[i] for i in holes}
            missing |= new
            work.append((parts, found, holes))
        heads = self._whole([parts[0] for parts, _, _ in work])
        # White space at the end of a text belongs to its last piece, which is no key of the cache.
        ending = [k for k in missing if not k or k[-1].isspace()]
        learned = dict(zip(ending, self._whole([" " + k for k in ending])))
        missing.difference_update(ending)
        # A comma or full stop after a letter is a token of its own.
        closed = [k for k in missing if k[-1] in self._stops and k[-2:-1].isalpha()]
        fresh = self._learn(list({k[:-1] for k in closed}.difference(known).union(missing.difference(closed))))
        for k in closed:
            fresh[k] = (fresh.get(k[:-1]) or known[k[:-1]]) + self._stops[k[-1]]
        known.update(fresh)
        out = []
        for head, (parts, found, holes) in zip(heads, work):
            found[0] = head
            for i in holes:
                found[i] = fresh.get(parts[i]) or learned[parts[i]]
            out.append(b"".join(found))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null counts as empty, and an empty text has none."""
        texts = [t or "" for t in texts]
        if not self._by_piece:
            return self._whole(texts)
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= _BATCH_CHARS:
                out += self._encode_some(some)
                some, size = [], 0
        return out + self._encode_some(some) if some else out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python process; workers are used again, and so is what they have learned."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
