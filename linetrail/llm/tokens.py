"""Token ids of whole texts with a public tokenizer file, word by word.

The word tokenizer never joins characters across white space, so the ids of
a text are the ids of its white-space separated words in a row.  Each Python
worker keeps the ids of the words that it met lately; every id comes from
the tokenizers library.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Texts of these characters alone stay as they are under the tokenizer's
# normalisation but for lower-casing and white space, and are cut here by its
# own pattern (a fixed value, with its letter and number classes written out).
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÿ]|<\\|").search
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+").findall
_WORDS = re.compile(r"[^ \t\n\r]+").findall


class WordEncoder:
    """``encode(text)`` -> ids as little-endian unsigned integers in bytes.

    ``keep`` bounds the words held; of a full table only those stay that were met again while its second half filled.
    """

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str, keep: int = 2_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.cut = Tokenizer(self.tok.model)  # the same vocabulary, held once
        self.cut.normalizer = normalizers.Sequence([])
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        n = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.ends = np.zeros(n, dtype=bool)
        for word, i in self.tok.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.keep, self.pieces, self.words, self.again = keep, {}, {}, set()

    @classmethod
    def load(cls, path: str, keep: int = 2_000_000) -> WordEncoder:
        """The worker's encoder of this file, which from now on holds ``keep`` words at most."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path, keep)
        cls._loaded[path].keep = keep
        return cls._loaded[path]

    def _ids(self, tok, text: str) -> np.ndarray:
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that the tokenizer cuts no further: each ends with an end-of-word id."""
        for at in range(0, len(pieces), 2000):
            some = pieces[at:at + 2000]
            ids = self._ids(self.cut, " ".join(some))
            data, size = ids.tobytes(), self.dtype.itemsize
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(stops) != len(some):
                raise ValueError("this tokenizer does not end its pieces with </w>")
            self.pieces.update(zip(some, map(data.__getitem__, map(slice, [0, *stops], stops))))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        plain = [None if t is None or _OTHER(t) else _CUT(t.lower()) for t in texts]
        met = set().union(*(x for x in plain if x))
        new = met.difference(self.pieces)
        if 2 * len(self.pieces) > self.keep:
            self.again |= met - new
        if new:
            self._learn(list(new))
        ids = self.pieces.__getitem__
        out = [b"" if t is None else self._other(t) if x is None else b"".join(map(ids, x))
               for t, x in zip(texts, plain)]
        if len(self.pieces) > self.keep:
            stay = self.again if 2 * len(self.again) < self.keep else ()
            self.pieces, self.again = {w: self.pieces[w] for w in stay}, set()
        return out

    def _other(self, text: str) -> bytes:
        """Any text: its words, kept in turn, each through the whole tokenizer."""
        out, known = [], self.words
        for w in _WORDS(text):
            ids = known.get(w)
            if ids is None:
                ids = self._ids(self.tok, w).tobytes()
                if len(w) <= 40:
                    known[w] = ids
            out.append(ids)
        if len(known) > self.keep // 4:
            known.clear()
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def stream(self, texts, chars: int = 300_000):
        """Ids of each of ``texts`` in turn, some texts at a time."""
        some, n = [], 0
        for t in texts:
            some.append(t)
            n += len(t or "") + 1
            if n >= chars:
                yield from self.encode_many(some)
                some, n = [], 0
        yield from self.encode_many(some)


def token_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
