"""Word-cached encoding with a public tokenizer file.

`word_bpe_49k.json` drops white space and never merges across it, so a text's ids are its words' ids in a row. Each Python
worker keeps a bounded cache of words; a miss goes through the tokenizers library.
"""

from __future__ import annotations

import unicodedata
from array import array

CACHE_WORDS = 150_000
_ENCODERS: dict = {}


def _closes_word(mark: str) -> bool:
    """Whether the tokenizer still sees a letter or digit at the end of what it makes of this one."""
    return unicodedata.category(unicodedata.normalize("NFC", mark).lower()[-1])[0] in "LN"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 marks stand for themselves, the other bytes for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class _Cache(dict):
    """Ids by word; a word that is not known is learnt."""

    def __init__(self, learn):
        super().__init__()
        self.__learn = learn

    def __missing__(self, word: bytes) -> bytes:
        return self.__learn(word)


class WordEncoder:
    """Encode texts to little-endian unsigned 32-bit ids; `literal` reads special tokens' strings as ordinary text."""

    def __init__(self, path: str, literal: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        self.young = _Cache(self._learn)
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        lower = text.lower()
        if lower.isalpha() and max(lower) < "\u0250":
            # Latin letters alone: nothing to normalise but case, nothing to split; the model itself is enough.
            units = lower.encode().decode("latin-1").translate(_BYTE_LETTERS)
            return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _known(self, word: bytes) -> bytes | None:
        found = self.young.get(word)
        return self.old.get(word) if found is None else found

    def _learn(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            # A closing run of these marks is a token of its own after a letter or digit, and case never matters.
            core = text.rstrip(".,!?")
            if "<|" in text or not core or not _closes_word(core[-1]):
                ids = self._ids(text)
            else:
                bare, tail = core.encode().lower(), text[len(core) :].encode()
                ids = b""
                for part in (bare, tail) if tail else (bare,):
                    if part == word or (got := self._known(part)) is None:
                        got = self._ids(part.decode())
                        self.young[part] = got
                    ids += got
        self.young[word] = ids
        if len(self.young) > CACHE_WORDS:
            self.old = dict(self.young)
            self.young.clear()
        return ids

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        return b"".join(map(self.young.__getitem__, words))


def encoder(path: str, literal: bool = False) -> WordEncoder:
    """One encoder for each Python worker, so that its cache outlives a task."""
    key = (path, literal)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, literal)
    return _ENCODERS[key]
