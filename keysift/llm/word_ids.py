"""Token ids of texts under a byte-level BPE that drops white space.

Such a tokenizer treats the words between white space one by one, so the ids of a text
are those of its words in order.  A text of plain Latin letters, digits and punctuation is
cut here, and its pieces are given to the library's merge model; other texts are cut into
words, and any word that is not plain goes through the whole library, which also
checks at the start that both ways agree.  Pieces and words come back often, pieces more
so, as words differ in case and punctuation too: the ids of both are kept in dictionaries of
bounded size, a text is one join of byte strings, and only what was not met lately
calls the library.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

from keysift.llm.bpe import byte_alphabet

# The most pieces, and words, that are held.
KEPT = 360_000
KEPT_BYTES = 48

# Words that need no normalisation but lower case: printable ASCII and letters of the Latin-1 supplement.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
# Fixed value: how the tokenizer cuts words, for the characters above in lower case.
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_CHARACTER = {byte: char for char, byte in byte_alphabet().items()}
_PROBES = ("Ab", "don't", "ÉÀßÿ", "x9.", "a--b's", "'re", "...", "Größe,", "42nd", "(é)", "I'LL", "q\"r")


class _Known(dict):
    """Ids by word or piece; asks for what it lacks, and gives up the older half when it is full."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word: str | bytes) -> bytes:
        ids = self._make(word)
        if len(word) <= KEPT_BYTES:
            self[word] = ids
        return ids

    def bound(self) -> None:
        if len(self) > KEPT:
            newer = dict(islice(self.items(), len(self) - KEPT // 2, None))
            self.clear()
            self.update(newer)


class WordEncoder:
    """Ids as little-endian integers of ``width`` bytes; equal to encoding whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self._words, self._pieces = _Known(self._word), _Known(self._piece)
        separate = [self._whole(f"Ab{w}cd{w}{w}9 é{w}") for w in " \t\n\v\f\r"]
        if any(s != self._whole("Ab") + self._whole("cd") + self._whole("9") + self._whole("é") for s in separate):
            raise ValueError("the tokenizer does not drop white space, so words cannot be encoded one by one")
        self._cuts_plain = all(self._plain(w) == self._whole(w) for w in _PROBES)

    def _whole(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(_CHARACTER.__getitem__, piece.encode()))
        return array(self._code, [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, _PIECES.findall(text.lower())))

    def _is_plain(self, text: str, kind: re.Pattern) -> bool:
        return self._cuts_plain and kind.fullmatch(text) is not None and not any(s in text for s in self._special)

    def _word(self, data: bytes) -> bytes:
        word = data.decode("utf-8", "replace")
        return self._plain(word) if self._is_plain(word, _PLAIN) else self._whole(word)

    def _text(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if self._is_plain(text, _PLAIN_TEXT):
            return self._plain(text)
        return b"".join(map(self._words.__getitem__, data.split()))  # at ASCII white space

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        self._words.bound()
        self._pieces.bound()
        return [self._text(text) for text in texts]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    return WordEncoder(path)
