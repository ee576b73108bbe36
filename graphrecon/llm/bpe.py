"""Whole texts through a public tokenizer file, with each distinct piece encoded once.

A byte pair encoder first cuts a text into pretokens and then works inside each of them. A text may
therefore be cut beforehand wherever no pretoken can reach across; the pieces' ids, put together,
are the ids of the whole text. Texts where such a cut isn't proven go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import numpy as np

#: Pieces, and parts of pieces, that a worker remembers. About 130 MB together.
PIECES, PARTS = 400_000, 100_000

# A letter or number before ASCII punctuation other than an apostrophe, and both sides of a single
# line break: every pretokenizer used here ends a pretoken there.
_CUT = re.compile(r"(?<=[^\W_])(?=[!-&(-/:-@\[-`{-~])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
# Runs of white space that a cut at single spaces would split otherwise than the library does.
_UNSAFE = re.compile(r"\s \s|\s \Z")


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_PUNCTUATION = ".,!?;:*$%&#|)"
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _cut(piece: str) -> list[str]:
    """Parts of a piece that no pretoken reaches across."""
    if piece.isalpha() or "<|" in piece:
        return [piece]
    base = piece.rstrip(_PUNCTUATION)
    if base.isalpha() or base[1:].isalpha() and base[0] == " ":
        return [base, piece[len(base) :]] if len(base) < len(piece) else [piece]
    return _CUT.split(piece)


class _Known(dict):
    """What is known of pieces; ``find`` is asked for the others, one by one, when they are read."""

    def __init__(self, find: Callable):
        self.find = find

    def __missing__(self, piece: str):
        return self.find(piece)


class Pieces:
    """Remembers for each piece its number of ids, or the ids themselves (``as_ids``) as bytes.

    ``cased``: whether the encoder keeps capitals. A piece read from ``known`` is encoded if need be; ``learn`` encodes
    many at once.
    """

    def __init__(self, tokenizer, as_ids: bool, cased: bool):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.as_ids, self.cased = tokenizer, as_ids, cased
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: written(chr(c))[0][0] for c in (32, *range(0xC0, 0x100))}
        self.merge = tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.packed = [np.array([i], self.kind).tobytes() for i in range(tokenizer.get_vocab_size())] if as_ids else []
        self.known: dict = _Known(self._find)
        self.older: dict = {}
        self.parts: dict = {}

    def learn(self, pieces: set[str]) -> None:
        """Make sure that every one of ``pieces`` is known.

        When half of ``PIECES`` are known, they become the older half, and what was the older half before is
        forgotten but for the pieces that are met again.
        """
        new = pieces.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > PIECES // 2:
            self._age()
            new = pieces
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new -= again
        words = [p for p in new if p.isalpha() and p.isascii() and (self.cased or p.islower())]
        self.known.update(self._encode_words(words))
        self._learn_parts(new.difference(words))

    def _age(self) -> None:
        self.older, self.known = self.known, _Known(self._find)

    def _find(self, piece: str) -> int | bytes:
        """What ``learn`` finds for one piece."""
        found = self.known.get(piece)  # a reader may still hold the older half
        if found is None:
            found = self.older.get(piece)
            if found is None:
                base = piece.rstrip(_PUNCTUATION)
                if base.isalpha() and base.isascii() and (self.cased or base.islower()):
                    found = self._encode_word(base) if len(base) == len(piece) or base not in self.known else self.known[base]
                    if len(base) < len(piece):
                        found += self._part(piece[len(base) :])
                else:
                    parts = list(map(self._part, _cut(piece)))
                    found = parts[0] if len(parts) == 1 else b"".join(parts) if self.as_ids else sum(parts)
            if len(self.known) >= PIECES // 2:
                self._age()
            self.known[piece] = found
        return found

    def _part(self, part: str) -> int | bytes:
        found = self.known.get(part)
        if found is None:
            found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= PARTS:
                self.parts = {}
            if _WORD.fullmatch(part) and (self.cased or part.islower()):
                found = self.parts[part] = self._encode_word(part)
            else:
                self._encode_each([part])
                found = self.parts[part]
        return found

    def _learn_parts(self, pieces: set[str]) -> None:
        cut = {p: _cut(p) for p in pieces}
        needed = {x for parts in cut.values() for x in parts}
        if len(self.parts) + len(needed) > PARTS:
            self.parts = {}
        wanted = needed.difference(self.parts)
        known = wanted.intersection(self.known)
        self.parts.update(zip(known, map(self.known.__getitem__, known)))
        wanted -= known
        words = {x for x in wanted if _WORD.fullmatch(x) and (self.cased or x.islower())}
        self.parts.update(self._encode_words(words))
        self._encode_each(list(wanted - words))
        part, join = self.parts.__getitem__, b"".join if self.as_ids else sum
        self.known.update((p, part(c[0]) if len(c) == 1 else join(map(part, c))) for p, c in cut.items())

    def _encode_each(self, parts: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        value = (lambda e: np.array(e.ids, self.kind).tobytes()) if self.as_ids else len
        self.parts.update(zip(parts, map(value, encoded)))

    def _encode_words(self, words: Collection[str]) -> Iterator[tuple[str, int | bytes]]:
        return zip(words, map(self._encode_word, words))

    def _encode_word(self, word: str) -> int | bytes:
        """A word of letters alone, which is one pretoken: straight to the library's merges."""
        form = word if word.isascii() and word.isalpha() else word.translate(self.letters)
        tokens = self.merge(form)
        if not self.as_ids:
            return len(tokens)
        packed = self.packed
        return packed[tokens[0].id] if len(tokens) == 1 else b"".join([packed[t.id] for t in tokens])


def space_pieces(text: str) -> list[str] | None:
    """Pieces of a text for a byte-level encoder whose pretokens take one space before a word.

    None where the text has runs of white space or special strings that need the whole text.
    """
    if _UNSAFE.search(text) or "<|" in text:
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


def word_pieces(text: str) -> list[str] | None:
    """Pieces of a text for a lower-casing encoder that drops white space; None as above."""
    if "<|" in text:
        return None
    try:
        text.encode("latin-1")  # here lower case and normal form go character by character
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").split(" ")


_KEPT: dict = {}


def worker_cache(name: str, make: Callable):
    """What ``make`` gives, kept by this Python worker for later tasks."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]
