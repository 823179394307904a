"""Ids of whole texts through the tokenizers library, with words remembered.

A text is cut where a single space or line break stands between two
characters that are no white space.  No token of the vocabularies used here
crosses such a place, so the ids of the parts, one after the other, are the
ids of the text.  A part is encoded by the library and found in a dictionary
as long as it is met again and again.  Texts with any other white space are
encoded as they are, and so are texts that hold one of the vocabulary's added
tokens (in any case), which the library finds before words.  A part made of
Latin letters is one word to these vocabularies and goes to the library's
model directly.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Callable

from jointwork.llm.remember import held

REMEMBERED = 600_000
CLOSING = ".,!?;:*#$%&|"
MARKS = ("^", "\n")  # of the first word of a text and of a line
BEFORE_CLOSING = frozenset(string.ascii_letters + string.digits)
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return [c for _, c in sorted([(b, chr(b)) for b in shown] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


LETTERS = _byte_letters()
SPACE = LETTERS[32]
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(33)]


def _packed(ids: list[int]) -> bytes:
    n = len(ids)
    return PACKERS[n](*ids) if n < 33 else struct.pack(f"<{n}I", *ids)


class Words(dict):
    """Parts and their ids (none if only the whole text has them).

    A part that is looked up and not there comes from the ``older`` ones or is
    learned.  Closing signs after a letter or digit are a piece of their own
    to the vocabularies: such a part is put together and not kept itself.
    """

    def __init__(self, older: dict[str, bytes | None], learn: Callable[[str], bytes | None], one: Callable[[str], bytes]):
        self.older, self.learn, self.one = older, learn, one
        self.endings: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes | None:
        stem = part.rstrip(CLOSING)
        if len(stem) < len(part) and stem[-1:] in BEFORE_CLOSING:
            ids, signs = self[stem], part[len(stem) :]
            if ids is None:
                return None
            if signs not in self.endings:
                self.endings[signs] = self.one(signs)
            return ids + self.endings[signs]
        ids = self[part] = self.older[part] if part in self.older else self.learn(part)
        return ids


class WordEncoder:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids, a bytes object per text.

    ``keeps_space``: the vocabulary marks a word's leading space (byte-level
    files); otherwise white space has no ids at all.

    At most about ``remembered`` words are kept, in two halves: when the newer
    one is full it becomes the older one, and what is met again moves to the
    newer, so that frequent words are not learned anew.
    """

    def __init__(self, path: str, keeps_space: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        # Signs before the first letter have no case: a text without them needs no copy in lower case.
        self.heads = {re.match(r"[!-/:-@\[-`{-~]*", t)[0] for t in self.added}
        self.keeps_space, self.remembered = keeps_space, remembered
        self.model = self.tokenizer.model.tokenize
        self.known = Words({}, self._learn, self._one)

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _one(self, word: str) -> bytes:
        """Ids of what is one word to the vocabulary."""
        letters = word.replace(" ", SPACE) if word.isascii() else "".join([LETTERS[b] for b in word.encode()])
        return _packed([t.id for t in self.model(letters)])

    def _learn(self, part: str) -> bytes | None:
        mark = part[:1] if self.keeps_space and part[:1] in MARKS else ""
        word = part[1:] if mark else part
        plain = word.isalpha() if word.isascii() else LATIN.fullmatch(word)
        if not self.keeps_space:
            low = word.lower()
            return (self.known.get(low) or self.known.older.get(low) or self._one(low)) if plain else self._library(word)
        if plain:
            return self._library("\n") + self.known["^" + word] if mark == "\n" else self._one(word if mark else " " + word)
        if part != "^" and word.split() != [word]:
            return None
        return self._library(word if mark == "^" else mark + word if mark else " " + word)

    def _words(self, text: str) -> list[str] | None:
        """Parts of a text; none if it holds an added token."""
        if any(h in text for h in self.heads):
            low = text.lower()
            if any(t in low for t in self.added):
                return None
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        words = ("^" + text).replace("\n", " \n").split(" ")
        # A later word that itself starts with the mark keeps its space, which sends the text to the library whole.
        return words if text.find("^") < 0 else [words[0], *(" " + w if w[:1] == "^" else w for w in words[1:])]

    def _forget(self) -> None:
        """The newer half becomes the older one once it is full."""
        if len(self.known) + len(self.known.endings) > self.remembered // 2:
            self.known = Words(dict(self.known), self._learn, self._one)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            self._forget()
            parts = self._words(text)
            try:
                out.append(b"".join(map(self.known.__getitem__, parts)))
            except TypeError:  # no parts, or one of them without ids of its own
                out.append(self._library(text))
        return out


def encoder(path: str, keeps_space: bool, remembered: int = REMEMBERED) -> WordEncoder:
    """One per worker process, so that remembered words serve later tasks too."""
    return held((path, keeps_space), lambda: WordEncoder(path, keeps_space, remembered))


def in_blocks(rows: list, size: int = 256):
    for i in range(0, len(rows), size):
        yield rows[i : i + size]
