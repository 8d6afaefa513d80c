"""Exact tokenisation with public tokenizer files, one encoder call per distinct piece of text.

Both tokenizers split a text before merging.  A single space between two visible characters always
ends such a split, so a text is cut there and each distinct cut is encoded once per worker; the ids
of a text are the ids of its cuts.  Texts where white space runs together are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Entries of one generation of a worker's cache; two generations are kept.
CACHE_LIMIT = 500_000
_IRREGULAR = re.compile(r" \s|\s ")
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_CODES = {2: "H", 4: "I"}
_MARKS = frozenset(".,;:!?")
#: Letters below this one are their own normal form; the dotted capital I alone has a lower case of two.
_LATIN_END, _DOTTED_I = "\u0250", "\u0130"
#: Special tokens begin so; their capitals are plain text.
_SPECIAL = "<|"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_width(path: str) -> int:
    """Bytes of an id: two where the whole vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return width_of(Tokenizer.from_file(path))


def width_of(tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Cuts(dict):
    """cut -> its ids as little-endian bytes; unseen cuts are encoded on first use.

    A word of Latin letters is one piece for both tokenizers, so the merges alone decide its ids.  A mark after a Latin letter is always a split of its own, and so is a line break between two visible
    characters: such cuts are put together from their parts.  The dotted capital I counts as no such letter: its lower case ends in a combining dot, which joins the mark.
    """

    def __init__(self, encode, merged, before: str, lower: bool, bare: _Cuts | None = None):
        super().__init__()
        self.encode, self.merged, self.before, self.lower, self.old = encode, merged, before, lower, {}
        self.bare = self if bare is None else bare

    def __missing__(self, cut: str) -> bytes:
        made = self.old.get(cut)
        if made is None:
            if cut.isalpha() and (cut.isascii() or max(cut) < _LATIN_END and _DOTTED_I not in cut):
                made = self.merged(self.before, cut.lower() if self.lower else cut)
            elif len(cut) > 1 and cut[-1] in _MARKS and cut[-2].isalpha() and (cut.isascii() or max(cut) < _LATIN_END and _DOTTED_I not in cut):
                made = self[cut[:-1]] + self.bare[cut[-1]]
            elif "\n" in cut and not self.lower and (found := re.fullmatch(r"(\S+)\n(\S+)", cut)):
                made = self[found[1]] + self.bare["\n"] + self.bare[found[2]]
            elif self.lower and cut.isascii() and _SPECIAL not in cut and cut != cut.lower():
                made = self[cut.lower()]
            else:
                made = self.encode(self.before + cut)
        self[cut] = made
        return made

    def age(self) -> None:
        if len(self) > CACHE_LIMIT:
            self.old = dict(self)
            self.clear()


class PieceCache:
    """Encodes texts with one tokenizer file; ``drops_white_space`` says that it ignores white space."""

    def __init__(self, path: str, drops_white_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width_of(self.tokenizer)
        self.letters = byte_letters()
        self.drops = drops_white_space
        self.bare = _Cuts(self.encode_whole, self.merged, "", drops_white_space)
        self.spaced = self.bare if drops_white_space else _Cuts(self.encode_whole, self.merged, " ", False, self.bare)

    def encode_whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, before: str, word: str) -> bytes:
        """The ids of one piece of letters: its bytes as letters of the vocabulary, merged."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.tokenizer.model.tokenize(self.letters[32] + word if before else word)])

    def packed(self, ids: list[int]) -> bytes:
        out = array(_CODES[self.width], ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width`` bytes; null counts as empty."""
        self.bare.age()
        self.spaced.age()
        spaced, join, out = self.spaced.__getitem__, b"".join, []
        for text in texts:
            text = text or ""
            if self.drops:
                out.append(join(map(spaced, text.replace("\n", " ").split(" "))))
            elif self._irregular(text):
                out.append(self.encode_whole(text))
            else:
                first, *rest = text.split(" ")
                out.append((self.bare[first] if first else b"") + join(map(spaced, rest)))
        return out

    @staticmethod
    def _irregular(text: str) -> bool:
        """Whether a space stands beside other white space, or at an end."""
        if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return bool(text)
        rare = not text.isascii() or any(c in text for c in _RARE_SPACE)
        return rare and _IRREGULAR.search(text) is not None


_caches: dict[tuple, PieceCache] = {}


def piece_cache(path: str, drops_white_space: bool) -> PieceCache:
    """One cache per Python worker; workers are reused between tasks."""
    key = (path, drops_white_space)
    if key not in _caches:
        _caches[key] = PieceCache(path, drops_white_space)
    return _caches[key]


def text_slices(texts: list, chars: int = 2_000_000):
    """Index ranges of about ``chars`` characters, so that working memory stays bounded."""
    start = used = 0
    for k, text in enumerate(texts):
        used += len(text or "")
        if used >= chars:
            yield start, k + 1
            start, used = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
