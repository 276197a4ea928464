"""Exact encoding with a public tokenizer, word by word through a bounded memo.

Both tokenizers cut a text at a space before they merge, so the ids of a text are the ids of its words in a row. A text
with three or more white-space characters together, or two at its end, goes to the tokenizer whole instead, as does
every text of a tokenizer whose kind is not known here. The tokenizer itself gives every id.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import attrgetter

from .common import one_thread

#: Words kept in each of the memo's two halves; the older half goes when the newer is full.
MEMO_WORDS = 500000
_RUNS = re.compile(r"\s\s\s|\s\s\Z")
#: Signs that follow letters as a piece of their own: ASCII ones but for the apostrophe, which may join letters behind it.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Fixed value: how the tokenizer that drops white space cuts its pieces.
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ID = attrgetter("id")
#: Marks a word with nothing before it. Texts that hold it go to the tokenizer whole.
_BARE = "\x00"
#: Letters before this are Latin ones that composition leaves as they are, and whose small letters are one character.
_PLAIN = "\u0130"


def _shown_bytes() -> dict[int, str]:
    """The character by which byte-level tokenizers show each byte: itself where it prints, else the next free one from 256."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


_SHOWN = _shown_bytes()


class _Memo(dict):
    """Ids by word; a word that isn't here comes from the older half, or is learned."""

    def __init__(self, older: dict, learn):
        super().__init__()
        self.older, self.learn = older, learn

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.learn(word)
        self[word] = found
        return found


class WordEncoder:
    """encode(texts) gives, for each text, its ids as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.dtype = f"<u{self.width}"
        kind = json.loads(self.tokenizer.to_str())
        pre, normal = kind["pre_tokenizer"] or {}, kind["normalizer"] or {}
        plain = kind["model"]["type"] == "BPE" and not kind["model"].get("dropout")
        self.spaced = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not normal
        parts = [x["type"] for x in pre.get("pretokenizers", ())]
        small = [x["type"] for x in normal.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        self.dropped = plain and small and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and pre["pretokenizers"][0]["pattern"] == {"Regex": _DROPPING}
        self.code = {2: "H", 4: "I"}[self.width]
        self.merged = self.tokenizer.model.tokenize
        self.memo_words, self.memo = memo_words, _Memo({}, self._learn)
        self.line = self._whole(["\n"])[0]

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of plain letters, perhaps behind a space: one piece to the merges."""
        shown = "\u0120" + word[1:] if word[:1] == " " else word
        if not word.isascii():
            shown = word.encode().decode("latin-1").translate(_SHOWN)
        return self._pack(map(_ID, self.merged(shown)))

    def _learn(self, word: str) -> bytes:
        """The ids of a word, keyed as _words gives it; its letters and the signs behind them are words of their own."""
        stem = word.rstrip(_SIGNS)
        if stem and stem is not word and len(stem) < len(word) and stem[-1].isalpha() and stem[-1] < _PLAIN:
            tail = word[len(stem) :]
            return self.memo[stem] + self.memo[_BARE + tail if self.spaced else tail]
        if self.dropped:
            return self._letters(word.lower()) if word.isalpha() and max(word) < _PLAIN else self._whole([word])[0]
        if word[:1] == "\n" and len(word) > 1:
            return self.line + self.memo[_BARE + word[1:]]
        bare = word[1:] if word[:1] == _BARE else word
        text = word if word[:1] == "\n" else bare if bare is not word else " " + word
        return self._letters(text) if bare.isalpha() and max(bare) < _PLAIN else self._whole([text])[0]

    def _words(self, text: str) -> list[str]:
        """A text's words as keys of the memo: after a line end with it, the first one marked, others follow a space."""
        if self.dropped:
            return text.replace("\n", " ").split(" ")
        words = text.replace("\n", " \n").split(" ")
        words[0] = _BARE + words[0]
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        if not (self.spaced or self.dropped):
            return self._whole(texts)
        out = []
        for text in texts:
            if self.spaced and (_BARE in text or _RUNS.search(text)):
                out += self._whole([text])
            else:
                out.append(b"".join(map(self.memo.__getitem__, self._words(text))))
            if len(self.memo) > self.memo_words:
                self.memo.older = {}
                self.memo = _Memo(self.memo, self._learn)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
