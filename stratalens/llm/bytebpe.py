"""Byte-level BPE from a public ``tokenizers`` JSON file, split word by word.

A text is cut into pre-tokens ("words") and each word is merged on its own, so a text's ids are
the concatenation of its words' ids.  Two ways of cutting give the same words:

* texts of ASCII and Latin-1 letters (plus some common punctuation) by one ``re`` pattern with
  explicit character ranges, which is the published pattern restricted to those characters;
* any other text by the library's own pre-tokenizer, so that its Unicode tables decide.

Strings of special tokens inside a text are cut out first, as the library does by default.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(rf"[\x00-\x7f{_LETTER}‘’“”–—…€]*")
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\t-\r 0-9{_LETTER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary strings: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in plain}
    return table | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in table)}


class ByteBpe:
    """``spec`` is the text of the JSON file; it is small and bounded by the vocabulary, so it is shipped whole."""

    def __init__(self, spec: str, cached_words: int = 300_000):
        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or j.get("normalizer") or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or j["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in j["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        back = {c: b for b, c in byte_chars().items()}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        self.pieces = {v: bytes(back[c] for c in k) for k, v in vocab.items()}
        self.dtype = np.dtype("<u2" if max([*self.pieces, *self.special.values()]) < 1 << 16 else "<u4")
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        #: With ids in merge order, merging by lowest id is merging by lowest rank; else the library merges each word.
        self._core = tiktoken.Encoding("bytes", pat_str=r"(?s).", mergeable_ranks={b: i for i, b in self.pieces.items()}, special_tokens={}) if merged == sorted(merged) and len(merged) + 256 == len(vocab) else None
        self._cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._special_bytes = {k: np.array([v], self.dtype).tobytes() for k, v in self.special.items()}
        self.cache = _Words(self, cached_words)

    def split(self, text: str) -> list[str]:
        if _SAFE.fullmatch(text):
            return _WORD.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[str]:
        """Alternating ordinary text and special-token strings (odd places)."""
        if self._cut is None or not any(x in text for x in self.special):
            return [text]
        return self._cut.split(text)

    def word_ids(self, word: str) -> bytes:
        if self._core is not None:
            ids = self._core._encode_single_piece(word)
        else:
            self.library.encode_special_tokens = True
            ids = self.library.encode(word, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the whole text as packed little-endian numbers of ``dtype``."""
        out, get = [], self.cache.__getitem__
        for i, part in enumerate(self.segments(text)):
            out.append(self._special_bytes[part] if i % 2 else b"".join(map(get, self.split(part))))
        self.cache.trim()
        return out[0] if len(out) == 1 else b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


class _Words(dict):
    """Words to packed ids, emptied between texts when it holds too many."""

    def __init__(self, bpe: ByteBpe, most: int):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, word: str) -> bytes:
        found = self.bpe.word_ids(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


_LOADED: dict[int, ByteBpe] = {}


def loaded(spec: str) -> ByteBpe:
    """One tokenizer a Python worker."""
    if (key := hash(spec)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(spec)
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_spec(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()
