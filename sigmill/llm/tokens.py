"""Token ids of texts, as the tokenizers library gives them, at corpus speed.

Invented and inflected words make most of the cost: a text is cut into stretches that encode alone (a
stretch ends before a space or line break that follows a visible character, where no pre-token of the two
supported kinds can cross), stretches seen before come from a bounded memo, and new ones go through
tiktoken on the same merge ranks. Stretches of unusual texts (special tokens, letters beyond Latin, other
white space) go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Stretches kept in a worker's memo, and the longest kept.
MEMO, MEMO_CHARS = 250_000, 48

#: White space other than a single space or line break, and what else keeps a text off the fast path.
_ODD = ("  ", "\n\n", "\n ", " \n", "<|", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_ODD_LATIN = "\x85\xa0"
_STRETCH = re.compile(r"[ \n]*.*?\S(?=[ \n]|\Z)|.+\Z", re.S)
#: Pre-token pattern of byte-level BPE. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = re.compile("[^\x00-\u024f]|\u0130")
_STOPS = frozenset(",.;:!?")


def plain(text: str) -> bool:
    """Latin letters, and words one space or line break apart: case and normal form act on each character alone."""
    if any(x in text for x in _ODD):
        return False
    if text.isascii():
        return True
    return not any(x in text for x in _ODD_LATIN) and _BEYOND_LATIN.search(text) is None


def stretches(text: str) -> list[str]:
    """The text in pieces that encode independently of each other."""
    return _STRETCH.findall(text)


def byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizers, on this machine."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class Encoder:
    """One vocabulary file; ``end_of_word_suffix`` in it tells the two kinds apart."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte, suffix = byte_of(), spec["model"].get("end_of_word_suffix") or ""
        self.word_ends = bool(suffix)
        ranks: dict[bytes, int] = {}
        for token, number in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            # The end of a word is written as byte 255, which no UTF-8 text holds.
            ended = self.word_ends and token.endswith(suffix)
            raw = bytes(to_byte[c] for c in (token.removesuffix(suffix) if ended else token))
            ranks[raw + b"\xff" if ended else raw] = number
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {n: raw for raw, n in ranks.items()} | {n: t.encode() for t, n in self.special.items()}
        if self.word_ends:
            self.parts = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p))
        self.piece = self.fast._core_bpe.encode_single_piece
        self.memo: dict[str, int] = {}
        self.flat, self.at = array("I"), array("q", [0])

    def exact(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def one(self, stretch: str) -> list[int]:
        """Ids of a stretch of a plain text, lower-cased already if the vocabulary is."""
        if not self.word_ends:
            return self.fast.encode_ordinary(stretch)
        stretch = stretch.strip()
        if stretch.isalpha():
            parts = [stretch]
        elif stretch[:-1].isalpha() and stretch[-1] in _STOPS:
            parts = [stretch[:-1], stretch[-1]]
        else:
            parts = self.parts.findall(stretch)
        out: list[int] = []
        for part in parts:
            out += self.piece(part.encode() + b"\xff")
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts."""
        keys: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if plain(text):
                found = (text.lower() if self.word_ends else text).replace("\n", " \n").split(" ")
                found[0] = "\r" + found[0]
                keys += found
            else:
                keys += ["\t" + s for s in stretches(text)]
            ends[i + 1] = len(keys)
        memo = self.memo
        at: list = list(map(memo.get, keys))
        mark, added = len(self.at), []
        for i in [i for i, v in enumerate(at) if v is None]:
            k = keys[i]
            v = memo.get(k)
            if v is None:
                first = k[:1]
                self.flat.extend(self.exact(k[1:]) if first == "\t" else self.one(k[1:] if first == "\r" else k if first == "\n" else " " + k))
                v = len(self.at) - 1
                self.at.append(len(self.flat))
                memo[k] = v
                added.append(k)
            at[i] = v
        n = np.array(at, np.int64)
        starts, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        size = starts[n + 1] - starts[n]
        out = np.zeros(len(n) + 1, np.int64)
        np.cumsum(size, out=out[1:])
        ids = flat[np.repeat(starts[n] - out[:-1], size) + np.arange(out[-1])] if out[-1] else np.empty(0, np.uint32)
        del starts, flat  # the arrays can't change while they are viewed
        if len(memo) > MEMO:  # the memo keeps what came first; the rest of this step is forgotten
            for k in added:
                del memo[k]
            del self.at[mark:]
            del self.flat[self.at[-1] :]
        else:
            for k in added:
                if len(k) > MEMO_CHARS:
                    del memo[k]
        return ids, out[ends]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        table, at = self._byte_table
        size = at[ids + 1] - at[ids]
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=out[1:])
        return table[np.repeat(at[ids] - out[:-1], size) + np.arange(out[-1])].tobytes() if out[-1] else b""

    @property
    def _byte_table(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_table"):
            size = max(self.token_bytes) + 1
            parts = [self.token_bytes.get(i, b"") for i in range(size)]
            at = np.zeros(size + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=at[1:])
            self._table = np.frombuffer(b"".join(parts), np.uint8), at
        return self._table


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary; it outlives the task, with its memo."""
    return Encoder(vocabulary)
