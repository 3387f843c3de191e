"""Ids of a public word-level BPE, each distinct word encoded once.

The tokenizer drops white space, and its pre-tokenizer never joins characters across it, so the ids of
a text are those of its white-space separated words in order. Words are looked up by hash; only new
ones are encoded, many at a time. Words of printable ASCII and Latin-1 letters go through the same
merges in a faster encoder (a word end is a byte of its own, merged first), all others through the
tokenizer itself; both give the tokenizer's ids.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from . import textkernel as K

#: Distinct words that a Python worker remembers (about 40 MB); beyond it the memory starts anew.
REMEMBERED = 1_000_000
SEPARATOR = "<|endoftext|>"
_MADE: dict[str, "WordIds"] = {}


#: The pre-tokenizer that the fast way knows, and its form for lower-case ASCII and Latin-1 letters.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9\n]+")
_OTHER = re.compile(r"[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\|")
_END = b"\0"


def _byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def fast_encoder(path: str):
    """(encoder, its rank to the tokenizer's id), or None where the file is not of the kind this needs."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    known = (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT}
    )
    if not known:
        return None
    symbol = _byte_symbols()

    def raw(token: str) -> bytes:
        ends = token.endswith("</w>")
        return bytes(symbol[c] for c in (token[:-4] if ends else token)) + (_END if ends else b"")

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256)}
    for m in model["merges"]:
        ranks.setdefault(b"".join(map(raw, m if isinstance(m, list) else m.split(" "))), len(ranks))
    ids = np.zeros(max(ranks.values()) + 1, np.uint32)
    special = {t["content"] for t in spec["added_tokens"]}
    for token, i in model["vocab"].items():
        if token not in special:
            ids[ranks[raw(token)]] = i
    return tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={}), ids


_NONE = np.zeros(0, np.uint32)


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = self.tokenizer.token_to_id(SEPARATOR)
        self.fast = fast_encoder(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in _MADE:
            _MADE[path] = cls(path)
        return _MADE[path]

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _quick(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words parted by line ends, and the number of each word's ids."""
        encoder, to_id = self.fast
        ranks = np.array(encoder.encode_ordinary(_PIECE.sub("\\g<0>\0", joined.lower())), np.int64)
        inside = ranks != 10
        cut = np.flatnonzero(~inside)
        return to_id[ranks[inside]], np.diff(np.concatenate(([-1], cut, [len(ranks)]))) - 1

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join(words).decode("utf-8", "replace")
        if self.fast and not _OTHER.search(joined):
            return self._quick(joined)
        texts = joined.split("\n")
        slow = [i for i, t in enumerate(texts) if not self.fast or _OTHER.search(t)]
        out = [_NONE] * len(texts)
        if len(slow) < len(texts):
            rest = set(slow)
            quick = [i for i in range(len(texts)) if i not in rest]
            ids, length = self._quick("\n".join([texts[i] for i in quick]))
            for i, part in zip(quick, np.split(ids, np.cumsum(length)[:-1]), strict=True):
                out[i] = part
        plain = [i for i in slow if "<|" not in texts[i]]
        if plain:
            ids = np.array(self.tokenizer.encode(SEPARATOR.join(texts[i] for i in plain), add_special_tokens=False).ids, np.uint32)
            for i, part in zip(plain, np.split(ids, np.flatnonzero(ids == self.apart)), strict=True):
                out[i] = part[part != self.apart]
        for i in slow:
            if "<|" in texts[i]:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        made, length = self._encode(words)
        total = len(made)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.used : self.used + total] = made
        at = self.used + np.cumsum(length) - length
        self.used += total
        where = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.length = np.insert(self.hash, where, hashes), np.insert(self.at, where, at), np.insert(self.length, where, length)

    def ids(self, words: K.Words, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's bounds in them; end is added to each text."""
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > REMEMBERED:
            self.clear()
        where = np.searchsorted(self.hash, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(self.hash)
        new[inside] = self.hash[where[inside]] != distinct[inside]
        if new.any():
            data = words.data.tobytes()
            spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            self._learn(distinct[new], [data[a:b] for a, b in spans])
            where = np.searchsorted(self.hash, distinct)
        at, length = self.at[where][back], self.length[where][back]
        flat = self.flat
        if end is not None:
            flat = np.concatenate((self.flat[: self.used], np.array([end], np.uint32)))
            at = np.insert(at, words.off[1:], self.used)
            length = np.insert(length, words.off[1:], 1)
            word_off = words.off + np.arange(len(words.off))
        else:
            word_off = words.off
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        out = flat[np.repeat(at - (stop - length), length) + np.arange(total)]
        return out, np.concatenate(([0], stop))[word_off]


def text_ids(column: pa.Array, path: str, end: int | None = None):
    """(first row, end row, ids, bounds) for chunks of a text column; a null is an empty text."""
    table = WordIds.of(path)
    for lo, hi, words in K.texts(column, lower=False):
        yield lo, hi, *table.ids(words, end)
