"""Fast exact encoding of many texts with a tokenizers file.

A text is cut where no token can cross, and each different part is encoded once for an array of texts. Parts of Latin
letters and marks are cut into pre-tokens, of which those met before are looked up; only new ones, and other parts, go
through the tokenizers library. The cuts hold for two pre-tokenizers, recognised from the file:

* byte-level with the usual pattern and no normalizer: a token never crosses into a space that is followed by
  a character that isn't white space;
* NFC, white space to one space, lower case, then a split that drops white space: no token holds white space.

Any other file is encoded text by text. Every way gives exactly the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPACED = re.compile(r" (?=\S)")
#: Texts with a space that such a part could not begin at; more than these is only slower.
ODD = "[ ](?:[\\x00-\\x20\\x7f-\\x{a0}]|[^\\x00-\\x{24f}]|$)"
#: Strings that no normalizer changes but for case (U+0130 becomes two characters).
LATIN = re.compile("[\x00-\x7f\xa1-\u012f\u0131-\u024f]*")
#: Parts that Arrow can cut: printable, without white space but for single line feeds.
PLAIN = "^(?:{0}\\n?)+$".format("[\\x21-\\x7e\\x{a1}-\\x{12f}\\x{131}-\\x{24f}]")
#: The pattern of byte-level pre-tokenizers; a fixed value of that format. The second is what is left of it where a plain part follows a space.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PIECE = BYTE_LEVEL.removesuffix(r"|\s+(?!\S)|\s+") + r"|\n"
#: Stands between pieces; no piece holds it.
MARK = "\ue000"


def _byte_characters() -> np.ndarray:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    out = np.arange(256, dtype="<u4")
    out[hidden] = 256 + np.arange(len(hidden))
    return out


class _Store(dict):
    """Part -> position; the ids of all parts stand in one array. New parts wait in ``new`` for their ids."""

    def __init__(self):
        super().__init__()
        self.new: list = []
        self.pool, self.starts, self.lens = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def find(self, parts: list, count: int) -> np.ndarray:
        at = np.fromiter(map(self.get, parts, repeat(-1)), np.int64, count)
        if len(lost := np.flatnonzero(at < 0)):
            missing = [parts[k] for k in lost.tolist()]
            new = list(dict.fromkeys(missing))
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.new += new
            at[lost] = np.fromiter(map(self.__getitem__, missing), np.int64, len(missing))
        return at

    def learn(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """The ids of the parts in ``new``."""
        n, begin, end = len(self), len(self) - len(lens), self.used + len(flat)
        for name, need in (("pool", end), ("starts", n), ("lens", n)):
            a = getattr(self, name)
            if need > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)]))
        self.lens[begin:n] = lens
        self.starts[begin:n] = self.used + np.cumsum(lens) - lens
        self.pool[self.used : end] = flat
        self.used, self.new = end, []

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these parts in a row, and where each part's ids end."""
        return _gather(self.pool, self.starts, self.lens, at)


def _gather(pool: np.ndarray, starts: np.ndarray, all_lens: np.ndarray, at: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts in a row, and where each part's ids end; block after block, as places take more room than ids."""
    lens = all_lens.take(at)
    ends = np.cumsum(lens)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    for k in range(0, len(at), block):
        size, done = lens[k : k + block], int(ends[k] - lens[k])
        where = np.repeat(starts.take(at[k : k + block]) - (ends[k : k + block] - size) + done, size)
        where += np.arange(len(where))
        flat[done : done + len(where)] = pool[where]
    return flat, ends


def _bounds(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids of each text, from where each part's ids end and the number of parts of each text."""
    return np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


class Encoder:
    """Encodes arrays of texts; keeps about ``limit`` parts and as many pre-tokens."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.limit = limit
        self.size = self.tokenizer.get_vocab_size()
        self.kind, pattern = self._kind(head.get("normalizer"), head.get("pre_tokenizer"))
        self.pattern = regex.compile(pattern, flags=regex.VERSION0)
        self.characters = _byte_characters()
        self.parts, self.pieces = _Store(), _Store()

    @staticmethod
    def _kind(normalizer, pre) -> tuple[str, str]:
        pre = pre or {}
        if not normalizer and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte", BYTE_LEVEL
        steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
        splits = [x.get("type") for x in pre.get("pretokenizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]:
            pattern = pre["pretokenizers"][0]["pattern"].get("Regex", "")
            if pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
                return "word", pattern
        return "whole", ""

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in a row, and the number of parts of each."""
        if self.kind == "word":
            # A-Z may be lowered at once unless a combining mark follows that NFC would join to it.
            marks = pc.match_substring_regex(texts, "[\u0300-\u036f]")
            lists = pc.ascii_split_whitespace(pc.if_else(marks, texts, pc.ascii_lower(texts)))
        elif self.kind == "byte":
            odd = pc.match_substring_regex(texts, ODD)
            lists = pc.split_pattern(texts, " ")
            if pc.any(odd).as_py():
                ways = lists.to_pylist()
                for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                    ways[i] = SPACED.split(texts[i].as_py())
                lists = pa.array(ways, pa.list_(pa.string()))
        else:
            return texts, np.ones(len(texts), np.int64)
        return lists.flatten(), np.diff(lists.offsets.to_numpy())

    def _spaced(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts that follow a space: an array of ids, where each part's begin there, and how many they are."""
        plain = pc.match_substring_regex(parts, PLAIN)
        texts = pc.binary_join_element_wise(" ", parts.filter(plain), "")
        marked = pc.replace_substring_regex(texts, PLAIN_PIECE, "\\0\x1f")
        pieces = pc.split_pattern(pc.utf8_rtrim(marked, "\x1f"), "\x1f")
        seen = pieces.flatten().dictionary_encode()
        names = seen.dictionary.to_pylist()
        at = self._find_pieces(names)
        if len(self.pieces) > self.limit:  # these go on, as what is frequent is among them
            known, self.pieces = self.pieces, _Store()
            flat, ends = known.gather(at)
            at = self.pieces.find(names, len(names))
            self.pieces.learn(flat, np.diff(ends, prepend=0))
        flat, ends = self.pieces.gather(at.take(seen.indices.to_numpy()))
        lens, is_plain = np.zeros(len(parts), np.int64), plain.to_numpy(zero_copy_only=False)
        lens[is_plain] = _bounds(ends, np.diff(pieces.offsets.to_numpy()))
        flats = [flat]
        if not is_plain.all():
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([" " + p for p in parts.filter(pc.invert(plain)).to_pylist()], add_special_tokens=False)]
            other, lens[~is_plain] = _flat(ids)
            flats.append(other)
        starts = np.zeros(len(parts), np.int64)
        for those in (is_plain, ~is_plain):
            starts[those] = np.cumsum(lens[those]) - lens[those]
        starts[~is_plain] += len(flat)
        return np.concatenate(flats), starts, lens

    def _shown(self, pieces: list[str]) -> list[str]:
        """Pre-tokens in the byte-level alphabet."""

        def shown(text: str) -> str:
            return self.characters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")

        return shown(MARK.join(pieces)).split(shown(MARK))

    def _find_pieces(self, pieces: list[str]) -> np.ndarray:
        """Where pre-tokens stand among those known; new ones are given to the model."""
        at = self.pieces.find(pieces, len(pieces))
        if new := self.pieces.new:
            flats, lens = [], []
            for k in range(0, len(new), 10_000):
                tokens = list(map(self.model.tokenize, self._shown(new[k : k + 10_000])))
                lens.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
                flats.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), np.uint32, int(lens[-1].sum())))
            self.pieces.learn(np.concatenate(flats), np.concatenate(lens))
        return at

    def _learn(self, parts: list) -> None:
        """Find the ids of new parts: strings, or bytes for those that begin a text."""
        byte, simple = self.kind == "byte", self.kind != "whole"
        found: list[str] = []
        counts, whole = np.zeros(len(parts), np.int64), []
        for k, p in enumerate(parts):
            s = p.decode("utf-8") if isinstance(p, bytes) else p
            if simple and (s.isascii() or LATIN.fullmatch(s)):
                pieces = self.pattern.findall(s if byte else s.lower())
                counts[k] = len(pieces)
                found += pieces
            else:
                whole.append((k, s))
        if not byte and len(self.pieces) > self.limit:
            self.pieces = _Store()
        at = self._find_pieces(found)
        flat, ends = self.pieces.gather(at)
        lens = _bounds(ends, counts)
        if whole:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([s for _, s in whole], add_special_tokens=False)]
            rows = np.split(flat, np.cumsum(lens)[:-1])
            for (k, _), x in zip(whole, ids):
                rows[k] = np.array(x, np.uint32)
            lens, flat = np.fromiter(map(len, rows), np.int64, len(rows)), np.concatenate(rows)
        self.parts.learn(flat, lens)

    def clear(self) -> None:
        """Forget all parts, so that an idle worker holds little memory."""
        self.parts, self.pieces = _Store(), _Store()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text. texts: strings without nulls."""
        if len(self.parts) > self.limit or self.parts.used > 20 * self.limit:
            self.parts = _Store()
        cut, counts = self._cut(texts)
        if self.kind == "byte" and len(texts):
            return self._encode_bytes(cut, counts)
        seen = cut.dictionary_encode()
        at = self.parts.find(seen.dictionary.to_pylist(), len(seen.dictionary))[seen.indices.to_numpy()]
        if self.parts.new:
            self._learn(self.parts.new)
        flat, ends = self.parts.gather(at)
        return flat, _bounds(ends, counts)

    def _encode_bytes(self, cut: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The first part of a text has no space before it; these are kept apart.
        first = (np.cumsum(counts) - counts)[counts > 0]
        at_first = self.parts.find([x.encode() for x in cut.take(pa.array(first)).to_pylist()], len(first))
        if self.parts.new:
            self._learn(self.parts.new)
        seen = cut.dictionary_encode()
        flat, starts, lens = self._spaced(seen.dictionary)
        at = seen.indices.to_numpy().copy()
        at[first] = len(lens) + at_first
        n, used = len(self.parts), self.parts.used
        pool = np.concatenate([flat, self.parts.pool[:used]])
        flat, ends = _gather(pool, np.concatenate([starts, len(flat) + self.parts.starts[:n]]), np.concatenate([lens, self.parts.lens[:n]]), at)
        return flat, _bounds(ends, counts)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
