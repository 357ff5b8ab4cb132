"""Token ids of whole texts by the ``tokenizers`` library, at the cost of one look-up for each distinct word of a batch.

A pre-tokenizer never joins characters across a space that stands before a visible character, so a text may be
encoded as units cut before such spaces. Arrow cuts the texts of a batch and finds their distinct units; each of them
is encoded once, and what it consists of is remembered from batch to batch: the words of a unit of Latin letters, which
go to the library's BPE model, or any other unit as a whole, which goes through the library's whole pipeline. The ids
equal those of encoding the text in one piece, which the tests assert.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A unit boundary: a space before a visible character.
_CUT = re.compile(r" (?=\S)")
#: White space that a plain split at spaces would cut wrongly.
_RUN = re.compile(r" \s| $")
#: Letters, digits and white space here are the same to Python and to the tokenizers; a superscript two is not, as it is a
#: number to them but no digit to re.
_LATIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
#: Marks that are one word of a tokenizer's, whatever number of them follows letters.
_MARKS = ".,;:!?"

#: Bytes that a dictionary takes for an entry beside key and value; characters of a unit that is remembered at most; missing
#: units for each remembered one after which a full table starts anew; places for the hashes of what was seen once.
ENTRY, LONGEST, PATIENCE, ONCE = 104, 64, 16, 1 << 20
#: Bytes of remembered units.
MEMORY = 40_000_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where it is printable, else the next
    free code point from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Room:
    """What several tables remember takes about ``memory`` bytes at most. Half of it is for what comes first, the rest for
    what comes again. When it is full the tables stay as they are until so much was missing that the texts have changed."""

    def __init__(self, memory: int):
        self.memory, self.tables = memory, []
        self.empty()

    def empty(self) -> None:
        for t in self.tables:
            t.clear()
        self.held, self.missed, self.once = 0, 0, bytearray(ONCE)

    def takes(self, unit: str, found: bytes) -> bool:
        if len(unit) > LONGEST:
            return False
        size = sys.getsizeof(unit) + sys.getsizeof(found) + ENTRY
        if self.held + size > self.memory:
            self.missed += 1
            if self.missed > PATIENCE * sum(map(len, self.tables)):
                self.empty()
            return False
        if 2 * self.held > self.memory:
            at = hash(unit) % ONCE
            if not self.once[at]:  # neither this unit nor another one of equal hash was here before
                self.once[at] = 1
                return False
        self.held += size
        return True


class _Known(dict):
    """What has been encoded so far, as far as there is room; a missing key is encoded when it is asked for."""

    def __init__(self, encode, room: _Room):
        super().__init__()
        self.encode, self.room = encode, room
        room.tables.append(self)

    def __missing__(self, unit: str) -> bytes:
        found = self.encode(unit)
        if self.room.takes(unit, found):
            self[unit] = found
        return found


class UnitEncoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit integers in one bytes object.

    A text that holds the string of an added token goes through the whole pipeline in one piece. ``memory`` bounds the
    bytes of the remembered units.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        added = [(t["content"], t.get("normalized", False)) for t in parts.get("added_tokens", [])]
        # a token that is sought in normalized text may differ in case from what the text has
        self.added = re.compile("|".join(f"(?i:{re.escape(t)})" if loose else re.escape(t) for t, loose in added)) if added else None
        self.lower = "Lowercase" in json.dumps(parts["normalizer"] or {})
        words = re.search(r'"Regex": "(\'s[^"]*)"', json.dumps(parts["pre_tokenizer"], ensure_ascii=False))
        kind = parts["pre_tokenizer"]["type"]
        letter, digit, rest = r"[^\W\d_]", r"\d", r"[^\s\w]|_"
        if kind == "ByteLevel" and parts["pre_tokenizer"]["use_regex"] and not parts["normalizer"]:
            self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?(?:{rest})+|\s+(?!\S)|\s+")
        elif words and self.lower:
            self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|(?:{rest})+")
        else:
            self.words = None  # another pipeline: units go through all of it
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # what is asked of the model is what isn't remembered here
        # words that stand behind a space, without it, and words that don't: the same where no word has the space
        self.room = _Room(memory)
        self.bare = _Known(self._piece, self.room)
        self.spaced = self.bare if self.lower else _Known(lambda word: self._piece(word, _LETTERS[32]), self.room)
        self.units = _Known(self._whole, self.room)

    def _piece(self, word: str, space: str = "") -> bytes:
        if not (word.isascii() and word.isalpha()):
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return _packed([t.id for t in self.model.tokenize(space + word)])

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _unit(self, unit: str, space: str = " ") -> bytes:
        """The ids of a unit that stands behind ``space``."""
        if self.words is None:
            return self.units[space + unit]
        word = unit.rstrip(_MARKS)
        if word.isalpha():  # most units
            low = word.lower() if self.lower else word
            if low.isascii() or _LATIN.fullmatch(low):  # nothing there to compose
                head = (self.spaced if space else self.bare)[low]
                return head if len(word) == len(unit) else head + self.bare[unit[len(word) :]]
        text = space + unit
        plain = unit.isascii() and unit.isprintable()
        if self.lower:
            text = text.lower() if plain else unicodedata.normalize("NFC", text).lower()
        if not plain and not _LATIN.fullmatch(text):
            return self.units[space + unit]
        words = self.words.findall(text)
        if words and len(words[0]) > 1 and words[0][0] == " ":
            head = self.spaced[words[0][1:]]
            return head + b"".join(map(self.bare.__getitem__, words[1:])) if len(words) > 1 else head
        return b"".join(map(self.bare.__getitem__, words))

    def _together(self, plain: list[str], cut: list[list[str]]) -> Iterator[bytes]:
        """The ids of texts that any space cuts, then those of texts that come as units."""
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        units = pa.concat_arrays([split.flatten(), pa.array((u for c in cut for u in c), pa.large_string())])
        counts = np.concatenate([pc.list_value_length(split).to_numpy(), np.array([len(c) for c in cut], np.int64)])
        ends = np.cumsum(counts)
        starts, coded = ends - counts, units.dictionary_encode()
        distinct, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.spaced.get if self.words else self.units.get
        found = [self._unit(u) if (ids := known(u)) is None else ids for u in distinct]
        found += [self._unit(u, "") for u in units.take(pa.array(starts)).to_pylist()]  # no space before a text's first one
        index = coded.indices.to_numpy().copy()
        index[starts] = np.arange(len(distinct), len(found))
        ids = pa.array(found, pa.large_binary()).take(pa.array(index))
        at, data = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2] or b"")
        for a, b in zip(at[starts].tolist(), at[ends].tolist(), strict=True):
            yield bytes(data[a:b])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, plain, cut = [b""] * len(texts), {}, {}
        for i, t in enumerate(texts):
            t = t or ""
            if self.added and self.added.search(t):
                out[i] = self._whole(t)
                continue
            if self.lower and t.isascii():
                t = t.lower()
            if _RUN.search(t):
                cut[i] = _CUT.split(t)
            else:
                plain[i] = t
        if plain or cut:
            for i, found in zip([*plain, *cut], self._together([*plain.values()], [*cut.values()]), strict=True):
                out[i] = found
        return out


_encoders: dict[str, UnitEncoder] = {}


def forget() -> None:
    """Drop the encoder that this Python worker keeps. Its tables refer to it, so only the collector frees it."""
    if _encoders:
        _encoders.clear()
        gc.collect()


def encoder(path: str, memory: int = MEMORY) -> UnitEncoder:
    """The encoder of a Python worker, which keeps what it remembers from task to task; one tokenizer at a time."""
    if path not in _encoders:
        forget()
        _encoders[path] = UnitEncoder(path, memory)
    return _encoders[path]
