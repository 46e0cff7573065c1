"""Token ids of whole texts by a vocabulary file, looked up by hashed pretokens.

The vocabulary's splitting pattern never crosses white space and its normaliser works on
single characters, so a text's ids are the ids of its words in a row, and those of a word
of plain Latin letters, digits and signs are the ids of its runs. Bytes of about half a
million characters at a time are cut into such pretokens by array operations and named by
64-bit hashes; one lookup for each distinct hash gives its ids, and one gather writes
the ids of the whole batch. New pretokens go through the library's merge model together.
Words with any other character (apostrophes, controls, marks, other scripts, special
strings) are one pretoken each and take the library's full path; so does every text of a
file with other rules.

What is remembered is bounded in entries and in ids, not by the text: keys have 8 bytes,
and pretokens above ``LONGEST`` bytes are never kept. Two of a million remembered
pretokens share a hash with a chance of about 3e-8.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd

from gridloom.llm.shingles import byte_values, mix, powers

LONGEST = 256
SPACE, LETTER, DIGIT, SIGN, OTHER, WHOLE = range(6)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = SIGN
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[ord("'"), ord("<")]] = OTHER  # contractions and special strings are the library's
KINDS[[9, 10, 13, 32]] = SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = byte_values(fold=False)


def shown_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenIds:
    """The ids of texts; remembers pretokens by their hash."""

    def __init__(self, path: str, most_kept: int = 1_000_000, most_ids: int = 8_000_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.most_kept, self.most_ids = Tokenizer.from_file(path), most_kept, most_ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [s.get("type") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.merger = Tokenizer(self.full.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shown = shown_bytes()
        vocabulary = spec["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.entry: dict[int, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store, self.used, self.given = np.zeros(1 << 18, np.uint32), 0, 0

    def merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of runs of plain characters, in one call."""
        joined = b" ".join(parts)
        text = joined.decode("latin-1")
        ids = np.array(self.merger.encode_batch_fast([text if joined.isascii() else text.translate({b: c for b, c in self.shown.items() if b != 32})])[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1  # a run's last token is marked as such
        return ids, np.diff(ends, prepend=0)

    def learn(self, keys: list[int], parts: list[bytes], whole: np.ndarray) -> np.ndarray:
        """Entry numbers of new pretokens; long ones are stored for the moment only."""
        first = self.given
        flat = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for which, run in ((np.flatnonzero(~whole), self.merged), (np.flatnonzero(whole), self.by_library)):
            if len(which):
                ids, sizes = run([parts[i] for i in which.tolist()])
                while self.used + len(ids) > len(self.store):
                    self.store = np.concatenate([self.store, np.zeros_like(self.store)])
                self.store[self.used : self.used + len(ids)] = ids
                flat[0][which], flat[1][which] = self.used + np.cumsum(sizes) - sizes, sizes
                self.used += len(ids)
        while first + len(parts) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        numbers = np.arange(first, first + len(parts))
        self.given += len(parts)
        self.starts[numbers], self.lengths[numbers] = flat
        self.entry.update(zip(keys, numbers.tolist(), strict=True))
        return numbers

    def by_library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.full.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each text)."""
        if self.given > self.most_kept or self.used > self.most_ids:
            self.forget()
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        kind, low = KINDS[data], LOWER[data]
        lead = np.flatnonzero(data == 0xC3)  # Latin-1 letters take two bytes, times and divide aside
        lead = lead[(data[lead + 1] & 0x5F) != 0x17]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead[data[lead + 1] < 0x9F] + 1] |= 0x20  # the capitals among them
        space = kind == SPACE
        odd = np.flatnonzero(kind == OTHER)
        if len(odd):  # the whole word around it is one pretoken, spelled as it stands
            begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
            at = np.unique(np.searchsorted(begins, odd, "right") - 1)
            inside = np.zeros(len(data), np.int8)
            inside[begins[at]] = 1
            inside[ends[at]] -= 1
            inside = np.cumsum(inside, dtype=np.int8).view(bool)
            kind[inside] = WHOLE
            np.copyto(low, data, where=inside)
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        own = kind[cuts]
        real = np.flatnonzero(own[:-1] != SPACE) if len(cuts) else np.zeros(0, np.int64)
        starts, ends = cuts[real], cuts[real + 1] if len(cuts) else cuts
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[low] * up[: len(data)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        code, distinct = pd.factorize(keys)
        some = np.zeros(len(distinct), np.int64)
        some[code] = np.arange(len(code))  # a place of each distinct pretoken
        names = distinct.tolist()
        number = np.fromiter(map(self.entry.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            where, spelled = some[new], low.tobytes()
            a, b = starts[where], ends[where]
            parts = [spelled[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            number[new] = self.learn([names[i] for i in new.tolist()], parts, kind[a] == WHOLE)
        first, size = self.starts[number][code], self.lengths[number][code]
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        ids = self.store[np.repeat(first - (done - size), size) + np.arange(total)]
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        upto = np.concatenate([[0], done])[np.searchsorted(starts, bounds)]
        if len(new):
            for i in np.flatnonzero(b - a > LONGEST).tolist():
                del self.entry[names[new[i]]]
        return ids, np.diff(upto)


def portions(texts: list[str | None], most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (text position, bytes) of about ``most`` bytes; long texts are cut at a space."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
        while True:
            stop = len(raw)
            if stop - at > most:
                near = raw.rfind(b" ", at + 1, at + most)
                near = near if near > 0 else raw.find(b" ", at + most)
                stop = near if near > 0 else stop
            held.append((k, raw[at:stop]))
            size += stop - at + 1
            at = stop
            if size >= most:
                yield held
                held, size = [], 0
            if at >= len(raw):
                break
    if held:
        yield held


_encoders: dict[str, TokenIds] = {}


def token_ids(path: str, texts: list[str | None], most: int = 500_000) -> Iterator[np.ndarray]:
    """Yields the ids of each text as unsigned 32-bit numbers; a null has none."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        gc.set_threshold(100_000, 50, 100)
        _encoders[path] = TokenIds(path)
    own = _encoders[path]
    open_text, kept = -1, []
    for group in portions(texts, most):
        if own.plain:
            ids, sizes = own.encode([raw for _, raw in group])
        else:
            ids, sizes = own.by_library([raw for _, raw in group])
        ends = np.cumsum(sizes).tolist()
        for (k, _), a, b in zip(group, [0, *ends], ends, strict=False):
            if k != open_text:
                if open_text >= 0:
                    yield kept[0] if len(kept) == 1 else np.concatenate(kept)
                open_text, kept = k, []
            kept.append(ids[a:b])
    if open_text >= 0:
        yield kept[0] if len(kept) == 1 else np.concatenate(kept)
