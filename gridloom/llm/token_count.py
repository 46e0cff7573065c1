"""Token counts by compiled finite-state transducers.

Two deterministic transducers replace the tokenizer:

1. A splitter over character symbols. Its states are the open pretoken's kind; a
   transition says whether a pretoken begins before the character. Look-ahead of the
   pattern (contractions, the last space of a run) is folded into the symbol. The text
   is cut into fixed chunks, every chunk gets its map start state -> end state, the maps
   compose through a parallel prefix scan, and a second pass emits the boundaries of all
   chunks at once from the right start states.
2. A merge transducer over the bytes of a pretoken. Its states are the beginnings of
   tokens; a transition goes to the longest beginning that ends with the byte, and is
   annotated with the tokens that end there, longest first. The one of them that may
   follow the last token before it is the last token here, and the count there plus one
   is the count here, so no merges are replayed. Transitions, annotations and merge ranks
   are compiled into sorted arrays, and all new pretokens of a batch step side by side.

That the last token alone decides rests on a property of byte-pair encodings: a token
sequence is the encoding of its bytes if and only if each neighbouring pair is the
encoding of the pair's bytes.

Pretokens are named by 64-bit hashes and counted once while remembered: keys and counts
have a fixed size, so memory does not follow the text. Two of a million remembered
pretokens share a hash with a chance of about 3e-8.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_of
from gridloom.llm.shingles import mix, powers
from gridloom.llm.tokens import shown_bytes

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, LAST_SPACE, LAST_WHITE, WHITE, END = range(9)
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, IN_WHITE, EAT1, EAT2 = range(8)
CHUNK = 512


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, a pretoken begins here) for each state and symbol."""
    begin = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, QUOTE1: EAT1, QUOTE2: EAT2, LAST_SPACE: AFTER_SPACE, LAST_WHITE: FRESH, WHITE: IN_WHITE, END: FRESH}
    step = np.empty((8, 9), np.uint8)
    starts = np.ones((8, 9), bool)
    for state in range(8):
        for symbol, target in begin.items():
            step[state, symbol] = target
    inside = [
        (IN_LETTER, {LETTER: IN_LETTER}),
        (IN_NUMBER, {NUMBER: IN_NUMBER}),
        (IN_OTHER, dict.fromkeys((OTHER, QUOTE1, QUOTE2), IN_OTHER)),
        (AFTER_SPACE, {LETTER: IN_LETTER, NUMBER: IN_NUMBER} | dict.fromkeys((OTHER, QUOTE1, QUOTE2), IN_OTHER)),
        (IN_WHITE, {WHITE: IN_WHITE}),
        (EAT1, {LETTER: FRESH}),
        (EAT2, {LETTER: EAT1}),
    ]
    for state, moves in inside:
        for symbol, target in moves.items():
            step[state, symbol], starts[state, symbol] = target, False
    return step, starts


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, everything):
            kinds[[ord(c) for c in m[0]]] = kind
    return kinds


class Splitter:
    def __init__(self) -> None:
        self.kinds = character_kinds()
        self.step, self.starts = splitter_tables()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of the code points; ``ends`` are the positions that close a text."""
        sym = self.kinds[points]
        sym[ends] = END
        after = np.empty_like(sym)
        after[:-1], after[-1] = sym[1:], END
        white = sym == WHITE
        last = white & (after != WHITE) & (after != END)
        sym[last] = np.where(points[last] == 32, LAST_SPACE, LAST_WHITE)
        quotes = np.flatnonzero((points == 39) & (sym == OTHER))
        if len(quotes):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pairs = one.astype(np.uint64) << np.uint64(32) | two
            long = np.isin(pairs, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
            sym[quotes[short]], sym[quotes[long]] = QUOTE1, QUOTE2
        return sym

    def boundaries(self, sym: np.ndarray) -> np.ndarray:
        """Where a pretoken (or a closed text) begins, by chunk maps and a prefix scan."""
        n = len(sym)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
        at = 0
        while at < CHUNK and (maps != maps[:, :1]).any():  # all start states side by side
            maps = self.step[maps, grid[at][:, None]]
            at += 1
        lane = maps[:, 0]
        for j in range(at, CHUNK):  # every map is constant by now
            lane = self.step[lane, grid[j]]
        if at < CHUNK:
            maps = np.repeat(lane[:, None], 8, axis=1)
        reach = 1
        while reach < chunks:  # prefix scan: compose with the map `reach` chunks before
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
            reach *= 2
        lane = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.intp)
        begins = np.empty(grid.shape, bool)
        step, starts = self.step.ravel().astype(np.intp), self.starts.ravel()
        for j in range(CHUNK):
            at = lane * 9 + grid[j]
            begins[j] = starts[at]
            lane = step[at]
        return begins.T.reshape(-1)[:n]


NEVER = 1 << 60
LANE = 64  # bytes; longer pretokens step on their own


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    """Values of the sorted keys, ``default`` where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class MergeTransducer:
    """Counts the tokens of pretokens' bytes by compiled transitions."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[bytes, bytes], int], pair_bits: int = 21) -> None:
        self.merges = merges
        node = {b"": 0}
        for t in tokens:
            for i in range(1, len(t) + 1):
                node.setdefault(t[:i], len(node))
        spelled = list(node)
        count = len(spelled)
        edges = np.array([node[s[:-1]] << 8 | s[-1] for s in spelled[1:]], np.int64)
        order = np.argsort(edges)
        self.edges, self.targets = edges[order], (order + 1).astype(np.int64)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.token = np.array([tokens.get(s, -1) for s in spelled], np.int64)
        self.shorter = np.zeros(count, np.int64)  # the longest shorter beginning at the end
        self.longest, self.next = np.zeros(count, np.int64), np.zeros(count, np.int64)  # tokens that end here
        for s, n in sorted(node.items(), key=lambda x: len(x[0])):
            if n:
                i = 1
                while s[i:] not in node:
                    i += 1
                self.shorter[n] = back = node[s[i:]]
                self.next[n] = self.longest[back]
                self.longest[n] = n if s in tokens else self.longest[back]
        self.text = {i: t for t, i in tokens.items()}
        size = max(tokens.values()) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for (a, b), rank in reversed(merges.items()):  # of equal results the first merge counts
            t = tokens[a + b]
            self.rank[t], self.left[t], self.right[t] = rank, tokens[a], tokens[b]
        pairs = np.array([tokens[a] << 20 | tokens[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.fromiter(merges.values(), np.int64, len(merges))[order]
        self.whole = np.full(size, -1, np.int8)  # whether a token is the encoding of its bytes; -1 unknown
        self.bits = pair_bits
        self.met, self.fits = np.full(1 << pair_bits, -1, np.int64), np.zeros(1 << pair_bits, bool)

    @classmethod
    def of_file(cls, path: str) -> tuple[MergeTransducer, list[str]]:
        """From a tokenizer file; also its special strings."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in shown_bytes().items()}
        raw = lambda s: bytes(byte[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        return cls(tokens, merges), special

    def merged(self, data: bytes) -> list[bytes]:
        """The plain merge loop; runs only on single tokens' bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.merges.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between two finished tokens, for each pair.

        Runs time backwards: undo the merge that made the younger border token, and see
        whether a merge across the border would have come before it. Of equal merges the
        left one comes first.
        """
        out = np.zeros(len(left), bool)
        lane, before = np.arange(len(left)), np.full(len(left), NEVER)
        while len(lane):
            crossed = lookup(self.pairs, self.pair_ranks, left << 20 | right, NEVER) < before
            made_left, made_right = self.rank[left], self.rank[right]
            done = (made_left < 0) & (made_right < 0)
            out[lane[done & ~crossed]] = True
            undo = made_left > made_right
            before = np.where(undo, made_left, made_right + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
            on = ~(crossed | done)
            lane, left, right, before = lane[on], left[on], right[on], before[on]
        return out

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``right`` may be the next token after ``left`` (-1: at the beginning)."""
        for t in np.unique(right[self.whole[right] < 0]).tolist():
            self.whole[t] = self.merged(self.text[t]) == [self.text[t]]
        out = self.whole[right] > 0
        ask = np.flatnonzero(out & (left >= 0))
        key = left[ask] << 20 | right[ask]
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        fresh = np.flatnonzero(self.met[slot] != key)
        if len(fresh):
            new, at = np.unique(key[fresh], return_index=True)
            fit = self.apart(new >> 20, new & 0xFFFFF)
            known = self.fits[slot]
            known[fresh] = fit[np.searchsorted(new, key[fresh])]
            self.met[slot[fresh[at]]], self.fits[slot[fresh[at]]] = new, fit
            # Of pairs that share a slot one is remembered; keep key and answer of the same one.
            self.fits[slot[fresh[at]]] = lookup(new, fit, self.met[slot[fresh[at]]], 0).astype(bool)
            out[ask] = known
        else:
            out[ask] = self.fits[slot]
        return out

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        lane = np.arange(len(state))
        while len(lane):
            found = lookup(self.edges, self.targets, state << 8 | byte, 0)
            out[lane] = found
            on = (found == 0) & (state > 0)
            lane, state, byte = lane[on], self.shorter[state[on]], byte[on]
        return out

    def lanes(self, pieces: list[bytes]) -> np.ndarray:
        """Counts of pretokens, all stepped side by side; the longest first."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer(b"".join(pieces[i] for i in order.tolist()), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        register = begin + np.arange(len(sizes))  # one more place than bytes each
        last, count = np.full(len(flat) + len(sizes), -1, np.int64), np.zeros(len(flat) + len(sizes), np.int64)
        state = np.zeros(len(sizes), np.int64)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -j, "left"))
            state = self.step(state[:live], flat[begin[:live] + j])
            here, node, lane = register[:live] + j + 1, self.longest[state], np.arange(live)
            while len(lane):
                if not node.all():
                    raise ValueError("the vocabulary lacks a byte")
                back = here[lane] - self.lengths[node]
                token = self.token[node]
                fit = self.follows(last[back], token)
                at = here[lane[fit]]
                last[at], count[at] = token[fit], count[back[fit]] + 1
                lane, node = lane[~fit], self.next[node[~fit]]
        out = np.zeros(len(sizes), np.int64)
        out[order] = count[register + sizes]
        return out

    def alone(self, data: bytes) -> int:
        """The count of one long pretoken, by the same transitions byte by byte."""
        last, count, state = np.full(len(data) + 1, -1, np.int64), [0] * (len(data) + 1), 0
        moves: dict[tuple[int, int], int] = {}
        fits: dict[tuple[int, int], bool] = {}
        for j, byte in enumerate(data, 1):
            if (state, byte) not in moves:
                moves[state, byte] = int(self.step(np.array([state]), np.array([byte]))[0])
            state = moves[state, byte]
            node = int(self.longest[state])
            while True:
                back, token = j - int(self.lengths[node]), int(self.token[node])
                pair = int(last[back]), token
                if pair not in fits:
                    fits[pair] = bool(self.follows(last[back : back + 1], self.token[node : node + 1])[0])
                if fits[pair]:
                    break
                node = int(self.next[node])
            last[j], count[j] = token, count[back] + 1
        return count[-1]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        short = [i for i, p in enumerate(pieces) if len(p) <= LANE]
        out[short] = self.lanes([pieces[i] for i in short])
        for i, p in enumerate(pieces):
            if len(p) > LANE:
                out[i] = self.alone(p)
        return out


class TokenCounter:
    """Whole-text token counts of a byte-level vocabulary file."""

    def __init__(self, path: str, most_kept: int = 1_000_000) -> None:
        self.splitter = Splitter()
        self.transducer, self.special = MergeTransducer.of_file(path)
        self.known: dict[int, int] = {}  # hash of a pretoken -> its tokens
        self.most_kept = most_kept

    def segments(self, text: str) -> list[str]:
        """The text between special strings, which are one token each."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        return parts

    def counts(self, texts: list[str], most_chars: int = 1_000_000) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            own = self.segments(text)
            out[i] = len(own) - 1
            for p in own:
                if p:
                    parts.append(p)
                    owner.append(i)
                    held += len(p) + 1
            if held >= most_chars:
                self.flush(parts, owner, out)
                parts, owner, held = [], [], 0
        if parts:
            self.flush(parts, owner, out)
        return out

    def flush(self, parts: list[str], owner: list[int], out: np.ndarray) -> None:
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins = np.flatnonzero(self.splitter.boundaries(self.splitter.symbols(points, ends)))
        is_end = np.zeros(len(points), bool)
        is_end[ends] = True
        real = np.flatnonzero(~is_end[begins[:-1]])
        starts, stops = begins[real], begins[real + 1]
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        code, keys = pd.factorize(mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        if len(self.known) > self.most_kept:
            self.known.clear()
        names = keys.tolist()
        counts = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(counts < 0)
        if len(new):
            some = np.zeros(len(names), np.int64)
            some[code] = np.arange(len(code))  # a place of each distinct pretoken
            a, b = starts[some[new]].tolist(), stops[some[new]].tolist()
            counts[new] = self.transducer.counts([joined[x:y].encode("utf-8", "surrogatepass") for x, y in zip(a, b, strict=True)])
            self.known.update(zip([names[i] for i in new.tolist()], counts[new].tolist(), strict=True))
        done = np.concatenate([[0], np.cumsum(counts[code])])
        each = np.diff(done[np.searchsorted(starts, np.concatenate([[0], ends]))])
        np.add.at(out, np.asarray(owner), each)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter of a vocabulary file, compiled once."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    * null and empty texts have 0 bytes and 0 tokens; special strings inside a text are
      one token each; nothing is added, truncated or padded;
    * texts of any length are cut into chunks inside the task; no shuffle, no join;
    * repeated rows are counted each; an empty table gives no rows; other columns are
      ignored, whatever their names.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for texts in batches:
            yield pd.Series(own.counts(texts.tolist()))

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    counted = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
