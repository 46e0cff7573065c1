"""Packing of documents into fixed-length sequences by swap-based local search.

Every document becomes token pieces; only documents above the capacity are cut. Pieces
are dealt by hash over shelves of about ``shelf_pieces``, each packed in one task. The
search starts from next fit in order of arrival and goes on while a change between two
underfull bins raises the sum of squared fills: a piece moves, one piece is exchanged for
one, or two for one, always from the emptier to the fuller bin and to where the least
room is left. Bins empty and go. It ends at a fixed point, where no such change is left,
or when as few bins are left as the tokens need at least. A shelf ends with at most a bin
or so more than one packing of all pieces, a share of 1 / (bins of a shelf).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.llm.tokens import token_ids


def next_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions in order of arrival; a bin closes when an item does not fit."""
    bins: list[list[int]] = []
    room = -1
    for i, size in enumerate(sizes):
        if size > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= size
    return bins


class Places:
    """Members by a number up to the capacity; finds the least number at or above another."""

    def __init__(self, capacity: int) -> None:
        self.at: list[list] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit n: some member has number n

    def add(self, n: int, member) -> None:
        insort(self.at[n], member)
        self.used |= 1 << n

    def drop(self, n: int, member) -> None:
        own = self.at[n]
        del own[bisect_left(own, member)]
        if not own:
            self.used &= ~(1 << n)

    def upward(self, n: int) -> Iterator[int]:
        left = self.used >> n
        while left:
            step = (left & -left).bit_length() - 1
            yield n + step
            left = left >> step + 1
            n += step + 1


class LocalSearch:
    """Underfull bins, changed step by step; every step raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins = [sorted(b, key=sizes.__getitem__) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.rooms = Places(capacity)  # bins by their room
        self.swaps = Places(capacity)  # (size, item, bin) by the largest size that could take the item's place
        self.left = len(bins)
        for b in range(len(bins)):
            self.enter(b)

    def enter(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.bins[b]:
            self.rooms.add(room, b)
            for i in self.bins[b]:
                self.swaps.add(self.sizes[i] + room, (self.sizes[i], i, b))

    def leave(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.bins[b]:
            self.rooms.drop(room, b)
            for i in self.bins[b]:
                self.swaps.drop(self.sizes[i] + room, (self.sizes[i], i, b))

    def change(self, give: int, take: int, out: list[int], back: int | None) -> None:
        for b in (give, take):
            self.leave(b)
        for i in out:
            self.bins[give].remove(i)
            self.bins[take].append(i)
        if back is not None:
            self.bins[take].remove(back)
            self.bins[give].append(back)
        for b in (give, take):
            self.bins[b].sort(key=self.sizes.__getitem__)
            self.fill[b] = sum(self.sizes[i] for i in self.bins[b])
            self.enter(b)
        self.left -= not self.bins[give]

    def moved(self, give: int) -> bool:
        """The largest piece that fits elsewhere goes where it leaves the least room."""
        for i in reversed(self.bins[give]):
            size = self.sizes[i]
            for room in self.rooms.upward(size):
                for take in self.rooms.at[room]:
                    if take != give and self.fill[take] + size > self.fill[give]:
                        self.change(give, take, [i], None)
                        return True
        return False

    def exchanged(self, give: int, out: list[int]) -> bool:
        """``out`` takes the place of one smaller piece of a bin that ends above this one."""
        size = sum(self.sizes[i] for i in out)
        if size > self.capacity:
            return False
        for most in self.swaps.upward(size):
            if self.capacity - (most - size) <= self.fill[give]:
                return False  # from here on bins would end no fuller than this one
            for other, i, take in self.swaps.at[most]:
                if other >= size:
                    break
                if take != give:
                    self.change(give, take, out, i)
                    return True
        return False

    def step(self, give: int) -> bool:
        if self.moved(give):
            return True
        own = self.bins[give]
        if any(self.exchanged(give, [i]) for i in reversed(own)):
            return True
        return any(self.exchanged(give, [own[a], own[b]]) for b in range(len(own) - 1, 0, -1) for a in range(b - 1, -1, -1))

    def run(self) -> list[list[int]]:
        least = -(-sum(self.sizes) // self.capacity)
        changed = True
        while changed and self.left > least:
            changed = False
            for give in sorted((b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity), key=self.fill.__getitem__):
                while self.bins[give] and self.fill[give] < self.capacity and self.left > least and self.step(give):
                    changed = True
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins at a fixed point of the exchanges and moves."""
    return LocalSearch(bins, sizes, capacity).run()


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row's tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out = batch["id"].array, []
            for k, own in enumerate(token_ids(vocabulary, batch["text"].tolist())):
                data = np.append(own, np.uint32(end_id)).astype("<u4", copy=False)
                for piece, at in enumerate(range(0, len(data), capacity)):
                    part = data[at : at + capacity]
                    out.append((k, piece, at, len(part), zlib.crc32(part)))
            table = np.array(out, np.int64).reshape(-1, 5)
            yield pd.DataFrame({"id": ids[table[:, 0]], "piece": table[:, 1].astype(np.int32), "start": table[:, 2], "length": table[:, 3], "ids_crc32": table[:, 4]})

    return docs.mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    shelf_pieces: int = 12_000,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    * a document's tokens are its ids and one ``end_id``; a null or empty text is one
      piece of length 1;
    * sequences hold at most ``capacity`` tokens, offsets run gapless from 0; sequence
      ids are unique, not dense;
    * rows that repeat an id are packed each; a null id stays null; an empty table gives
      no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = stored(token_pieces(rows, vocabulary, capacity, end_id), "pieces")
    shelves = max(1, pieces.count() // shelf_pieces)
    # The row's number deals out rows that are equal in all columns.
    dealt = pieces.withColumn("shelf", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shelves)))

    def pack(shelf: pd.DataFrame) -> pd.DataFrame:
        shelf = shelf.sort_values(["id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        sizes = shelf["length"].tolist()
        bins = local_search(next_fit(sizes, capacity), sizes, capacity)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = b, at
                at += sizes[i]
        shelf["sequence_id"] = sequence + (shelf["shelf"].to_numpy(np.int64) << 32)
        shelf["offset"] = offset
        return shelf.drop(columns="shelf")

    packed = dealt.groupBy("shelf").applyInPandas(
        pack, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return packed.withColumnRenamed("id", id_col)
