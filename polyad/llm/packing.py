"""Filling containers of one capacity with items of whole-number sizes.

Items of one size are alike, so a packing is decided on the counts per size: a table of ``capacity`` rows
at most, however many items there are. On it, Martello and Toth's reduction first fixes sets of up to
three items that dominate every other set holding their largest item (some optimal packing contains
them); what is left is filled by best fit, largest sizes first. The result is a short list of runs, each
giving consecutive items of a size their containers, and every item finds its run by its number among
the items of its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.balance import number_rows
from polyad.runtime import bounded_rows, cut

#: The largest capacity; the table of counts per size that reaches the driver has no more rows.
LARGEST = 1_000_000


@dataclass
class Runs:
    """``n`` items of ``size``, from number ``first`` on, go ``per`` each into the containers from ``container`` on."""

    size: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    used: Counter = field(default_factory=Counter)
    containers: int = 0
    fixed: int = 0

    def put(self, size: int, containers: int, per: int, at: int) -> None:
        self.size.append(size)
        self.first.append(self.used[size])
        self.n.append(containers * per)
        self.container.append(at)
        self.per.append(per)
        self.used[size] += containers * per

    def fix(self, items: Counter, times: int) -> None:
        """Close ``times`` containers that hold ``items`` each."""
        for size, per in items.items():
            self.put(size, times, per, self.containers)
        self.containers += times
        self.fixed += times


class _Left:
    """The items not yet placed: distinct sizes in order, and their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.n)

    def take(self, items: Counter, times: int) -> None:
        for size, per in items.items():
            self.n[size] -= per * times
            if not self.n[size]:
                del self.n[size]
                self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, room: int, without: Counter) -> int | None:
        """The largest size <= room of which an item is there besides ``without``."""
        k = bisect_left(self.sizes, room + 1) - 1
        while k >= 0 and self.n[self.sizes[k]] <= without[self.sizes[k]]:
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def smallest(self, how_many: int, without: Counter, above: int = 0) -> list[int]:
        """The smallest items larger than ``above``."""
        found: list[int] = []
        k = bisect_left(self.sizes, above + 1)
        while k < len(self.sizes) and len(found) < how_many:
            size = self.sizes[k]
            found += [size] * min(how_many - len(found), self.n[size] - without[size])
            k += 1
        return found

    def pair_sums(self, capacity: int) -> np.ndarray:
        """For every room up to the capacity, the ordered pairs of sizes of which two items have a sum <= room.

        All sums of two sizes at once are the product of the sizes' indicator with itself, by a fast
        Fourier transform. Items that are taken later only make the true numbers smaller.
        """
        held = np.zeros(capacity + 1)
        held[self.sizes] = 1.0
        width = 1 << (2 * capacity + 1).bit_length()
        ways = np.rint(np.fft.irfft(np.fft.rfft(held, width) ** 2, width)[: capacity + 1]).astype(np.int64)
        single = 2 * np.array([s for s, n in self.n.items() if n == 1 and 2 * s <= capacity], dtype=np.int64)
        ways[single] -= 1  # one item is no pair
        return np.cumsum(ways)

    def has_pair(self, least: int, room: int, size: int, sums: np.ndarray) -> bool:
        """Whether two items besides one of ``size`` have a sum in (``least``, ``room``], by all pairs less those that need this one."""
        pairs, both = int(sums[room] - sums[least]), least < 2 * size <= room
        if self.n[size] == 1:
            pairs -= 2 * (bisect_left(self.sizes, room - size + 1) - bisect_left(self.sizes, least - size + 1) - both)
        elif self.n[size] == 2:
            pairs -= both
        return pairs > 0


def dominating_set(left: _Left, size: int, capacity: int, sums: np.ndarray | None = None) -> Counter | None:
    """A set that holds an item of ``size`` and dominates every feasible set that does, if one of up to three items is known to.

    A set dominates another if the other's items can be parted so that each part is matched by an item
    of the set that is no smaller than the part's sum. ``sums`` are the pair sums of these items; with
    those of more items a set may be missed, never a wrong one found.
    """
    own = Counter([size])
    room = capacity - size
    best = left.largest(room, own)
    if best is None:
        return own
    if best == room:
        return own + Counter([best])
    low = left.smallest(3, own)
    if len(low) < 2 or low[0] + low[1] > room:  # no more than one item fits beside it
        return own + Counter([best])
    if len(low) == 3 and sum(low) <= room:
        return None
    pair = own + Counter([best])
    third = left.largest(room - best, pair)
    if third is None:
        return None if left.has_pair(best, room, size, left.pair_sums(capacity) if sums is None else sums) else pair
    # Two items larger than the third have a sum of low[1] + low[2] at least, more than room - low[0] and
    # so more than the best, which leaves room for the third: only whether two of them fit is open.
    two = left.smallest(2, own, third)
    return None if len(two) == 2 and sum(two) <= room else pair + Counter([third])


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing of items of these sizes has fewer containers."""
    if not counts:
        return 0
    n = np.zeros(capacity + 2, dtype=np.int64)
    n[list(counts)] = list(counts.values())
    number, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    a = np.arange(capacity // 2 + 1)  # items above capacity - a stand alone, those below a don't count
    alone = number[capacity] - number[capacity - a]
    half = capacity // 2
    large = number[capacity - a] - number[half]
    room = large * capacity - (volume[capacity - a] - volume[half])
    rest = volume[half] - np.where(a > 0, volume[a - 1], 0)
    return int((alone + large + np.maximum(0, -(-(rest - room) // capacity))).max())


def plan(counts: dict[int, int], capacity: int) -> Runs:
    """Runs that place ``counts[size]`` items of every size (1..capacity).

    The reduction goes over the sizes, largest first, until a pass fixes nothing: its pair sums are those
    of the items left, so no size has a dominating set any more. What isn't fixed is packed by best fit.
    """
    if any(not 0 < s <= capacity for s in counts):
        raise InvalidParameterError("sizes must lie between 1 and the capacity")
    left, runs = _Left(counts), Runs()
    changed = True
    while changed:  # a set that is fixed uses a size up, all but one item at most
        changed, sums = False, left.pair_sums(capacity)
        for size in reversed(left.sizes.copy()):
            while size in left.n and (found := dominating_set(left, size, capacity, sums)):
                times = min(left.n[s] // per for s, per in found.items())
                left.take(found, times)
                runs.fix(found, times)
                changed = True
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def keep(room: int, at: int, n: int) -> None:
        if n and room:
            if room not in open_bins:
                insort(rooms, room)
            open_bins.setdefault(room, []).append((at, n))

    for size in reversed(left.sizes):
        n = left.n[size]
        while n:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                at, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[k]
            else:
                room, bins = capacity, -(-n // (capacity // size))
                at = runs.containers
                runs.containers += bins
            per = room // size
            whole = min(bins, n // per)
            if whole:
                runs.put(size, whole, per, at)
                keep(room - per * size, at, whole)
                n -= whole * per
            rest = bins - whole
            if rest and n:
                runs.put(size, 1, n, at + whole)
                keep(room - n * size, at + whole, 1)
                n, rest, whole = 0, rest - 1, whole + 1
            keep(room, at + whole, rest)
    return runs


def _assign(runs: Runs):
    order = np.lexsort((runs.first, runs.size))
    size, first, container, per = (np.array(x, dtype=np.int64)[order] for x in (runs.size, runs.first, runs.container, runs.per))
    starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]) if len(size) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            out = np.empty(len(sizes), dtype=np.int64)
            by_size = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(sizes[by_size]) != 0]) if len(sizes) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(sizes)]):
                at = by_size[a:b]
                k = np.searchsorted(size[starts], sizes[at[0]])
                mine = slice(starts[k], ends[k])
                found = np.searchsorted(first[mine], ranks[at], side="right") - 1
                out[at] = container[mine][found] + (ranks[at] - first[mine][found]) // per[mine][found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["item", "size", "container"])

    return run


def _parted(items: DataFrame, capacity: int, item: str, size: str) -> DataFrame:
    """``item``, ``size``, the containers it fills as a ``whole``, and the ``rest``."""
    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    whole = F.when(F.col("size") > capacity, F.expr(f"size div {capacity}")).otherwise(F.lit(0))
    return rows.withColumn("whole", whole).withColumn("rest", F.col("size") - F.col("whole") * capacity)


def _counts(rows: DataFrame, capacity: int) -> dict[int, int]:
    return {r.rest: r.n for r in bounded_rows(rows.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")), capacity, "sizes")}


def pack(items: DataFrame, capacity: int, *, item: str = "item", size: str = "size") -> DataFrame:
    """Containers for ``items``: ``item``, ``part``, ``size`` and ``container`` (BIGINT, numbered from 0).

    An item that fits is never split: one row, ``part`` 0. One that exceeds the capacity by itself fills
    containers of its own, and its rest is an item like the others: its rows are the parts 0, 1, ...
    An item of size 0 or null takes no room and has one row with ``container`` null. Repeated rows are
    items of their own; other columns are dropped. ``items`` is read several times and should be a
    table. Only the counts per size, at most ``capacity`` rows, reach the driver.
    """
    if not 1 <= capacity <= LARGEST:
        raise InvalidParameterError(f"the capacity must lie between 1 and {LARGEST}")
    rows = _parted(items, capacity, item, size)
    runs = plan(_counts(rows, capacity), capacity)
    kind = rows.schema["item"].dataType.simpleString()
    numbered = number_rows(rows.where("rest > 0"), "rest", columns=["item", "whole"])
    rests = numbered.select(F.struct("item", "whole").alias("item"), F.col("__key").alias("size"), F.col("__row").alias("rank"))
    rests = rests.mapInArrow(_assign(runs), f"item struct<item:{kind},whole:bigint>, size bigint, container bigint")
    rests = rests.select(F.col("item.item").alias("item"), F.col("item.whole").alias("part"), "size", "container")
    split = number_rows(rows.where("whole > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part")), F.lit(0), columns=["item", "part"])
    split = split.select("item", F.col("part").cast("bigint").alias("part"), F.lit(capacity).cast("bigint").alias("size"), (F.col("__number") + runs.containers).alias("container"))
    nothing = rows.where("size <= 0").select("item", F.lit(0).cast("bigint").alias("part"), "size", F.lit(None).cast("bigint").alias("container"))
    return rests.unionByName(split).unionByName(nothing).withColumnRenamed("item", item)


def _measured(documents: DataFrame, containers: DataFrame, id_column: str, text_column: str, folder: str | None) -> list[tuple]:
    """The usable rows of ``containers``, each with the documents' sizes in its tokenizer's tokens."""
    from polyad.llm.tokens import count_corpus

    settings = [r for r in bounded_rows(containers.select("container", "capacity", "tokenizer"), 100, "kinds of containers") if r.tokenizer and (r.capacity or 0) >= 1]
    measured = {name: cut(count_corpus(documents, name, id_column=id_column, text_column=text_column, folder=folder)) for name in sorted({r.tokenizer for r in settings})}
    return [(r, measured[r.tokenizer]) for r in settings]


def packing_report(documents: DataFrame, containers: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """One row per kind of container: ``kind``, ``capacity``, ``n_tokens``, ``n_containers``, ``n_least`` (no packing has fewer), ``n_fixed`` by the reduction, and ``fill``, the share of room in use."""
    rows = []
    for r, sizes in _measured(documents, containers, id_column, text_column, folder):
        parted = _parted(sizes, r.capacity, id_column, "n_tokens")
        counts, (tokens, whole) = _counts(parted, r.capacity), parted.agg(F.sum("size"), F.sum("whole")).first()
        runs, whole, tokens = plan(counts, r.capacity), int(whole or 0), int(tokens or 0)
        n = runs.containers + whole
        rows.append((r.container, int(r.capacity), tokens, n, lower_bound(counts, r.capacity) + whole, runs.fixed, tokens / (n * r.capacity) if n else None))
    return documents.sparkSession.createDataFrame(rows, "kind string, capacity bigint, n_tokens bigint, n_containers bigint, n_least bigint, n_fixed bigint, fill double")


def pack_documents(documents: DataFrame, containers: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """Documents in the containers of every row of ``containers`` (``container``, ``capacity``, ``tokenizer``).

    Result: ``kind`` (the container's name), ``doc_id``, ``part``, ``n_tokens`` and ``container``; see
    ``pack``. ``containers`` is a small table of settings, 100 rows at most; rows without a capacity of
    at least 1 or without tokenizer are left out. Each tokenizer measures the corpus once.
    """
    parts = []
    for r, sizes in _measured(documents, containers, id_column, text_column, folder):
        packed = pack(sizes, r.capacity, item=id_column, size="n_tokens")
        parts.append(packed.select(F.lit(r.container).alias("kind"), id_column, "part", F.col("size").alias("n_tokens"), "container"))
    if not parts:
        raise InvalidParameterError("no container with a capacity and a tokenizer")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
