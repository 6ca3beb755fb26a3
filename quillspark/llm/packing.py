"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Items are dealt at random into blocks of a few thousand. Several islands evolve each block: a child
takes whole well-filled bins of one parent, bins of the other that hold the same items are dissolved,
and the items so displaced are best-fitted. After each epoch the best solution of an island moves to
the next island of its block. The badly filled bins of all blocks are then dissolved and packed
together in a further, much smaller level, so that blocks cost no sequences.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import bounded_batches, joined, picked
from .tokens import ENCODED_BYTES, crc, encoder


@dataclass(frozen=True)
class Evolution:
    block: int = 2048
    islands: int = 3
    epochs: int = 2
    population: int = 4
    generations: int = 6
    #: Bins filled to less than this share are dissolved and packed again across blocks.
    keep_fill: float = 0.995
    levels: int = 4


class Bins:
    """Bins of one solution: item lists and free places, found by size of the free place."""

    __slots__ = ("by_free", "capacity", "items", "mask", "room", "sizes")

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit f is set while some bin has f free places

    def add(self, items: list[int], free: int) -> None:
        at = len(self.items)
        self.items.append(items)
        self.room.append(free)
        self.by_free[free].append(at)
        self.mask |= 1 << free

    def best_fit(self, item: int) -> None:
        """Put the item where the least room is left, or into a new bin."""
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.add([item], self.capacity - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.items[at].append(item)
        left = free - size
        self.room[at] = left
        self.by_free[left].append(at)
        self.mask |= 1 << left

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then more uneven ones, whose leftovers take more."""
        return len(self.items), -sum(f * f for f in self.room)


def best_fit_decreasing(sizes: list[int], capacity: int, order: list[int] | None = None) -> Bins:
    bins = Bins(sizes, capacity)
    for i in order or sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins.best_fit(i)
    return bins


def crossover(taker: Bins, giver: Bins, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of ``giver`` into ``taker``, then best-fit what that displaces."""
    ranked = sorted(range(len(giver.items)), key=lambda b: (giver.room[b], rng.random()))
    injected = ranked[: rng.randint(1, max(1, len(ranked) // 2))]
    child, taken = Bins(taker.sizes, taker.capacity), set()
    for b in injected:
        child.add(list(giver.items[b]), giver.room[b])
        taken.update(giver.items[b])
    displaced: list[int] = []
    for items, room in zip(taker.items, taker.room):
        if taken.isdisjoint(items):
            if room and rng.random() < 0.2:  # a badly filled bin may be dissolved too
                displaced += items
            else:
                child.add(list(items), room)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: -child.sizes[i])
    for i in displaced:
        child.best_fit(i)
    return child


def from_assignment(sizes: list[int], capacity: int, places: list[int]) -> Bins:
    bins, grouped = Bins(sizes, capacity), {}
    for i, b in enumerate(places):
        grouped.setdefault(b, []).append(i)
    for items in grouped.values():
        bins.add(items, capacity - sum(sizes[i] for i in items))
    return bins


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[list[int]], how: Evolution) -> Bins:
    """One island's epoch; it ends early when no fewer bins are possible."""
    least = -(-sum(sizes) // capacity)
    rng = random.Random(seed)
    population = [from_assignment(sizes, capacity, g) for g in guests]
    if not population:
        population.append(best_fit_decreasing(sizes, capacity))
    while len(population) < how.population and min(len(p.items) for p in population) > least:
        jitter = [s * (1 + 0.1 * rng.random()) for s in sizes]
        population.append(best_fit_decreasing(sizes, capacity, sorted(range(len(sizes)), key=lambda i: -jitter[i])))
    population.sort(key=Bins.fitness)
    for _ in range(how.generations):
        if len(population[0].items) <= least or len(population) < 2:
            break
        a, b = rng.sample(range(len(population)), 2)
        for taker, giver in ((a, b), (b, a)):
            population.append(crossover(population[taker], population[giver], rng))
        population = sorted(population, key=Bins.fitness)[: how.population]
    return population[0]


def _places(bins: Bins) -> list[int]:
    places = [0] * len(bins.sizes)
    for b, items in enumerate(bins.items):
        for i in items:
            places[i] = b
    return places


def _epoch(islands: DataFrame, capacity: int, epoch: int, how: Evolution) -> DataFrame:
    """``islands``: block, island, lengths, guests (assignments). Adds the island's best as ``places``."""

    def run(batches):
        import pyarrow as pa

        names = ["block", "island", "lengths", "places", "n_bins", "slack"]
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["lengths"]
                best = evolve(sizes, capacity, hash((row["block"], row["island"], epoch)), row["guests"] or [], how)
                n, slack = best.fitness()
                one = [[row["block"]], [row["island"]], [sizes], [_places(best)], [n], [slack]]
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds)], names=names)

    return islands.mapInArrow(run, "block long, island int, lengths array<int>, places array<int>, n_bins int, slack long")


def pack_items(items: DataFrame, capacity: int, length_col: str = "length", how: Evolution = Evolution()) -> DataFrame:
    """Every row with ``sequence_id`` (long) and ``offset`` (long) added.

    ``items`` must be a table that reads the same each time (a written one) and have a unique pair of
    columns ``part`` and ``seq``. Lengths from 1 to ``capacity`` are packed; a null length, or one out
    of that range, is an error. An empty table stays empty. Rows that are equal but for their place
    are packed one by one.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    payload = [c for c in items.columns]
    length = F.col(length_col)
    length = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.concat(F.lit("length out of range: "), F.coalesce(length.cast("string"), F.lit("null")))))
    rows = items.withColumn(length_col, length.cast("int"))
    whole = rows.filter(length == capacity).withColumn("sequence_id", -(F.col("part").cast("long") * (1 << 32) + F.col("seq") + 1)).withColumn("offset", F.lit(0).cast("long"))
    left, done = rows.filter(length < capacity), [whole]
    for level in range(how.levels):
        count = left.count()
        if not count and level:
            break
        blocks = max(1, -(-count // how.block))
        dealt = left.withColumn("block", F.pmod(F.xxhash64("part", "seq", F.lit(level)), F.lit(blocks)))
        packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "seq", F.struct(*payload).alias("row")))).alias("rows"))
        table = scratch.keep(packed.select("block", F.col(f"rows.row.{length_col}").alias("lengths"), "rows.row"), f"blocks{level}")
        islands = table.select("block", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"), "lengths", F.lit(None).cast("array<array<int>>").alias("guests"))
        for epoch in range(how.epochs):
            best = scratch.keep(_epoch(islands.repartition("block", "island"), capacity, epoch, how), f"epoch{level}_{epoch}")
            moved = best.select("block", F.pmod(F.col("island") + 1, F.lit(how.islands)).cast("int").alias("island"), F.col("places").alias("guest"))
            islands = best.join(moved, ["block", "island"]).select("block", "island", "lengths", F.array("places", "guest").alias("guests"))
        final = best.groupBy("block").agg(F.min_by("places", F.struct("n_bins", "slack", "island")).alias("places"))
        laid = table.join(final, "block").select("block", F.explode(F.arrays_zip("row", "places")).alias("z")).select("block", "z.row.*", F.col("z.places").alias("bin"))
        last = blocks == 1 or level == how.levels - 1
        laid = _offsets(laid, length_col, capacity, last, how)
        laid = scratch.keep(laid, f"laid{level}")
        settled = laid if last else laid.filter("settled")
        sequence = F.lit(level << 58) + F.col("block") * (1 << 20) + F.col("bin")
        done.append(settled.select(*payload, sequence.alias("sequence_id"), "offset"))
        if last:
            break
        left = laid.filter(~F.col("settled")).select(*payload)
    out = done[0].select(*payload, "sequence_id", "offset")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _offsets(laid: DataFrame, length_col: str, capacity: int, last: bool, how: Evolution) -> DataFrame:
    """Places within the bins, and whether a bin is full enough to stay."""
    from pyspark.sql.window import Window

    bin_ = Window.partitionBy("block", "bin")
    before = bin_.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    fill = F.sum(length_col).over(bin_)
    return laid.withColumn("offset", F.coalesce(F.sum(length_col).over(before), F.lit(0)).cast("long")).withColumn("settled", F.lit(True) if last else fill >= capacity * how.keep_fill)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32, part, seq``.

    Each document ends with ``end_id``; a null text is an empty one, a piece of one id. A longer
    document is cut so that only its first piece is short. ``part`` and ``seq`` number the rows made.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        part, seq, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in joined(batches, ENCODED_BYTES):
            out: list[list] = [[] for _ in names]
            found, ends = enc.encode_column(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids = found[a:b].tobytes() + end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    row = (doc_id, piece, start, size, crc(ids[4 * start : 4 * (start + size)]), part, seq)
                    for column, value in zip(out, row):
                        column.append(value)
                    start, piece, seq = start + size, piece + 1, seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=names)

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", how: Evolution = Evolution()) -> DataFrame:
    """Pieces of all documents with the sequence each lies in and its offset there.

    Null ids, repeated rows and ids, and empty texts are all packed; an empty table gives no rows.
    """
    table = Scratch(docs.sparkSession, "pieces").keep(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    packed = pack_items(table, capacity, how=how)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
