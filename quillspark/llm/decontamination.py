"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Items and item-sized windows of documents are sequences of words. The CGK random walk embeds a
sequence of n words in 3n steps: each step emits the word under a pointer, which a random bit of (step,
word) may advance, so that it passes all n words; sequences a few edits apart so become sequences a few positions apart. Each of
``repeats`` hash tables samples positions of the embedding as its key; an item and a window that share
a key are verified by their word edit distance.

Windows start at every word, but only those are embedded that can be within the distance: each edit
changes three word triples at most, so a window with fewer benchmark triples than an item of its
length must keep is left out without loss. (Very short items use pairs or words.)
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, picked

#: Texts whose windows are embedded together.
SLICE = 256
_WORDS = re.compile(r"\w+").findall


@dataclass(frozen=True)
class Search:
    #: Word edits up to this share of the item's words count as the same passage.
    edit_share: float = 0.2
    #: Positions sampled for each key, and keys of each walk.
    positions: int = 3
    repeats: int = 12
    walks: int = 4
    #: Items of one pass over the documents; more items take more passes.
    block_items: int = 20_000
    seed: int = 5


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def edits(a, b, most: int) -> int:
    """Word edits from ``a`` to the best prefix of ``b``, or ``most`` + 1 if there are more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row[max(0, lo - 1) : hi + 1]) > most:
            return most + 1
    return min(row)


def _mix(x):
    """Well-mixed 64-bit numbers (a finaliser with fixed odd multipliers)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Index:
    """Items of one block with their hash tables; made on the driver, sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], how: Search = Search()):
        import numpy as np

        self.how, self.vocabulary, self.items = how, {}, []
        for item_id, text in items:
            found = words(text)
            if found:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]))
        sizes = [len(i) for _, i in self.items]
        self.distinct = [frozenset(i) for _, i in self.items]
        self.allowed = [int(how.edit_share * n) for n in sizes]
        rng = np.random.default_rng(how.seed)
        self.grams = {q: np.unique(np.concatenate([np.zeros(0, np.int64), *[self._grams(np.array(i, np.int64), q) for _, i in self.items]])) for q in (1, 2, 3)}
        # Items of one length share samples, drawn over their whole walk; lengths of one power of two share walks.
        lengths: dict[int, list[int]] = {}
        for k, n in enumerate(sizes):
            lengths.setdefault(n, []).append(k)
        self.groups: list[list[tuple]] = []
        for n, members in sorted(lengths.items()):
            most = self.allowed[members[0]]
            q = next((q for q in (3, 2) if n + 1 - q - q * most > 0), 1)
            # By turns from the first, middle and last half of the walk: edits in one part leave the keys of another.
            half = max(1, 3 * n // 2)
            samples = [[np.sort(rng.choice(half, min(how.positions, half), replace=False)) + s % 3 * (3 * n - half) // 2 for s in range(how.repeats)] for _ in range(how.walks)]
            flat = np.array([[*self.items[k][1], 0] for k in members], np.int64).ravel()
            starts = np.arange(len(members)) * (n + 1)
            maps: dict[int, list[int]] = {}
            mixed = self._mixed(flat)
            for walk, sampled in enumerate(samples):
                made = self._keys(mixed, starts, starts + n, self._walk(mixed, starts, starts + n, walk, n), n, walk, sampled)
                for k, own in zip(members, made.tolist()):
                    for key in set(own):
                        maps.setdefault(key, []).append(k)
            if not self.groups or self.groups[-1][0][0].bit_length() < n.bit_length():
                self.groups.append([])
            self.groups[-1].append((n, n + most, q, max(1, n + 1 - q - q * most), samples, maps, np.array(sorted(maps), np.uint64)))

    @staticmethod
    def _grams(ids, q: int):
        """Runs of ``q`` words as one number each."""
        out = ids[: len(ids) + 1 - q] if len(ids) >= q else ids[:0]
        for j in range(1, q):
            out = out * (1 << 21) + ids[j : len(ids) + 1 - q + j]
        return out

    @staticmethod
    def _mixed(ids):
        import numpy as np

        return _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def _walk(mixed, starts, ends, walk: int, n: int):
        """How far from each start the pointer is at each of 3n steps; it reads no further than the end."""
        import numpy as np

        turns = _mix(np.arange(3 * n, dtype=np.uint64) + np.uint64((walk + 1) << 32)) | np.uint64(1)
        pointer, out = np.zeros(len(starts), np.int64), np.empty((3 * n, len(starts)), np.int32)
        for step in range(3 * n):
            out[step] = pointer
            pointer += (mixed[np.minimum(starts + pointer, ends)] * turns[step] >> np.uint64(63)).astype(np.int64)
        return out

    @staticmethod
    def _keys(mixed, starts, ends, pointers, n: int, walk: int, sampled, own=slice(None)):
        """Keys of the sequences of ``n`` words at the starts: one for each sample."""
        import numpy as np

        out = []
        for s, positions in enumerate(sampled):
            key = np.full(len(starts), walk * 1000 + s, np.uint64)
            for p in positions:
                key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[np.minimum(starts + np.minimum(pointers[p][own], n - 1), ends)]
            out.append(_mix(key))
        return np.array(out).T.reshape(len(starts), -1)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        return self.matches_of([text])[0]

    def matches_of(self, many: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text ``(item_id, edits, first word, words)`` of each item in it, at its best window.

        The windows of all the texts are embedded together, a few thousand at a time.
        """
        import numpy as np

        known = self.vocabulary.get
        # All texts in a row, each followed by a word that no item has.
        found = [words(text) for text in many]
        sizes = np.array([len(own) for own in found], np.int64)
        ids = np.fromiter(chain.from_iterable(chain(map(known, own, repeat(0)), (0,)) for own in found), np.int64, int(sizes.sum()) + len(many))
        firsts = np.cumsum(sizes + 1) - sizes - 1
        ends = np.repeat(firsts + sizes, sizes + 1)
        mixed = self._mixed(ids)
        best: list[dict[int, tuple[int, int]]] = [{} for _ in many]
        sums: dict[int, object] = {}
        for group in self.groups:
            admitted = []
            for q in sorted({q for _, _, q, *_ in group}):
                if q not in sums:
                    own, grams = self._grams(ids, q), self.grams[q]
                    held = grams[np.minimum(np.searchsorted(grams, own), len(grams) - 1)] == own if len(grams) else np.zeros(len(own), bool)
                    sums[q] = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])
                total = sums[q]
                tables = [t for t in group if t[2] == q]
                # Starts that any of the lengths may admit, then those of each length.
                last = np.minimum(ends[: len(total) - 1] + 1 - q, len(total) - 1)
                at = np.arange(len(total) - 1)
                some = np.flatnonzero(total[np.maximum(at, np.minimum(at + max(t[1] for t in tables) + 1 - q, last))] - total[:-1] >= min(t[3] for t in tables))
                for t in tables if len(some) else ():
                    starts = some[total[np.maximum(some, np.minimum(some + t[1] + 1 - q, last[some]))] - total[some] >= t[3]]
                    if len(starts):
                        admitted.append((t, starts))
            if admitted:
                union = np.unique(np.concatenate([starts for _, starts in admitted]))
                width = max(64, min(4096, (1 << 20) // admitted[-1][0][0]))
                for a in range(0, len(union), width):
                    self._verify(ids, mixed, firsts, ends, union[a : a + width], admitted, best)
        return [sorted((self.items[k][0], n, start, len(self.items[k][1])) for k, (n, start) in own.items()) for own in best]

    def _verify(self, ids, mixed, firsts, ends, union, admitted, best) -> None:
        """Embed the windows at these starts and check the items that share a key with one."""
        import numpy as np

        longest = max(t[0] for t, _ in admitted)
        shared: set[tuple[int, int]] = set()
        inside = [(t, np.flatnonzero(np.isin(union, starts, assume_unique=True))) for t, starts in admitted]
        for walk in range(self.how.walks):
            pointers = self._walk(mixed, union, ends[union], walk, longest)
            for (n, _, _, _, samples, maps, keys), own in inside:
                starts = union[own]
                made = self._keys(mixed, starts, ends[starts], pointers, n, walk, samples[walk], own)
                hit = keys[np.minimum(np.searchsorted(keys, made), len(keys) - 1)] == made
                for w, s in zip(*(x.tolist() for x in np.nonzero(hit))):
                    shared.update((int(starts[w]), k) for k in maps[int(made[w, s])])
        for start, k in sorted(shared):
            d = int(np.searchsorted(firsts, start, "right")) - 1
            own, at = best[d], start - int(firsts[d])
            if k in own and own[k][0] == 0:
                continue
            sequence, most = self.items[k][1], self.allowed[k]
            window = ids[start : min(start + len(sequence) + most, int(ends[start]))].tolist()
            if window[: len(sequence)] == sequence:
                n = 0
            elif len(self.distinct[k].difference(window)) > most:
                continue  # each word of the item that the window lacks takes an edit
            else:
                n = edits(sequence, window, most)
            if n <= most and (k not in own or (n, at) < own[k]):
                own[k] = (n, at)


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, start_word, n_words``: a row for each document and item found in it.

    The items are fetched in blocks of ``how.block_items`` and each block searches all documents.
    Null or wordless texts and items match nothing; repeated documents each match; no rows on either
    side give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-items.count() // how.block_items))
    rows = picked(docs, id_col, text_col)
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], how)

        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                found = []
                for at in range(0, batch.num_rows, SLICE):
                    ids, own = batch.column(0).slice(at, SLICE).to_pylist(), batch.column(1).slice(at, SLICE).to_pylist()
                    found += [(i, *m) for i, ms in zip(ids, index.matches_of(own)) for m in ms]
                columns = [*zip(*found)] or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "edits", "start_word", "n_words"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits int, start_word int, n_words int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, how: Search = Search(), text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Null and wordless texts hold no item and stay; repeated rows stay or go together; texts of any
    length are read whole; null items match nothing; an empty table gives no rows.
    """
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = max(1, -(-items.count() // how.block_items))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = Index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], how)
        where = docs.columns.index(text_col)

        def run(batches, index=index, where=where):
            import pyarrow as pa

            for batch in batches:
                keep: list[bool] = []
                for at in range(0, batch.num_rows, SLICE):
                    keep += [not m for m in index.matches_of(batch.column(where).slice(at, SLICE).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
