"""Language-model scores: cross-entropy difference of two matched n-gram models.

Tokens are UTF-8 bytes, so both models share one closed vocabulary: 256 bytes and an end mark. A model
counts every 5-gram of its corpus, each as itself, and is exact: a context's counts are the sum of its
5-grams', and the back-off to bigrams, and of those to single bytes, leaves each context's
probabilities with a sum of one. The two corpora share no document and have the same number of tokens:
whichever is larger, target documents or all others, is thinned by a hash to the other's size. No
document is scored with its own counts: documents fall into two folds by a hash, and those of one are
scored by the models of the other. A text's score is its mean loss under the background model less
that under the target model, in nats per token: higher means more like the target.

Counts are one table in the shared folder, which grows with the corpus. Scoring broadcasts it in
blocks of at most ``BLOCK`` 5-grams, split by context, one pass over the texts for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import bounded_batches

ORDER = 5
#: Pseudo-counts of the two back-off steps, the same for both models.
BACK, BACK_2 = 4.0, 8.0
# A byte that UTF-8 never has: before a text, ORDER - 1 times, and once after it.
MARK = b"\xff"
#: The most 5-grams that are broadcast at once, of some 30 bytes each.
BLOCK = 4_000_000
#: Cells of the hash by which a corpus is thinned.
CELLS = 4096


def grams(texts: list[str | None]):
    """5-grams of the texts as unsigned numbers, and the text each belongs to.

    A text of n bytes has n + 1: one for each byte and one for its end. A null text is an empty one.
    """
    import numpy as np

    raw = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b"".join([MARK * (ORDER - 1) + r + MARK for r in raw]), np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    # The first byte of each 5-gram: texts lie four marks further apart than they have 5-grams.
    at = np.arange(int(sizes.sum())) + (ORDER - 1) * owner
    codes = np.zeros(len(at), np.int64)
    for j in range(ORDER):
        codes = codes << 8 | flat[at + j]
    return codes, owner


def keyed(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, is_target, fold, cell``; the hash is of id and text, so null ids fall everywhere."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("is_target"))
    h = F.xxhash64("doc_id", "text")
    return rows.withColumns({"fold": F.pmod(h, F.lit(2)).cast("int"), "cell": F.pmod(F.shiftright(h, 1), F.lit(CELLS)).cast("int")})


def cuts(sizes: DataFrame) -> dict[tuple[int, bool], int]:
    """For each fold and side the first cell that is left out, from ``is_target, fold, cell, n`` rows.

    At most 4 * CELLS sums reach the driver. The smaller side stays whole; of the larger one, cells are
    taken while their tokens do not pass the other's, so sizes differ by a cell's at most.
    """
    held: dict[tuple[int, bool], dict[int, int]] = {(f, t): {} for f in (0, 1) for t in (False, True)}
    for r in sizes.groupBy("is_target", "fold", "cell").agg(F.sum("n").alias("n")).collect():
        held[r["fold"], r["is_target"]][r["cell"]] = r["n"]
    out = {}
    for fold in (0, 1):
        most = min(sum(held[fold, t].values()) for t in (False, True))
        for side in (False, True):
            total, cut = 0, CELLS
            for cell in sorted(held[fold, side]):
                total += held[fold, side][cell]
                if total > most:
                    cut = cell
                    break
            out[fold, side] = cut
    return out


def count(rows: DataFrame) -> DataFrame:
    """``fold, code, target, background`` of ``text, is_target, fold`` rows: how often each 5-gram occurs.

    Tasks count their own texts, a batch at a time; equal 5-grams are combined before the shuffle.
    """
    bounded_batches(rows.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []

        def out():
            # One more bit for each of the two flags: 5-grams of all four corpora sort as one list.
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            held.clear()
            side = (codes & 1).astype(bool)
            columns = [(codes >> 1 & 1).astype(np.int32), codes >> 2, np.where(side, n, 0), np.where(side, 0, n)]
            for start in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in columns], names=["fold", "code", "target", "background"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                codes, owner = grams(batch.column(0).slice(at, 256).to_pylist())
                flag = np.array(batch.column(1).slice(at, 256).to_pylist(), np.int64) + 2 * np.array(batch.column(2).slice(at, 256).to_pylist(), np.int64)
                held.append(np.unique(codes << 2 | flag[owner], return_counts=True))
            if sum(len(c) for c, _ in held) > 4_000_000:
                yield from out()
        if held:
            yield from out()

    found = rows.select("text", "is_target", "fold").mapInArrow(run, "fold int, code long, target long, background long")
    return found.groupBy("fold", "code").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


@dataclass
class Block:
    """One fold's 5-grams whose context falls into one block, with the bigrams that the models back off to."""

    codes: object
    counts: object
    contexts: object
    context_counts: object
    pairs: object

    @classmethod
    def of(cls, codes, counts, bigrams) -> Block:
        """``codes`` ascend; ``counts`` has a row for each, of target and background; ``bigrams`` are 2 x 65,536 counts."""
        import numpy as np

        contexts, starts = np.unique(codes >> 8, return_index=True)
        sums = np.add.reduceat(counts, starts) if len(codes) else np.zeros((0, 2))
        return cls(codes, counts.astype(np.float64), contexts, sums.astype(np.float64), np.array([pair_probabilities(b) for b in bigrams]).T)

    def losses(self, codes):
        """Nats of each token under the target and the background model."""
        import numpy as np

        def looked(known, values, wanted):
            if not len(known):
                return np.zeros((len(wanted), 2))
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            return np.where((known[at] == wanted)[:, None], values[at], 0.0)

        own, context = looked(self.codes, self.counts, codes), looked(self.contexts, self.context_counts, codes >> 8)
        return -np.log((own + BACK * self.pairs[codes & 0xFFFF]) / (context + BACK))


def pair_probabilities(counts):
    """Probabilities of a byte after a byte, smoothed by those of single bytes, from 65,536 bigram counts."""
    import numpy as np

    two = np.asarray(counts, np.float64).reshape(256, 256)
    one = (two.sum(0) + 1) / (two.sum() + 256)
    return ((two + BACK_2 * one) / (two.sum(1, keepdims=True) + BACK_2)).ravel()


def models(counts: DataFrame, block: int = BLOCK) -> tuple[int, object]:
    """The number of blocks, and a function that fetches one of them for both folds, from a written ``count`` table."""
    import numpy as np

    blocks = max(1, -(-counts.count() // block))
    bigrams = np.zeros((2, 2, 1 << 16))
    pairs = counts.groupBy("fold", F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("target").alias("t"), F.sum("background").alias("b"))
    for r in pairs.collect():  # 2 x 65,536 rows at most
        bigrams[r["fold"], :, r["pair"]] = r["t"], r["b"]

    def fetch(i: int) -> list[Block]:
        out = []
        for fold in (0, 1):
            some = counts.filter((F.col("fold") == fold) & (F.pmod(F.shiftright("code", 8), F.lit(blocks)) == i)).select("code", "target", "background")
            table = some.toArrow()
            codes, *sides = (table.column(c).to_numpy() for c in range(3))
            order = np.argsort(codes)
            out.append(Block.of(codes[order], np.stack(sides, 1)[order] if len(codes) else np.zeros((0, 2), np.int64), bigrams[fold]))
        return out

    return blocks, fetch


def score(rows: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of ``doc_id, text, fold`` rows.

    Each is scored by the counts of the other fold. Null and empty texts have one token, their end;
    null ids and repeated rows stay; texts of any length are read whole; without counts all losses are
    those of a uniform model; no rows give no rows.
    """
    bounded_batches(rows.sparkSession)
    blocks, fetch = models(counts, block)
    now = rows.select("doc_id", "text", "fold", *[F.lit(0.0).alias(c) for c in ("target_loss", "background_loss")], F.lit(0).cast("long").alias("n_tokens"))
    scratch = Scratch(rows.sparkSession, "scored")
    for i in range(blocks):
        own = fetch(i)

        def run(batches, own=own, i=i):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    codes, owner = grams(part.column(1).to_pylist())
                    fold = np.array(part.column(2).to_pylist(), np.int64)
                    n = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
                    sums = np.stack([part.column(3).to_numpy(), part.column(4).to_numpy()])
                    for f in (0, 1):
                        mine = (fold[owner] != f) & ((codes >> 8) % blocks == i)
                        lost = own[f].losses(codes[mine])
                        sums += np.stack([np.bincount(owner[mine], lost[:, s], part.num_rows) for s in (0, 1)])
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sums[0]), pa.array(sums[1]), pa.array(n)], names=part.schema.names)

        now = now.mapInArrow(run, now.schema)
        if i < blocks - 1:
            now = scratch.keep(now, f"pass{i}")
    target, background = F.col("target_loss") / F.col("n_tokens"), F.col("background_loss") / F.col("n_tokens")
    return now.select("doc_id", "n_tokens", target.alias("target_loss"), background.alias("background_loss"), (background - target).alias("score"))


def cross_entropy_difference(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Scores of all ``docs``; ``target`` tells which of them the target model is to be like (null: not)."""
    scratch = Scratch(docs.sparkSession, "models")
    rows = keyed(docs, target, id_col, text_col)
    cut = cuts(rows.select("is_target", "fold", "cell", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")))
    chosen = F.lit(False)
    for (fold, side), first in cut.items():
        chosen = chosen | ((F.col("fold") == fold) & (F.col("is_target") == side) & (F.col("cell") < first))
    counts = scratch.keep(count(rows.filter(chosen)), "counts")
    # Which fold a text is in needs no label, so the texts are scored as they are read.
    return score(keyed(docs, F.lit(False), id_col, text_col), counts, block)
