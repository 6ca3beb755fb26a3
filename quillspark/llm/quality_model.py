"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Texts are read as pieces: runs of letters and digits as they are written, and runs of signs. A piece's
index vector is sparse, random and made from the hash of its spelling, so no table of them exists; its
word vector is the sum of the index vectors around it, counted over every document. Pieces that make
up at least ``share`` of all pieces have vectors of their own, of which there are 1 / ``share`` at
most; rarer ones share the vector of their form (capitals, small letters, digits and signs, runs cut
to two, with the length's order), kept by the same rule. A text is the mean and the maximum of its
pieces' vectors. A two-layer network, fitted on a bounded sample of labelled texts, gives a score,
whose temperature is fitted on rows that the network has not seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import bounded_batches, joined, picked
from .tokens import gathered, texts


@dataclass(frozen=True)
class Training:
    #: The most labelled rows that the network is fitted on, the first by a hash of their id.
    max_rows: int = 6_000
    #: Pieces and forms that make up this share of all pieces have vectors: 1 / share of each at most.
    share: float = 1e-5
    size: int = 64
    nonzero: int = 6
    window: int = 2
    #: How much of a piece's own index vector is added to its word vector of length 1.
    own: float = 0.5
    hidden: int = 24
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11


_PIECES = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
_RUNS = re.compile(r"(.)\1{2,}", re.S)
#: No piece has a blank: forms are told from pieces by it.
_FORM = " "
#: Words of one piece, or of one and a sign at the end, that Arrow takes apart: small letters after at most one capital.
_PLAIN, _CAPITAL, _SIGNS, _PLAIN_CHARS = "^[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+[.,;:!?]?$", "^[A-ZÀ-ÖØ-Þ]", ".,;:!?", 64
#: What a reader remembers: other words of up to so many characters, so many of them.
MEMORY, MEMORY_CHARS = 300_000, 48
#: Counts that one worker gathers before it sums them up and hands them on.
COUNTED = 2_000_000
#: Pieces whose neighbours are counted at once.
NEIGHBOURS = 1 << 22


class _Kinds(dict):
    """The kind of each character, found as it is met: ``X``, ``x``, ``9``, or a sign itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if len(self) < 100_000:
            self[code] = kind
        return kind


_KINDS = _Kinds()


def form(piece: str) -> str:
    """What a piece looks like: ``Xx9`` for its characters, runs cut to two, and the order of its length."""
    return f"{_FORM}{_RUNS.sub(r'\1\1', piece[:64].translate(_KINDS))}{_FORM}{len(piece).bit_length()}"


def _words(column):
    """An Arrow column's different words, the number of the word at each place, and where each text's words begin and end.

    Words are cut at ASCII white space, which no piece holds; some are empty. Null texts are empty.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), at - at[0]


def _plain(words):
    """Which words are plain; of these the letters, and the byte of the sign at the end or 0."""
    import numpy as np
    import pyarrow.compute as pc

    plain = pc.match_substring_regex(words, _PLAIN)
    plain = pc.and_(plain, pc.less(pc.utf8_length(words), _PLAIN_CHARS))
    own = words.filter(plain)
    letters = pc.ascii_rtrim(own, _SIGNS)
    signs = np.zeros(len(own), np.uint8)
    if len(own):
        ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset + 1 : own.offset + len(own) + 1]
        signs = np.frombuffer(own.buffers()[2], np.uint8)[ends - 1]
        signs = np.where(pc.equal(pc.binary_length(own), pc.binary_length(letters)).to_numpy(zero_copy_only=False), 0, signs)
    return plain.to_numpy(zero_copy_only=False), letters, signs


class Reader:
    """Turns columns of texts into the numbers of their pieces' vectors; what it remembers is bounded.

    Pieces never cross white space, so each different word of a column is taken apart once: plain ones
    by Arrow, all at once, and the others by the pieces' pattern, remembered with all their pieces.
    """

    def __init__(self, units: list[str]):
        import numpy as np
        import pyarrow as pa

        self.units = {u: i for i, u in enumerate(units)}
        self.names = pa.array(units, pa.string())
        self.known: dict[str, tuple[int, ...]] = {}
        # The form of a plain word hangs on its length and its capital only.
        self.small = np.array([self.units.get(form("x" * n), len(self.units)) for n in range(_PLAIN_CHARS)])
        self.capital = np.array([self.units.get(form("X" + "x" * (n - 1)), len(self.units)) for n in range(1, _PLAIN_CHARS + 1)])
        self.signs = np.zeros(128, np.int64)
        self.signs[[ord(c) for c in _SIGNS]] = [self._number(c) for c in _SIGNS]

    def _number(self, piece: str) -> int:
        found = self.units.get(piece)
        return self.units.get(form(piece), len(self.units)) if found is None else found

    def _look(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple([self._number(p) for p in _PIECES(word)])
            if len(word) <= MEMORY_CHARS:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[word] = found
        return found

    def _numbers(self, words):
        """The numbers of all words' pieces one after another, and where each word's begin and how many they are."""
        import numpy as np
        import pyarrow.compute as pc

        plain, letters, signs = _plain(words)
        number = pc.fill_null(pc.index_in(letters, value_set=self.names), -1).to_numpy().astype(np.int64)
        size, upper = pc.utf8_length(letters).to_numpy(), pc.match_substring_regex(letters, _CAPITAL).to_numpy(zero_copy_only=False)
        number = np.where(number < 0, np.where(upper, self.capital[size - 1], self.small[size]), number)
        others = [*map(self._look, words.filter(~plain).to_numpy(zero_copy_only=False))]

        begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begins[plain], sizes[plain] = 2 * np.arange(len(number)), 1 + (signs > 0)
        sizes[~plain] = own = np.fromiter(map(len, others), np.int64, len(others))
        begins[~plain] = 2 * len(number) + np.cumsum(own) - own
        rest = np.fromiter(chain.from_iterable(others), np.int64, own.sum())
        return np.concatenate([np.column_stack([number, self.signs[signs]]).ravel(), rest]), begins, sizes

    def read(self, column):
        """Vector numbers of the pieces of all texts, and where each text's begin and end.

        A piece whose form is rare, too, has the number after the last.
        """
        words, codes, at = _words(column)
        found, ends = gathered(codes, *self._numbers(words))
        return found, ends[at]


def _counts(rows: DataFrame, of, schema: str) -> DataFrame:
    """``unit, n``: what ``of`` counts in each batch, summed over all rows; partial sums before the shuffle."""

    def run(batches):
        import pyarrow as pa

        def summed(tables):
            found = pa.concat_tables(tables).group_by("unit").aggregate([("n", "sum")])
            yield from found.select(["unit", "n_sum"]).rename_columns(["unit", "n"]).to_batches(max_chunksize=100_000)

        held, n = [], 0
        for batch in joined(batches):
            for names, counts in of(batch):
                held.append(pa.table([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["unit", "n"]))
                n += len(held[-1])
            if n > COUNTED:
                yield from summed(held)
                held, n = [], 0
        if held:
            yield from summed(held)

    return rows.mapInArrow(run, schema).groupBy("unit").agg(F.sum("n").alias("n"))


def units(docs: DataFrame, how: Training = Training(), text_col: str = "text") -> list[str]:
    """Pieces, then forms of the other pieces, that make up ``how.share`` of all pieces of all documents."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pieces")

    def pieces(batch):
        import numpy as np

        words, codes, _ = _words(batch.column(0))
        times = np.bincount(codes, minlength=len(words))
        plain, letters, signs = _plain(words)
        yield letters, times[plain]
        after = np.bincount(signs, times[plain], 128).astype(np.int64)
        counted = {c: int(after[ord(c)]) for c in _SIGNS if after[ord(c)]}
        for word, n in zip(words.filter(~plain).to_numpy(zero_copy_only=False), times[~plain].tolist()):
            for piece in _PIECES(word):
                counted[piece] = counted.get(piece, 0) + n
        yield [*counted], [*counted.values()]

    def forms(batch):
        counted: dict[str, int] = {}
        for piece, n in zip(texts(batch.column(0), 10_000), texts(batch.column(1), 10_000)):
            own = form(piece)
            counted[own] = counted.get(own, 0) + n
        yield [*counted], [*counted.values()]

    found = scratch.keep(_counts(docs.select(F.col(text_col).cast("string").alias("text")), pieces, "unit string, n long"), "counts")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") >= max(2, total * how.share)
    shaped = _counts(found.filter(~often), forms, "unit string, n long").filter(often)
    names = found.filter(often).unionByName(shaped)  # 2 / share rows at most, as each is that share of the pieces
    scratch_names = scratch.keep(names.select("unit"), "names")
    return sorted(r["unit"] for r in scratch_names.collect())


def index_entries(names: list[str], how: Training):
    """Places and signs of each name's ``nonzero`` entries, one row of all names for each, made from the hash of the name."""
    import numpy as np
    import xxhash

    places, signs = [], []
    hashed = np.array([xxhash.xxh64_intdigest(n, how.seed) for n in [*names, ""]], np.uint64)
    for _ in range(how.nonzero):
        # The next number of each name's own sequence.
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15)
        places.append(((hashed >> np.uint64(40)) % np.uint64(how.size)).astype(np.int64))
        signs.append(np.where(hashed >> np.uint64(63), 1, -1))
    return places, signs


def index_vectors(names: list[str], how: Training):
    """The sparse random vectors, ``nonzero`` entries of 1 or -1 each."""
    import numpy as np

    table = np.zeros((len(names) + 1, how.size), np.int32)
    for places, signs in zip(*index_entries(names, how)):
        np.add.at(table, (np.arange(len(table)), places), signs)
    return table


def word_vectors(docs: DataFrame, names: list[str], how: Training = Training(), text_col: str = "text"):
    """One vector for each name and one for all else: sums of the index vectors around it in all documents.

    Sums are whole numbers, so they do not depend on how the rows are dealt. Each task sends one row
    for each of its names; the sums, ``len(names) + 1`` rows, go to the driver.
    """
    import numpy as np

    bounded_batches(docs.sparkSession)
    size, window = how.size, how.window

    def gather(batches):
        import pyarrow as pa

        reader, entries, n = Reader(names), index_entries(names, how), len(names) + 1
        total = np.zeros((n, size), np.int64)
        for batch in joined(batches):
            # All texts in a row; pairs that lie apart within a text are counted, and each different pair is added once.
            ids, ends = reader.read(batch.column(0))
            place = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            for at in range(0, len(ids), NEIGHBOURS):
                pairs = []
                for d in range(1, window + 1):
                    left, right = slice(at, min(at + NEIGHBOURS, len(ids) - d)), slice(at + d, at + d + NEIGHBOURS)
                    if left.stop > at:
                        pairs.append((ids[left] * n + ids[right])[place[left] == place[right]])
                pairs = np.sort(np.concatenate(pairs or [np.zeros(0, np.int64)]))
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                times, (left, right) = np.diff(first, append=len(pairs)), np.divmod(pairs[first], n)
                for own, near in ((left, right), (right, left)):
                    for places, signs in zip(*entries):
                        np.add.at(total.reshape(-1), own * size + places[near], times * signs[near])
        some = np.flatnonzero(total.any(1))
        for at in range(0, len(some), 4096):
            own = some[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array(total[own, j]) for j in range(size))], names=["unit", *(f"c{j}" for j in range(size))])

    columns = [f"c{j}" for j in range(size)]
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(gather, "unit long, " + ", ".join(f"{c} long" for c in columns)).groupBy("unit").agg(*[F.sum(c).alias(c) for c in columns])
    total = np.zeros((len(names) + 1, size))
    for batch in sums.toArrow().to_batches():
        at = batch.column(0).to_numpy()
        for j in range(size):
            total[at, j] = batch.column(j + 1).to_numpy()
    norms = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.maximum(norms, 1e-9) + how.own * index_vectors(names, how) / np.sqrt(how.nonzero)).astype(np.float32)


def pooled(ids, vectors):
    """Mean and maximum of the vectors of a text's pieces; zeros for a text without pieces."""
    import numpy as np

    size = vectors.shape[1]
    out = np.zeros(2 * size, np.float32)
    if len(ids):
        mean, most = np.zeros(size), np.full(size, -np.inf, np.float32)
        for at in range(0, len(ids), 8192):
            own = vectors[ids[at : at + 8192]]
            mean += own.sum(0)
            np.maximum(most, own.max(0), out=most)
        out[:size], out[size:] = mean / len(ids), most
    return out


@dataclass
class Model:
    names: list[str]
    vectors: object
    mean: object
    scale: object
    first: object
    first_bias: object
    second: object
    second_bias: float
    temperature: float

    def logits(self, features):
        import numpy as np

        hidden = np.tanh((features - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probability(self, features):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def learn(rows: DataFrame, docs: DataFrame, how: Training = Training()) -> Model:
    """A model from ``text, label`` rows, at most ``how.max_rows`` by contract, with vectors from all ``docs``.

    The driver gets the vectors and one small vector for each row. Null texts are empty ones; rows
    whose label is neither 0 nor 1 are left out; equal rows count as often as they are given, and a
    text under both labels counts for both; texts of any length are read whole, a slice at a time.
    Without documents all pieces share one vector, and without rows every score is one half.
    """
    import numpy as np

    bounded_batches(docs.sparkSession)
    names = units(docs, how)
    vectors = word_vectors(docs, names, how)

    def features(batches):
        import pyarrow as pa

        reader = Reader(names)
        for batch in joined(batches):
            ids, ends = reader.read(batch.column(0))
            made = [pooled(ids[a:b], vectors).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["features", "label"])

    kept = rows.filter("label IN (0, 1)").select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    got = kept.mapInArrow(features, "features binary, label int").toPandas()
    width = 2 * vectors.shape[1]
    x = np.array([np.frombuffer(f, np.float32) for f in got["features"]], np.float64).reshape(-1, width)
    y = got["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T[::-1], y))  # the same order however the rows arrive
    return _fit(x[order], y[order], names, vectors, how)


def _fit(x, y, names, vectors, how: Training) -> Model:
    import numpy as np

    rng = np.random.default_rng(how.seed)
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    model = Model(names, vectors, mean, scale, rng.normal(0, width**-0.5, (width, how.hidden)), np.zeros(how.hidden), np.zeros(how.hidden), 0.0, 1.0)
    unseen = rng.random(len(x)) < 0.2
    a, b = x[~unseen], y[~unseen]
    if len(set(b)) < 2:
        model.second_bias = 0.0 if not len(y) else float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -5, 5))
        return model
    a = (a - mean) / scale
    weights = [model.first, model.first_bias, rng.normal(0, how.hidden**-0.5, how.hidden), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, how.steps + 1):  # Adam, whole batches
        hidden = np.tanh(a @ weights[0] + weights[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30)))
        d = (p - b) / len(b)
        back = np.outer(d, weights[2]) * (1 - hidden**2)
        grads = [a.T @ back + how.decay * weights[0], back.sum(0), hidden.T @ d + how.decay * weights[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            weights[i] = weights[i] - how.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.first, model.first_bias, model.second, model.second_bias = weights[0], weights[1], weights[2], float(weights[3][0])
    if unseen.sum() >= 20:
        logits = model.logits(x[unseen])

        def loss(t: float) -> float:
            z = np.clip(logits / t, -30, 30)
            return float(np.mean(np.logaddexp(0, z) - y[unseen] * z))

        model.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row.

    Null, empty and wordless texts have a score too, that of zero vectors; null ids and repeated rows
    stay; texts of any length are read whole; a score equal to the threshold is predicted as 1; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        reader = Reader(model.names)
        for batch in joined(batches):
            ids, ends = reader.read(batch.column(1))
            x = np.array([pooled(ids[a:b], model.vectors) for a, b in zip(ends[:-1], ends[1:])], np.float64).reshape(batch.num_rows, -1)
            p = model.probability(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
