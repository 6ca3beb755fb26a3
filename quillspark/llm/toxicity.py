"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, and digits or
signs inside words to the letters they stand for. The lexicon and its weights are learnt from labelled
rows: words and word stems that toxic texts have significantly more often than others. Phrases of a
term and the word beside it that only clean texts have are exceptions; their occurrences hide the
terms inside them.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, picked
from .tokens import texts

# Cyrillic, Greek and other letters, each with the Latin letter it looks like.
_PAIRS = (
    "аa вb еe гr дd зz іi ӏl јj кk мm нh оo пn рp сc тt уy хx ѕs ԁd һh ԛq ԝw ѵv ьb "
    "αa εe ηn ιi κk νv οo ρp τt υu χx ωw ɑa ɡg ɩi ɪi ʀr ʟl ϲc ӕa"
)
HOMOGLYPHS = {pair[0]: pair[1] for pair in _PAIRS.split()}
# Digits and signs that stand for letters within a word.
DIGITS = dict(zip("0123456789@$!|", "oizeasgtbgasil"))


def _fold_table() -> dict[int, str]:
    table = {ord(a): b for a, b in HOMOGLYPHS.items()}
    table |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    # Full-width forms lie a fixed distance above ASCII.
    return table | {c + 0xFEE0: chr(c).lower() for c in range(0x21, 0x7F)}


_FOLDS = _fold_table()
_RUN = re.compile(r"[\w@$!|]+")
_MIXED = re.compile(r"[0-9@$!|][^\W\d_]").search
_LEET = str.maketrans(DIGITS)
#: Marks the end of a counted word.
END = "$"
_WORD = re.compile(r"[^\W\d_]+")


def _spelt(run: re.Match) -> str:
    """The run with letters for its digits and signs, if one stands before a letter; signs at its end stay."""
    text = run[0]
    if not _MIXED(text):
        return text
    kept = text.rstrip("@$!|_")
    return kept.translate(_LEET) + text[len(kept) :]


def fold(text: str | None) -> str:
    """Lower case, one Latin form of look-alikes, letters for digits inside words; in time linear in the length."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_FOLDS))
    return _RUN.sub(_spelt, text) if _MIXED(text) else text


@dataclass
class Lexicon:
    """Term weights, whether a term is a stem (matches longer words), exceptions and calibration."""

    weights: dict[str, float]
    stems: set[str] = field(default_factory=set)
    exceptions: tuple[str, ...] = ()
    #: A text of so many words has its weights counted in full; longer ones less, by the square root.
    words: int = 200
    slope: float = 1.0
    offset: float = 0.0
    _machine: object = None

    def _built(self):
        if self._machine is None:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                machine.add_word(term, (len(term), weight, term in self.stems))
            for phrase in self.exceptions:
                if phrase not in self.weights:
                    machine.add_word(phrase, (len(phrase), None, False))
            machine.make_automaton()
            self._machine = machine
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Spans and weights of terms at the start of a word (whole words unless stems), in order, without exceptions.

        An exception hides the terms that lie inside it; spans and exceptions are walked once.
        """
        if not self.weights:
            return []
        found, hidden = [], []
        for last, (size, weight, stem) in self._built().iter(folded):
            start, end = last + 1 - size, last + 1
            if (start and folded[start - 1].isalpha()) or (not stem and end < len(folded) and folded[end].isalpha()):
                continue
            if weight is None:
                hidden.append((start, end))
            else:
                found.append((start, end, weight))
        found.sort()
        hidden.sort()
        kept, at, reach = [], 0, 0
        for start, end, weight in found:
            while at < len(hidden) and hidden[at][0] <= start:
                reach = max(reach, hidden[at][1])
                at += 1
            if reach < end:
                kept.append((start, end, weight))
        return kept

    def raw(self, text: str | None) -> float:
        """Sum of weights over the root of the length beyond ``words``."""
        folded = fold(text)
        total = sum(w for _, _, w in self.matches(folded))
        return total / math.sqrt(max(1.0, (folded.count(" ") + 1) / self.words)) if total else 0.0

    def score(self, text: str | None) -> float:
        z = self.slope * self.raw(text) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass(frozen=True)
class Training:
    #: The most labelled rows that are used, the first by a hash of their id.
    max_rows: int = 20_000
    #: A term occurs in at least so many toxic texts, and this share of the texts that have it is toxic.
    min_toxic: int = 4
    min_precision: float = 0.9
    #: How unlikely a term's counts are by chance: at least so many nats of log likelihood ratio.
    significance: float = 8.0
    #: Whole words have this many letters or more, stems as many as the next says to the last.
    min_word: int = 2
    min_chars: int = 4
    max_chars: int = 12
    #: An exception occurs in at least so many clean texts, and this share of the texts that have it is clean.
    min_clean: int = 3
    clean_precision: float = 0.95


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", how: Training = Training()) -> Lexicon:
    """A lexicon from labelled rows; null labels and texts are left out, no rows give no terms.

    Repeated rows count as often as they are given; texts are read whole. Words and their prefixes are counted in the executors, once for each text and label; only terms
    that pass the thresholds reach the driver.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).filter("text IS NOT NULL AND label IN (0, 1)")

    def count(batches):
        import pyarrow as pa

        counted: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            terms = list(counted[1]) + [t for t in counted[0] if t not in counted[1]]
            numbers = [[c[t] for t in terms] for c in (counted[1], counted[0])]
            for c in counted:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(n, pa.int64()) for n in numbers)], names=["term", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                words = {w for w in _WORD.findall(fold(text)) if len(w) >= how.min_word}
                counted[label].update({w[:n] for w in words for n in range(how.min_chars, min(len(w), how.max_chars) + 1)} | {w + END for w in words})
            if len(counted[0]) + len(counted[1]) > 300_000:
                yield out()
        yield out()

    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = classes.get(1, 0), classes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, offset=-3.0 if n_clean else 0.0)
    sums = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    both, prior = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    gain = F.col("toxic") * F.log(F.col("toxic") / (both * prior)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - prior)))).otherwise(0.0)
    kept = sums.filter((F.col("toxic") >= how.min_toxic) & (F.col("toxic") >= how.min_precision * both)).filter(gain >= how.significance)
    found = {r["term"]: (r["toxic"], r["clean"]) for r in kept.collect()}  # bounded by the words of max_rows texts over min_toxic
    weights, stems = _terms(found, n_toxic, n_clean)
    lexicon = Lexicon(weights, stems)
    lexicon.exceptions = _exceptions(lexicon, rows, how)
    lexicon._machine = None
    return calibrated(lexicon, rows)


def _exceptions(lexicon: Lexicon, rows: DataFrame, how: Training) -> tuple[str, ...]:
    """Phrases of a matched word and its neighbour that clean texts have and toxic ones hardly do."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            counted: Counter = Counter()
            for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                folded = fold(text)
                found = lexicon.matches(folded)
                if not found:
                    continue
                words = [m.span() for m in _WORD.finditer(folded)]
                starts, phrases = [a for a, _ in words], set()
                for start, _, _ in found:
                    i = bisect.bisect_right(starts, start) - 1
                    phrases |= {folded[words[j][0] : words[j + 1][1]] for j in (i - 1, i) if 0 <= j < len(words) - 1 and words[j + 1][1] - words[j][0] <= 64}
                counted.update((p, label) for p in phrases)
            pairs = [*counted]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32()), pa.array([counted[p] for p in pairs], pa.int64())], names=["phrase", "label", "n"])

    toxic, clean = (F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    sums = rows.mapInArrow(count, "phrase string, label int, n long").groupBy("phrase").agg(toxic.alias("toxic"), clean.alias("clean"))
    kept = sums.filter((F.col("clean") >= how.min_clean) & (F.col("clean") >= how.clean_precision * (F.col("toxic") + F.col("clean"))))
    return tuple(sorted(r["phrase"] for r in kept.select("phrase").collect()))


def _terms(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], set[str]]:
    """Stems that longer words share, or whole words.

    A prefix is lengthened as long as that loses no toxic text; if it then ends the word, the term is
    a whole word, else a stem. Prefixes of a chosen term are not terms themselves.
    """
    weights: dict[str, float] = {}
    stems: set[str] = set()
    longer: dict[str, list[str]] = {}
    for t in found:
        longer.setdefault(t[:-1], []).append(t)
    for term in sorted(found, key=lambda t: (len(t), t)):
        if term.endswith(END) or any(term[:n] in weights for n in range(1, len(term) + 1)) or any(w.startswith(term) for w in weights):
            continue
        toxic, clean = found[term]
        while same := [t for t in longer.get(term, ()) if found[t][0] == toxic]:
            term = min(same)
        whole = term.endswith(END)
        term = term.removesuffix(END)
        weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if weight > 0:
            weights[term] = weight
            if not whole:
                stems.add(term)
    return weights, stems


def calibrated(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Slope and offset of a logistic curve over the raw score, fitted to the same rows.

    What reaches the driver is a histogram of raw scores by label, of at most 2 x 400 cells.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [min(399, round(10 * lexicon.raw(t))) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.int32()), batch.column(1)], names=["cell", "label"])

    cells = rows.mapInArrow(run, "cell int, label int").groupBy("cell", "label").agg(F.count("*").alias("n")).collect()
    data = [(r["cell"] / 10, r["label"], r["n"]) for r in cells]
    slope, offset = 1.0, -3.0
    total = sum(n for _, _, n in data)
    for _ in range(50):  # Newton's steps of a ridge-penalised logistic regression
        ga = gb = haa = hab = hbb = 0.0
        for x, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            d, h = n * (p - y), n * max(p * (1 - p), 1e-9)
            ga, gb, haa, hab, hbb = ga + d * x, gb + d, haa + h * x * x, hab + h * x, hbb + h
        ga, gb, haa, hbb = ga + 1e-3 * total * slope, gb + 1e-4 * total * offset, haa + 1e-3 * total, hbb + 1e-4 * total
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2 / max(abs(da), abs(db), 1e-12))
        slope, offset = slope - scale * da, offset - scale * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    lexicon.slope, lexicon.offset = max(slope, 0.0), offset
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row.

    Null and empty texts have the score of no match; null ids and repeated rows stay; texts of any
    length are read whole, in linear time; a score equal to the threshold is predicted as 1; an empty
    table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    lexicon._machine = None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [lexicon.score(t) for t in texts(batch.column(1))]
            flags = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(flags, pa.int32())], names=["doc_id", "score", "predicted"])

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``.

    Null texts score as empty ones; repeated rows stay or go together; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    lexicon._machine = None
    where = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t) < threshold for t in texts(batch.column(where))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
