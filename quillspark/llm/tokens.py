"""Byte-level BPE encoding with bounded memory, for Arrow batches of whole texts.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizer as loaded. A pre-token boundary of the
byte-level pattern lies before every space that a non-space character follows, so a text may be cut
there and the pieces encoded one by one; no text is ever encoded as a whole. Most pieces are Latin words,
with signs and line ends between them: of those, all different words of a column are merged at once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

#: Pieces remembered in each of two generations; the older one is dropped when the newer is full.
CACHE_ENTRIES = 300_000
#: Longer pieces are encoded each time instead of being remembered.
CACHE_CHARS = 48
#: Batches of texts are joined to about so many bytes before they are encoded.
ENCODED_BYTES = 8 << 20
#: Pieces whose ids are gathered at once.
GATHERED = 1 << 18

# The pattern of byte-level pre-tokenization.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class every Unicode version agrees; pieces with others go through ``encode``.
_OTHER = re.compile(r"[^\n\t\x20-\x7eÀ-ɏ]").search
#: Pieces that are merged at once: words of these letters, each with signs after it (an apostrophe may begin a pre-token), at line ends.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LINE = _LETTERS + "[!-&(-/:-@\\[-`{-~]*"
_LINES = f"^{_LINE}(?:\n{_LINE})*$"
#: Bytes of such a piece at most, and words in a block.
MERGED_BYTES, MERGED_WORDS = 63, 8192


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Merges:
    """The merges of a BPE model, applied to many words at once.

    As in the library, each step merges the pair of the lowest rank of a word, the leftmost of equal
    ones. The symbols of a block of words are columns of an array, linked to those before and after;
    the ranks of pairs are found in an open hash table.
    """

    NONE, RANK_BITS, TABLE_BITS = (1 << 31) - 1, 20, 18

    def __init__(self, path: str):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.none = max(vocab.values()) + 1  # stands for no symbol
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # Of a pair that is listed twice the library has the last rank.
        ranks = {vocab[a] * (self.none + 1) + vocab[b]: i for i, (a, b) in enumerate(merges)}
        keys = np.fromiter(ranks, np.int64, len(ranks))
        held = keys << self.RANK_BITS | np.fromiter(ranks.values(), np.int64, len(ranks))
        self.bits = max(self.TABLE_BITS, (4 * len(ranks)).bit_length())
        self.table, at = np.full(1 << self.bits, -1), self._slot(keys)
        while len(held):
            place, first = np.unique(at, return_index=True)
            first = first[self.table[place] < 0]
            self.table[at[first]] = held[first]
            held, at = np.delete(held, first), self._next(np.delete(at, first))

    def _slot(self, keys):
        import numpy as np

        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, at):
        return (at + 1) & ((1 << self.bits) - 1)

    def _ranks(self, left, right):
        """64 times the rank of each pair, or ``NONE``."""
        import numpy as np

        keys = left * (self.none + 1) + right
        at = self._slot(keys)
        held = self.table[at]
        hit = held >> self.RANK_BITS == keys
        found = np.where(hit, (held & ((1 << self.RANK_BITS) - 1)) << 6, self.NONE)
        more = np.flatnonzero(~hit & (held >= 0))
        if len(more):
            at = at[more]
        while len(more):
            at = self._next(at)
            held = self.table[at]
            hit = held >> self.RANK_BITS == keys[more]
            found[more[hit]] = (held[hit] & ((1 << self.RANK_BITS) - 1)) << 6
            rest = ~hit & (held >= 0)
            more, at = more[rest], at[rest]
        return found

    def ids(self, data, ends):
        """Ids of words of at most 64 bytes, one after another, and where each word's begin and how many they are.

        ``ends``: where each word begins in ``data``, and the last one's end.
        """
        import numpy as np

        lengths = np.diff(ends)
        order = np.argsort(lengths, kind="stable")
        begins, sizes, parts, done = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), [], 0
        for block in (order[a : a + MERGED_WORDS] for a in range(0, len(order), MERGED_WORDS)):
            symbols = self._merged(data, ends[block], lengths[block])
            kept = symbols < self.none
            sizes[block] = n = kept.sum(1)
            begins[block] = done + np.cumsum(n) - n
            parts.append(symbols[kept].astype("<u4"))
            done += len(parts[-1])
        return np.concatenate([np.zeros(0, "<u4"), *parts]), begins, sizes

    def _merged(self, data, starts, lengths):
        import numpy as np

        m, width = len(starts), int(lengths.max())
        rows = np.arange(width + 1)[:, None]
        # The last row has no symbols: it follows all others, and as row -1 lies before the first.
        symbols = self.bytes[data[np.minimum(starts + rows, len(data) - 1)]] if len(data) else np.full((width + 1, m), self.none)
        symbols[rows >= lengths] = self.none
        best = np.full((width + 1, m), self.NONE, np.int32)
        found = self._ranks(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width, m)
        best[:-1] = np.where(found < self.NONE, found + rows[:-1], self.NONE)
        after, before = np.repeat(rows + 1, m, 1), np.repeat(rows - 1, m, 1)
        s, b, after, before = symbols.reshape(-1), best.reshape(-1), after.reshape(-1), before.reshape(-1)
        while True:
            least = best.min(0)
            own = np.flatnonzero(least < self.NONE)
            if not len(own):
                return symbols.T
            least = least[own].astype(np.int64)
            place, made = least & 63, self.made[least >> 6]
            at = place * m + own
            gone = after[at] * m + own
            then = after[gone]
            s[at], s[gone], b[gone], after[at] = made, self.none, self.NONE, then
            before[then * m + own] = place
            last = before[at]
            for left, right, row in ((made, s[then * m + own], place), (s[last * m + own], made, last)):
                found = self._ranks(left, right)
                b[row * m + own] = np.where(found < self.NONE, found + row, self.NONE)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as ``bytes``."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens that a text spells are those tokens, as the library has it; texts are cut at them, the longest first.
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {c: array("I", [i]).tobytes() for c, i in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.model = self.tokenizer.model
        self.split = regex.compile(PRE_TOKEN).findall
        self.table = {i: c for i, c in enumerate(byte_characters())}
        self.merges = Merges(path)
        self.entries = entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.space = self.table[ord(" ")]
        # Signs that end a word are a pre-token of their own.
        self.tails = {c: self._piece(c) for c in ".,;:!?"}

    def _fresh(self, shown: str) -> bytes:
        """Ids of one pre-token, spelt in byte characters."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self._fresh(word.encode().decode("latin-1").translate(self.table))
            if len(word) <= CACHE_CHARS:
                if len(self.words) >= self.entries // 2:
                    self.words.clear()
                self.words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if _OTHER(piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return b"".join([self._word(w) for w in self.split(piece)])

    def _after_space(self, piece: str) -> bytes:
        """Ids of the piece with one space before it, remembered unless it is long or holds other white space."""
        found = self.old.get(piece)
        if found is None:
            if piece.isalpha():  # one pre-token
                if piece.isascii():
                    found = self._fresh(self.space + piece)
                elif _OTHER(piece):
                    found = self._piece(" " + piece)
                else:
                    found = self._fresh(self.space + piece.encode().decode("latin-1").translate(self.table))
            else:
                word, tail = piece[:-1], self.tails.get(piece[-1])
                found = (self.young.get(word) or self._after_space(word)) + tail if tail is not None and word.isalpha() else self._piece(" " + piece)
        if len(piece) <= CACHE_CHARS and "\n" not in piece:
            if len(self.young) >= self.entries:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cuts and self.cuts.search(text):
            return b"".join([self.added.get(p) or self._plain(p) for p in self.cuts.split(text) if p])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        first, *pieces = text.split(" ")
        ids = [*map(self.young.get, pieces)]
        if None in ids:
            missing = [p for p, i in zip(pieces, ids) if i is None]
            if "" in missing or any(p[0].isspace() for p in missing):
                first, pieces = self._rejoined(first, pieces)
                ids = [*map(self.young.get, pieces)]
            ids = [self._after_space(p) if i is None else i for p, i in zip(pieces, ids)]
        return b"".join([self._piece(first), *ids])

    @staticmethod
    def _rejoined(first: str, pieces: list[str]) -> tuple[str, list[str]]:
        """The same text cut only at spaces that a non-space character follows."""
        runs: list[list[str]] = [[first]]
        for p in pieces:
            if p and not p[0].isspace():
                runs.append([p])
            else:
                runs[-1].append(p)
        first, *rest = [" ".join(r) for r in runs]
        return first, rest


    def encode_column(self, column):
        """Ids of all texts of an Arrow column one after another, as ``uint32``, and where each text's begin and end.

        Nulls are empty. Arrow splits the texts and numbers the different pieces, so that each of
        them is looked up once in a column; ids are then gathered by these numbers.
        """
        import numpy as np
        import pyarrow.compute as pc

        if not len(column):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        column = pc.fill_null(column, "")
        lists = pc.split_pattern(column, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast("string")
        lines = pc.and_(pc.match_substring_regex(pieces, _LINES), pc.less_equal(pc.binary_length(pieces), MERGED_BYTES))
        ids, begins, sizes = self._encode_lines(pieces.filter(lines))
        lines = lines.to_numpy(zero_copy_only=False)

        # A space that white space follows is no place to cut, nor may an added token be cut: such texts go one by one.
        others = pieces.filter(~lines).to_numpy(zero_copy_only=False).tolist()
        known, blank = [*map(self.young.get, others)], np.zeros(len(others), bool)
        for i, p in enumerate(others):
            if known[i] is None:
                blank[i] = not p or p[0].isspace()
                known[i] = b"" if blank[i] else self._after_space(p)
        odd = np.zeros(len(pieces), bool)
        odd[~lines] = blank
        joined = odd[codes]
        joined[at[:-1]] = False
        single = np.logical_or.reduceat(joined, at[:-1])
        for content in self.added:
            single |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)

        # The first piece of a text has no space before it; a text that goes one by one is its own first piece.
        codes[np.repeat(single, np.diff(at))] = len(pieces)
        codes[at[:-1]] = len(pieces) + 1 + np.arange(len(column))
        firsts = pc.take(lists.flatten(), at[:-1]).to_pylist()
        known += [b"", *(self.encode(column[i].as_py()) if one else self._piece(firsts[i]) for i, one in enumerate(single.tolist()))]

        # The lines' ids, then those of the other pieces and of the firsts.
        own = np.fromiter(map(len, known), np.int64, len(known)) // 4
        order = np.empty(len(pieces), np.int64)
        order[lines], order[~lines] = np.arange(len(sizes)), len(sizes) + np.arange(len(others))
        order = np.concatenate([order, np.arange(len(pieces), len(sizes) + len(known))])
        begins, sizes = np.concatenate([begins, len(ids) + np.cumsum(own) - own]), np.concatenate([sizes, own])
        found, ends = gathered(codes, np.concatenate([ids, np.frombuffer(b"".join(known), "<u4")]), begins[order], sizes[order])
        return found, ends[at]

    def _encode_lines(self, pieces):
        """Ids of pieces that ``_LINES`` matches, with a space before each, and where each one's begin and how many they are."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = pc.split_pattern(pieces, "\n")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        lines = lists.flatten()
        first = np.zeros(len(lines), bool)
        first[at[:-1]] = True
        letters = pc.ascii_rtrim(lines, _SIGNS)
        words = pc.if_else(pa.array(first), pc.binary_join_element_wise(" ", letters, ""), letters).dictionary_encode()
        signed = pc.greater(pc.binary_length(lines), pc.binary_length(letters)).to_numpy(zero_copy_only=False)
        signs = pc.replace_substring_regex(lines.filter(signed), "^" + _LETTERS, "").dictionary_encode()

        made = words.dictionary
        ends = np.frombuffer(made.buffers()[1], np.int32)[made.offset : made.offset + len(made) + 1].astype(np.int64)
        ids, begins, sizes = self.merges.ids(np.frombuffer(made.buffers()[2], np.uint8), ends)
        more = [b"", self._piece("\n"), *map(self._piece, signs.dictionary.to_pylist())]
        own = np.fromiter(map(len, more), np.int64, len(more)) // 4
        # Each line: a line end unless it is the first, its word, its signs if it has any.
        parts = np.full((len(lines), 3), len(made))
        parts[~first, 0] += 1
        parts[:, 1] = words.indices.to_numpy()
        parts[signed, 2] += 2 + signs.indices.to_numpy()
        begins, sizes = np.concatenate([begins, len(ids) + np.cumsum(own) - own]), np.concatenate([sizes, own])
        found, ends = gathered(parts.ravel(), np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")]), begins, sizes)
        ends = ends[3 * at]
        return found, ends[:-1], np.diff(ends)


def gathered(codes, ids, begins, sizes):
    """The ids of the pieces with these codes one after another, and where each one's begin and end; a piece's are ``sizes`` from ``begins`` on."""
    import numpy as np

    counts = sizes[codes]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    found = np.empty(ends[-1], ids.dtype)
    for a in range(0, len(codes), GATHERED):
        n = counts[a : a + GATHERED]
        shift = begins[codes[a : a + GATHERED]] - ends[a : a + len(n)]
        found[ends[a] : ends[a + len(n)]] = ids[np.repeat(shift, n) + np.arange(ends[a], ends[a + len(n)])]
    return found, ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that what it remembers lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts(column, size: int = 64) -> Iterator[str | None]:
    """The strings of an Arrow column, a few at a time."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
