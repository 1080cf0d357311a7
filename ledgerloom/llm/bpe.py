"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has one encoding, and so one last token. The table of last tokens
is filled from left to right: token t that ends at byte i is the last one there if, before it,
the last token p makes (p, t) a pair that BPE leaves apart, that is, if p + t is encoded as
p, t; this is told by taking back the merges of both. Since all adjacent pairs of an encoding are of this kind, and no other tokens are, this
gives the encoding that merging by rank gives, in time that is linear in the bytes. The table
makes appends exact, and an edit recomputes from its place only.

A text's pieces (the matches of the pattern) are encoded separately; a piece that is a token
as a whole is that token. Pieces repeat, so their encodings are kept, up to a bound. Those of
several texts that aren't known yet are encoded together: their tables are filled byte by byte,
each byte in all pieces at once, as arrays.

Defined results: a null text is empty and has no tokens; repeated rows are rows of their own;
an empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._shared import short_batches


#: Characters from which a text is long, and about how many pieces are looked up at once.
LONG, PIECES = 1 << 18, 1 << 16
#: Bytes of the longest piece that is encoded together with others, and about how many bytes of such pieces at once.
SHORT, TOGETHER = 256, 1 << 18
#: Places of the memory of pairs, a power of two.
MEMORY = 1 << 21


def places_of(numbers: np.ndarray, places: int) -> np.ndarray:
    """A place for each number below 2**31 (or pair of tokens), below `places`, a power of two."""
    return (numbers * 2654435761 >> 16) & (places - 1)


class Prefixtree:
    """The prefixes of all tokens, numbered from 0 for the empty one; which one a byte leads to is looked up for many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        nodes = {b"": 0}
        for token in ranks:
            for i in range(len(token)):
                nodes.setdefault(token[: i + 1], len(nodes))
        self.ranks = np.array([ranks.get(x, -1) for x in nodes], np.int64)
        steps = np.array([nodes[x[:-1]] << 8 | x[-1] for x in nodes if x], np.int64)
        self.table = np.full(4 << len(nodes).bit_length(), -1, np.int64)  # step and node, in the first free place from the step's own
        at, left = places_of(steps, len(self.table)), np.arange(len(steps))
        while len(left):
            left = left[np.argsort(at[left], kind="stable")]
            free = left[self.table[at[left]] < 0]
            self.table[at[free]] = steps[free] << 32 | free + 1
            left = left[self.table[at[left]] >> 32 != steps[left]]
            at[left] = (at[left] + 1) & (len(self.table) - 1)

    def next(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The node that each byte leads to from each node; -1 where there is none."""
        steps = nodes << 8 | data
        at = places_of(steps, len(self.table))
        found = self.table[at]
        out = np.where(found >> 32 == steps, found & 0xFFFFFFFF, -1)
        more = np.flatnonzero((out < 0) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.table) - 1)
            found = self.table[at[more]]
            same = found >> 32 == steps[more]
            out[more[same]] = found[same] & 0xFFFFFFFF
            more = more[~same & (found >= 0)]
        return out

    def tokens_in(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token in each piece of the data begins, and its rank."""
        start = np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)
        left = np.repeat(begins + lengths, lengths) - start
        node, deep, found = np.zeros(len(start), np.int64), 0, []
        while len(start):
            node = self.next(node, data[start + deep])
            deep += 1
            there = node >= 0
            start, left, node = start[there], left[there], node[there]
            rank = self.ranks[node]
            whole = rank >= 0
            found.append((start[whole], rank[whole]))
            there = left > deep
            start, left, node = start[there], left[there], node[there]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Vocabulary:
    """Ranks of byte strings, with the automaton that finds all tokens ending at each byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, *, keep: int = 150_000):
        self.ranks, self.pattern, self.keep = ranks, regex.compile(pattern), keep
        self.tokens, self.longest = {n: t for t, n in ranks.items()}, max(map(len, ranks))
        self.start = max(self.tokens) + 1  # stands for the empty prefix before a piece's first token
        self.sizes = np.zeros(self.start, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.places, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.tokens[n] for n in sorted(self.tokens)), np.uint8)
        self.decimals = np.array([f"{n}," for n in range(self.start)], np.bytes_)
        self.tree, self.found = Prefixtree(ranks), ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.found.add_word(token.decode("latin-1"), rank)
        self.found.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memory = np.full(MEMORY, -1, np.int64)  # pairs and whether they fit, each in the one place its number gives
        self.pieces: dict[str, bytes] = {}  # the ids of each, as 32-bit integers

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """path: a file with a line for each token, its bytes in base64 and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, itself twice for a byte; None if merging its bytes doesn't make it."""
        if rank not in self.halves:
            data = self.tokens[rank]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == len(self.ranks):
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[rank] = None if len(parts) > 2 else (self.ranks[parts[0]], self.ranks[parts[-1]])
        return self.halves[rank]

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens apart where they meet.

        Their merges are taken back, the latest first. At each step the two parts that meet stood side by
        side until then: had their own merge been due before the one taken back, it would have come first.
        """
        halves, tokens, ranks = self.halves, self.tokens, self.ranks
        due = len(ranks)  # merges of a lower rank came first; of equal ranks, the one on the left
        while True:
            across = ranks.get(tokens[left] + tokens[right], due)
            if across < due and self.split(across) == (left, right):
                return False
            first, second = halves.get(left) or self.split(left), halves.get(right) or self.split(right)
            left_whole, right_whole = first[0] != left, second[0] != right
            if left_whole and (left > right or not right_whole):
                due, left = left, first[1]
            elif right_whole:
                due, right = right + 1, second[0]
            else:
                return True

    def fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether BPE makes the tokens of each pair and leaves them apart. A pair is a number: last token before, or start, times start, plus the token."""
        places = places_of(pairs, len(self.memory))
        known = self.memory[places]
        out, new = known == 2 * pairs + 1, np.flatnonzero(known >> 1 != pairs)
        if len(new):
            told, first, back = np.unique(pairs[new], return_index=True, return_inverse=True)
            fits = np.array([self.split(t) is not None and (p == self.start or self.apart(p, t)) for p, t in zip(*(x.tolist() for x in divmod(told, self.start)), strict=True)])
            self.memory[places[new[first]]] = 2 * told + fits
            out[new] = fits[back]
        return out

    def encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as 32-bit integers, of pieces that aren't tokens as a whole; the tables of all are one array, filled in order of the bytes' places in their pieces."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(b"\0".join(pieces), np.uint8)  # a prefix's number: where it ends
        befores, ranks = self.tree.tokens_in(data, begins, lengths)
        stops = befores + self.sizes[ranks]
        at = (stops - np.repeat(begins, lengths + 1)[befores]).astype(np.int16)
        order = np.argsort(at, kind="stable")
        befores, stops, ranks = befores[order], stops[order], ranks[order]
        edges, last = np.cumsum(np.bincount(at)).tolist(), np.full(len(data) + 1, -1, np.int64)
        last[begins] = self.start
        for a, b in zip(edges, edges[1:], strict=False):
            before = last[befores[a:b]]
            open_ = np.flatnonzero(before >= 0)
            fits = open_[self.fit(before[open_] * self.start + ranks[a:b][open_])] + a
            last[stops[fits]] = ranks[fits]
        ends, ours = begins + lengths, np.zeros(len(last), bool)
        if (last[ends] < 0).any():
            raise KeyError("a piece has a byte that is no token")
        while len(ends):
            ours[ends] = True
            ends = ends - self.sizes[last[ends]]
            ends = ends[last[ends] != self.start]
        ids, cuts = last[ours].astype(np.int32).tobytes(), (4 * np.cumsum(ours)[begins + lengths]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Keep the ids of pieces."""
        known, names, held = self.pieces, [], []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                known[piece] = np.int32(whole).tobytes()
            elif len(data) > SHORT:
                known[piece] = np.array(Prefixes(self, data).ids(), np.int32).tobytes()
            else:
                names.append(piece)
                held.append(data)
        cuts = (np.flatnonzero(np.diff(np.cumsum(list(map(len, held))) // TOGETHER)) + 1).tolist() if held else []
        for a, b in zip([0, *cuts], [*cuts, len(held)], strict=True):
            if a < b:
                known.update(zip(names[a:b], self.encode_together(held[a:b]), strict=True))

    def pieces_of(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in one part or, so that a long text's pieces aren't all held, in several."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
        else:
            found = self.pattern.finditer(text)
            while pieces := [m.group() for m in islice(found, PIECES)]:
                yield pieces

    def parts(self, texts: Iterable[str]) -> Iterator[Iterator[np.ndarray]]:
        """The ids of each text, in its parts; to be read in order."""
        return (map(itemgetter(1), own) for _, own in groupby(self._parts(texts), itemgetter(0)))

    def _parts(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for pieces in self.pieces_of(text):
                held.append((i, pieces))
                size += len(pieces)
                if size >= PIECES:
                    yield from self.ids_of(held)
                    held, size = [], 0
        yield from self.ids_of(held)

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in map(list, self.parts(texts))]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.encode_all([text])[0]

    def ids_of(self, parts: list[tuple[int, list[str]]]) -> list[tuple[int, np.ndarray]]:
        """The ids of each part's pieces, with the number that came with it."""
        known = self.pieces
        if len(known) >= self.keep:  # the older half goes
            for piece in list(islice(known, len(known) // 2)):
                del known[piece]
        found = [list(map(known.get, pieces)) for _, pieces in parts]
        new = {piece for (_, pieces), own in zip(parts, found, strict=True) if None in own for piece, x in zip(pieces, own, strict=True) if x is None}
        self.learn(new)
        joined = [b"".join([known[piece] if x is None else x for piece, x in zip(pieces, own, strict=True)]) for (_, pieces), own in zip(parts, found, strict=True)]
        for piece in new:
            if len(piece) > 64:
                del known[piece]
        return [(i, np.frombuffer(x, np.int32)) for (i, _), x in zip(parts, joined, strict=True)]

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = ids if isinstance(ids, np.ndarray) else np.fromiter(ids, np.int64)
        sizes = self.sizes[ids]
        if not sizes.all() or (ids < 0).any():
            raise KeyError("an id is no token's")
        at = np.repeat(self.places[ids] - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return self.data[at].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, joined by commas."""
        text = self.decimals[ids].view(np.uint8)
        return text[text != 0].tobytes()[:-1]


class Prefixes:
    """The last token's rank for every prefix of a byte string, which may grow and be edited; -1 for the empty prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.of, self.data, self.last = vocabulary, data, [-1] * (len(data) + 1)
        self._fill(0, 0, None)

    def _fill(self, begin: int, known: int, settled: Callable[[int], bool] | None) -> None:
        """Fill the table behind prefix `known`, looking for tokens from byte `begin` on; stop where settled(prefix) says so."""
        of, last = self.of, self.last
        pairs, apart, split, tokens = of.pairs, of.apart, of.split, of.tokens
        if len(pairs) >= of.keep:
            pairs.clear()
        done = known
        for at, rank in of.found.iter(self.data[begin:].decode("latin-1")):
            stop = begin + at + 1
            if stop <= done:
                continue
            length = len(tokens[rank])
            before = last[stop - length]
            fits = pairs.get((before, rank))
            if fits is None:
                if stop > length and before < 0:
                    continue
                fits = pairs[before, rank] = split(rank) is not None and (before < 0 or apart(before, rank))
            if fits and (before >= 0 or stop == length):
                last[stop], done = rank, stop
                if settled is not None and settled(stop):
                    return

    def append(self, more: bytes) -> None:
        self.splice(len(self.data), len(self.data), more)

    def splice(self, start: int, end: int, new: bytes) -> None:
        """Put `new` in the place of bytes start to end.

        Last tokens up to start stand. Further on, an entry depends on the bytes and entries of the
        longest token's length before it: once so many in a row, over old bytes, are as they were,
        the rest of the old table holds.
        """
        old, shift, longest = self.last, start + len(new) - end, self.of.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last = [*old[: start + 1], *[-1] * (len(self.data) - start)]
        same = 0

        def settled(stop: int) -> bool:
            nonlocal same
            if stop <= start + len(new):
                return False
            same = same + 1 if old[stop - shift] == self.last[stop] else 0
            if same < longest:
                return False
            self.last[stop + 1 :] = old[stop - shift + 1 :]
            return True

        self._fill(max(0, start - longest), start, settled)

    def ids(self) -> list[int]:
        out, at, last, tokens = [], len(self.data), self.last, self.of.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        return out[::-1]


#: A worker's vocabularies, by path and pattern.
_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary.load(path, pattern)
    return _LOADED[path, pattern]


def encode(texts: Column, path: str, pattern: str) -> Column:
    """The ids of each text, an array of ints. path: the ranks, on every executor."""

    short_batches(SparkSession.active())

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(path, pattern)
        for batch in batches:
            yield pd.Series(known.encode_all(x or "" for x in batch), dtype=object)

    return of(texts)


def digests(texts: Column, path: str, pattern: str) -> Column:
    """A struct (n_tokens, ids_sha256, decoded_sha256) of each text: encoded, and decoded from its ids."""

    short_batches(SparkSession.active())

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path, pattern)
        for batch in batches:
            rows = []
            for parts in known.parts(x or "" for x in batch):
                n, told, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    if n and len(ids):
                        told.update(b",")
                    n += len(ids)
                    told.update(known.decimal(ids))
                    decoded.update(known.decode(ids))
                rows.append((n, told.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(texts)
