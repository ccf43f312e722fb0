"""SentencePiece encoding and decoding by vectorised merge rounds.

The distinct words of a batch are one flat array of symbols. Each round finds the best
rank among the pairs of each word, merges its leftmost non-overlapping occurrences at
once and compacts the array, until no word has a pair. A word begins at a run of word
marks, which no piece crosses (checked when the vocabulary is read). Long words are cut
between characters over which no piece reaches; what is still long merges all pairs at
once that are the best within the reach of a piece, so rounds don't grow with length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, numbered

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NONE = np.iinfo(np.int64).max
#: Words of up to LONG characters that a task keeps encoded; beyond that it starts anew.
CACHE = 600_000
#: Words of more characters are cut, and their parts of more characters are merged by local minima.
LONG = 64


@dataclass
class Vocabulary:
    """Tables of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    strings: list[str]
    kinds: np.ndarray  # 0 normal, 1 byte, 2 control, 3 unknown
    pair_keys: np.ndarray  # sorted left * size + right
    pair_ranks: np.ndarray
    pair_ids: np.ndarray  # the piece that each pair makes
    early: np.ndarray  # by rank: a merge with this piece can outrank it
    tied: int  # the rank of the pieces that share the lowest score (runs of word marks), if there are such
    byte_ids: np.ndarray
    bos: int
    eos: int
    longest: int  # characters of the longest piece, but for tied ones
    couples: np.ndarray  # sorted pieces of two characters, as numbers
    triples: np.ndarray  # sorted three neighbouring characters of pieces, as numbers
    ids: dict[str, int] = field(default_factory=dict)
    cache: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The library reads the model's file; nothing else of it is used."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        strings = [sp.id_to_piece(i) for i in range(n)]
        kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) else 0 for i in range(n)], np.int8)
        normal = [i for i in range(n) if kinds[i] == 0]
        ids = {strings[i]: i for i in normal}
        if any(re.search(f"[^{MARK}]{MARK}", strings[i]) for i in normal):
            raise ValueError("a piece crosses the start of a word")
        scores = sorted({sp.get_score(i) for i in normal if len(strings[i]) > 1}, reverse=True)
        place = {x: r for r, x in enumerate(scores)}
        rank = {i: place[sp.get_score(i)] for i in normal if len(strings[i]) > 1}
        tied = len(scores) - 1 if sum(r == len(scores) - 1 for r in rank.values()) > 1 else len(scores)
        if len({r for r in rank.values() if r < tied}) != sum(r < tied for r in rank.values()):
            raise ValueError("pieces share a score that isn't the lowest")
        sample = "ﬁ Ａ e\u0301\u00a0x\t\u200by  z"
        if sp.normalize(sample) != MARK + sample.replace(" ", MARK):
            raise ValueError("the model changes texts before it cuts them")
        early, pairs = np.zeros(len(scores), bool), []
        for i, r in rank.items():
            s = strings[i]
            for cut in range(1, len(s)):
                a, b = ids.get(s[:cut]), ids.get(s[cut:])
                if a is not None and b is not None:
                    pairs.append((a * n + b, r, i))
                for part in (a, b):
                    if part is not None and rank.get(part, -1) > r:
                        early[rank[part]] = True
        if early[tied:].any():
            raise ValueError("a piece of the lowest score is part of a better one")
        keys, ranks, made = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        byte_ids = np.zeros(256, np.uint32)
        for i in np.flatnonzero(kinds == 1):
            byte_ids[int(strings[i][3:5], 16)] = i
        longest = max((len(strings[i]) for i, r in rank.items() if r < tied), default=1)
        couples = np.unique([ord(strings[i][0]) << 21 | ord(strings[i][1]) for i in rank if len(strings[i]) == 2])
        triples = np.unique([ord(a) << 42 | ord(b) << 21 | ord(c) for i in rank for a, b, c in zip(strings[i], strings[i][1:], strings[i][2:])])
        return cls(strings, kinds, keys, ranks, made, early, tied, byte_ids, sp.bos_id(), sp.eos_id(), longest, couples.astype(np.int64), triples.astype(np.int64), ids)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    @property
    def size(self) -> int:
        return len(self.strings)

    def pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the tables, or -1."""
        known = (left < self.size) & (right < self.size)
        key = np.where(known, left * self.size + right, -1)
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == key, found, -1)

    def leftmost(self, symbols: list[int]) -> list[int]:
        """Merges among pieces of one score: always the leftmost pair, so what lies left of it is at rest."""
        pairs, out = self.tied_pairs, []
        for x in symbols:
            while out and (out[-1], x) in pairs:
                x = pairs[out.pop(), x]
            out.append(x)
        return out

    @cached_property
    def tied_pairs(self) -> dict[tuple[int, int], int]:
        chosen = self.pair_ranks == self.tied
        return {(k // self.size, k % self.size): i for k, i in zip(self.pair_keys[chosen].tolist(), self.pair_ids[chosen].tolist())}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (no empty ones) as little-endian unsigned 32-bit integers."""
        cuts = [[w] if len(w) <= LONG else self.parts(w) for w in words]
        units = list(set().union(*cuts)) if cuts else []
        short = [u for u in units if len(u) <= LONG]
        known = dict(zip(short, self._rounds(short)))
        for u in units:
            if len(u) > LONG:
                known[u] = self._bytes(np.array(self._local(u), np.int64))
        return [b"".join(map(known.__getitem__, c)) for c in cuts]

    def parts(self, word: str) -> list[str]:
        """A word cut between neighbours that no piece can hold: they are no piece of their own, and no
        piece has them together with the character before or after them."""
        c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        within = lambda x, table: table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)
        held = within(c[:-1] << 21 | c[1:], self.couples)
        three = within(c[:-2] << 42 | c[1:-1] << 21 | c[2:], self.triples)
        held[:-1] |= three
        held[1:] |= three
        ends = [0, *(np.flatnonzero(~held) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(ends, ends[1:])]

    def _local(self, word: str) -> list[int]:
        """The symbols of a long part of a word.

        A pair that is the best within `reach` symbols on both sides is merged next there, whatever
        happens elsewhere: no symbol outside can grow as far as its neighbours. Of equal pairs
        in reach of each other those on the left come first, up to one that makes a better pair."""
        reach = self.longest + 2
        symbols = np.array([self.ids.get(c, self.size + ord(c)) for c in word], np.int64)
        while len(symbols) > 1:
            place = self.pair_at(symbols[:-1], symbols[1:])
            ranks = np.where(place < 0, NONE, self.pair_ranks[place])
            ranks[ranks >= self.tied] = NONE
            n, width, step = len(ranks), 2 * reach + 1, 1
            low = np.concatenate([np.full(reach, NONE), ranks, np.full(reach, NONE)])
            while 2 * step <= width:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            low = np.minimum(low[:n], low[width - step : width - step + n])
            best = (ranks == low) & (ranks < NONE)
            at_ = np.flatnonzero(best)
            if not len(at_):
                break
            # An equal pair on the left that isn't the best of its own surroundings comes first, but not yet.
            held = np.zeros(len(at_), bool)
            for d in range(1, reach + 1):
                left = np.maximum(at_ - d, 0)
                held |= (at_ >= d) & (ranks[left] == ranks[at_]) & ~best[left]
            run = np.ones(len(at_), bool)
            run[1:] = at_[1:] != at_[:-1] + 1
            nth = np.arange(len(at_))
            even = (nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0
            stop = self._outranked(symbols, place, ranks, at_, even)
            stop[1:] = stop[:-1].copy()
            stop[0] = False
            chain = np.ones(len(at_), bool)
            chain[1:] = at_[1:] - at_[:-1] > reach
            stop[chain] = False
            count = np.cumsum(held | stop)
            before = np.maximum.accumulate(np.where(chain, count - (held | stop), 0))
            hit = at_[even & (count == before)]
            symbols[hit] = self.pair_ids[place[hit]]
            symbols = np.delete(symbols, hit + 1)
        return self.leftmost(symbols.tolist())

    def _outranked(self, symbols: np.ndarray, place: np.ndarray, ranks: np.ndarray, at_: np.ndarray, even: np.ndarray) -> np.ndarray:
        """Whether merging a pair makes a pair that comes before it, all equal pairs on its left being merged."""
        out = np.zeros(len(at_), bool)
        asked = np.flatnonzero(self.early[ranks[at_]] & even)
        if len(asked):
            i, new = at_[asked], self.pair_ids[place[at_[asked]]]
            merged = np.full(len(symbols), -1)
            merged[at_[even] + 1] = self.pair_ids[place[at_[even]]]
            before = np.where(merged[i - 1] >= 0, merged[i - 1], symbols[i - 1])
            for a, b, there in ((before, new, i > 0), (new, symbols[np.minimum(i + 2, len(symbols) - 1)], i + 2 < len(symbols))):
                p = self.pair_at(a, b)
                out[asked] |= there & (p >= 0) & (self.pair_ranks[p] < ranks[i])
        return out

    def _rounds(self, words: list[str]) -> list[bytes]:
        """encode_words() of short words, all of them at once."""
        size, ids = self.size, self.ids
        # A character without a piece of its own is size + its code point: it never merges.
        table = {c: ids.get(c, size + ord(c)) for c in set().union(*words)} if words else {}
        symbols = np.fromiter((table[c] for w in words for c in w), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = np.arange(len(words))
        done: list[bytes] = [b""] * len(words)
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(number):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.full(len(symbols), -1)
            place[:-1] = self.pair_at(symbols[:-1], symbols[1:])
            place[starts[1:] - 1] = -1
            ranks = np.where(place < 0, NONE, self.pair_ranks[place])
            best = np.minimum.reduceat(ranks, starts)
            for w in np.flatnonzero(best == self.tied):
                done[number[w]] = self._bytes(np.array(self.leftmost(symbols[starts[w] : starts[w] + lengths[w]].tolist())))
            whole = best == NONE
            ended.append((symbols[np.repeat(whole, lengths)], lengths[whole], number[whole]))
            best[best == self.tied] = NONE
            word = np.repeat(np.arange(len(number)), lengths)
            hit = np.flatnonzero((ranks == best[word]) & (ranks < NONE))
            # Of neighbouring hits every other one, from the left.
            first = np.ones(len(hit), bool)
            first[1:] = hit[1:] != hit[:-1] + 1
            nth = np.arange(len(hit))
            hit = hit[(nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0]
            # Where a merge with the new piece may come before the rest, one merge at a time.
            alone = np.ones(len(hit), bool)
            alone[1:] = word[hit[1:]] != word[hit[:-1]]
            hit = hit[alone | ~self.early[ranks[hit]]]
            symbols[hit] = self.pair_ids[place[hit]]
            keep = (best < NONE)[word]
            keep[hit + 1] = False
            lengths = np.bincount(word[keep], minlength=len(number))[best < NONE]
            symbols, number = symbols[keep], number[best < NONE]
        if ended:
            symbols, lengths, number = (np.concatenate(x) for x in zip(*ended))
            if len(number):
                self._cut(symbols, lengths, number, done)
        return done

    def _cut(self, symbols: np.ndarray, lengths: np.ndarray, number: np.ndarray, done: list[bytes]) -> None:
        """Put the bytes of words, whose symbols lie one after another, in their places."""
        stops = np.cumsum(lengths)
        starts = stops - lengths
        flat = symbols.astype("<u4").tobytes()
        for n, a, b in zip(number.tolist(), (4 * starts).tolist(), (4 * stops).tolist()):
            done[n] = flat[a:b]
        for w in np.flatnonzero(np.maximum.reduceat(symbols, starts) >= self.size):
            done[number[w]] = self._bytes(symbols[starts[w] : stops[w]])

    def _bytes(self, symbols: np.ndarray) -> bytes:
        if (symbols < self.size).all():
            return symbols.astype("<u4").tobytes()
        parts = [np.array([s], np.uint32) if s < self.size else self.byte_ids[list(chr(s - self.size).encode())] for s in symbols.tolist()]
        return np.concatenate(parts).astype("<u4").tobytes()

    def encode(self, texts: list[str], ends: bool = True) -> list[bytes]:
        """The ids of each text; ends: with begin and end ids."""
        split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache = {}
        new = list(set().union(*split) - self.cache.keys()) if split else []
        long = [w for w in new if len(w) > LONG]
        new = [w for w in new if len(w) <= LONG]
        for i in range(0, len(new), 50_000):
            self.cache.update(zip(new[i : i + 50_000], self.encode_words(new[i : i + 50_000])))
        known = self.cache if not long else self.cache | dict(zip(long, self.encode_words(long)))
        begin, end = (np.array([x], "<u4").tobytes() if ends else b"" for x in (self.bos, self.eos))
        return [b"".join([begin, *map(known.__getitem__, words), end]) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids. Byte pieces that aren't UTF-8 give U+FFFD each; control pieces nothing; the dummy prefix goes."""
        if not hasattr(self, "_out"):
            out = []
            for s, kind in zip(self.strings, self.kinds):
                out.append({0: s.replace(MARK, " ").encode(), 1: bytes([int(s[3:5], 16)]) if kind == 1 else b"", 2: b"", 3: b" \xe2\x81\x87 "}[int(kind)])
            self._out = out
        numbers = np.frombuffer(ids, "<u4")
        kinds = self.kinds[numbers]
        shown = np.flatnonzero(kinds != 2)
        if not len(shown):
            return ""
        cut = int(kinds[shown[0]] == 0 and self.strings[numbers[shown[0]]].startswith(MARK))
        whole = b"".join(map(self._out.__getitem__, numbers.tolist()))
        try:
            return whole.decode()[cut:]
        except UnicodeDecodeError:
            return self._decode_runs(numbers, kinds)[cut:]

    def _decode_runs(self, numbers: np.ndarray, kinds: np.ndarray) -> str:
        out, raw = [], b""
        for i, kind in [*zip(numbers.tolist(), kinds.tolist()), (-1, -1)]:
            if kind == 1:
                raw += self._out[i]
                continue
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    n = 1
                raw = raw[n:]
            if i >= 0:
                out.append(self._out[i].decode())
        return "".join(out)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit), n_tokens and decoded, a row per document.

    Null text is empty: only begin and end ids. Repeated rows give repeated rows. Whole
    texts are encoded whatever their length; other columns play no part. An empty table gives
    no rows."""
    vocabulary = Vocabulary.read(model_path)
    d = numbered(docs)
    d = d.select(d[at(docs, id_col)].alias("key"), blank_if_null(d[at(docs, text_col)]).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                ids = vocabulary.encode(part["t"].tolist(), ends)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [vocabulary.decode(x) for x in ids]})

    return d.mapInPandas(run, f"key {d.schema['key'].dataType.simpleString()}, ids binary, n_tokens long, decoded string")

