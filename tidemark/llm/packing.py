"""Best-fit packing of tokenised documents into sequences of fixed length, by exact-complement hashing.

Tasks encode whole texts and cut them into pieces; what the plan needs of them is how many pieces have each
length, at most ``capacity`` numbers at any size of the corpus. The plan indexes which lengths, pair sums and
triple sums are there; a combination that exactly fills a gap is consumed as often as its scarcest length
allows, and what no combination fills goes by best fit. A pattern of lengths and its number of copies are
ranges of ranks among the pieces of each length, so that each piece finds its sequence by its rank.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, free_name, text_batches

CAPACITY, END = 2048, 0
#: Remembered segments of a worker process; beyond them it forgets all and starts anew.
REMEMBERED = 1 << 20
#: Characters that are split and looked up at a time.
SLICE = 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Contractions that are segments of their own: fixed values of the tokenizer's pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each of the first 256 characters."""
    import unicodedata

    kinds, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    for i in range(256):
        kind = unicodedata.category(chr(i))[0]
        kinds[i] = SPACE if chr(i).isspace() and not 28 <= i <= 31 else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        lower[i] = ord(chr(i).lower())
    return kinds, lower


class SegmentCoder:
    """Token ids of whole texts, as the library gives them for the vocabulary ``definition``.

    The library encodes each segment between its split points by itself. Texts of the first 256 characters are
    lowered and split with numpy and their segments looked up among those met before; the library encodes new
    segments, and as a whole each text that holds other characters, a zero, or ``<|``, where a special token's
    name may begin.
    """

    _KINDS, _LOWER = _tables()
    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, definition: str, specials_as_text: bool = True, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = specials_as_text
        self.remembered = remembered
        self._forget(0)

    def _forget(self, least: int) -> None:
        room = max(self.remembered, least)
        self.shift = np.uint64(64 - max(4, (2 * room).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.low, self.high = np.zeros(room + 1, np.uint64), np.zeros(room + 1, np.uint64)
        self.start, self.size = np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
        self.pool, self.pooled, self.known, self.room = np.zeros(1 << 16, np.uint32), 0, 0, room
        self.long: dict[bytes, int] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Entries of new segments, in their order."""
        ids = self._library([w.decode("latin-1") for w in words])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        while self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        entries = np.arange(self.known + 1, self.known + 1 + len(words))
        self.start[entries] = self.pooled + np.cumsum(sizes) - sizes
        self.size[entries] = sizes
        self.pooled, self.known = self.pooled + len(flat), self.known + len(words)
        return entries

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries of segments of at most 16 bytes; 0 where one is new."""
        found = np.zeros(len(low), np.int64)
        open_, at = np.arange(len(low)), self._places(low, high)
        while len(open_):
            entry = self.table[at].astype(np.int64)
            same = (self.low[entry] == low[open_]) & (self.high[entry] == high[open_])
            found[open_[same]] = entry[same]
            more = (entry > 0) & ~same
            open_, at = open_[more], (at[more] + 1) & (len(self.table) - 1)
        return found

    def _put(self, entries: np.ndarray) -> None:
        at = self._places(self.low[entries], self.high[entries])
        while len(entries):
            free = self.table[at] == 0
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(at), bool)
            won[first] = True
            won &= free
            self.table[at[won]] = entries[won]
            entries, at = entries[~won], (at[~won] + 1) & (len(self.table) - 1)

    def _segments(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes with room behind them; starts and lengths of the segments."""
        low = np.zeros(len(text) + 32, np.uint8)
        low[: len(text)] = self._LOWER[np.frombuffer(text, np.uint8)]
        kind = self._KINDS[low]
        kind[len(text) :] = SPACE
        before = np.concatenate([[SPACE], kind[:-1]])
        starts = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        for at in (np.flatnonzero((low == ord("'")) & (before != OTHER)),):
            for form in CONTRACTIONS:
                hit = at
                for k, c in enumerate(form[1:].encode(), 1):
                    hit = hit[low[hit + k] == c]
                starts[hit + 1] = False
                starts[hit + len(form)] = kind[hit + len(form)] != SPACE
        begin = np.flatnonzero(starts)
        last = (kind != SPACE) & (np.concatenate([starts[1:], [True]]) | (np.concatenate([kind[1:], [SPACE]]) == SPACE))
        return low, begin, np.flatnonzero(last) + 1 - begin

    def _entries(self, low: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        windows = np.ndarray(len(low) - 8, "<u8", low, strides=(1,))
        first = windows[begin] & self._MASK[np.minimum(length, 8)]
        second = windows[np.minimum(begin + 8, len(windows) - 1)] & self._MASK[np.clip(length - 8, 0, 8)]
        short = length <= 16
        found = np.zeros(len(begin), np.int64)
        found[short] = self._find(first[short], second[short])
        new = np.flatnonzero(short & (found == 0))
        if len(new):
            order = new[np.lexsort((first[new], second[new]))]
            differs = np.ones(len(order), bool)
            differs[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            heads = order[differs]
            entries = self._add([low[b : b + n].tobytes() for b, n in zip(begin[heads], length[heads])])
            self.low[entries], self.high[entries] = first[heads], second[heads]
            self._put(entries)
            found[order] = entries[np.cumsum(differs) - 1]
        far = np.flatnonzero(~short)
        if len(far):
            words = [low[b : b + n].tobytes() for b, n in zip(begin[far], length[far])]
            fresh = [w for w in dict.fromkeys(words) if w not in self.long]
            if fresh:
                self.long.update(zip(fresh, self._add(fresh).tolist()))
            found[far] = [self.long[w] for w in words]
        return found

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        low, begin, length = self._segments(b"\n".join(texts))
        if self.known + len(begin) > self.room:
            self._forget(len(begin))
        entries = self._entries(low, begin, length)
        sizes = self.size[entries]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[entries] - ends + sizes, sizes)]
        bounds = np.cumsum([len(t) + 1 for t in texts])  # a text and what parts it from the next one
        cuts = np.concatenate([[0], ends])[np.searchsorted(begin, bounds[:-1])]
        return np.split(ids, cuts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            try:
                raw = text.encode("latin-1")
                (odd if "<|" in text or b"\0" in raw else plain).append((i, raw))
            except UnicodeEncodeError:
                odd.append((i, b""))
        held: list[tuple[int, bytes]] = []
        size = 0
        for n, (i, raw) in enumerate(plain, 1):
            held.append((i, raw))
            size += len(raw) + 1
            if size >= SLICE or n == len(plain):
                for (k, _), ids in zip(held, self._plain([r for _, r in held])):
                    out[k] = ids
                held, size = [], 0
        if odd:
            for (i, _), ids in zip(odd, self._library([texts[i] for i, _ in odd])):
                out[i] = np.array(ids, np.uint32)
        return out


_coders: dict[tuple, SegmentCoder] = {}


def _coder(definition: str, specials_as_text: bool) -> SegmentCoder:
    """One coder a worker process: what it remembers serves its later tasks too."""
    key = (hashlib.sha256(definition.encode()).digest(), specials_as_text)
    if key not in _coders:
        _coders.clear()
        _coders[key] = SegmentCoder(definition, specials_as_text)
    return _coders[key]


def pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END, specials_as_text: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of each document, its columns ``keep`` with them.

    ``docs`` needs a column text. A document is the ids of its text (null: empty) and the id ``end``; one
    longer than ``capacity`` is cut into pieces of ``capacity``, the last may be shorter. Columns: piece (from
    0), start (the document's ids before it), length, ids (little-endian unsigned 32-bit ids), and part and
    nth: the task that cut it and its number among that task's pieces of this length. Repeated rows are
    documents each; texts of any length are encoded whole; an empty table has no pieces.
    """
    text_batches(docs.sparkSession)
    columns = [*keep]
    source = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias(text := free_name("whole_text", docs)))
    schema = T.StructType([*docs.select(*columns).schema, *(T.StructField(n, T.LongType()) for n in ("piece", "start", "length")), T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, part, seen = _coder(definition, specials_as_text), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            coded = coder.encode(batch.column(text).to_pylist())
            total = np.array([len(x) + 1 for x in coded], np.int64)
            flat = np.concatenate([y for x in coded for y in (x, np.array([end], np.uint32))]).astype("<u4") if coded else np.zeros(0, "<u4")
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)])) + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            step = max(1, (32 << 20) // (4 * capacity))
            edges = np.concatenate([[0], np.cumsum(length)])
            kept = batch.select(columns).take(pa.array(row))
            for a in range(0, len(row), step):
                b = min(a + step, len(row))
                offsets = ((edges[a : b + 1] - edges[a]) * 4).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(flat[edges[a] : edges[b]])])
                yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, pa.array(piece[a:b]), pa.array(start[a:b]), pa.array(length[a:b]), ids, pa.array(np.full(b - a, part, np.int64)), pa.array(nth[a:b])], names=schema.names)

    return source.mapInArrow(run, schema)


class Plan:
    """Patterns of lengths that fill sequences of ``capacity``, each with its number of copies.

    ``counts`` has the number of pieces of each length. ``patterns`` holds (lengths, copies); together they
    use every piece once. All work is on at most ``capacity`` numbers, whatever they count.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        least = -(-sum(n * k for n, k in counts.items()) // capacity)
        found: list[tuple[tuple[int, ...], int]] | None = None
        # Exact combinations first; where they take what lengths over a half need, those lengths go first; last, without exact ones
        for ranges in ([(capacity, 0, True)], [(capacity, capacity // 2, True), (capacity // 2, 0, True)], [(capacity, 0, False)]):
            self.left = np.zeros(capacity + 1, np.int64)
            for length, n in counts.items():
                self.left[length] = n
            self.patterns: list[tuple[tuple[int, ...], int]] = []
            self._index()
            for high, low, exact in ranges:
                for first in range(high, low, -1) if exact else ():
                    while self.left[first] and (rest := self._complement(capacity - first, Counter([first]))) is not None:
                        self._take((first, *rest))
                for first in range(high, low, -1):
                    while self.left[first]:
                        self._take(self._best_fit(first, exact))
            if found is None or self.sequences < sum(k for _, k in found):
                found = self.patterns
            if sum(k for _, k in found) == least:
                break
        self.patterns = found

    def _index(self) -> None:
        """Sums of one, two and three lengths that are still there, as sets of bits."""
        whole = (1 << (self.capacity + 1)) - 1
        lengths = np.flatnonzero(self.left).tolist()
        self.single = sum(1 << n for n in lengths)
        self.pair = self.triple = 0
        for n in lengths:
            self.pair |= self.single << n & whole
        for n in lengths:
            self.triple |= self.pair << n & whole
        self.pair_sums = np.array([bool(self.pair >> s & 1) for s in range(self.capacity + 1)])

    def _pair(self, total: int, left: np.ndarray) -> tuple[int, int] | None:
        """The two lengths of this sum that can be consumed most often; the larger one first."""
        if total < 2 or not self.pair >> total & 1:
            return None
        big = np.arange((total + 1) // 2, total)
        often = np.minimum(left[big], left[total - big])
        if total % 2 == 0:
            often[0] = left[total // 2] // 2
        best = int(np.argmax(often))
        return (int(big[best]), total - int(big[best])) if often[best] > 0 else None

    def _complement(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Up to three lengths that exactly fill ``gap``, beside those used already; None if there are none."""
        if gap == 0:
            return ()
        if not (self.single | self.pair | self.triple) >> gap & 1:
            return None
        left = self.left
        if used:
            left = left.copy()
            for n, times in used.items():
                left[n] -= times
        if left[gap] > 0:
            return (gap,)
        if (two := self._pair(gap, left)) is not None:
            return two
        if self.triple >> gap & 1:
            third = np.arange(1, gap)
            third = third[(left[third] > 0) & self.pair_sums[gap - third]]
            for n in third[np.argsort(-left[third], kind="stable")].tolist():
                left[n] -= 1
                two = self._pair(gap - n, left)
                left[n] += 1
                if two is not None:
                    return (n, *two)
        return None

    def _best_fit(self, first: int, exact: bool) -> tuple[int, ...]:
        """``first`` and the largest lengths that still fit, one by one, until nothing fits or, if ``exact``, a complement fills the gap."""
        parts, gap = [first], self.capacity - first
        while gap:
            used = Counter(parts)
            if exact and (rest := self._complement(gap, used)) is not None:
                return (*parts, *rest)
            fits = [n for n in np.flatnonzero(self.left[: gap + 1]).tolist() if self.left[n] > used[n]]
            if not fits:
                break
            parts.append(fits[-1])
            gap -= fits[-1]
        return tuple(parts)

    def _take(self, parts: tuple[int, ...]) -> None:
        uses = Counter(parts)
        copies = int(min(self.left[n] // times for n, times in uses.items()))
        for n, times in uses.items():
            self.left[n] -= copies * times
        self.patterns.append((parts, copies))
        if any(self.left[n] == 0 for n in uses):
            self._index()

    @property
    def sequences(self) -> int:
        return sum(copies for _, copies in self.patterns)

    def slots(self) -> tuple[np.ndarray, ...]:
        """Ranges of ranks, sorted by length: length, first rank, first sequence, place in the sequence."""
        used: Counter = Counter()
        rows, sequence = [], 0
        for parts, copies in self.patterns:
            place = 0
            for n in parts:
                rows.append((n, used[n], sequence, place))
                used[n] += copies
                place += n
            sequence += copies
        return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


#: Ranks are below 2 to the power of this.
RANK_BITS = 48


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END, specials_as_text: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All pieces of the documents (see ``pieces``) with sequence_id and offset, the place in that sequence.

    Sequences hold at most ``capacity`` ids without gaps between pieces. The driver sees the number of pieces
    of each length, never a piece. A piece's rank among those of its length is its number in its task and the
    number of such pieces in the tasks before: one small row for each task and length.
    """
    made = cut(pieces(docs, definition, capacity, end, specials_as_text, keep), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = cut(counts, "piece-counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = free_name("before", made)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    placed = made.join(ranks, ["part", "length"])
    slots = plan.slots()
    names = [*keep, "piece", "start", "length", "ids"]
    schema = T.StructType([*made.select(*names).schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        of, first, sequence, offset = slots
        wanted = (length.to_numpy(np.int64) << RANK_BITS) | rank.to_numpy(np.int64)
        at = np.searchsorted((of << RANK_BITS) | first, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy(np.int64) - first[at], "offset": offset[at]})

    spot = free_name("spot", made)
    out = placed.select(*names, place(F.col("length"), F.col("nth") + F.col(before)).alias(spot))
    return out.select(*names, f"{spot}.sequence_id", f"{spot}.offset").to(schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_pieces, length, ids (little-endian unsigned 32-bit ids, piece after piece)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"), F.sum("length").alias("length"))
    joined = F.aggregate("held", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return rows.select("sequence_id", F.size("held").alias("n_pieces"), "length", joined.alias("ids"))
