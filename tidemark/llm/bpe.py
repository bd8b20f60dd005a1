"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

A sequence of tokens is what BPE makes of its bytes if and only if every token is made of its own bytes
and every two neighbours are what BPE makes of their joint bytes. So the encodings form a regular
language: an automaton over the vocabulary's byte trie whose arcs close a token when it fits the token
before it. ``Transducer`` determinises that automaton while it reads: a state holds the live hypotheses
(the token before, the place in the trie), and an arc puts out the one token that can end there. Following
those back from a point on which all hypotheses agree, at most the longest token behind, gives the tokens.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_batches

#: States kept at most; beyond it the machine starts afresh with the same results. A state's row of arcs takes 1 KB.
MAX_STATES = 49_152
#: Chunks of text whose ids are remembered at most, and their longest length. They are kept in two
#: generations of half as many: when the younger is full the older is forgotten, so frequent chunks stay.
MAX_REMEMBERED, MAX_CHUNK = 160_000, 64
#: Pieces up to this many bytes are run through the machine together, so many at a time.
TOGETHER, GROUP = 64, 8192
#: Bytes of one piece after which tokens are emitted as far as they are settled.
EMIT = 4096
#: Hypotheses that so few tokens can complete are dropped as soon as none of these fits.
FEW = 8
#: Texts encoded at a time, and ids decoded at a time.
BATCH = 128
DECODE_STEP = 65_536
#: Fixed value: the split pattern under which a space before a character that is no white space always starts a
#: match, so that texts can be cut at single spaces. Texts are split whole under any other pattern.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks file: a line has a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Arcs go from (state, byte) to the next state and the token that ends there.

    ``live`` has each state's hypotheses, a hypothesis being a class of tokens before, then a trie node.
    Tokens are in one class if the same tokens fit after them: all that matters of a token are the parts
    at its right end that some merge could take up before they are merged within. So states depend on a
    few bytes only and are met again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.length = np.zeros(max(ranks.values(), default=-1) + 2, np.int64)  # the last is that of token -1
        self.bytes_of = [b""] * len(self.length)
        #: the trie: child by node and byte; of each node its token (or -1), depth, and, of the tokens in order
        #: of their bytes, the first at or below it and the one after the last
        self.child: dict[int, int] = {}
        self.token_at, self.depth, self.low, self.high = array("i", [-1]), array("i", [0]), array("i", [0]), array("i", [0])
        self.in_order = array("i")
        for token in sorted(ranks):
            at, rank = 0, ranks[token]
            for b in token:
                to = self.child.get(at << 8 | b)
                if to is None:
                    to = self.child[at << 8 | b] = len(self.token_at)
                    for own, value in ((self.token_at, -1), (self.depth, self.depth[at] + 1), (self.low, len(self.in_order)), (self.high, 0)):
                        own.append(value)
                at = to
                self.high[at] = len(self.in_order) + 1
            self.token_at[at] = rank
            self.in_order.append(rank)
            self.bytes_of[rank], self.length[rank] = token, len(token)
        self.high[0] = len(self.in_order)
        self.bits = len(self.token_at).bit_length()
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.below_of: dict[int, list[int]] = {}
        #: classes of tokens before, with the parts at their right ends; of class 0 is the start of a piece, too
        self.class_of: dict[int, int] = {}
        self.classes: dict[tuple, int] = {(): 0}
        self.rights: list[list] = [[]]
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[int, ...], int] = {}
        self.live: list[tuple[int, ...]] = []
        #: number of the arc by state and byte, 0 for none (rows take memory when they are written), then each
        #: arc's next state and token, -1 for none
        self.arc_at = np.zeros((MAX_STATES + GROUP + 2, 256), np.int32)
        self.to, self.ends = np.zeros(4096, np.int32), np.zeros(4096, np.int32)
        self.arcs = 1
        self.narrow: dict[int, int] = {}
        self.firsts: dict[tuple, int] = {}
        self.start = self._state((0,))

    def _state(self, live: tuple[int, ...]) -> int:
        state = self.states.get(live)
        if state is None:
            state = self.states[live] = len(self.live)
            self.live.append(live)
        return state

    def _merge(self, data: bytes, until: int) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, data: bytes) -> list[int]:
        """BPE by definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        return [self.ranks[p] for p in self._merge(data, 1)]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's left and right end while it is merged, each with the rank that ends it.

        None for a token that BPE doesn't make of its own bytes.
        """
        if token not in self.edges:
            data, none = self.bytes_of[token], 1 << 60
            left, right = [(data, none)], [(data, none)]
            found = ([(data, none)], [(data, none)])
            if len(data) > 1:
                parts = self._merge(data, 2)
                if len(parts) != 2 or self._edges(self.ranks[parts[0]]) is None or self._edges(self.ranks[parts[1]]) is None:
                    found = None
                else:
                    left += [(p, token if r == none else r) for p, r in self._edges(self.ranks[parts[0]])[0]]
                    right += [(p, token if r == none else r) for p, r in self._edges(self.ranks[parts[1]])[1]]
                    found = (left, right)
            self.edges[token] = found
        return self.edges[token]

    def _below(self, node: int) -> list[int]:
        """Sorted tokens strictly below a node of the trie."""
        found = self.below_of.get(node)
        if found is None:
            own = self.token_at[node] >= 0  # first of its range
            found = self.below_of[node] = sorted(self.in_order[self.low[node] + own : self.high[node]])
        return found

    def _node(self, data: bytes, at: int = 0) -> int | None:
        for byte in data:
            at = self.child.get(at << 8 | byte)
            if at is None:
                break
        return at

    def _class(self, token: int) -> int:
        """The class of a token before; its parts that nothing can take up in time do not count."""
        known = self.class_of.get(token)
        if known is None:
            right, key = [], []
            for x, x_ends in self._edges(token)[1]:
                able = bisect_left(self._below(self._node(x)), x_ends)
                if able:
                    right.append((x, x_ends))
                    key.append((x, able))
            known = self.classes.setdefault(tuple(key), len(self.rights))
            if known == len(self.rights):
                self.rights.append(right)
            self.class_of[token] = known
        return known

    def _fit(self, before: int, token: int) -> bool:
        """Whether BPE leaves (a, token) as they are, a being of class ``before``: no merge across comes before those within.

        A token's rank is above those of its parts, so merges within happen in the order of ranks; of
        equal ranks the leftmost comes first.
        """
        own, rank_of = self._edges(token), self.ranks.get
        if own is None:
            return False
        for x, x_ends in self.rights[before]:
            for y, y_ends in own[0]:
                rank = rank_of(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def _narrowed(self, before: int, node: int) -> int:
        """The first class met at ``node`` that is as good as ``before`` for all tokens below it; -1 if none of them fits.

        Only merges of a part at the right end with a beginning of such a token matter. Where few tokens are
        below, classes are as good as each other if the same ones fit.
        """
        path = before << 32 | node
        known = self.narrow.get(path)
        if known is None:
            if len(below := self._below(node)) <= FEW:
                key = tuple([t for t in below if self._fit(before, t)])
                known = -1 if not key else 0 if len(key) == len(below) else self.firsts.setdefault((node, key), before)
            else:
                met, text = [], self.bytes_of[self.in_order[self.low[node]]][: self.depth[node]]
                for x, x_ends in self.rights[before]:
                    at, able = self._node(x), 0
                    for byte in text:
                        at = self.child.get(at << 8 | byte)
                        if at is None:
                            break
                        able += 0 <= self.token_at[at] < x_ends
                    if at is not None:
                        able += bisect_left(self._below(at), x_ends)
                    if able:
                        met.append((x, able))
                known = self.firsts.setdefault((node, tuple(met)), before) if met else 0
            self.narrow[path] = known
        return known

    def _arc(self, state: int, byte: int) -> int:
        live, ended, bits = [], -1, self.bits
        for code in self.live[state]:
            before, node = code >> bits, code & (1 << bits) - 1
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and ended < 0 and self._fit(before, token):
                ended = token
            if self.high[child] - self.low[child] > (token >= 0) and (narrowed := self._narrowed(before, child)) >= 0:
                live.append(narrowed << bits | child)
        if ended >= 0:
            live.append(self._class(ended) << bits)
        arc, to = self.arcs, self._state(tuple(live))
        if arc == len(self.to):
            self.to, self.ends = np.resize(self.to, 2 * arc), np.resize(self.ends, 2 * arc)
        self.to[arc], self.ends[arc] = to, ended
        self.arc_at[state, byte] = arc
        self.arcs += 1
        return arc

    def _back(self, last: list[int], at: int) -> list[int]:
        """Tokens of the prefix of length ``at``, last first; ``last`` has the last token of each prefix."""
        out, length = [], self.length
        while at > 0:
            token = last[at - 1]
            if token < 0:
                raise ValueError("a prefix without an encoding: the ranks are not those of a BPE")
            out.append(token)
            at -= int(length[token])
        return out

    def _settled(self, last: list[int], state: int) -> int:
        """The longest prefix on whose tokens all live hypotheses agree."""
        common: set[int] | None = None
        for code in self.live[state]:
            at = len(last) - self.depth[code & (1 << self.bits) - 1]
            ends = {at}
            for token in self._back(last, at):
                at -= int(self.length[token])
                ends.add(at)
            common = ends if common is None else common & ends
        return max(common or {0})

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern. Tokens of long pieces are emitted every ``EMIT`` bytes."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.live) > MAX_STATES:
            self._reset()
        state, last, out = self.start, [], []
        for byte in piece:
            arc = int(self.arc_at[state, byte]) or self._arc(state, byte)
            state = int(self.to[arc])
            last.append(int(self.ends[arc]))
            if len(last) >= EMIT:
                settled = self._settled(last, state)
                out += self._back(last, settled)[::-1]
                del last[:settled]
                if len(self.live) > MAX_STATES:  # within a very long piece, too
                    live = self.live[state]
                    self._reset()
                    state = self._state(live)
        out += self._back(last, len(last))[::-1]
        return out

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the ends of each piece's ids, 0 first.

        Short pieces run through the machine side by side, a byte of each in a step.
        """
        ids, sizes = [], []
        for i in range(0, len(pieces), GROUP):
            if len(self.live) > MAX_STATES:
                self._reset()
            found, n = self._group(pieces[i : i + GROUP])
            ids.append(found)
            sizes.append(n)
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.concatenate([[0], *(np.cumsum(np.concatenate(sizes)),)] if sizes else [[0]]).astype(np.int64)

    def _group(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int64, n)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        alone = {int(i): self.encode(pieces[i]) for i in np.nonzero((lengths > TOGETHER) & (whole < 0))[0]}
        run = np.nonzero((lengths <= TOGETHER) & (whole < 0))[0]
        run = run[np.argsort(-lengths[run], kind="stable")]  # longest first: those that go on are a prefix
        own = lengths[run]
        data = np.frombuffer(b"".join([pieces[i] for i in run.tolist()]), np.uint8)
        begin = np.cumsum(own) - own
        depth = int(own[0]) if len(own) else 0
        last, state = np.full((depth, len(run)), -1, np.int32), np.full(len(run), self.start, np.int64)
        going = np.searchsorted(-own, -np.arange(depth), side="left")  # pieces longer than k
        for k in range(depth):
            m = going[k]
            byte = data[begin[:m] + k]
            arc = self.arc_at[state[:m], byte]
            if (new := np.nonzero(arc == 0)[0]).size:
                for key in np.unique(state[new] << 8 | byte[new]).tolist():
                    self._arc(key >> 8, key & 255)
                arc = self.arc_at[state[:m], byte]
            state[:m] = self.to[arc]
            last[k, :m] = self.ends[arc]
            if len(self.live) > MAX_STATES:
                met, which = np.unique(state[:m], return_inverse=True)
                kept = [self.live[s] for s in met.tolist()]
                self._reset()
                state[:m] = np.array([self._state(x) for x in kept])[which]
        # follow the tokens back from the ends
        back, at = [], own.copy()
        rows = np.nonzero(at)[0]
        while rows.size:
            token = last[at[rows] - 1, rows]
            if (token < 0).any():
                raise ValueError("a prefix without an encoding: the ranks are not those of a BPE")
            back.append((rows, token))
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        sizes = np.where(whole >= 0, 1, 0)
        counts = np.zeros(len(run), np.int64)
        for rows, _ in back:
            counts[rows] += 1
        sizes[run] = counts
        for i, found in alone.items():
            sizes[i] = len(found)
        ends = np.cumsum(sizes)
        ids = np.zeros(int(ends[-1]) if n else 0, "<u4")
        one = np.nonzero(whole >= 0)[0]
        ids[ends[one] - 1] = whole[one]
        for j, (rows, token) in enumerate(back):
            ids[ends[run[rows]] - 1 - j] = token
        for i, found in alone.items():
            ids[ends[i] - len(found) : ends[i]] = found
        return ids, sizes


class Encoder:
    """Whole texts to ids: splits by the pattern, runs the transducer, remembers chunks between spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.odd = regex.compile(r" (?=\s)| $").search if pattern == SPACED else lambda text: True
        self.younger: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _made(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of which each is split by the pattern for itself."""
        split = [self.split(x) for x in texts]
        ids, ends = self.machine.encode_all([p.encode() for p in chain.from_iterable(split)])
        data = memoryview(ids.tobytes())
        at = ends[np.cumsum([0, *map(len, split)])] * 4
        return [bytes(data[a:b]) for a, b in pairwise(at.tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A space before a character that is no white space always starts a match, so texts are cut at
        spaces and each chunk is encoded once; texts with other spaces are split as a whole. A chunk
        stands for itself with the space before it, a text's first one, marked by a space behind, without.
        """
        whole = {i for i, x in enumerate(texts) if self.odd(x)}
        cut = [[] if i in whole else x.split(" ") for i, x in enumerate(texts)]
        for chunks in cut:
            if chunks:
                chunks[0] += " "
        wanted = set(chain.from_iterable(cut))
        ids = {c: self.younger[c] for c in wanted if c in self.younger}
        ids |= {c: self.older[c] for c in wanted if c not in ids and c in self.older}
        new = [c for c in wanted if c not in ids]
        ids |= zip(new, self._made([c[:-1] if c[-1:] == " " else " " + c for c in new]), strict=True)
        if len(self.younger) + len(wanted) > MAX_REMEMBERED // 2:
            self.older, self.younger = self.younger, {}
        if len(wanted) <= MAX_REMEMBERED // 2:
            self.younger |= {c: x for c, x in ids.items() if len(c) <= MAX_CHUNK}
        odd = dict(zip(whole, self._made([texts[i] for i in whole]), strict=True))
        of = ids.__getitem__
        return [odd[i] if i in odd else b"".join(map(of, chunks)) for i, chunks in enumerate(cut)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _utf8_steps() -> list[bytes]:
    """The machine's table: for each state, the next one by byte.

    States: 0 between characters; 1, 2, 3 before the last, the last two, the last three continuation
    bytes; 4 to 7 after E0, ED, F0, F4, whose next byte has a narrower range; 8 where no character can go on.
    """
    bad, tail = 8, range(0x80, 0xC0)
    steps = [[bad] * 256 for _ in range(8)]
    for first, last, to in ((0, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        steps[0][first : last + 1] = [to] * (last + 1 - first)
    for state, own, to in ((1, tail, 0), (2, tail, 1), (3, tail, 2), (4, range(0xA0, 0xC0), 1), (5, range(0x80, 0xA0), 1), (6, range(0x90, 0xC0), 2), (7, range(0x80, 0x90), 2)):
        for b in own:
            steps[state][b] = to
    return [bytes(s) for s in steps]


class Utf8Machine:
    """Incremental UTF-8: bytes in pieces that may end inside a character, text out as characters complete.

    What cannot be part of a character becomes U+FFFD, one for each longest beginning of a character.
    """

    STEPS = _utf8_steps()

    def __init__(self) -> None:
        self.state, self.held = 0, bytearray()

    def feed(self, data: bytes) -> str:
        state, held, steps, out = self.state, self.held, self.STEPS, []
        for byte in data:
            to = steps[state][byte]
            if to == 8 and state:  # the character breaks off; the byte begins another
                out.append("\ufffd")
                held.clear()
                to = steps[0][byte]
            if to == 8:
                out.append("\ufffd")
                state = 0
                continue
            held.append(byte)
            state = to
            if not state:
                out.append(held.decode())
                held.clear()
        self.state = state
        return "".join(out)

    def end(self) -> str:
        broken, self.state = self.state, 0
        self.held.clear()
        return "\ufffd" if broken else ""


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        #: whether a token is whole characters, as the machine finds: from between characters to between characters
        self.whole = np.zeros(len(self.table), bool)
        steps = Utf8Machine.STEPS
        for token, rank in ranks.items():
            self.table[rank] = token
            state = 0
            for byte in b"" if token.isascii() else token:
                state = steps[state][byte]
                if state == 8:
                    break
            self.whole[rank] = state == 0

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text, step by step; only the last step may hold an incomplete character back.

        Between characters the machine takes runs of whole tokens at once, else a token's bytes one by one.
        """
        machine, of = Utf8Machine(), self.table.__getitem__
        for i in range(0, len(ids), DECODE_STEP):
            part, out, at = list(map(of, ids[i : i + DECODE_STEP].tolist())), [], 0
            ends = [*np.nonzero(~self.whole[ids[i : i + DECODE_STEP]])[0].tolist(), len(part)]
            while at < len(part):
                to = at if machine.state else ends[bisect_left(ends, at)]
                if to > at:
                    out.append(b"".join(part[at:to]).decode())
                    at = to
                else:
                    out.append(machine.feed(part[at]))
                    at += 1
            yield "".join(out)
        yield machine.end()


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _digests(ids: list[bytes], decoder: Decoder) -> tuple[list[str], list[str]]:
    """Of each list of ids: the digest of its ids and that of the text they decode to, in UTF-8."""
    of_text = []
    for own in ids:
        sha = hashlib.sha256()
        for text in decoder.stream(np.frombuffer(own, "<u4")):
            sha.update(text.encode())
        of_text.append(sha.hexdigest())
    return [hashlib.sha256(own).hexdigest() for own in ids], of_text


#: The coder last used in this worker process. What it has learnt serves all tasks that the process runs.
_coders: dict[tuple[bytes, str], tuple[Encoder, Decoder]] = {}


def coder(ranks_file: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    key = (hashlib.sha256(ranks_file).digest(), pattern)
    if key not in _coders:
        _coders.clear()
        ranks = load_ranks(ranks_file)
        _coders[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _coders[key]


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, text: str = "text", ids: str = "ids", digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int), special tokens being plain text; a null text is empty.

    With ``digests``, also n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (the text that the ids decode to, in UTF-8). ``ranks_file`` is the content of a ranks
    file, about 1 MB, broadcast once. Work is per row; nothing is shuffled. ``keep`` names the columns of
    ``docs`` to return (all by default); a column of ``docs`` with the name of a new one, in any case of
    letters, is replaced. An empty table gives an empty result; repeated rows are coded each for itself;
    a very long text is held in memory once with its ids.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] * digests + [ids]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new}]
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), ids: T.ArrayType(T.IntegerType(), False)}
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, kinds[c]) for c in new])
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(sent.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                found = encoder.encode_all([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
                more = [pa.array([len(x) // 4 for x in found], pa.int64()), *map(pa.array, _digests(found, decoder))] if digests else []
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + more + [_lists(found)], names=kept + new)

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, ranks_file: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of ``ids``; a null list gives an empty text."""
    sent = coded.sparkSession.sparkContext.broadcast(ranks_file)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(load_ranks(sent.value))
        for lists in batches:
            yield lists.map(lambda x: "".join(decoder.stream(np.asarray([] if x is None else x, np.int64))))

    return coded.withColumn(text, of(F.col(ids)))
