"""Seeded merge-dropout over a SentencePiece BPE vocabulary, and lossless decoding.

Encoding follows the model: white space becomes the meta symbol, a leading one is added, characters merge by piece
score (best first, leftmost on a tie), what is left outside the vocabulary becomes bytes. A candidate merge on the
agenda is skipped when its keyed hash, over (key, start, split, end) in characters, falls under the dropout rate. The
key is that of the occurrence: it hashes (seed, doc_id, the chunk's place in the text), so a word is segmented anew
wherever it stands. No piece reaches over a chunk's end (a chunk is a run of meta symbols and the characters up to the
next), so chunks are independent.

Occurrences of a batch go side by side. Those of a frequent chunk share its walks: a walk is the agenda under one set of
skipped candidates, known with the candidates that it still draws; an occurrence whose draws skip none of them ends
with the walk's pieces, any other goes on to the walk that skips its first one too. All other occurrences run their own
agendas, short chunks in arrays, long ones with a heap. All ways skip the same candidates.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from signalframe.functions.memory import unused_returned
from signalframe.llm.common import Memory, narrowed, pieces

DROPOUT = 0.1
SEED = 97
LONG = 40
FREQUENT, AGAIN = 6, 3  # occurrences in a batch from which a first and a further walk are worth their making
MOST_CHUNKS, MOST_WALKS = 40_000, 200_000
SIDE_BY_SIDE = 1 << 16
BATCH_BYTES = 8 << 20
META = "▁"
#: Stands for a literal meta symbol of the text; no valid text holds it.
LITERAL = "\udc00"
CHUNKS = re.compile(f"\n|{META}*[^{META}\n]+|{META}+")
MASK = (1 << 64) - 1
NEVER = np.int64(1) << 40


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _mixes(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Vocabulary:
    """Pieces, their bytes, and the table of merges (left, right) -> (rank, merged); every pair of known parts counts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        if any(META in p.lstrip(META) for _, p, _ in normal) or any("\n" in p for _, p, _ in normal):
            raise ValueError("pieces reach over chunk ends")
        self.ids = {p: i for i, p, _ in normal}
        self.size = len(model.pieces)
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.bytes = [p.piece.replace(META, " ").encode() if p.type == p.NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else b"" for p in model.pieces]
        self.chars = dict(self.ids)
        for _, p, _ in normal:
            for c in p:
                self.chars.setdefault(c, len(self.chars) + self.size)
        rank = {i: r for r, (i, _, _) in enumerate(sorted(normal, key=lambda t: (-t[2], t[0])))}
        self.merges = {(self.chars[p[:k]], self.chars[p[k:]]): (rank[i], i) for i, p, _ in normal for k in range(1, len(p)) if p[:k] in self.chars and p[k:] in self.chars}
        self._unit = -1 - np.arange(0x110000)
        self._unit[[ord(c) for c in self.chars if len(c) == 1]] = [i for c, i in self.chars.items() if len(c) == 1]
        self._unit[ord(LITERAL)] = -1 - ord(META)
        pairs = np.array([(a << 20 | b, r, m) for (a, b), (r, m) in self.merges.items()], np.int64)
        self._bits = int(len(pairs) * 4 - 1).bit_length()
        self._keys, self._at = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, np.int64)
        self._rank, self._merged = pairs[:, 1], pairs[:, 2].astype(np.int32)
        todo, slot = np.arange(len(pairs)), self._slot(pairs[:, 0])
        while len(todo):
            free = self._keys[slot] < 0
            self._keys[slot[free]] = pairs[todo[free], 0]
            done = self._keys[slot] == pairs[todo, 0]
            self._at[slot[done]] = todo[done]
            todo, slot = todo[~done], slot[~done] + 1 & (1 << self._bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NEVER, merged piece) of each pair."""
        keys = left.astype(np.int64) << 20 | right
        rank, merged = np.full(len(keys), NEVER), np.zeros(len(keys), np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))  # characters outside the vocabulary merge with nothing
        slot = self._slot(keys[todo])
        while len(todo):
            seen = self._keys[slot]
            hit = seen == keys[todo]
            at = self._at[slot[hit]]
            rank[todo[hit]], merged[todo[hit]] = self._rank[at], self._merged[at]
            on = ~hit & (seen >= 0)
            todo, slot = todo[on], slot[on] + 1 & (1 << self._bits) - 1
        return rank, merged

    def unit(self, char: str) -> int:
        """A character's symbol; -1 - code point outside the vocabulary."""
        return int(self._unit[ord(char)])

    def units(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return self._unit[points]

    def emit(self, symbols: list[int]) -> list[int]:
        """Symbols as ids; what is outside becomes bytes."""
        out = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                char = chr(-1 - s) if s < 0 else next(c for c, i in self.chars.items() if i == s)
                out += [self.byte_id[b] for b in char.encode()]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def key_of(doc_id: int | None, place: int) -> int:
    return _mix(_document_key(doc_id) + place & MASK)


def _document_key(doc_id: int | None) -> int:
    return _mix(xxhash.xxh64_intdigest(str(doc_id), SEED))


def _candidate(start: int, split: int, end: int) -> int:
    return (start << 42 | split << 21 | end) & MASK


def skipped(key: int, candidate: int, rate: float) -> bool:
    return _mix(key ^ candidate) >> 11 < rate * (1 << 53)


def agenda(vocab: Vocabulary, chunk: str, skip: Callable[[int], bool]) -> list[int]:
    """One chunk by a heap of candidate merges; ``skip`` is asked once for each candidate that comes up."""
    symbols, ends = [vocab.unit(c) for c in chunk], list(range(1, len(chunk) + 1))
    before, after = list(range(-1, len(chunk) - 1)), [*range(1, len(chunk)), -1]
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (got := vocab.merges.get((symbols[i], symbols[j]))) and not skip(_candidate(i, ends[i], ends[j])):
            heapq.heappush(heap, (got[0], i, ends[i], ends[j], got[1]))

    for i in range(len(chunk) - 1):
        offer(i)
    while heap:
        _, i, split, end, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or ends[i] != split or j < 0 or ends[j] != end:
            continue
        symbols[i], ends[i], after[i], symbols[j] = merged, end, after[j], None
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return vocab.emit([s for s in symbols if s is not None])


class Walk:
    """The agenda of a chunk that skips ``skips`` and nothing after: the candidates it draws after the last of these, in
    order, the ids it ends with, and the walks that skip one of those candidates too."""

    made = 0

    def __init__(self, vocab: Vocabulary, chunk: str, skips: tuple[int, ...] = ()):
        asked: list[int] = []

        def skip(candidate: int) -> bool:
            asked.append(candidate)
            return candidate in skips

        self.chunk, self.skips, self.next = chunk, skips, {}
        self.ids = packed(agenda(vocab, chunk, skip))
        self.draws = np.array(asked[asked.index(skips[-1]) + 1 :] if skips else asked, np.uint64)
        Walk.made += 1


def _ranks(vocab: Vocabulary, sym, start, end, at, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged piece of the candidates (at, at + 1); skipped ones have rank NEVER."""
    rank, merged = vocab.lookup(sym[at], sym[at + 1])
    live = np.flatnonzero(rank < NEVER)
    if rate and len(live):
        s, m, e = (x.astype(np.uint64) for x in (start[at[live]], end[at[live]], end[at[live] + 1]))
        h = _mixes(key[at[live]] ^ (s << np.uint64(42) | m << np.uint64(21) | e))
        rank[live[h >> np.uint64(11) < np.uint64(rate * (1 << 53))]] = NEVER
    return rank, merged


def agendas(vocab: Vocabulary, chunks: list[str], keys: np.ndarray, rate: float) -> list[bytes]:
    """Many chunks, each with its key, side by side: in each round every chunk carries out the best candidate of its agenda.

    Returns each chunk's ids as little-endian unsigned 16-bit numbers.
    """
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    sym = vocab.units("".join(chunks))
    owner = np.repeat(np.arange(len(chunks)), lengths)
    start = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    end, key = start + 1, keys[owner]
    rank, merged = np.full(len(sym), NEVER), np.zeros(len(sym), np.int32)
    at = np.flatnonzero(owner[:-1] == owner[1:])
    rank[at], merged[at] = _ranks(vocab, sym, start, end, at, key, rate)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank << 20 | start, first)
        over = best >= NEVER << 20
        if over.any():
            sizes = np.diff(np.append(first, len(sym)))
            gone = np.repeat(over, sizes)
            done.append((owner[gone], sym[gone]))
            stay = ~gone
            sym, owner, start, end, rank, merged, key = (x[stay] for x in (sym, owner, start, end, rank, merged, key))
            if not len(sym):
                break
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = best[~over]
        which = np.zeros(len(chunks), np.int64)
        which[owner[first]] = best & (1 << 20) - 1
        i = np.flatnonzero(start == which[owner])
        sym[i], end[i] = merged[i], end[i + 1]
        stay = np.ones(len(sym), bool)
        stay[i + 1] = False
        i -= np.arange(len(i))  # one symbol fewer for each chunk before
        sym, owner, start, end, rank, merged, key = (x[stay] for x in (sym, owner, start, end, rank, merged, key))
        near = np.zeros(len(sym), bool)
        near[i] = near[i[i > 0] - 1] = True
        rank[near] = NEVER
        near = np.flatnonzero(near)
        near = near[near + 1 < len(sym)]
        near = near[owner[near] == owner[near + 1]]
        rank[near], merged[near] = _ranks(vocab, sym, start, end, near, key, rate)
    out = [b""] * len(chunks)
    if done:
        owners, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owners, kind="stable")
        owners, symbols = owners[order], symbols[order]
        odd = set(owners[(symbols < 0) | (symbols >= vocab.size)].tolist())
        cut = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        flat, names = symbols.astype("<u2").tobytes(), owners[cut].tolist()
        for o, a, b in zip(names, cut.tolist(), [*cut[1:].tolist(), len(symbols)]):
            out[o] = packed(vocab.emit(symbols[a:b].tolist())) if o in odd else flat[2 * a : 2 * b]
    return out


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u2").tobytes()


def chunked(text: str) -> list[str]:
    return CHUNKS.findall(META + text.replace(META, LITERAL).replace(" ", META)) if text else []


@cache
def walks(path: str) -> Memory:
    """Chunk -> its first walk, one memory a Python worker."""
    return Memory(lambda chunk: Walk(vocabulary(path), chunk), MOST_CHUNKS)


def _walked(vocab: Vocabulary, start: dict[int, Walk], code: np.ndarray, key: np.ndarray, rate: float, out: np.ndarray) -> np.ndarray:
    """Sends occurrences (code: their chunk, of those in ``start``) down the walks, writes the ids of those that end on one
    to ``out``, and returns the others (walks that too few of them ask for are not made)."""
    left, at = [], np.flatnonzero(np.isin(code, np.fromiter(start, np.int64, len(start))))
    number = {c: i for i, c in enumerate(start)}
    known, on = list(start.values()), np.array([number[c] for c in code[at].tolist()], np.int64)
    while len(at):
        ids = np.empty(len(known), object)
        ids[:] = [w.ids for w in known]
        sizes = np.array([len(w.draws) for w in known], np.int64)
        draws, first = np.concatenate([w.draws for w in known]), np.cumsum(sizes) - sizes
        hit, step = [], []
        for begin in range(0, len(at), SIDE_BY_SIDE):  # an occurrence has many draws, so not all at once
            some, own = on[begin : begin + SIDE_BY_SIDE], key[at[begin : begin + SIDE_BY_SIDE]]
            each = sizes[some]
            which = np.repeat(np.arange(len(some)), each)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            skip = np.flatnonzero(_mixes(own[which] ^ draws[first[some][which] + nth]) >> np.uint64(11) < np.uint64(rate * (1 << 53)))
            one, index = np.unique(which[skip], return_index=True)
            hit.append(one + begin)
            step.append(nth[skip[index]])
        hit, step = np.concatenate(hit), np.concatenate(step)
        through = np.ones(len(at), bool)
        through[hit] = False
        out[at[through]] = ids[on[through]]
        pair = on[hit] << 32 | step
        asked, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        made, place = [], np.full(len(asked), -1, np.int64)
        for i, (p, n) in enumerate(zip(asked.tolist(), times.tolist())):
            walk, draw = known[p >> 32], p & (1 << 32) - 1
            then = walk.next.get(draw)
            if then is None and n >= AGAIN:
                then = walk.next[draw] = Walk(vocab, walk.chunk, (*walk.skips, int(walk.draws[draw])))
            if then is not None:
                place[i] = len(made)
                made.append(then)
        at, on, known = at[hit], place[which], made
        left.append(at[on < 0])
        at, on = at[on >= 0], on[on >= 0]
    return np.concatenate(left) if left else at


def encode_all(path: str, texts: list[str], doc_ids: list[int | None], rate: float = DROPOUT) -> list[np.ndarray]:
    """Ids of each text; every chunk is drawn under the key of its document and place."""
    vocab, memory = vocabulary(path), walks(path)
    if Walk.made > MOST_WALKS:
        memory.clear()
        memory.older, Walk.made = {}, 0
    split = [chunked(t) for t in texts]
    flat = list(chain.from_iterable(split))
    number = {c: i for i, c in enumerate(dict.fromkeys(flat))}
    distinct = list(number)
    code = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    counts = np.array(list(map(len, split)), np.int64)
    ends = np.cumsum(counts)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    place = np.cumsum(size[code]) - size[code]
    begins = np.append(place, 0)[np.minimum(ends - counts, len(flat))]  # of a text without chunks: unused
    own = np.array([_document_key(d) for d in doc_ids], np.uint64)
    key = _mixes(np.repeat(own, counts) + (place - np.repeat(begins, counts)).astype(np.uint64))
    out = np.empty(len(flat), object)
    often = (np.bincount(code, minlength=len(distinct)) >= FREQUENT) | np.fromiter((c in memory or c in memory.older for c in distinct), bool, len(distinct))
    often &= size <= LONG
    alone = np.flatnonzero(~often[code])
    start = {c: memory[distinct[c]] for c in np.flatnonzero(often).tolist()}
    rest = np.concatenate([alone, _walked(vocab, start, code, key, rate, out)]) if start else alone
    long = size[code[rest]] > LONG
    for i in rest[long].tolist():
        out[i] = packed(agenda(vocab, flat[i], lambda c, k=int(key[i]): skipped(k, c, rate)))
    rest = rest[~long]
    for first in range(0, len(rest), SIDE_BY_SIDE):
        some = rest[first : first + SIDE_BY_SIDE]
        got = np.empty(len(some), object)
        got[:] = agendas(vocab, [flat[i] for i in some.tolist()], key[some], rate)
        out[some] = got
    line = out.tolist()
    return [np.frombuffer(b"".join(line[e - n : e]), "<u2") for e, n in zip(ends.tolist(), counts.tolist())]


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text again, exactly: pieces' bytes in a row without the added leading space."""
    return b"".join(map(vocab.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


OUT = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def forgotten() -> None:
    """Drops this worker's vocabularies and walks, so that a worker that waits for other steps holds none of them."""
    walks.cache_clear()
    vocabulary.cache_clear()
    Walk.made = 0
    unused_returned()


def _in_batches(docs: DataFrame, model: str, rate: float, finish, out: str, batch_bytes: int = BATCH_BYTES, remember: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        try:
            for batch in pieces(batches, batch_bytes):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield finish(vocab, ids, texts, encode_all(model, texts, ids, rate))
        finally:
            if not remember:
                vocab = None
                forgotten()

    return narrowed(docs).mapInArrow(run, out)


def segmented(docs: DataFrame, model: str, rate: float = DROPOUT) -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def finish(vocab, ids, texts, got) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tolist() for x in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _in_batches(docs, model, rate, finish, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, model: str, rate: float = DROPOUT, batch_bytes: int = BATCH_BYTES, remember: bool = True) -> DataFrame:
    """One row per document: n_tokens, crc32 of the ids as little-endian unsigned 32-bit, the decoded text's sha256, and
    whether it equals the text.

    Null and empty texts have no ids. Repeated rows get the same ids (the keys depend on doc_id and place). A literal meta symbol
    becomes bytes, so it comes back. An empty table gives an empty result. ``batch_bytes`` of text are
    worked on at once; results do not depend on it. Without ``remember`` a worker drops its vocabulary and walks after each
    task, as a stage among others should, since idle workers stay in the executor's memory.
    """

    def finish(vocab, ids, texts, got) -> pa.RecordBatch:
        back = [decode(vocab, x) for x in got]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in got]
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
        columns = [ids, [len(x) for x in got], crc, sha, [a == b for a, b in zip(back, texts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], [x.split()[0] for x in OUT.split(", ")])

    return _in_batches(docs, model, rate, finish, OUT, batch_bytes, remember)
