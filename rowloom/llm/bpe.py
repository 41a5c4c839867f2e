"""Byte-level BPE encoding and decoding.

Encoding. Text is split as the public byte-level tokenizers do (contractions,
runs of letters, of numbers, of other signs, each with one space before it, and
white space). Each piece goes through a transducer compiled from the merges. A
state is the string of bytes read but not yet covered by emitted tokens. After
a byte, every place where the token that is being read may begin is one after
which the pending bytes go on to be the start of some token; the tokens before
those places, as far as all of them agree, are certain whatever follows, and are
emitted. So lookahead is bounded by the longest token. States and transitions
are made when first needed and kept in a hash table of a fixed size, which is
emptied but for the states in use before it gets too full. All distinct pieces of
a chunk run in lockstep: a numpy step is one byte of each.

A piece of over ``LANE`` bytes is cut into lanes that run side by side, each as if
the piece began there. A state is nothing but the pending bytes, so a lane is right
from the first place on where the true run, which goes on from the lane before it,
has as many bytes pending; up to there the true run's tokens are taken. A lane
where that doesn't happen is walked byte by byte.

Decoding. ``StreamDecoder`` turns ids into text as they come: a UTF-8 state
machine holds back the bytes of a character that isn't whole; what can't become
a character turns into U+FFFD, as Python's decoder has it.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter. It
is read on the driver and broadcast (under 2 MB).

Defined cases. Null text: ids null, n_tokens null, exact null. Empty text: no
ids, 0, true. Null doc_id and repeated rows: one result row each. Ids beyond the
vocabulary: ValueError on decoding. Empty table: empty result. Extra columns are
ignored. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLOTS = 1 << 19
LANE = 256
STEP = 4096  # ids that come at once in streaming decode


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, _, b in (x.partition(b" ") for x in lines) if b}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: the pair of least rank merges first, the leftmost of equals. The definition to match."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == sys.maxsize:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


# -- pieces -------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE = 1, 2, 3
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    if not _kinds:
        major = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((major.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        t[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds.append(t)
    return _kinds[0]


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces begin, over adjacent texts."""
    n_bytes = len(buf)
    if not n_bytes:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    char = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(char)
    kind = np.zeros(n + 4, np.uint8)
    kind[:n] = _kind_table()[char]
    fresh = np.zeros(n + 4, bool)  # the first character of a text, and all beyond the end
    fresh[np.searchsorted(lead, offs)] = True
    fresh[n:] = True
    prev = np.append(0, kind[: n - 1])
    run = fresh[:n] | (kind[:n] != prev)
    begin = np.zeros(n + 4, bool)
    word = run & (kind[:n] != _SPACE)
    joined = word & ~fresh[:n] & np.append(False, char[:-1] == 32)
    begin[:n] = run & ~joined
    begin[np.flatnonzero(joined) - 1] = True
    # The last white space before a word stands apart from the rest of its run.
    after = np.flatnonzero(word & ~fresh[:n] & (prev == _SPACE))
    begin[after - 1] = True
    # Contractions: an apostrophe that begins a piece, followed by s d m t, ll ve re.
    at = np.flatnonzero((char == 39) & begin[:n])
    at = at[(kind[at + 1] == _LETTER) & ~fresh[at + 1]]
    if len(at):
        padded = np.append(char, np.zeros(4, np.uint32))
        one = np.isin(padded[at + 1], np.frombuffer(b"sdmt", np.uint8))
        a, b = padded[at + 1], padded[at + 2]
        two = ~one & ~fresh[at + 2] & (((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101)))
        for hit, length in ((at[one], 2), (at[two], 3)):
            begin[hit + 1] = False
            begin[hit + length] = True
    return lead[begin[:n]]


# -- the transducer -------------------------------------------------------------


class Transducer:
    """Lazily determinised; see the module's head. State 0 is the empty string."""

    def __init__(self, ranks: dict[bytes, int], slots: int = SLOTS):
        self.ranks, self.slots = ranks, slots
        self.by_id = {i: t for t, i in ranks.items()}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.reset()

    def reset(self) -> None:
        self.outputs: list[tuple[int, ...]] = [()]
        self.out_number: dict[tuple[int, ...], int] = {(): 0}
        self.known: dict[bytes, tuple[int, ...]] = {b"": ()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Drops states and transitions; emissions keep their numbers."""
        self.key = np.full(self.slots, -1, np.int64)
        self.to, self.out = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.filled = 0
        self.walked: dict[int, tuple[int, int]] = {}
        self.states: list[bytes] = [b""]
        self.number = {b"": 0}
        self.final = np.zeros(1024, np.int32)  # what a state emits at a piece's end
        self.due = np.zeros(1024, np.int32)  # its number of pending bytes

    def _renumber(self, state: np.ndarray) -> np.ndarray:
        """Empties the table; the given states' new numbers."""
        some, which = np.unique(state, return_inverse=True)
        kept = [self.states[i] for i in some.tolist()]
        self._forget()
        return np.array([self._state(x) for x in kept], np.int64)[which]

    def tokens(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a piece, from those of its beginnings: its last token is the one that
        ends it and stays apart from the last token before it when both are merged alone."""
        if (found := self.known.get(piece)) is not None:
            return found
        for at in range(max(0, len(piece) - self.longest), len(piece)):
            last = self.ranks.get(piece[at:])
            if last is not None:
                before = self.tokens(piece[:at])
                if not before or self._apart(before[-1], last):
                    self.known[piece] = (*before, last)
                    return self.known[piece]
        raise ValueError("the vocabulary lacks a byte")

    def _apart(self, left: int, right: int) -> bool:
        pair = left, right
        if pair not in self.pairs:
            self.pairs[pair] = merge(self.by_id[left] + self.by_id[right], self.ranks) == [left, right]
        return self.pairs[pair]

    def _emission(self, ids: tuple[int, ...]) -> int:
        if ids not in self.out_number:
            self.out_number[ids] = len(self.outputs)
            self.outputs.append(ids)
        return self.out_number[ids]

    def _state(self, pending: bytes) -> int:
        if pending not in self.number:
            n = len(self.states)
            if n == len(self.due):
                self.final, self.due = (np.concatenate([x, np.zeros_like(x)]) for x in (self.final, self.due))
            self.number[pending] = n
            self.states.append(pending)
            self.final[n], self.due[n] = self._emission(self.tokens(pending)), len(pending)
        return self.number[pending]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, emission): the determinised transition."""
        read = self.states[state] + bytes([byte])
        n = len(read)
        certain = self.tokens(read)
        for q in range(max(0, n - self.longest), n):
            if read[q:] in self.starts:
                way = self.tokens(read[:q])
                k = 0
                while k < min(len(way), len(certain)) and way[k] == certain[k]:
                    k += 1
                certain = certain[:k]
                if not k:
                    break
        done = sum(len(self.by_id[i]) for i in certain)
        return self._state(read[done:]), self._emission(certain)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (K.mix(key.astype(np.uint64)) % np.uint64(self.slots)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't there."""
        at = self._slot(key)
        found = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.key[at[open_]]
            hit = held == key[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) % self.slots
        return found

    def _insert(self, key: int, at: int) -> None:
        if len(self.known) > 2 * self.slots:
            self.known = {b"": ()}
        if len(self.pairs) > 2 * self.slots:
            self.pairs = {}
        to, out = self.step(key >> 8, key & 255)
        while self.key[at] >= 0:
            at = (at + 1) % self.slots
        self.key[at], self.to[at], self.out[at] = key, to, out
        self.filled += 1

    def _advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, emissions) of at most a quarter of ``slots`` states. Numbers of states
        from before hold no longer if the table had to be emptied."""
        key = state * 256 + byte
        at = self._find(key)
        if (at < 0).any():
            new = np.unique(key[at < 0])
            if self.filled + len(new) > self.slots // 4 * 3:
                key = self._renumber(state) * 256 + byte
                new = np.unique(key)
            for k, slot in zip(new.tolist(), self._slot(new).tolist(), strict=True):
                self._insert(k, slot)
            at = self._find(key)
        return self.to[at].astype(np.int64), self.out[at]

    def _lockstep(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray | None = None, sync: np.ndarray | None = None, record: np.ndarray | None = None):
        """Runs lanes of falling size: (their pending bytes at the end, what they emit there,
        and who emitted what when). record: takes the pending bytes after each byte. sync: such
        a record of other runs; a lane ends where it agrees with it, and its place there is
        returned as well, its size if it never does."""
        n = len(start)
        due, last, met = np.zeros(n, np.int64), np.zeros(n, np.int64), size.copy()
        lane = np.arange(n)
        state = np.zeros(n, np.int64) if state is None else state
        who, when, what = [], [], []
        for i in range(int(size[0]) if n else 0):
            state, out = self._advance(state, buf[start[lane] + i])
            some = np.flatnonzero(out)
            who.append(lane[some])
            when.append(np.full(len(some), i))
            what.append(out[some])
            pending = self.due[state]
            if record is not None:
                record[lane, i] = pending
            ended = size[lane] == i + 1
            if sync is not None:
                agree = pending == sync[lane, i]
                met[lane[agree]] = i
                ended |= agree
            if ended.any():
                due[lane[ended]], last[lane[ended]] = pending[ended], self.final[state[ended]]
                lane, state = lane[~ended], state[~ended]
            if not len(lane):
                break
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return due, last, met, join(who), join(when), join(what)

    def _walk(self, lane: bytes, pending: bytes, sync: list[int]) -> tuple[int, bytes, list[tuple[int, int]]]:
        """One lane byte by byte: (where it met sync or its size, the bytes pending, emissions)."""
        state, found = self._state(pending), []
        for i, byte in enumerate(lane):
            key = state << 8 | byte
            step = self.walked.get(key)
            if step is None:
                if len(self.states) > 2 * self.slots or len(self.walked) > self.slots:
                    key = int(self._renumber(np.array([state]))[0]) << 8 | byte
                step = self.walked[key] = self.step(key >> 8, key & 255)
            state, out = step
            if out:
                found.append((i, out))
            if self.due[state] == sync[i]:
                return i, b"", found
        return len(lane), self.states[state], found

    def run(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them) of the pieces buf[start:end], in order."""
        n = len(start)
        if self.filled > self.slots // 2 or len(self.outputs) > 2 * self.slots:
            self.reset()
        if len(self.states) > 2 * self.slots:
            self._forget()
        # Lanes: piece, place in it, bytes.
        lanes = np.maximum(-(-(end - start) // LANE), 1)
        of = np.repeat(np.arange(n), lanes)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        begin = start[of] + place
        size = np.minimum(end[of] - begin, LANE)
        later = place > 0
        record = np.zeros((int(later.sum()), LANE), np.int32)
        row = np.cumsum(later) - 1
        due, last = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        most = max(1, self.slots // 4)
        who, when, what = [], [], []
        for part in np.split(np.arange(len(of)), np.arange(most, len(of), most)) if len(of) else []:
            for group in (part[~later[part]], part[later[part]]):
                group = group[np.argsort(-size[group], kind="stable")]
                taken = np.zeros((len(group), LANE), np.int32) if len(group) and later[group[0]] else None
                d, f, _, a, b, c = self._lockstep(buf, begin[group], size[group], record=taken)
                due[group], last[group] = d, f
                if taken is not None:
                    record[row[group]] = taken
                who.append(group[a])
                when.append(b)
                what.append(c)
        met = np.full(len(of), -1)  # a lane's own emissions count after this byte
        fix = np.flatnonzero(later)
        if len(fix):
            own = [np.concatenate(x) for x in (who, when, what)]
            met[fix], more = self._stitch(buf, begin, size, due, last, fix, record)
            keep = own[1] > met[own[0]]
            who, when, what = ([x[keep], y] for x, y in zip(own, more, strict=True))
        tail = np.cumsum(lanes) - 1
        who.append(tail)
        when.append(np.full(n, LANE))
        what.append(last[tail])
        lane, what, when = np.concatenate(who), np.concatenate(what), np.concatenate(when)
        by = np.lexsort((when, lane))
        lane, what = lane[by], what[by]
        length = np.array([len(x) for x in self.outputs], np.int64)
        flat = np.array([i for x in self.outputs for i in x], np.int32)
        k = length[what]
        ids = flat[_spans((np.cumsum(length) - length)[what], k)]
        return ids, np.bincount(of[lane], k, n).astype(np.int64)

    def _stitch(self, buf: np.ndarray, begin: np.ndarray, size: np.ndarray, due: np.ndarray, last: np.ndarray, fix: np.ndarray, record: np.ndarray):
        """The true runs through the lanes ``fix``, those that don't begin their piece: where each
        met its lane, and (lane, when, what) of what they emitted. due and last are put right."""
        order = np.argsort(-size[fix], kind="stable")
        most = max(1, self.slots // 4)
        met = np.zeros(len(fix), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(fix), most):
            part = order[at : at + most]
            lane = fix[part]
            # As if every lane before had ended as it did alone; those that didn't are walked below.
            held = [buf[b - d : b].tobytes() for b, d in zip(begin[lane].tolist(), due[lane - 1].tolist(), strict=True)]
            state = np.array([self._state(x) for x in held], np.int64)
            _, _, m, a, b, c = self._lockstep(buf, begin[lane], size[lane], state, record[part])
            met[part] = m
            found.append((part[a], b, c))
        who, when, what = (np.concatenate(x) for x in zip(*found, strict=True))
        if (never := np.flatnonzero(met == size[fix])).size:
            redone: dict[int, list[tuple[int, int]]] = {}
            where = {lane: i for i, lane in enumerate(fix.tolist())}
            for lane in fix[never].tolist():
                # On through the piece's next lanes, until one is met.
                while (i := where.get(lane)) is not None and i not in redone:
                    held = buf[begin[lane] - due[lane - 1] : begin[lane]].tobytes()
                    met[i], pending, redone[i] = self._walk(buf[begin[lane] : begin[lane] + size[lane]].tobytes(), held, record[i].tolist())
                    if met[i] < size[lane]:
                        break
                    due[lane], last[lane] = len(pending), self.final[self._state(pending)]
                    lane += 1
            stays = ~np.isin(who, list(redone))
            extra = [(i, w, o) for i, x in redone.items() for w, o in x]
            more = np.array(extra, np.int64).reshape(-1, 3).T
            who, when, what = (np.concatenate([x[stays], y]) for x, y in zip((who, when, what), more, strict=True))
        return met, (fix[who], when, what)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then those of the next span."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


class Codec:
    def __init__(self, ranks: dict[bytes, int], slots: int = SLOTS):
        self.transducer = Transducer(ranks, slots)
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for t, i in ranks.items():
            by_id[i] = t
        self.by_id = by_id
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them) of adjacent texts."""
        start = piece_starts(buf, offs)
        end = np.append(start[1:], len(buf)) if len(start) else start
        h = K.range_hash(buf, start, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        ids, k = self.transducer.run(buf, start[first], end[first])
        ids = ids[_spans((np.cumsum(k) - k)[which], k[which])]
        per_piece = np.append(0, np.cumsum(k[which]))
        return ids, np.diff(per_piece[np.searchsorted(start, offs)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[_spans(self.at[ids], self.size[ids])]


# -- streaming decode -----------------------------------------------------------

ACCEPT, REJECT = 0, 1
#: States of the UTF-8 machine beyond those: bytes still due, with the first one's allowed range.
_DUE = {2: (1, 0x80, 0xBF), 3: (2, 0x80, 0xBF), 4: (2, 0xA0, 0xBF), 5: (2, 0x80, 0x9F), 6: (3, 0x80, 0xBF), 7: (3, 0x90, 0xBF), 8: (3, 0x80, 0x8F)}


def utf8_next(state: int, byte: int) -> int:
    """The UTF-8 state machine: ACCEPT between characters, REJECT after a byte that can't come."""
    if state == ACCEPT:
        if byte < 0x80:
            return ACCEPT
        if 0xC2 <= byte <= 0xDF:
            return 2
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 3)
        return {0xF0: 7, 0xF4: 8}.get(byte, 6) if 0xF0 <= byte <= 0xF4 else REJECT
    due, low, high = _DUE[state]
    if not low <= byte <= high:
        return REJECT
    return {1: ACCEPT, 2: 2, 3: 3}[due]


class StreamDecoder:
    """Text of ids as they come; never gives out part of a character."""

    def __init__(self, codec: Codec):
        self.codec, self.held = codec, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + self.codec.decode(np.asarray(ids, np.int64)).tobytes()
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = ACCEPT
                for byte in data[-back:]:
                    state = utf8_next(state, byte)
                    if state == REJECT:
                        break
                if state > REJECT:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


def decoded(codec: Codec, ids: np.ndarray, step: int = STEP) -> str:
    """The text of ids that come ``step`` at a time."""
    stream = StreamDecoder(codec)
    return "".join([*(stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)), stream.end()])


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): exact says that streaming decode gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    made: dict[str, Codec] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "it" not in made:
            made["it"] = Codec(shared.value)
        codec = made["it"]
        text = K.column_of(batch, "text")
        buf, offs = K.text_buffer(text)
        ids, n = codec.encode(buf, offs)
        at = np.append(0, np.cumsum(n)).tolist()
        # Through the streaming decoder, as whoever reads the ids would.
        exact = np.array([decoded(codec, ids[a:b]) == t.as_py() for a, b, t in zip(at[:-1], at[1:], text, strict=True)], bool)
        null = text.is_null().to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))
        return pa.RecordBatch.from_arrays([K.column_of(batch, "doc_id"), lists, pa.array(n, mask=null), pa.array(exact, mask=null)], ["doc_id", "ids", "n_tokens", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(K.by_chunk(work), f"doc_id {kind}, ids array<int>, n_tokens long, exact boolean")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, step: int = STEP) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), each row through a StreamDecoder, ``step`` ids at a time."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            out = []
            for row in K.column_of(batch, "ids"):
                if not row.is_valid:
                    out.append(None)
                    continue
                out.append(decoded(codec, row.values.to_numpy(), step))
            yield pa.RecordBatch.from_arrays([K.column_of(batch, "doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
