"""Byte-level BPE by a lazily determinised finite-state transducer, and decoding by a UTF-8 automaton.

A sequence of vocabulary tokens is the BPE encoding of its bytes exactly if each token encodes to itself and each
two neighbours encode to themselves. So there is a nondeterministic transducer that walks the
vocabulary's trie and may end a token wherever the token agrees with the one before it. It is unambiguous:
each prefix of the input has one valid tokenisation, which one token ends. The machine here determinises it on the fly: a
state is the set of live guesses (trie node, token before), and a move sends the token that ends the prefix read so far. A guess
that is still live begins at most the longest token back, so after that many bytes all guesses go back to the
same tokens, which are emitted then. States and moves are kept up to a bound of bytes and then built anew.

Nulls are empty texts; empty texts give no ids and empty bytes. Long runs are read in linear time.
Repeated rows are each encoded. Empty tables give empty results; columns named as the results are replaced.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import small_batches, widened
from strata.llm.text import Coded, Words, as_array, gathered, pieces, ragged, raw, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
_BETWEEN = (0, 0, 0, 0)
#: Instead of a token's half: a single byte, not asked yet, its bytes encode to other tokens, ranks don't rise while it is merged.
_BYTE, _UNKNOWN, _NEVER, _ODD = -1, -2, -3, -4


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State(dict):
    """A byte's move: (next state, token that ends there). Live guesses: token before + 1 << 32 | trie node."""

    __slots__ = ("machine", "guesses")

    def __init__(self, machine: Transducer, guesses: tuple[int, ...]):
        self.machine, self.guesses = machine, guesses

    def __missing__(self, byte: int) -> tuple[State, int]:
        return self.machine._move(self, byte)


class Transducer:
    """Encodes byte strings; moves are built when first taken."""

    def __init__(self, ranks: dict[bytes, int], most_bytes: int = 64 << 20):
        self.ranks, self.most_bytes = ranks, most_bytes
        self.piece = {v: k for k, v in ranks.items()}
        #: The trie: (node << 8 | byte) -> node, the token that ends at a node, and whether a node goes on.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.goes_on = bytearray(1)
        for word, rank in ranks.items():
            node = 0
            for b in word:
                step = self.child.get(node << 8 | b)
                if step is None:
                    step = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.goes_on[node] = 1
                    self.goes_on.append(0)
                node = step
            self.token_at[node] = rank
        self.size = {rank: len(word) for word, rank in ranks.items()}
        self.longest = max(self.size.values(), default=1)
        #: The two tokens that each token is merged from last. Arrays, so that nothing small outlives the words of a task.
        top = max(ranks.values(), default=0) + 1
        self.left, self.right = (array("q", [_UNKNOWN]) * top for _ in range(2))
        for word, rank in ranks.items():
            if len(word) == 1:
                self.left[rank] = self.right[rank] = _BYTE
        self.agrees: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.restart()

    def restart(self) -> None:
        """Drop all states and moves. States refer to each other, so each is emptied."""
        for state in self.states.values():
            state.clear()
        self.start = State(self, (0,))
        self.states = {self.start.guesses: self.start}
        self.used = 0
        self.agrees = {}

    def merged(self, data: bytes, steps: list[int] | None = None, most: int = -1) -> list[int]:
        """The encoding by merging the lowest-ranked neighbours; defines which tokens agree. ``steps`` gets the merges' ranks; ``most`` bounds them."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1 and most:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if steps is not None:
                steps.append(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            most -= 1
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> int:
        """Fill in the halves of a token, and give the left one."""
        steps: list[int] = []
        data = self.piece[token]
        if self.merged(data, steps) != [token]:
            self.left[token] = self.right[token] = _NEVER
        elif any(a > b for a, b in zip(steps, steps[1:])):
            self.left[token] = self.right[token] = _ODD
        else:
            self.left[token], self.right[token] = self.merged(data, None, len(steps) - 1)
        return self.left[token]

    def _agree(self, before: int, token: int) -> bool:
        """Whether the bytes of both tokens encode to just them: at no time comes a merge across the border first."""
        left, right, piece = self.left, self.right, self.piece
        for t in (before, token):
            if t >= 0 and left[t] == _UNKNOWN:
                self._split(t)
        if left[token] == _ODD or before >= 0 and left[before] == _ODD:
            ok = self.merged((piece[before] if before >= 0 else b"") + piece[token]) == ([before, token] if before >= 0 else [token])
        elif before < 0 or left[before] == _NEVER or left[token] == _NEVER:
            ok = before < 0 and left[token] != _NEVER
        else:  # back in time: undo the later of the merges that made the two parts at the border
            x, y, end, get, ok = before, token, 1 << 60, self.ranks.get, True
            while True:
                rank = get(piece[x] + piece[y])
                if rank is not None and rank < end:
                    ok = False
                    break
                a, b = right[x], left[y]
                if a >= 0 and (x > y or b < 0):
                    end, x = x, a
                    if right[a] == _UNKNOWN:
                        self._split(a)
                elif b >= 0:
                    end, y = y + 1, b  # of equal ranks the left one is merged first
                    if left[b] == _UNKNOWN:
                        self._split(b)
                else:
                    break
        if len(self.agrees) > 100_000:
            self.agrees = {}
        self.agrees[before + 1 << 32 | token] = ok
        return ok

    def _move(self, state: State, byte: int) -> tuple[State, int]:
        guesses, whole = [], -1
        child, token_at, goes_on, agrees = self.child, self.token_at, self.goes_on, self.agrees
        for guess in state.guesses:
            step = child.get((guess & 0xFFFFFFFF) << 8 | byte)
            if step is None:
                continue
            if whole < 0 and (token := token_at[step]) >= 0:
                pair = guess >> 32 << 32 | token
                ok = agrees.get(pair)
                if self._agree((guess >> 32) - 1, token) if ok is None else ok:
                    whole = token
            if goes_on[step]:
                guesses.append(guess >> 32 << 32 | step)
        if whole < 0:
            raise ValueError(f"no token ends with byte {byte}: the vocabulary lacks single bytes")
        guesses.append(whole + 1 << 32)
        key = tuple(guesses)
        to = self.states.get(key)
        if to is None:
            if self.used > self.most_bytes:
                self.restart()
            self.used += 250 + 16 * len(key)  # with its moves, about
            to = self.states[key] = State(self, key)
        found = state[byte] = (to, whole)
        return found

    def encode(self, data: bytes) -> list[int]:
        if len(data) > 1 << 14:
            stream = TokenStream(self)
            return [*chain.from_iterable(stream.feed(data[i : i + 4096]) for i in range(0, len(data), 4096)), *stream.finish()]
        state, ends = self.start, []
        for b in data:
            state, token = state[b]
            ends.append(token)
        size, at, out = self.size, len(ends), []
        while at:
            out.append(token := ends[at - 1])
            at -= size[token]
        out.reverse()
        return out


class TokenStream:
    """Incremental encoder of one word: feed bytes, get the tokens that no later byte can change."""

    def __init__(self, machine: Transducer):
        self.machine, self.state = machine, machine.start
        self.ends: list[int] = []  # for each byte not yet emitted the token that ends there

    def _back(self, at: int, base: int = 0) -> list[int]:
        out = []
        while at > base:
            out.append(token := self.ends[at - 1])
            at -= self.machine.size[token]
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        m, state = self.machine, self.state
        for b in data:
            state, token = state[b]
            self.ends.append(token)
        self.state = state
        live = {len(self.ends) - m.depth[g & 0xFFFFFFFF] for g in state.guesses}
        while len(live) > 1:  # back to where the guesses' tokens meet
            live.remove(at := max(live))
            live.add(at - m.size[self.ends[at - 1]])
        at = live.pop()
        out = self._back(at)
        del self.ends[:at]
        return out

    def finish(self) -> list[int]:
        out = self._back(len(self.ends))
        self.state, self.ends = self.machine.start, []
        return out


class Utf8Stream:
    """Incremental decoder: feed token bytes, get the text that is settled; bad bytes become U+FFFD."""

    #: Fixed values of the UTF-8 encoding form: lead bytes, bytes that follow, and the range of the first that follows.
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    _lead = {b: (n, low, high) for first, last, n, low, high in LEADS for b in range(first, last + 1)}

    def __init__(self) -> None:
        self.state: tuple[int, int, int, int] = _BETWEEN  # bytes to come, bits so far, range of the next byte

    @classmethod
    def step(cls, state: tuple[int, int, int, int], data: bytes) -> tuple[tuple[int, int, int, int], str, bool]:
        """The next state, the text settled, and whether bad bytes were met."""
        left, bits, low, high = state
        out: list[str] = []
        bad = False
        for b in data:
            if left:
                if low <= b <= high:
                    left, bits, low, high = left - 1, bits << 6 | b & 0x3F, 0x80, 0xBF
                    if not left:
                        out.append(chr(bits))
                    continue
                left, bad = 0, True
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif lead := cls._lead.get(b):
                left, low, high = lead
                bits = b & (0x3F >> left)
            else:
                bad = True
                out.append("�")
        return (left, bits, low, high) if left else _BETWEEN, "".join(out), bad

    def feed(self, data: bytes) -> str:
        self.state, text, _ = self.step(self.state, data)
        return text

    def finish(self) -> str:
        left, self.state = self.state[0], _BETWEEN
        return "�" if left else ""


class Codec:
    """Encoding and decoding of batches of texts."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self._machine: Transducer | None = None
        self.split = regex.compile(pattern).findall
        self.known = Coded()
        top = max(self.ranks.values()) + 1
        table = [b""] * top
        for word, rank in self.ranks.items():
            table[rank] = word
        self.table = table
        self.sizes = np.fromiter(map(len, table), np.int64, top)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        #: Steps of the UTF-8 automaton: (state, token) -> (state, text, whether bad bytes were met).
        self.moves: dict[tuple, tuple] = {}
        #: Tokens of whole characters: they lead from between two characters to between two characters.
        self.closed = np.fromiter((w.isascii() or _whole(w) for w in table), bool, top)

    @property
    def machine(self) -> Transducer:
        """Built for encoding only."""
        if self._machine is None:
            self._machine = Transducer(self.ranks)
        return self._machine

    def forget(self) -> None:
        """Drop what was learnt from texts; a worker may serve other stages next."""
        self.known.forget()
        self.moves.clear()
        if self._machine is not None:
            self._machine.restart()
        gc.collect()
        tidy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offset of each text's ids."""
        w = blank_led(*raw(texts))
        self.known.trim()
        at = self.known.find(w.distinct.view(pa.string()), self._learn)
        begins, sizes = self.known.off[at][w.codes], np.diff(self.known.off)[at][w.codes]
        return gathered(self.known.ids, begins, sizes), np.concatenate([[0], np.cumsum(sizes)])[w.starts]

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cut chunks into words, and encode each distinct word once."""
        chars, off = raw(new)
        long = np.diff(off) > 1
        led = np.zeros(len(new), bool)
        led[long] = (chars[off[:-1][long]] == 0x20) & _VISIBLE[chars[off[:-1][long] + 1]]
        order = np.argsort(led, kind="stable")  # chunks led by a blank may stand one after another
        texts = new.take(pa.array(order)).to_pylist()
        first = len(new) - int(led.sum())
        found = [*map(self.split, texts[:first]), self.split("".join(texts[first:]))]
        index = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        encode, coded = self.machine.encode, [()] * len(index)
        collects = gc.isenabled()
        gc.disable()  # states are many; those dropped are emptied, so that no cycle is left
        for word in sorted(index):  # neighbours share their first moves
            coded[index[word]] = encode(word.encode())
        if collects:
            gc.enable()
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
        ids = flat[ragged((np.cumsum(sizes) - sizes)[at], sizes[at])]
        ends = np.cumsum(np.fromiter(map(len, index), np.int64, len(index))[at])
        words = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), side="right")
        size = np.diff(np.concatenate([[0], np.cumsum(sizes[at])])[words], prepend=0)
        back = np.argsort(order)
        return ids[ragged((np.cumsum(size) - size)[back], size[back])], size[back]

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.begins[ids], self.sizes[ids]).tobytes()

    def decode_texts(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The texts of ids[off[i]:off[i + 1]] by the UTF-8 automaton.

        A closed token leads from between two characters to between two characters and its text is its bytes, so only
        the runs of other tokens are stepped; where the automaton finds bad bytes, the text is put together from its pieces.
        """
        sizes = self.sizes[ids]
        where = np.concatenate([[0], np.cumsum(sizes)])
        data = gathered(self.bytes, self.begins[ids], sizes)
        bounds = where[off]
        bad: set[int] = set()
        open_ = np.flatnonzero(~self.closed[ids])
        if len(open_):
            text = np.searchsorted(off, open_, side="right") - 1
            last = np.append((open_[1:] != open_[:-1] + 1) | (text[1:] != text[:-1]), True)  # a closed token or an end follows
            state, moves = _BETWEEN, self.moves
            for i, t, stop in zip(ids[open_].tolist(), text.tolist(), last.tolist()):
                step = moves.get((state, i))
                if step is None:
                    step = moves[state, i] = self._step(state, i)
                state = step[0]
                if step[2] or stop and state[0]:
                    bad.add(t)
                if stop:
                    state = _BETWEEN
        if len(bounds) > 1 and bounds[-1] > 0x7FFFFFFF:
            raise ValueError("more than 2 GiB of text in a batch")
        if not bad:
            return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        return pa.array([self.decode_text(ids[off[i] : off[i + 1]]) if i in bad else data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in range(len(off) - 1)], pa.string())

    def _step(self, state: tuple, token: int) -> tuple[tuple, str, bool]:
        if len(self.moves) > 100_000:
            self.moves.clear()
        return Utf8Stream.step(state, self.table[token])

    def decode_text(self, ids: np.ndarray) -> str:
        """Text of one run of ids, stepped token by token."""
        state, out = _BETWEEN, []
        for i in ids.tolist():
            state, text, _ = self._step(state, i)
            out.append(text)
        return "".join(out) + ("\ufffd" if state[0] else "")


#: Bytes that begin a visible character for certain: ASCII marks, letters and digits, and lead bytes under which no blank lies.
_VISIBLE = np.array([0x21 <= b <= 0x7E or 0xC3 <= b and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])


def blank_led(body: np.ndarray, off: np.ndarray) -> Words:
    """Chunks of texts, cut before each blank that a visible character follows: every pattern of this kind has a border there."""
    first = np.zeros(len(body) + 1, bool)
    first[off[:-1][np.diff(off) > 0]] = True
    first[:-2] |= (body[:-1] == 0x20) & _VISIBLE[body[1:]]
    at = np.flatnonzero(first[: len(body)])
    chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(body)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
    coded = chunks.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, off), coded.dictionary)


def _whole(data: bytes) -> bool:
    state, _, bad = Utf8Stream.step(_BETWEEN, data)
    return not state[0] and not bad


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _where(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, back: bool = False) -> DataFrame:
    """All columns of docs with ``ids`` array<int>, and with ``decoded`` string, by the UTF-8 automaton, if they are to be decoded in the same pass.

    ``path``: a rank file that every executor has.
    """
    path = _where(path)
    small_batches(docs.sparkSession)
    extra = ["ids", "decoded"] if back else ["ids"]
    rows = docs.select(*[c for c in docs.columns if c not in extra])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in pieces(batches, limit=2 << 20):
            ids, off = own.encode(as_array(b.column(b.schema.get_field_index("text"))))
            made = [_lists(ids, off)]
            if back:
                made.append(own.decode_texts(ids, off))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *extra])
        own.forget()

    return rows.mapInArrow(work, widened(rows, "ids array<int>, decoded string" if back else "ids array<int>"))


def decode(coded: DataFrame, path: str | None = None, text: bool = True) -> DataFrame:
    """All columns with ``decoded`` binary and, if asked for, ``decoded_text``; null ids count as none."""
    path = _where(path)
    small_batches(coded.sparkSession)
    extra = ["decoded", "decoded_text"] if text else ["decoded"]
    keep = [c for c in coded.columns if c not in extra]
    rows = coded.select(*keep)
    schema = widened(rows, "decoded binary, decoded_text string" if text else "decoded binary")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, public_tokenizers.PATTERN)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                column = part.column(part.schema.get_field_index("ids"))
                ids = column.flatten().to_numpy(zero_copy_only=False)
                off = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                made = [pa.array([own.decode(ids[off[i] : off[i + 1]]) for i in range(part.num_rows)], pa.binary())]
                if text:
                    made.append(own.decode_texts(ids, off))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *extra])

    return rows.mapInArrow(work, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, back=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
