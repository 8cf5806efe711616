"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges make of its bytes exactly if each token is what the merges make of its
own bytes and each two neighbours, merged from scratch, stay these two. That is a condition on neighbours, so
the encoder is a nondeterministic transducer over bytes: a guess is (tokens not yet certain, place in the trie
of tokens). Its determinisation is built lazily: a state holds all guesses that the bytes so far allow, and
tokens that all guesses share are certain and are emitted, after a bounded lookahead.
"""

from __future__ import annotations

import base64
import codecs
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, kept, slices, utf8, with_fields, with_results

#: Most entries of a worker's caches (results don't depend on them): states start anew, pieces are kept in two
#: generations, and of pairs the first stay.
MOST_STATES = 250_000
MOST_PAIRS = 200_000
MOST_PIECES = 200_000
#: Below a place in the trie with at most so many tokens, a state keeps which of them don't fit, not the token before.
FEW_TOKENS = 16
#: Bytes of text, or ids, that a worker encodes or decodes before it hands them on.
SLICE_BYTES = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pack(certain: int, guesses: list[tuple[tuple[int, ...], int]]) -> bytes:
    """A state in few bytes: what stands before, and of each guess the number of pending tokens, these and its place."""
    flat = [certain]
    for pending, node in guesses:
        flat += (len(pending), *pending, node)
    return struct.pack(f"<{len(flat)}i", *flat)


def _unpack(state: bytes) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
    flat, at, guesses = struct.unpack(f"<{len(state) // 4}i", state), 1, []
    while at < len(flat):
        end = at + 1 + flat[at]
        guesses.append((flat[at + 1 : end], flat[end]))
        at = end + 1
    return flat[0], guesses


#: No token stands before, or none that matters.
NONE = -1


class Transducer:
    """Encodes one piece (bytes) at a time; transitions are kept between pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for b, r in ranks.items():
            node = 0
            for x in b:
                nxt = self.trie.get(node << 8 | x)
                if nxt is None:
                    nxt = len(self.ends)
                    self.ends.append(-1)
                    self.trie[node << 8 | x] = nxt
                node = nxt
            # a token that merges don't make of its own bytes ends no guess
            self.ends[node] = r if len(b) == 1 or self.parts(r) is not None else -1
        self.children: list[list[int]] = [[] for _ in self.ends]
        for k, node in self.trie.items():
            self.children[k >> 8].append(node)
        self.below = [0] * len(self.ends)
        for node in range(len(self.ends) - 1, -1, -1):  # a node has a higher number than its parent
            self.below[node] = (self.ends[node] >= 0) + sum(self.below[c] for c in self.children[node])
        self._reset()

    def _reset(self):
        self.states = [_pack(NONE, [((), 0)])]
        self.number = {self.states[0]: 0}
        self.next: dict[int, int | tuple[int, bytes]] = {}  # with the ids that become certain, if any do
        self.last: dict[int, bytes] = {}
        self.barred: list[frozenset[int]] = []
        self._contexts: dict[int, int] = {}
        self._barred_number: dict[frozenset[int], int] = {frozenset(): NONE}

    def _tokens_below(self, node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if self.ends[x] >= 0:
                out.append(self.ends[x])
            todo += self.children[x]
        return out

    def _good(self, before: int, token: int) -> bool:
        """Whether token may follow: before is a token, NONE, or a set of barred tokens (see _context)."""
        if before >= 0:
            known = self._fits.get(before << 32 | token)
            return self.fits(before, token) if known is None else known
        return before == NONE or token not in self.barred[-2 - before]

    def _context(self, before: int, node: int) -> int:
        """What of `before` still matters at this place of the trie: where few tokens are left, only which don't fit.

        Many tokens bar the same ones, mostly none, so states merge.
        """
        if before == NONE or self.below[node] > FEW_TOKENS:
            return before
        known = self._contexts.get(before << 20 | node)
        if known is None:
            barred = frozenset(t for t in self._tokens_below(node) if not self._good(before, t))
            known = self._barred_number.get(barred)
            if known is None:
                known = self._barred_number[barred] = -2 - len(self.barred)
                self.barred.append(barred)
            self._contexts[before << 20 | node] = known
        return known

    def merge(self, piece: bytes, below: float = float("inf")) -> list[bytes]:
        """The merges of ranks below `below`, lowest first and leftmost first, done one by one."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or where merges don't make it."""
        if token not in self._parts:
            halves = self.merge(self.bytes[token], token)
            self._parts[token] = (self.ranks[halves[0]], self.ranks[halves[1]]) if len(halves) == 2 else None
        return self._parts[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged together, become just these two tokens.

        Merges are undone from the latest on. A merge over the seam that comes before the one undone last
        would have been done instead; of equal ranks, the leftmost is done first.
        """
        x, y, before, result = a, b, float("inf"), True
        while True:
            rank = self.ranks.get(self.bytes[x] + self.bytes[y])
            if rank is not None and rank < before:
                result = False
                break
            left, right = self.parts(x), self.parts(y)
            if left is None and right is None:
                break
            if right is None or left is not None and x > y:
                before, x = x, left[1]
            else:
                before, y = y + 1, right[0]
        if len(self._fits) < MOST_PAIRS:
            self._fits[a << 32 | b] = result
        return result

    def _step(self, state: int, byte: int) -> int | tuple[int, bytes]:
        certain, guesses = _unpack(self.states[state])
        trie, ends, fresh = self.trie, self.ends, self.trie[byte]
        after = []
        for pending, node in guesses:
            on = trie.get(node << 8 | byte)
            if on is not None:
                after.append((pending, on))
            token = ends[node]
            if token >= 0 and self._good(pending[-1] if pending else certain, token):
                after.append(((*pending, token), fresh))
        first, shared = after[0][0], 0
        if len(after) == 1:
            shared = len(first)
        elif first:
            least = min(len(p) for p, _ in after)
            while shared < least and all(p[shared] == first[shared] for p, _ in after):
                shared += 1
        if shared:
            certain, after = first[shared - 1], [(p[shared:], node) for p, node in after]
        # only the first guess can have nothing pending; without such a one, what stands before has had its say
        key = _pack(NONE if after[0][0] else self._context(certain, after[0][1]), after)
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        out = (number, struct.pack(f"<{shared}I", *first[:shared])) if shared else number
        self.next[state << 8 | byte] = out
        return out

    def _finish(self, state: int) -> bytes:
        certain, guesses = _unpack(self.states[state])
        for pending, node in guesses:
            token = self.ends[node]
            if token >= 0 and self._good(pending[-1] if pending else certain, token):
                self.last[state] = out = struct.pack(f"<{len(pending) + 1}I", *pending, token)
                return out
        raise ValueError("a byte has no token")

    def encode(self, piece: bytes) -> bytes:
        """Ids of a piece, packed as little-endian unsigned 32-bit integers."""
        if not piece:
            return b""
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token, even if merges don't make it
            return struct.pack("<I", whole)
        if len(self.states) > MOST_STATES:
            self._reset()
        state, out, table = 0, [], self.next
        for byte in piece:
            hit = table.get(state << 8 | byte)
            if hit is None:
                hit = self._step(state, byte)
            if hit.__class__ is int:
                state = hit
            else:
                state, ids = hit
                out.append(ids)
        last = self.last.get(state)
        out.append(last if last is not None else self._finish(state))
        return b"".join(out)


class Pieces(dict):
    """Packed ids of pieces (str), encoded at first sight. What a generation of pieces used stays for the next one."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) < 64:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class StreamDecoder:
    """Decodes ids as they come. Characters come out once their last byte is there; what is not UTF-8 becomes U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _in_slices(batches, column: str):
    for batch in batches:
        for first, beyond in slices(utf8(batch.column(batch.schema.get_field_index(column)))[1], SLICE_BYTES):
            yield batch.slice(first, beyond - first)


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decode: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens (long) and token_ids (binary: little-endian unsigned 32-bit ids) of the whole text, and, if
    asked for, decoded: what the ids give again.

    Each match of pattern is encoded by itself; special tokens are ordinary text. A null text counts as empty and has no
    tokens. Texts may be of any length; equal texts have equal ids, and repeated rows stay. Columns named like a result
    are replaced, all others stay, but for the text if keep_text is false, which spares its way back from Python. An
    empty table gives an empty table. The ranks (one vocabulary file of a fixed size) travel with the task. Results
    leave a task in slices of about SLICE_BYTES of text.
    """
    kept_fields = docs if keep_text else docs.drop(text_col)
    schema = with_fields(kept_fields, ("n_tokens", T.LongType()), ("token_ids", T.BinaryType()), *[("decoded", T.StringType())] * decode)
    names, ranks = schema.names, docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    name = f"{path} {pattern}"

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        pieces = kept(name, lambda: Pieces(Transducer(ranks.value)))
        get = pieces.__getitem__
        for batch in _in_slices(batches, text_col):
            packed = [b"".join(map(get, find(text))) if text else b"" for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            new = {"n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()), "token_ids": pa.array(packed, pa.binary())}
            if decode:
                new["decoded"] = pa.array([_decoded(x, pieces.transducer.bytes) for x in packed], pa.string())
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return docs.mapInArrow(run, schema)


def _decoded(packed: bytes | None, tokens: dict[int, bytes], block: int = 65_536) -> str:
    decoder, ids = StreamDecoder(tokens), np.frombuffer(packed or b"", "<u4")
    return "".join(decoder.feed(ids[a : a + block].tolist()) for a in range(0, len(ids), block)) + decoder.finish()


def decode_ids(rows: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """rows with decoded (string), read back from packed ids in blocks. Null ids give an empty text. A column named decoded
    is replaced, all others stay; an empty table gives an empty table."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        tokens = {r: b for b, r in ranks.value.items()}
        for batch in batches:
            yield pa.array([_decoded(x.as_py(), tokens) for x in batch], pa.string())

    return with_results(rows, decoded=decode(F.col(ids_col)))
