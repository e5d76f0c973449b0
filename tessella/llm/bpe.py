"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. The rank file's merges define which token sequences a merge run can leave: a sequence is the encoding of its bytes
exactly if each token survives the merging of its own bytes, and each adjacent pair survives the merging of its joint bytes.
So the encoder is a non-deterministic transducer whose states are (last token, node of the token trie); it has one accepting
path for each byte string. ``Transducer`` determinises it on demand: a state is the set of the paths still possible, each with
the tokens it holds back; what all paths agree on is emitted. A path dies when no token continues, so output waits for no more
bytes than the longest token has. The table of states has a bounded size: states met first (the common
ones) stay, and pieces that need others are searched without it. Encoded pieces are memoised in a table emptied when full.

Decoding. ``Utf8Machine`` is a table over UTF-8's lead and continuation ranges; ``StreamingDecoder`` runs it over tokens (a
token that is whole characters leaves the start state at once) and holds incomplete characters until they end.

Defined results: null and empty texts have no tokens; bytes that are not UTF-8 are replaced by U+FFFD before encoding. Each
row is encoded by itself, so repeated rows, ties and empty tables need nothing; other columns pass through, and an input
column named as an output column is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm.scratch import arrow_map

_BUILT: dict[tuple, "Codec"] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = 60_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: list[int | None] = [None]
        inner = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(None)
                    inner[node] = 1
                    inner.append(0)
                node = self.child[key]
            self.token_at[node] = rank
        self.inner = inner
        self._pairs: dict[int, bool] = {}
        start = ((-1, 0, ()),)
        self.states, self.ids, self.final = [start], {start: 0}, [()]
        self.steps: dict[int, tuple[int, tuple]] = {}

    def merged(self, data: bytes, border: int = -1) -> list[int] | None:
        """What merging leaves of data, lowest rank first, leftmost first: the definition that pairs are tested against.

        None as soon as a merge crosses the border.
        """
        get, none = self.ranks.get, len(self.ranks) + 1
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            if border >= 0:
                left = sum(map(len, parts[:i]))
                if left < border < left + len(parts[i]) + len(parts[i + 1]):
                    return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _follows(self, last: int, token: int) -> bool:
        key = last * len(self.bytes_of) + token
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 300_000:
                self._pairs.clear()
            whole = self.bytes_of[token]
            found = self.merged(whole) == [token] if last < 0 else self._follows(-1, token) and self.merged(self.bytes_of[last] + whole, len(self.bytes_of[last])) == [last, token]
            self._pairs[key] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        """Make the determinised state after byte, with what is emitted on the way."""
        paths = []
        end = None
        for last, node, held in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token is not None and end is None and self._follows(last, token):
                end = (token, 0, (*held, token))
            if self.inner[node]:
                paths.append((last, node, held))
        if end is None:
            raise ValueError("the rank file lacks a single byte")
        paths.append(end)
        emit = 0
        first = paths[0][2]
        while emit < len(first) and all(len(p[2]) > emit and p[2][emit] == first[emit] for p in paths):
            emit += 1
        key = tuple((last, node, held[emit:]) for last, node, held in paths)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.final.append(key[-1][2])
        self.steps[state << 8 | byte] = out = (found, first[:emit])
        return out

    def _search(self, piece: bytes) -> list[int]:
        """The accepting path of the transducer before determinisation: for each prefix the last token of its encoding."""
        n = len(piece)
        last, start = [-1, *[None] * n], [0] * (n + 1)
        child, token_at, follows, pairs, size = self.child.get, self.token_at, self._follows, self._pairs, len(self.bytes_of)
        for j in range(n):
            node, before = 0, last[j]
            for i in range(j, n):
                node = child(node << 8 | piece[i])
                if node is None:
                    break
                if last[i + 1] is None and (token := token_at[node]) is not None:
                    fits = pairs.get(before * size + token)
                    if fits or fits is None and follows(before, token):
                        last[i + 1], start[i + 1] = token, j
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Determinised steps as far as the table of states goes; when it is full, a piece that needs another state is searched."""
        out, state, get = [], 0, self.steps.get
        for byte in piece:
            step = get(state << 8 | byte)
            if step is None:
                if len(self.states) >= self.max_states:
                    return self._search(piece)
                step = self._step(state, byte)
            state, emit = step
            if emit:
                out += emit
        out += self.final[state]
        return out


class Utf8Machine:
    """States: 0 between characters, 1 to 3 so many plain continuation bytes to come, 4 to 7 a first continuation byte from a
    narrower range (after E0, ED, F0, F4), 8 error."""

    ERROR = 8

    def __init__(self):
        step = np.full((9, 256), self.ERROR, np.uint8)
        step[0, :0x80] = 0
        for lead, state in ((range(0xC2, 0xE0), 1), (range(0xE1, 0xF0), 2), (range(0xF1, 0xF4), 3), ([0xE0], 4), ([0xED], 5), ([0xF0], 6), ([0xF4], 7)):
            step[0, list(lead)] = state
        for state, low, high, after in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
            step[state, low:high] = after
        self.step = step

    def run(self, state: int, data: bytes) -> int:
        for byte in data:
            state = int(self.step[state, byte])
        return state


class StreamingDecoder:
    """feed() takes ids and returns the bytes of all characters that are complete; finish() returns what is left.

    ``valid`` turns false at the first byte that cannot be UTF-8; from there on bytes are passed as they are.
    """

    def __init__(self, codec: "Codec"):
        self.codec, self.state, self.held, self.valid = codec, 0, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        codec = self.codec
        data = self.held + b"".join(map(codec.token_bytes.__getitem__, ids.tolist()))
        odd = np.flatnonzero(~codec.whole[ids]) if self.valid else ()
        state, at = self.state, -1
        for i in map(int, odd):
            if state and i != at:  # tokens of whole characters came inside a character
                state = Utf8Machine.ERROR
                break
            state, at = codec.after(state, int(ids[i])), i + 1
            if state == Utf8Machine.ERROR:
                break
        if state and state != Utf8Machine.ERROR and len(ids) and at != len(ids):
            state = Utf8Machine.ERROR
        if state == Utf8Machine.ERROR:
            self.valid, state = False, 0
        self.state, self.held = state, b""
        if state:
            start = len(data) - 1
            while data[start] & 0xC0 == 0x80:
                start -= 1
            self.held = data[start:]
            return data[:start]
        return data

    def finish(self) -> bytes:
        out, self.held = self.held, b""
        self.valid &= not out
        return out


#: Fixed value: Unicode's White_Space characters, which \s stands for.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Codec:
    def __init__(self, rank_data: bytes, pattern: str, max_pieces: int = 500_000):
        ranks = read_ranks(rank_data)
        self.ranks, self.max_pieces = ranks, max_pieces
        self.machine = Utf8Machine()
        outside = re.sub(r"\\s(?![^\[]*\])", lambda m: f"[{WHITE}]", pattern.replace(r"\S", f"[^{WHITE}]"))
        self.split = regex.compile(outside.replace(r"\s", WHITE)).findall
        self.pieces: dict[str, bytes] = {}
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.whole = np.array([self.machine.run(0, token) == 0 for token in self.token_bytes], bool)
        self._after: dict[tuple[int, int], int] = {}

    @functools.cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.ranks)

    def after(self, state: int, token: int) -> int:
        found = self._after.get((state, token))
        if found is None:
            found = self._after[state, token] = self.machine.run(state, self.token_bytes[token])
        return found

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else self.transducer.encode(data)
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= self.max_pieces:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self.pieces.get, self._piece
        return b"".join([get(p) or miss(p) for p in self.split(text)])

    def decode(self, ids: bytes, chunk: int = 65_536) -> bytes:
        decoder, ids = StreamingDecoder(self), np.frombuffer(ids, "<u4")
        out = [decoder.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)]
        return b"".join([*out, decoder.finish()])


def _codec(rank_data: bytes, pattern: str) -> Codec:
    """One codec for each Python worker."""
    key = (hashlib.sha256(rank_data).digest(), pattern)
    if key not in _BUILT:
        _BUILT[key] = Codec(rank_data, pattern)
    return _BUILT[key]


def _added(df: DataFrame, column: str, added: T.StructType, f, keep_tables: bool = True) -> DataFrame:
    """df with columns that f makes from the binary column, batch by batch. Each batch is worked on in slices of bounded bytes."""
    names = {x.name for x in added}
    kept = [c for c in df.columns if c not in names and c != "__text__"]
    schema = T.StructType([*[df.schema[c] for c in kept], *added])
    source = "__bytes__"
    ready = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("binary").alias(source))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(whole.num_rows, int(whole.num_rows * 4_000_000 / max(whole.nbytes, 1))))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                made = f(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *[x.name for x in added]])
        if not keep_tables:
            _BUILT.clear()

    return arrow_map(ready, work, schema)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df without its text (unless kept), with ids (binary, little-endian unsigned 32-bit) and n_tokens. No shuffle."""
    with open(rank_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def ids_of(texts: list[bytes | None]) -> list[pa.Array]:
        codec = _codec(shared.value, pattern)
        ids = [codec.encode(x.decode("utf-8", "replace")) if x else b"" for x in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    source = df if keep_text else df.withColumn("__text__", F.col(f"`{text}`")).drop(text)
    out = _added(source, text if keep_text else "__text__", T.StructType().add("ids", "binary").add("n_tokens", "long"), ids_of)
    return out.drop("__text__")


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), the bytes of each row's ids. No shuffle."""
    with open(rank_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def bytes_of(rows: list[bytes | None]) -> list[pa.Array]:
        codec = _codec(shared.value, pattern)
        return [pa.array([codec.decode(x) if x else b"" for x in rows], pa.binary())]

    return _added(df, ids, T.StructType().add("decoded", "binary"), bytes_of)


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text", keep_tables: bool = True) -> DataFrame:
    """encode() and decode() in one pass, so that a task holds one codec: df without its text, with ids, n_tokens and decoded.

    Without keep_tables a task frees its tables at its end, which leaves the Python worker's memory to other operators.
    """
    with open(rank_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def both(texts: list[bytes | None]) -> list[pa.Array]:
        codec = _codec(shared.value, pattern)
        ids = [codec.encode(x.decode("utf-8", "replace")) if x else b"" for x in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([codec.decode(x) for x in ids], pa.binary())]

    return _added(df.withColumnRenamed(text, "__text__"), "__text__", T.StructType().add("ids", "binary").add("n_tokens", "long").add("decoded", "binary"), both, keep_tables).drop("__text__")


def digests(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256."""
    done = round_trip(df, rank_path, pattern, text)
    return done.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")
