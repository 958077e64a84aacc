"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A merge list fixes, for every byte string, one token sequence; its prefixes have unique sequences too,
and the last token of a prefix p is the only token t that ends p, begins where a prefix q with last
token s ends, and of which the pair (s, t) survives its own merging. Reading a piece byte by byte,
the transducer keeps the unread bytes whose tokens can still change and the last token of each of
their prefixes. A state is exactly that; states and transitions are made when first needed. A token
goes out once every way on agrees on it, after a lookahead that the longest token's length bounds.

Pieces (matches of the pattern) are encoded separately. Decoding joins the tokens' bytes and passes
them through an incremental UTF-8 state machine that holds back an unfinished character.

Null texts are empty texts: no tokens. Repeated rows and null ids are encoded row by row, whole texts
at any length, an empty table gives an empty result, and input columns other than the text and the id
are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, short_batches, table

#: Bounds of the two caches of a worker; a full one starts anew, which costs time and changes nothing.
MAX_STATES = 300_000
MAX_PIECES = 450_000
#: Rows that a worker returns at once.
ROWS = 500
#: An arc that is missed for the first time is not made if fewer bytes than this are left of the piece: the
#: transducer's own rule then works out the rest of a rare piece without keeping states. Same ids at any value.
PATIENCE = 48

#: The public pattern for texts below U+0250, with its classes written out; others use `regex`.
_SPACE = r" \t-\r\x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
BEYOND = re.compile(r"[^\x00-ɏ]")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


def merge(ranks: dict[bytes, int], piece: bytes) -> tuple[int, ...]:
    """The plain definition: join the adjacent pair of lowest rank, leftmost first, until none is a token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


class Transducer:
    """Lazily determinised: arcs[state * 256 + byte] = (next state, tokens that go out).

    A state is (held bytes, last): last[k] is the last token of the prefix that ends after k held
    bytes, DEAD where nothing can depend on it any more, and None where the piece begins.
    """

    DEAD = -1

    def __init__(self, ranks: dict[bytes, int], most: int = MAX_STATES):
        self.ranks, self.most = ranks, most
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.survives: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[bytes, tuple]] = [(b"", (None,))]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple]] = {}
        self.missed: set[int] = set()

    def pair_survives(self, s: int, t: int) -> bool:
        found = self.survives.get((s, t))
        if found is None:
            if len(self.survives) > 2 * self.most:
                self.survives.clear()
            found = self.survives[s, t] = merge(self.ranks, self.bytes_of[s] + self.bytes_of[t]) == (s, t)
        return found

    def _tokens(self, last: tuple, at: int) -> list[int]:
        """The tokens on the way from where the held bytes begin to a position."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make an arc: find the new last token, send out what all ways share, drop what is dead."""
        held, last = self.states[state]
        held += bytes((byte,))
        n, dead = len(held), self.DEAD
        new, live = None, [n]
        for at in range(n):
            s = last[at]
            if s == dead or held[at:] not in self.prefixes:
                continue
            live.append(at)  # some token could begin here and end later
            if new is None and (t := self.ranks.get(held[at:])) is not None and (s is None or self.pair_survives(s, t)):
                new = t
        if new is None:
            raise KeyError(byte)  # these ranks don't keep the property that prefixes have unique sequences
        last += (new,)
        # positions form a tree by "last token begins at"; all ways share the way to the live ones' common ancestor
        open_, needed = set(live), set(live)
        while len(open_) > 1:
            at = max(open_)
            open_.remove(at)
            needed.add(at)
            open_.add(at - self.size[last[at]])
        cut = open_.pop()
        out = tuple(self._tokens(last, cut)) if cut else ()
        key = (held[cut:], tuple([last[cut], *[last[at] if at in needed else dead for at in range(cut + 1, n + 1)]]))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        arc = self.arcs[state << 8 | byte] = (to, out)
        return arc

    def finish(self, state: int, rest: bytes) -> list[int]:
        """The tokens from a state to the end of the piece, without making arcs."""
        held, last = self.states[state]
        first, held, last = len(held) + 1, held + rest, list(last)
        dead, ranks, survives = self.DEAD, self.ranks.get, self.survives
        for n in range(first, len(held) + 1):
            for at in range(n - 1, -1, -1):
                s = last[at]
                if s != dead and (t := ranks(held[at:n])) is not None and (s is None or (survives[s, t] if (s, t) in survives else self.pair_survives(s, t))):
                    last.append(t)
                    break
            else:
                raise KeyError(rest)
        return self._tokens(last, len(held))

    def encode(self, piece: bytes) -> list[int]:
        """Walk the arcs. A missing arc is made when it is missed for the second time, or where much
        of the piece is left; else the rest of the piece is worked out directly."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.most or len(self.missed) > 4 * self.most:
            self.reset()
        state, out, arc = 0, [], self.arcs.get
        try:
            for i, byte in enumerate(piece):
                key = state << 8 | byte
                found = arc(key)
                if found is None:
                    if key not in self.missed and len(piece) - i < PATIENCE:
                        self.missed.add(key)
                        return out + self.finish(state, piece[i:])
                    found = self.step(state, byte)
                state, sent = found
                if sent:
                    out += sent
        except KeyError:
            return list(merge(self.ranks, piece))
        held, last = self.states[state]
        return out + self._tokens(last, len(held))


class Pieces(dict):
    """Piece -> its ids in decimal, joined by spaces; made when first asked for.

    Two generations of at most `most` each: a full one becomes the older one, and what is still
    used comes back from there.
    """

    def __init__(self, transducer: Transducer, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.most, self.older = transducer, most, {}

    def __missing__(self, piece: str) -> str:
        out = self.older.get(piece)
        if out is None:
            out = " ".join(map(str, self.transducer.encode(piece.encode("utf-8", "surrogatepass"))))
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


class Utf8Stream:
    """Incremental UTF-8 decoder: `feed` returns the finished characters and keeps an unfinished one.

    The states are how many continuation bytes are due and the range of the next one; a byte that
    fits no state becomes U+FFFD, as does an unfinished character at `finish`.
    """

    LEAD = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, 0xE0: (2, 0xA0, 0xBF), **{b: (2, 0x80, 0xBF) for b in [*range(0xE1, 0xED), 0xEE, 0xEF]}, 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF4: (3, 0x80, 0x8F)}

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for at in range(len(data) - 1, max(-1, len(data) - 4), -1):  # the last lead byte decides
            b = data[at]
            if b < 0x80:
                break
            if b >= 0xC0:
                due, low, high = self.LEAD.get(b, (0, 0, 0))
                rest = data[at + 1 :]
                fits = all((low if k == 0 else 0x80) <= x <= (high if k == 0 else 0xBF) for k, x in enumerate(rest))
                if len(rest) < due and fits:
                    cut = at
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, scale: float = 1.0):
        """scale: of the caches' bounds."""
        self.transducer = Transducer(ranks, int(MAX_STATES * scale))
        self.pattern = regex.compile(pattern)
        self.narrow = pattern == PUBLIC_PATTERN
        self.pieces = Pieces(self.transducer, int(MAX_PIECES * scale))
        self.token_bytes = {str(r): t for t, r in ranks.items()}

    def split(self, text: str) -> list[str]:
        return (NARROW if self.narrow and not BEYOND.search(text) else self.pattern).findall(text)

    def encode_decimal(self, text: str) -> str:
        """The ids in decimal, joined by spaces."""
        return " ".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decimal(text).split()]

    def decode_bytes(self, ids: list[str]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_stream(self, ids, chunk: int = 4096):
        """Yield text as its characters are finished; ids are ints."""
        stream = Utf8Stream()
        ids = list(ids)
        for at in range(0, len(ids), chunk):
            yield stream.feed(self.decode_bytes([str(i) for i in ids[at : at + chunk]]))
        yield stream.finish()


#: The pattern that NARROW writes out.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_open: dict = {}


def opened(key: str, shared, scale: float = 1.0) -> ByteBpe:
    """The coder of a broadcast vocabulary; one a Python worker, so its states stay from task to task."""
    if key not in _open:
        _open.clear()
        _open[key] = ByteBpe(*shared.value, scale)
    return _open[key]


def share(spark, vocabulary: str, pattern: str) -> tuple[str, object]:
    """(key, broadcast of the ranks and the pattern); a vocabulary is a fixed file of a few MB at most."""
    ranks = read_ranks(vocabulary)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return key, spark.sparkContext.broadcast((ranks, pattern))


def digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with the ids themselves if asked for.

    keep: workers keep their caches from task to task, which saves time; without it the caches are a
    fifth as large and the memory goes back after each task, as in a step among others it should.
    """
    short_batches(docs.sparkSession)
    key, shared = share(docs.sparkSession, vocabulary, pattern)

    def code(it):
        gc.disable()  # the caches hold no cycles, and looking for some among millions of entries takes a fifth of the time
        try:
            yield from batches(it)
        finally:
            if not keep:
                _open.clear()
                give_back()
            gc.enable()

    def batches(it):
        coder = opened(key, shared, 1.0 if keep else 0.2)
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                rows, lines = [], []
                for t in b.column(1).to_pylist():
                    line = coder.encode_decimal(t or "")
                    tokens = line.split(" ") if line else []
                    stream, sha = Utf8Stream(), hashlib.sha256()
                    for k in range(0, len(tokens), 65_536):
                        sha.update(stream.feed(coder.decode_bytes(tokens[k : k + 65_536])).encode("utf-8", "surrogatepass"))
                    sha.update(stream.finish().encode())
                    rows.append((len(tokens), hashlib.sha256(line.encode()).hexdigest(), sha.hexdigest()))
                    if ids:
                        lines.append(np.fromstring(line, np.int32, sep=" "))
                added = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                if ids:
                    ends = np.cumsum([0, *map(len, lines)], dtype=np.int32)
                    added.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lines))))
                yield pa.RecordBatch.from_arrays([b.column(0), *added], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(code, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: each kept document's ids."""
    return digests(docs, *public_vocabulary(), ids=True, keep=False)
