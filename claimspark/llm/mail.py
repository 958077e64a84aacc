"""Messages between blocks of texts and hash partitions: integer columns in binary bodies.

A block asks many partitions about its entries, sorted by partition, and gets as many answers. What a
message costs must not depend on how many there are: at 100 TB blocks and partitions are millions, and
a block has a handful of entries for each. So a block's messages are written in one of two ways:
- on average THIN entries a message or more: each body has its columns apart, each as narrow as its
  values allow, byte plane by byte plane, rising columns as differences, joint columns with one number for
  all the small values of a row, compressed with zstd;
- fewer: the entries as records of fixed width in one buffer; a body is a slice of it, made without a
  step for each message. There are never more messages than entries.
Both are read into the same columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

THIN = 32
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
#: Stands where a column rises or not: the joint columns of a sheet, whose rows mostly hold small values that go together.
JOINT = "joint"


def narrowest(a: np.ndarray):
    if not len(a):
        return np.int8
    low, high = int(a.min()), int(a.max())
    return next(w for w in WIDTHS if np.iinfo(w).min <= low and high <= np.iinfo(w).max)


def stable_order(key: np.ndarray, top: int) -> np.ndarray:
    """The stable order of keys below `top`."""
    bits = max(len(key) - 1, 1).bit_length()
    if top.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)  # values and places as one number


def group(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where each first stands, the group of each); keys are below `top`."""
    n, order = len(key), stable_order(key, top)
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], order[new], inverse


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted column."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return a[new]


def joint_bits(columns: int) -> int:
    """Bits of a value that counts as small."""
    return max(1, min(4, 20 // columns))


def joined(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number of each row's kind, the kinds, the columns' other values): a kind is a row of small values, the frequent ones
    first; all rows with others are of one kind above these.
    """
    bits, small, key = joint_bits(len(columns)), np.ones(len(columns[0]), bool), np.zeros(len(columns[0]), np.int64)
    for c in columns:
        small &= (c >= 0) & (c < 1 << bits)
        key = key << bits | c
    key[~small] = 1 << bits * len(columns)
    kinds, _, number = group(key, 2 << bits * len(columns))
    order = np.argsort(-np.bincount(number, minlength=len(kinds)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[number], kinds[order], [c[~small] for c in columns]


def parted(number: np.ndarray, kinds: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
    """The columns that `joined` was given."""
    bits, key, out = joint_bits(len(others)), kinds[number], []
    large = np.flatnonzero(key >> bits * len(others))
    for k, other in enumerate(others):
        c = key >> bits * (len(others) - 1 - k) & ((1 << bits) - 1)
        c[large] = other
        out.append(c)
    return out


def pack_columns(columns, rising: tuple[bool | str, ...]) -> bytes:
    """Integer columns of one length; uint64 counts as its 64 bits."""
    n, sizes, head, planes, together, plain = len(columns[0]), b"", [], [], [], []
    for a, up in zip(columns, rising, strict=True):
        a = a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64, copy=False)
        if up == JOINT:
            together.append(a)
        elif up and n:
            plain.append(np.concatenate([a[:1], a[1:] - a[:-1]]))
        else:
            plain.append(a)
    if together:
        number, kinds, others = joined(together)
        plain += [number, kinds, *others]
        sizes = len(kinds).to_bytes(4, "little") + len(others[0]).to_bytes(4, "little")
    for a in plain:
        a = np.ascontiguousarray(a.astype(narrowest(a)))
        head.append(a.itemsize)
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return n.to_bytes(4, "little") + sizes + bytes(head) + zstandard.compress(b"".join(planes), 3)


def unpack_columns(body: bytes, rising: tuple[bool | str, ...]) -> list[np.ndarray]:
    n, joint, at, found = int.from_bytes(body[:4], "little"), rising.count(JOINT), 4, []
    sizes = [n] * (len(rising) - joint)
    if joint:
        sizes += [n, int.from_bytes(body[4:8], "little"), *[int.from_bytes(body[8:12], "little")] * joint]
        at = 12
    widths, raw = body[at : at + len(sizes)], np.frombuffer(zstandard.decompress(body[at + len(sizes) :]), np.uint8)
    at = 0
    for width, size in zip(widths, sizes, strict=True):
        found.append(np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(f"<i{width}").reshape(size).astype(np.int64))
        at += size * width
    plain = iter(found)
    single = iter([np.cumsum(next(plain)) if up else next(plain) for up in rising if up != JOINT])
    together = iter(parted(next(plain), next(plain), list(plain)) if joint else ())
    return [next(together) if up == JOINT else next(single) for up in rising]


def is_thin(entries: int, messages: int) -> bool:
    return entries < THIN * messages


def bodies(ends: np.ndarray, columns, rising: tuple[bool | str, ...], thin: bool) -> pa.Array:
    """The bodies of messages that end at `ends` in the columns."""
    if not thin:
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return pa.array([pack_columns([c[s:e] for c in columns], rising) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
    rows = np.empty((len(columns[0]), len(columns)), np.int64)
    for k, c in enumerate(columns):
        rows[:, k] = c.view(np.int64) if c.dtype == np.uint64 else c
    offsets = (np.concatenate([[0], ends]) * 8 * len(columns)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def columns_of(array: pa.Array, thin: bool, rising: tuple[bool | str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns over all bodies, entries of each body)."""
    n = len(rising)
    if not thin:
        got = [unpack_columns(b, rising) for b in array.to_pylist()]
        empty = np.zeros(0, np.int64)
        return [np.concatenate([g[k] for g in got]) if got else empty for k in range(n)], np.array([len(g[0]) for g in got], np.int64)
    if not len(array):
        return [np.zeros(0, np.int64)] * n, np.zeros(0, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    rows = np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), np.int64).reshape(-1, n)
    return [np.ascontiguousarray(rows[:, k]) for k in range(n)], np.diff(offsets) // (8 * n)


class Sheet:
    """A set of columns in messages; `layout` says which columns rise inside a message."""

    def __init__(self, columns: list[np.ndarray], sizes: np.ndarray):
        self.columns, self.sizes = columns, sizes


LETTER = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("thin", pa.bool_()), ("a", pa.binary()), ("b", pa.binary())])
LETTERS = "block long, part long, thin boolean, a binary, b binary"


def letters(blocks, parts, a: Sheet, a_rising, b: Sheet | None = None, b_rising=()) -> pa.RecordBatch:
    """One row a message: to or from `blocks` and `parts` (one of each a message)."""
    n = len(a.sizes)
    thin = is_thin(int(a.sizes.sum()), n)
    second = bodies(np.cumsum(b.sizes), b.columns, b_rising, thin) if b is not None else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(blocks, n).astype(np.int64)), pa.array(np.broadcast_to(parts, n).astype(np.int64)), pa.array(np.full(n, thin)), bodies(np.cumsum(a.sizes), a.columns, a_rising, thin), second],
        schema=LETTER,
    )


def read(t: pa.Table, a_rising, b_rising=()) -> tuple[np.ndarray, np.ndarray, Sheet, Sheet | None]:
    """(block and part of each message, the sheets), packed messages first, each kind in the table's order."""
    t = t.combine_chunks()
    thin = np.asarray(t.column("thin").to_numpy(), bool)
    blocks, parts, sheets = [], [], []
    for kind in (False, True):
        at = np.flatnonzero(thin == kind)
        x = t if len(at) == len(thin) else t.take(pa.array(at))
        if len(at):
            blocks.append(x.column("block").to_numpy())
            parts.append(x.column("part").to_numpy())
            whole = lambda name: pa.concat_arrays(x.column(name).chunks)  # noqa: E731, B023
            sheets.append([columns_of(whole("a"), kind, a_rising), columns_of(whole("b"), kind, b_rising) if b_rising else None])
    if not sheets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), Sheet([np.zeros(0, np.int64)] * len(a_rising), np.zeros(0, np.int64)), Sheet([np.zeros(0, np.int64)] * len(b_rising), np.zeros(0, np.int64)) if b_rising else None
    both = lambda k: Sheet([np.concatenate(c) for c in zip(*(s[k][0] for s in sheets), strict=True)], np.concatenate([s[k][1] for s in sheets]))
    return np.concatenate(blocks), np.concatenate(parts), both(0), both(1) if b_rising else None


def in_order(sheet: Sheet, parts: np.ndarray) -> list[np.ndarray]:
    """The sheet's columns with messages in the order of their parts."""
    if len(parts) < 2 or (parts[1:] >= parts[:-1]).all():
        return sheet.columns
    order = np.argsort(np.repeat(parts, sheet.sizes), kind="stable")
    return [c[order] for c in sheet.columns]


def sizes_of(parts_sorted: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How many of the sorted parts are each of the (sorted, distinct) names."""
    edge = np.searchsorted(parts_sorted, names, "right")
    return np.diff(np.concatenate([[0], edge]))


def by_part(part: np.ndarray) -> np.ndarray:
    """The stable order by partition; linear where the numbers are small."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
