"""Suffix-array deduplication of byte strings that repeat within and across texts.

Every byte that a string of ``size`` bytes covers which also starts earlier
(smaller id, or same id and earlier start) is removed; strings are judged on the
input.  The work is cut into shards that no pair of equal strings straddles:

1. Anchors.  Of the 30-byte grams in a window of ``size`` bytes the one with the
   least hash (the leftmost of equals) is the window's anchor.  Equal windows
   have equal anchors at the same offset, so the anchor's hash is a shard key.
   A run of windows with one anchor is a unit: the bytes they cover.
2. Equal units are collapsed: all but the earliest are removed whole and do not
   go on.  A task does that for its own units first, so a group of copies sends
   one unit a task; the rest meet by anchor in one sort.
3. Units whose anchor has at least two different contents go on to the suffix
   arrays, each once: what is around edits, and the edges of shared passages.
4. A shard joins such units by a separator.  Its suffix array is built by
   induced sorting: suffixes are classified as smaller (S) or larger (L) than
   their successor, leftmost-S substrings are sorted by induction and named, the
   string of names is sorted by prefix doubling, and the array is induced from
   it.  Permuted common prefixes (of each suffix with its predecessor, in text
   order, up to ``size`` bytes) then give the runs of suffixes that share
   ``size`` bytes; all but the earliest of a run are removed.

An anchor with more different units than fit into a shard's memory (one very
common line in changing surroundings) is split further: its windows, not its
units, are dealt to buckets by a hash of their bytes, and equal windows of a
batch of texts go on once, so what many texts share is one row a batch.

Two steps go by hashes alone: equal units have equal 64-bit anchors and equal
64-bit contents, 128 bits together; within suffix arrays bytes are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets
from .shared import keep, table

#: Bytes of a repeated string; bytes of the gram that anchors a window.
SIZE, GRAM = 100, 30
#: Bytes of units that one suffix array is built over; units of an anchor from which its windows are dealt to buckets, and windows of a bucket.
SHARD, HOT = 3 << 20, 8_192
#: Bytes of text hashed at a time; a longer text is cut with an overlap of ``SIZE`` - 1 bytes.
PART = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_STEP = np.uint64(0xD1342543DE82EF95)
#: The lowest bit of each byte of a number.
_BYTE = np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, at least ``n``."""
    n = max(n, 1 << 12)
    n = 1 << (n - 1).bit_length()
    if n not in _POWERS:
        _POWERS.clear()
        one = np.ones(n, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = _STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))
        _POWERS[n] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _B
    x ^= x >> np.uint64(29)
    x = x * _C
    return x ^ (x >> np.uint64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


def units(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, start (in row), length, anchor hash and content hash of each unit of a run of texts."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < size:
        return none
    eight = _eights(data)[: n + 1]
    with np.errstate(over="ignore"):
        m = n - gram + 1
        g = _mix(eight[:m] * _A + (eight[8 : m + 8] ^ _C) * _B)
        g = _mix(g + eight[16 : m + 16] * _C + (eight[gram - 8 : m + gram - 8] ^ _A) * _A)
        # 40 bits of hash over 24 bits of position: the minimum is the leftmost least
        least = (g & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
        span, width = size - gram + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        start = np.arange(n - size + 1)
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + size <= offsets[row + 1]
        start, row, anchor = start[inside], row[inside], (least[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
        if not len(start):
            return none
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        s, e = start[first], start[last] + size
        up, down = _powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(eight[:n] * _C + _A) * up[:n])])
        # eight-byte values inside the unit only; its last bytes are in the last of them
        content = _mix((sums[e - 7] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return row[first], s - offsets[row[first]], e - s, g[anchor[first]], content


def _parts(data: np.ndarray, offsets: np.ndarray, size: int):
    """(row, start in row, data, offsets) of pieces; long rows are cut with an overlap of size - 1 bytes."""
    for a, b in bytesets.pieces(offsets, PART):
        if b == a + 1 and offsets[b] - offsets[a] > PART:
            at, end = int(offsets[a]), int(offsets[b])
            while True:
                to = min(end, at + PART)
                yield a, at - int(offsets[a]), data[at:to], np.array([0, to - at])
                if to == end:
                    break
                at = to - size + 1
        else:
            yield a, 0, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


# --- suffix arrays ---------------------------------------------------------


def _doubling(names: np.ndarray, reach: int) -> np.ndarray:
    """The suffix array of a string of names up to its first ``reach`` names; equal ones in text order."""
    rank, n, k = names.astype(np.int64), len(names), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else after[: max(0, n - k)]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        value = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
        k *= 2
        if k >= reach or k >= n or rank.max() == n - 1:
            return order


def _induce(text: np.ndarray, small: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """All suffixes from sorted leftmost-S ones: L suffixes left to right, then S suffixes right to left.

    A bucket is scanned in waves: the suffixes it holds, then those of the same
    character that these induced, until none is new.
    """
    n = len(text)
    size = np.diff(ends, prepend=0)
    begins = ends - size
    wide = np.bincount(text[~small], minlength=256)  # L suffixes come first in a bucket
    array = np.full(n, -1, np.int64)
    fill = begins.copy()
    seeds = np.split(seed, np.cumsum(np.bincount(text[seed], minlength=256))[:-1])

    def put(found: np.ndarray, at: np.ndarray, step: int) -> None:
        c = text[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        count = np.bincount(c, minlength=256)
        rank = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        array[at[c] + step * rank] = found
        at += step * count

    put(np.array([n - 1]), fill, 1)  # the last suffix is L: the sentinel after it is smaller
    for c in range(256):
        at = begins[c]
        while at < fill[c]:
            wave = array[at : fill[c]]
            at = fill[c]
            before = wave[wave > 0] - 1
            put(before[~small[before]], fill, 1)
        before = seeds[c] - 1
        put(before[(before >= 0) & ~small[before]], fill, 1)
    back = ends - 1
    for c in range(255, -1, -1):
        at = ends[c] - 1
        while at > back[c]:
            wave = array[back[c] + 1 : at + 1][::-1]
            at = back[c]
            before = wave[wave > 0] - 1
            put(before[small[before]], back, -1)
        if wide[c]:
            wave = array[begins[c] : begins[c] + wide[c]][::-1]
            before = wave[wave > 0] - 1
            put(before[small[before]], back, -1)
    return array


def suffix_array(text: np.ndarray, reach: int = 1 << 40) -> np.ndarray:
    """Suffix array of bytes; suffixes that agree in ``reach`` bytes stay in some order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # a suffix is S if smaller than the next: equal neighbours take the type of what follows their run
    differ = np.flatnonzero(text[1:] != text[:-1])
    run = np.searchsorted(differ, np.arange(n))
    rises = np.append(text[differ] < text[differ + 1], False)
    small = rises[run]
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=256))
    if len(leftmost) > 1:
        by = leftmost[np.argsort(text[leftmost], kind="stable")]
        rough = _induce(text, small, ends, by)
        mark = np.zeros(n, bool)
        mark[leftmost] = True
        order = rough[mark[rough]]  # leftmost-S substrings in order
        stop = np.append(leftmost[1:] + 1, n)
        size = np.zeros(n, np.int64)
        size[leftmost] = stop - leftmost
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        same &= (b + size[b] < n) & (a + size[a] < n)  # the last substring ends in the sentinel
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[size[a[live]] > k]
            if not len(live):
                break
            off = text[a[live] + k] != text[b[live] + k]
            same[live[off]] = False
            live, k = live[~off], k + 1
        name = np.empty(n, np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        leftmost = leftmost[_doubling(name[leftmost], reach)]
    return _induce(text, small, ends, leftmost)


def common_prefixes(text: np.ndarray, array: np.ndarray, size: int) -> np.ndarray:
    """Permuted common prefixes: for each position in text order, the bytes its suffix shares with its predecessor's
    in the array, counted up to ``size``."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    out = np.zeros(n, np.int64)
    eight = np.concatenate([_eights(text), np.zeros(size, np.uint64)])
    live = np.flatnonzero(before >= 0)
    for k in range(0, size, 8):
        differ = eight[live + k] ^ eight[before[live] + k]
        same = differ == 0
        last, differ = live[~same], differ[~same]
        low = differ & (~differ + np.uint64(1))  # the lowest set bit: the first byte that differs
        out[last] += np.searchsorted(_BYTE, low, "right") - 1
        live = live[same]
        out[live] += 8
    return np.minimum(out, np.minimum(size, np.minimum(n - np.arange(n), np.where(before >= 0, n - before, 0))))


def repeated(text: np.ndarray, order: np.ndarray, size: int, whole: np.ndarray) -> np.ndarray:
    """Starts of strings of ``size`` bytes that also start at a position of lower ``order``; only ``whole`` starts count."""
    array = suffix_array(text, size)
    joined = (common_prefixes(text, array, size) == size)[array]
    group = np.cumsum(~joined)
    ok = whole[array]
    array, group = array[ok], group[ok]
    by = np.lexsort((order[array], group))
    array, group = array[by], group[by]
    later = np.zeros(len(array), bool)
    later[1:] = group[1:] == group[:-1]
    return array[later]


# --- the distributed operator ----------------------------------------------


def _runs(start: np.ndarray, length: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted by (row, start), joined where they touch: row, start, length."""
    if not len(start):
        return row, start, length
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + length)[order]
    base = (row - row.min()) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(row), bool)
    new[1:] = (start + base)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[stop] - base[stop] - start[first]


_UNIT = "kind int, anchor long, content long, rank long, uid long, start long, length int"
_NAMES = [x.split()[0] for x in _UNIT.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_GONE, _OPEN = 0, 1  # kinds: removed bytes, a unit


def _batch(kind: int, anchor, content, rank, uid, start, length) -> pa.RecordBatch:
    cols = [np.full(len(start), kind), anchor.view(np.int64), content.view(np.int64), rank, uid, start, length]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _blank(n: int) -> np.ndarray:
    return np.zeros(n, np.int64)


def _packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, rank (the id as a number, null last) and body (compressed UTF-8) of each row; written."""
    one = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = bytesets.raw(batch.column(2))
            body = [zip_.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(1).fill_null((1 << 63) - 1), pa.array(body, pa.binary())], names=["uid", "id", "rank", "body"])

    return keep(one.mapInArrow(run, "uid long, id long, rank long, body binary"), "suffix-texts")


def _unpack(body) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body.as_py())


def _own_units(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """The units of all texts; a task's repeated units are collapsed at once."""

    def run(batches):
        for batch in batches:
            bodies = [_unpack(b) for b in batch.column(2)]
            uid, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
            data = np.frombuffer(b"".join(bodies), np.uint8)
            del bodies
            got = []
            for row, shift, part, cut in _parts(data, offsets, size):
                r, s, n, a, c = units(part, cut, size, gram)
                got.append((r + row, s + shift, n, a, c))
            if not got:
                continue
            row, start, length, anchor, content = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((start, uid[row], rank[row], content, anchor))
            row, start, length, anchor, content = (x[order] for x in (row, start, length, anchor, content))
            again = np.zeros(len(row), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
            r, s, n = _runs(start[again], length[again], row[again])
            yield _batch(_GONE, uid[r], _blank(len(r)), rank[r], uid[r], s, n)  # spread by text, not by anchor
            once = ~again
            r = row[once]
            yield _batch(_OPEN, anchor[once], content[once], rank[r], uid[r], start[once], length[once])

    return texts.select("uid", "rank", "body").mapInArrow(run, _UNIT)


def _meet(batches):
    """Units sorted by anchor, content, place: later equals are removed; anchors of several contents stay open.

    An anchor's rows may span batches: all that is carried over is the last row's
    keys, how many contents its anchor has had, and the first of them if it is
    the only one so far.
    """
    last, contents, waiting = None, 0, None
    for batch in batches:
        gone = int(np.searchsorted(batch.column(0).to_numpy(), _OPEN))  # sorted by kind: removed bytes pass through
        if gone:
            yield batch.slice(0, gone)
            batch = batch.slice(gone)
        if not len(batch):
            continue
        anchor, content, rank, uid, start, length = (batch.column(i).to_numpy() for i in range(1, 7))
        new_anchor, new_content = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_content[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        goes_on = last is not None and last[0] == anchor[0]
        if goes_on:
            new_anchor[0], new_content[0] = False, last[1] != content[0]
        group = np.cumsum(new_anchor) - (0 if goes_on else 1)  # 0 is the carried anchor's group if it goes on
        count = np.bincount(group, new_content, minlength=int(group[-1]) + 1).astype(np.int64)
        if goes_on:
            count[0] += contents
        again = ~new_content
        r, s, n = _runs(start[again], length[again].astype(np.int64), uid[again])
        yield _batch(_GONE, _blank(len(r)), _blank(len(r)), _blank(len(r)), r, s, n)
        if waiting is not None and goes_on and count[0] > 1:
            yield waiting
            waiting = None
        several = new_content & (count[group] > 1)
        yield _batch(_OPEN, anchor[several], content[several], rank[several], uid[several], start[several], length[several])
        if count[-1] > 1 or not (goes_on and group[-1] == 0):
            waiting = None
        if count[-1] == 1 and not (goes_on and group[-1] == 0):
            i = np.flatnonzero(new_content & (group == group[-1]))
            waiting = _batch(_OPEN, anchor[i], content[i], rank[i], uid[i], start[i], length[i])
        last, contents = (anchor[-1], content[-1]), int(count[-1])


def _window_bucket(body: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """A bucket for each string of ``size`` bytes, from its content."""
    eight = _eights(body)
    n = len(body) - size + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, size - 7, 8), size - 8]:
            h = _mix(h * _B + eight[k : k + n] + _A)
    return (h % np.uint64(buckets)).astype(np.int64)


def _cut(size: int):
    """Rows (body, rank, uid, wanted units) to one row a unit: anchor, bucket, buckets, rank, uid, start, bytes.

    Of a unit in buckets all strings of ``size`` bytes go on, each by itself, to
    the bucket of its content.  Equal ones of a batch go once; the later of them
    come back at once as removed (bucket -1, spread by text).
    """
    names, types = ["anchor", "bucket", "buckets", "rank", "uid", "start", "bytes"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            out, first = [], {}
            ranks, uids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in sorted(range(len(ranks)), key=lambda i: (ranks[i], uids[i])):
                text = None
                for w in sorted(batch.column(3)[i].as_py(), key=lambda w: w["start"]):
                    text = _unpack(batch.column(2)[i]) if text is None else text
                    start, piece = w["start"], text[w["start"] : w["start"] + w["length"]]
                    if w["buckets"] == 1:
                        out.append((w["anchor"], 0, 1, ranks[i], uids[i], start, piece))
                        continue
                    buckets = _window_bucket(np.frombuffer(piece, np.uint8), size, w["buckets"]).tolist()
                    for k, bucket in enumerate(buckets):
                        string = piece[k : k + size]
                        if first.setdefault(string, (i, start + k)) == (i, start + k):
                            out.append((w["anchor"], bucket, w["buckets"], ranks[i], uids[i], start + k, string))
                        else:
                            out.append((uids[i], -1, w["buckets"], ranks[i], uids[i], start + k, b""))
                    if len(out) >= 20_000:
                        yield made(out)
                        out = []
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return run


def _shard(rows: list[tuple], size: int) -> pa.RecordBatch:
    """Removed intervals (uid, start, length) of the units of one shard, by its suffix array."""
    bodies = [r[6] for r in rows]
    length = np.array([len(b) for b in bodies], np.int64)
    first = np.cumsum(length + 1) - length - 1
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)  # 255 is in no UTF-8 text
    rank, uid, start = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
    place = np.lexsort((uid, rank))
    new = np.ones(len(rows), bool)
    new[1:] = (rank[place][1:] != rank[place][:-1]) | (uid[place][1:] != uid[place][:-1])
    document = np.empty(len(rows), np.int64)
    document[place] = np.cumsum(new)
    unit = np.repeat(np.arange(len(rows)), length + 1)
    within = np.arange(len(text)) - first[unit]
    order = (document[unit] << 40) + start[unit] + within
    whole = within + size <= length[unit]
    found = repeated(text, order, size, whole)
    u = unit[found]
    r, s, n = _runs(start[u] + within[found], np.full(len(found), size), uid[u])
    return _batch(_GONE, _blank(len(r)), _blank(len(r)), _blank(len(r)), r, s, n)


def _shards(size: int):
    def run(batches):
        rows: list[tuple] = []
        have, key = 0, None
        for batch in batches:
            known = batch.filter(pc.less(batch.column(1), 0))
            if len(known):
                r, s, n = _runs(known.column(5).to_numpy(), np.full(len(known), size), known.column(4).to_numpy())
                yield _batch(_GONE, _blank(len(r)), _blank(len(r)), _blank(len(r)), r, s, n)
            for row in zip(*(c.to_pylist() for c in batch.filter(pc.greater_equal(batch.column(1), 0)).columns), strict=True):
                if row[:2] != key:
                    if have >= SHARD:
                        yield _shard(rows, size)
                        rows, have = [], 0
                    key = row[:2]
                rows.append(row)
                have += len(row[6]) + 1
        if rows:
            yield _shard(rows, size)

    return run


def removed(texts: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Removed intervals (uid, start, length) of packed texts, not yet joined."""
    order = ["kind", "anchor", "content", "rank", "uid", "start"]
    met = _own_units(texts, size, gram).repartition("anchor").sortWithinPartitions(*order).mapInArrow(_meet, _UNIT)
    met = keep(met, "suffix-met")
    still = met.where(F.col("kind") == _OPEN)
    windows = F.sum(F.col("length") - (size - 1))
    heavy = still.groupBy("anchor").agg(F.count("*").alias("n"), windows.alias("windows")).where(F.col("n") > hot).select("anchor", (F.ceil(F.col("windows") / hot) + 1).cast("int").alias("buckets"))
    heavy = keep(heavy, "suffix-heavy")  # a written table: Spark may broadcast it if it is small, or split a hot anchor's rows
    wanted = still.join(heavy, "anchor", "left").select("uid", F.struct("anchor", "start", "length", F.coalesce("buckets", F.lit(1)).alias("buckets")).alias("unit"))
    wanted = wanted.groupBy("uid").agg(F.collect_list("unit").alias("wanted"))  # units of one text
    cut = texts.join(wanted, "uid").select("rank", "uid", "body", "wanted").mapInArrow(_cut(size), "anchor long, bucket int, buckets int, rank long, uid long, start long, bytes binary")
    found = cut.repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket").mapInArrow(_shards(size), _UNIT)
    gone = met.where(F.col("kind") == _GONE).unionByName(found)
    return gone.select("uid", "start", "length")


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """id, n_bytes, spans (array of start, length: maximal removed runs) and kept (binary) of each row.

    Ids are numbers; a null id is the largest.  Of rows with one id the earlier
    in the table counts as earlier.  Null and empty texts, and texts shorter
    than ``size`` bytes, keep all they have.  Other columns do not matter; an
    empty table gives an empty table.  What is kept may be cut inside a
    character, so it is binary.
    """
    if not gram + 8 <= size or gram < 24:
        raise ValueError("grams have 24 bytes at least and fit into the strings")
    texts = _packed(df, id_col, text_col)
    spans = removed(texts, size, gram, hot).groupBy("uid").agg(F.collect_list(F.struct("start", "length")).alias("gone"))  # intervals of one text
    joined = texts.join(spans, "uid", "left").select("id", "body", "gone")
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for body, gone in zip(batch.column(1), batch.column(2), strict=True):
                text = _unpack(body)
                if not gone.is_valid:
                    rows.append((len(text), [], text))
                    continue
                flat = gone.values
                s, n = flat.field("start").to_numpy(), flat.field("length").to_numpy().astype(np.int64)
                _, s, n = _runs(s, n, np.zeros(len(s), np.int64))
                edge = [0, *np.stack([s, s + n], 1).ravel().tolist(), len(text)]
                rows.append((len(text), [{"start": a, "length": b} for a, b in zip(s.tolist(), n.tolist(), strict=True)], b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(span)), pa.array(cols[2], pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
