"""Byte-level BPE encoding and decoding by recursive queries, one DuckDB per Python worker.

A rank file gives the tokens and their ranks; a rank is the token's id.  Texts
are split by the tokenizer's pattern.  A word that is a token is that token.
All other words of a run of text become token-position rows (word, position,
id).  A recursive query joins neighbours with the merge table (every way to cut
a token into two tokens), contracts each word's leftmost pair of minimum rank
and goes on until no word has a pair left.  The ids of a text are those of its
words in order; decoding joins a text's ids with the vocabulary and concatenates
by an ordered aggregation.

A word of more than ``LONG`` bytes is encoded in overlapping windows, which are
words of the same query.  Two windows are joined at a token that both have at
the same place: up to that token's end, neither window merged anything across
its edges, so all merges of the whole are merges of one of the two windows, in
the same order, and the joined tokens are those of the whole.  Where two windows
have no token in common (they are out of step in a repetition), the later one is
taken anew from a token's start in the earlier one, further and further back.

Memory is bound by bytes, whatever the texts look like: a run of text holds
``PIECE`` characters, a query ``QUERY_BYTES`` rows, and a worker remembers words
it has seen lately, in two generations of about ``KNOWN`` short words; the
result does not depend on it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets
from .shared import table

#: Rows of a query, words kept by a worker (two generations), characters of text taken at a time.
QUERY_BYTES, KNOWN, PIECE = 1 << 18, 300_000, 1 << 20
#: Bytes of a word that is encoded in windows, bytes of a window, and from one window to the next; windows in hand at a time.
LONG, WINDOW, STRIDE, WINDOWS = 192, 64, 40, 1 << 11

#: A pair's rank, its position and the length of its left token in one number; the least is the next merge.
_BEST = "min(rank * 70368744177664 + pos * 1024 + (npos - pos))"
_SPOT, _RANK, _GONE = "((best // 1024) % 68719476736)", "(best // 70368744177664)::INT", "((best // 1024) % 68719476736 + best % 1024)"
_PAIRS = """
  SELECT n.*, m.rank FROM (
    SELECT w, pos, id, lead(id) OVER z AS nid, lead(pos) OVER z AS npos FROM ({rows})
    WINDOW z AS (PARTITION BY w ORDER BY pos)) n
  LEFT JOIN merges m ON m.pair = n.id * 65536::BIGINT + n.nid"""

#: The least per word comes from a grouping and a join, which costs less here than a second window.
_LEAST = "SELECT p.w, p.pos, p.id, g.best FROM p JOIN (SELECT w, " + _BEST + " AS best FROM p GROUP BY w) g USING (w)"
_MERGED = f"SELECT w, pos, CASE WHEN pos = {_SPOT} THEN {_RANK} ELSE id END AS id FROM s WHERE best IS NOT NULL AND pos <> {_GONE}"
ENCODE_SQL = f"""
WITH RECURSIVE s(w, pos, id, best) AS (
  (WITH p AS MATERIALIZED ({_PAIRS.format(rows="SELECT w, pos, id FROM given")}) {_LEAST})
  UNION ALL
  (WITH p AS MATERIALIZED ({_PAIRS.format(rows=_MERGED)}) {_LEAST})
)
SELECT w, pos, id FROM s WHERE best IS NULL ORDER BY w, pos"""

#: Every way to cut a token into two tokens.
MERGES_SQL = """
CREATE TABLE merges AS
SELECT l.id * 65536::BIGINT + r.id AS pair, t.id AS rank
FROM (SELECT id, piece, unnest(range(1, length(piece))) AS cut FROM vocab) t
JOIN vocab l ON l.piece = substr(t.piece, 1, t.cut) JOIN vocab r ON r.piece = substr(t.piece, t.cut + 1)"""

DECODE_SQL = "SELECT w, string_agg(piece, '' ORDER BY pos) AS text, count(*) AS n FROM given JOIN vocab USING (id) GROUP BY w"


class Codec:
    """Encodes and decodes words with one in-memory DuckDB; no spill files, one thread."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks_file.splitlines() if line)}
        if max(map(len, self.ranks)) >= 1024 or max(self.ranks.values()) >= 65536:
            raise ValueError("tokens of 1024 bytes or ids over 65535 do not fit the packed sort key")
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.names = [""] * (max(self.ranks.values()) + 1)
        for r in self.ranks.values():
            self.names[r] = str(r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "240MB", "temp_directory": "", "preserve_insertion_order": False})
        # bytes are code points 256 and up here, so that any byte sequence is a string
        self.db.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": ["".join(chr(256 + b) for b in t) for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.db.execute(MERGES_SQL)
        # a short word's ids, two bytes each
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def query(self, sql: str, **columns) -> pa.Table:
        """A query's result over a table ``given`` of these columns."""
        self.db.register("given", pa.table(columns))
        got = self.db.sql(sql).to_arrow_table()
        self.db.unregister("given")
        return got

    def tokens(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ids of the tokens of each word, by the recursive query over about ``QUERY_BYTES`` rows at a time."""
        at = 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and (to == at or size + len(words[to]) <= QUERY_BYTES):
                size += len(words[to])
                to += 1
            length = np.array([len(x) for x in words[at:to]], np.int64)
            data = np.frombuffer(b"".join(words[at:to]), np.uint8)
            pos = (np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
            got = self.query(ENCODE_SQL, w=np.repeat(np.arange(to - at, dtype=np.int32), length), pos=pos, id=self.byte_id[data])
            w, pos, ids = (got[c].to_numpy() for c in ("w", "pos", "id"))
            ends = np.searchsorted(w, np.arange(to - at + 1)).tolist()
            ids = ids.astype(np.uint16)
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                yield pos[i:j], ids[i:j]
            at = to

    def long_word(self, word: bytes) -> bytes:
        """The ids (two bytes each) of a word of any length, by windows."""
        starts, ids, end = array("q"), array("H"), 0  # the tokens of word[:end]
        seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # windows outside the usual steps
        places = range(0, max(1, len(word) - WINDOW + STRIDE), STRIDE)
        for group in (places[i : i + WINDOWS] for i in range(0, len(places), WINDOWS)):
            parts = [word[p : p + WINDOW] for p in group]
            distinct = list(dict.fromkeys(parts))
            found = dict(zip(distinct, self.tokens(distinct), strict=True))
            for place, part in zip(group, parts, strict=True):
                stop, back = place + len(part), WINDOW - STRIDE
                s, k = found[part]
                while end:
                    tail = bisect.bisect_left(starts, place)
                    ends = dict(zip(starts[tail:], [*starts[tail + 1 :], end], strict=False))
                    s = (s + place).tolist()
                    same = next((i for i, (a, b) in enumerate(zip(s, [*s[1:], stop], strict=True)) if ends.get(a) == b), None)
                    if same is not None or not place:
                        break
                    place = starts[max(0, bisect.bisect_right(starts, max(0, end - back)) - 1)]
                    back *= 2
                    part = word[place:stop]
                    if part not in seen:
                        seen[part] = next(self.tokens([part]))
                    s, k = seen[part]
                if end and same is not None:
                    cut = bisect.bisect_left(starts, s[same])
                    del starts[cut:], ids[cut:]
                    s, k = s[same:], k[same:]
                else:  # the first window, or one that begins with the word
                    del starts[:], ids[:]
                starts.extend(map(int, s))
                ids.frombytes(k.tobytes())
                end = stop
        return ids.tobytes()

    def decoded(self, sizes: list[int], ids: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids, ``sizes`` of them a text; an unknown id is an error."""
        out: list[list[bytes]] = [[] for _ in sizes]
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for at in range(0, len(ids), QUERY_BYTES):
            part = ids[at : at + QUERY_BYTES]
            got = self.query(DECODE_SQL, w=text[at : at + QUERY_BYTES], pos=np.arange(len(part), dtype=np.int32), id=part.astype(np.int32))
            if sum(got["n"].to_pylist()) != len(part):
                raise ValueError("an id that is not in the vocabulary")
            data, offsets = bytesets.raw(got["text"].combine_chunks())
            two = data.reshape(-1, 2)  # code points 256 to 511 take two bytes each
            plain = (((two[:, 0] & 3) << 6) | (two[:, 1] & 63)).astype(np.uint8).tobytes()
            ends = (offsets // 2).tolist()
            for w, i, j in zip(got["w"].to_pylist(), ends[:-1], ends[1:], strict=True):
                out[w].append(plain[i:j])
        return [b"".join(x) for x in out]

    def encoded(self, texts: list[list[str]]) -> list[bytes]:
        """The ids (two bytes each) of each text from its words; new short words are remembered."""
        if len(self.known) > KNOWN:
            self.older, self.known = self.known, {}
        known, ranks = self.known, self.ranks
        new = [w for w in set().union(*texts) if w not in known]
        fresh, large = [], {}
        for w in new:
            held = self.older.get(w)
            if held is not None:
                known[w] = held
                continue
            b = w.encode()
            r = ranks.get(b)
            if r is not None:
                known[w] = r.to_bytes(2, sys.byteorder)
            elif len(b) > LONG:
                large[w] = self.long_word(b)
            else:
                fresh.append((w, b))
        for (w, _), (_, ids) in zip(fresh, self.tokens([b for _, b in fresh]), strict=True):
            known[w] = ids.tobytes()
        if large:
            return [b"".join(large[w] if w in large else known[w] for w in words) for words in texts]
        return [b"".join(map(known.__getitem__, words)) for words in texts]


@contextmanager
def codec(ranks_file: bytes, forget: bool = False) -> Iterator[Codec]:
    """This worker's codec for a rank file.  ``forget``: one for this task only, so that a waiting worker holds no memory of it."""
    held = sys.__dict__.setdefault("_loomgraph_bpe", {})
    key = hashlib.sha256(ranks_file).hexdigest()
    this = held.pop(key, None) or Codec(ranks_file)
    try:
        yield this
    finally:
        if forget:
            this.db.close()
            this.known, this.older, this.ranks, this.names = {}, {}, {}, []
        else:
            held[key] = this
        bytesets.trim()


def runs(texts: list[str], pattern) -> Iterator[list[tuple[int, list[str]]]]:
    """The words of the texts (number of the text, words) in runs of about ``PIECE`` characters; a longer text goes over several runs."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if size + len(text) <= PIECE:
            held.append((i, pattern.findall(text)))
            size += len(text)
            continue
        words = []
        for found in pattern.finditer(text):
            words.append(found.group())
            size += len(words[-1])
            if size >= PIECE:
                held.append((i, words))
                yield held
                held, words, size = [], [], 0
        held.append((i, words))
    if held:
        yield held


def coded(texts: list[str], pattern, this: Codec) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the text and ids, in order, run by run: a long text comes in several parts."""
    for run in runs(texts, pattern):
        for (i, _), ids in zip(run, this.encoded([words for _, words in run]), strict=True):
            yield i, np.frombuffer(ids, np.uint16)


def _ranks(spark: SparkSession, path: str | None):
    """The rank file (its size does not depend on the data), sent once to each executor."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, id_col: str, text_col: str, ranks: str | None, pattern: str, rows, schema: pa.Schema, ddl: str, forget: bool = False) -> DataFrame:
    """id and what ``rows`` (codec, pattern, texts of a batch) gives for each row of ``df``."""
    sent = _ranks(df.sparkSession, ranks)
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        cut = regex.compile(pattern)
        with codec(sent.value, forget) as this:
            for batch in batches:
                cols = list(zip(*rows(this, cut, batch.column(1).to_pylist()), strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]], names=["id", *schema.names])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, {ddl}")


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id and ``ids`` (array of int) of each row, as the tiktoken library gives without special tokens.

    Null and empty texts have no ids.  Texts and words may be of any length.
    Rows come back as often as they came, other columns do not matter, an empty
    table gives an empty table.
    """

    def rows(this, cut, texts):
        out = [[] for _ in texts]
        for i, ids in coded(texts, cut, this):
            out[i].append(ids)
        return [(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32),) for x in out]

    return _mapped(df, id_col, text_col, ranks, pattern, rows, pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>")


def decode(df: DataFrame, *, id_col: str = "id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """id and ``bytes`` of each row of token ids; null or no ids give no bytes, an unknown id is an error."""
    sent = _ranks(df.sparkSession, ranks)
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        with codec(sent.value) as this:
            for batch in batches:
                lists = batch.column(1)
                ends = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
                out = this.decoded(np.diff(ends).tolist(), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, bytes binary")


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, forget: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded, and their ids decoded again.

    Defined like ``encode``.  The digests are built up run by run, so that the
    ids of a long text are never held as a whole.  ``forget``: workers drop their
    words after each task, for jobs whose other stages need the memory.
    """

    def rows(this, cut, texts):
        counts, named, plain = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for run in runs(texts, cut):
            parts = [np.frombuffer(x, np.uint16) for x in this.encoded([words for _, words in run])]
            for (i, _), ids, text in zip(run, parts, this.decoded([len(x) for x in parts], np.concatenate(parts)), strict=True):
                if len(ids):
                    named[i].update(((" " if counts[i] else "") + " ".join(map(this.names.__getitem__, ids.tolist()))).encode())
                    counts[i] += len(ids)
                    plain[i].update(text)
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(counts, named, plain, strict=True)]

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(df, id_col, text_col, ranks, pattern, rows, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", forget)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
