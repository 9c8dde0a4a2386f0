"""Encoding with a public byte-level BPE tokenizer by recursive SQL inside each partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file on the driver; tasks that don't find it there get it with the job, see ship.
VOCABULARY = os.environ.get("GRAINMILL_BPE", "/opt/tokenizers/byte_bpe_50k.json")
#: The tokenizer's fixed pattern that cuts a text into words before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of one SQL call and of the memory of words: they steer speed and memory, not results.
BYTES_A_CALL, ROUNDS_A_CALL, WORDS_KEPT = 1 << 18, 24, 200_000

# Words stand as rows (w, pos, tok). A round joins every token and its follower with the merges, finds the least rank
# of each word and contracts the places that have it, the leftmost first where they overlap (every second one of a run
# of equal tokens). A merge yields only pairs of higher rank, so all places of the least rank go before anything else,
# just as if they were contracted one by one. Words without a pair in the merges leave the recursion.
_ROUNDS = """
WITH RECURSIVE t(w, pos, tok, round) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN taken THEN merged ELSE tok END, round + 1
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten
    FROM (
      SELECT *, hit AND (n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS taken
      FROM (
        SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit, min(rank) OVER (PARTITION BY w) AS least
        FROM (
          SELECT s.*, m.rank, m.merged
          FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS follower, row_number() OVER (PARTITION BY w ORDER BY pos) AS n FROM t) s
          LEFT JOIN merges m ON m.a = s.tok AND m.b = s.follower
        )
      )
      WHERE least IS NOT NULL AND round < $rounds
    )
  )
  WHERE NOT eaten
)
SELECT w, pos, tok, round FROM t QUALIFY round = max(round) OVER (PARTITION BY w) ORDER BY w, pos
"""
_DECODE = """
SELECT d, list(bytes ORDER BY pos) AS pieces FROM ids JOIN tokens USING (tok) GROUP BY d
"""


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One per Python worker: an in-memory database with the merge table, and the words met so far."""

    def __init__(self, vocabulary: str):
        import duckdb
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        signs = _byte_signs()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table({
            "a": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "b": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()), "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        self.bytes_of = {i: bytes(signs[c] for c in t) for t, i in vocab.items() if all(c in signs for c in t)}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # no spill into a worker's folder
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.words = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}
        self.pieces: dict[bytes, np.ndarray] = {}
        self._join_tables()

    def _join_tables(self) -> None:
        """Which neighbouring bytes some token holds together: as a token of its own, or within three bytes of one."""
        self.pair = np.zeros(1 << 16, dtype=bool)
        self.triple = np.zeros(1 << 24, dtype=bool)
        for t in self.bytes_of.values():
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            if len(b) == 2:
                self.pair[b[0] << 8 | b[1]] = True
            elif len(b) > 2:
                self.triple[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] = True

    def cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sorted positions in raw, the bytes of many words, where a piece begins: each word's start, and every place that
        no token of the vocabulary can span. Merges never reach across such a place, so pieces encode independently."""
        b = raw.astype(np.int64)
        n = len(b)
        fresh = np.zeros(n, dtype=bool)
        fresh[starts] = True
        three = np.zeros(n + 1, dtype=bool)  # at i: bytes i, i+1, i+2 lie in a token and in one word
        if n > 2:
            three[: n - 2] = self.triple[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] & ~fresh[1:-1] & ~fresh[2:]
        held = np.zeros(n, dtype=bool)  # at i: some token may span bytes i-1 and i
        if n > 1:
            held[1:] = self.pair[b[:-1] << 8 | b[1:]] | three[: n - 1]
            held[2:] |= three[: n - 2]
        return np.flatnonzero(fresh | ~held)

    def _contract(self, raw: list[bytes]) -> list[np.ndarray]:
        """Token ids of words given as bytes; long recursions are cut into calls of a bounded number of rounds."""
        sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw))
        w = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        pos = np.arange(len(w), dtype=np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        done_w, done_tok = [], []
        rounds = ROUNDS_A_CALL
        while len(w):
            self.db.register("start", pa.table({"w": w, "pos": pos, "tok": tok}))
            got = self.db.sql(_ROUNDS, params={"rounds": rounds}).to_arrow_table()
            self.db.unregister("start")
            w, pos, tok, at = (got.column(c).to_numpy() for c in ("w", "pos", "tok", "round"))
            left = at == rounds
            done_w.append(w[~left])
            done_tok.append(tok[~left])
            w, pos, tok = w[left], pos[left], tok[left]
        w, tok = np.concatenate(done_w), np.concatenate(done_tok)
        order = np.argsort(w, kind="stable")
        ends = np.searchsorted(w[order], np.arange(1, len(raw)))
        return np.split(tok[order].astype(np.int32), ends)

    def learn(self, words: set[str]) -> None:
        batch: list[str] = []
        size = 0
        for x in sorted(words):
            batch.append(x)
            size += len(x) * 3
            if size > BYTES_A_CALL:
                self._add(batch)
                batch, size = [], 0
        if batch:
            self._add(batch)

    def _add(self, batch: list[str]) -> None:
        """Cut the words into independent pieces, contract the pieces not met yet, and put the words together again."""
        raw = [x.encode("utf-8", "replace") for x in batch]
        ends = np.cumsum([len(x) for x in raw])
        flat = b"".join(raw)
        cuts = self.cuts(np.frombuffer(flat, np.uint8), np.concatenate([[0], ends[:-1]]))
        stops = np.append(cuts[1:], len(flat))
        parts = [flat[i:j] for i, j in zip(cuts.tolist(), stops.tolist())]
        if len(self.pieces) > WORDS_KEPT:
            self.pieces = {}
        new = sorted(set(parts) - self.pieces.keys())
        if new:
            self.pieces.update(zip(new, self._contract(new)))
        firsts = np.searchsorted(cuts, np.concatenate([[0], ends]))
        for x, i, j in zip(batch, firsts[:-1].tolist(), firsts[1:].tolist()):
            self.known[x] = self.pieces[parts[i]] if j == i + 1 else np.concatenate([self.pieces[y] for y in parts[i:j]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        new = {x for ws in cut for x in ws if x not in self.known}
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known = {}
            new = {x for ws in cut for x in ws}
        self.learn(new)
        none = np.zeros(0, dtype=np.int32)
        return [np.concatenate([self.known[x] for x in ws]) if ws else none for ws in cut]

    def decode(self, rows: list[list[int] | None]) -> list[str]:
        """Texts of id lists by ordered aggregation; null and empty lists give an empty text."""
        if not hasattr(self, "has_tokens"):
            self.db.register("given", pa.table({"tok": pa.array(self.bytes_of.keys(), pa.int32()), "bytes": pa.array(self.bytes_of.values(), pa.binary())}))
            self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
            self.has_tokens = True
        sizes = [len(r) if r is not None else 0 for r in rows]
        ids = pa.table({
            "d": np.repeat(np.arange(len(rows), dtype=np.int64), sizes), "pos": np.arange(sum(sizes), dtype=np.int64),
            "tok": pa.array([i for r in rows if r is not None for i in r], pa.int32())})
        self.db.register("ids", ids)
        got = self.db.sql(_DECODE).to_arrow_table().to_pydict()
        out = [""] * len(rows)
        for d, pieces in zip(got["d"], got["pieces"]):
            out[d] = b"".join(pieces).decode("utf-8", "replace")
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    from pyspark import SparkFiles

    return Encoder(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))


def ship(df: DataFrame, vocabulary: str) -> DataFrame:
    """df, whose tasks will find the vocabulary on any machine: Spark hands the file to the executors."""
    sc = df.sparkSession.sparkContext
    if not any(f.rsplit("/", 1)[-1] == os.path.basename(vocabulary) for f in sc.listFiles):
        sc.addFile(vocabulary)
    return df


def slices(b: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of text bytes (a single longer text is a part of its own)."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < b.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        yield b.slice(start, end - start)
        start = end


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash df over the cluster if its files make too few partitions for costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, F.xxhash64(key)) if df.rdd.getNumPartitions() < cores else df


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each whole text, without special tokens; null and empty texts give an empty list.

    Rows stay where they are read: each partition encodes its distinct words with its own database. Repeated rows stay
    repeated; strings that look like special tokens are ordinary text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for whole in batches:
            for b in slices(whole, text):
                got = e.encode(b.column(text).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                flat = np.concatenate(got) if got else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], [key, "ids"])

    rows = spread(ship(documents, vocabulary).select(key, text), key)
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text): the inverse of encode."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(e.decode(b.column("ids").to_pylist()), pa.string())], [key, "text"])

    rows = ship(encoded, vocabulary).select(key, "ids")
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, text string")
