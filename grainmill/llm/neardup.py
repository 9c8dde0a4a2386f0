"""Near-duplicate records: exact Jaccard pairs by fingerprints in vantage-point trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import broadcast_if_small, cut

#: A word is a run of these letters and digits or one character from U+4E00 to U+9FFF.
WORD = re.compile("[a-z0-9]+|[一-鿿]")
#: What isn't a letter or digit of such a word becomes a blank in texts of ASCII alone, whose words are then parted by blanks.
BLANKS = {i: " " for i in range(128) if not WORD.match(chr(i))}
BITS = 512
#: Sets with more members than WIDE_FROM get a fingerprint of WIDE bits as well; folding it gives the short one.
WIDE, WIDE_FROM = 2048, 200
SURVEYED = ["kind", "id", "version", "key", "check", "n", "size", "print"]
#: Most words, and most shingles, whose counts are sent to every task; the rest count as rare, which moves work but no result.
SENT = 1 << 18
#: Words that a task counts together, and records among them that make a shingle common enough to report.
COUNTED_TOGETHER, OFTEN = 2_000_000, 4


@dataclass(frozen=True)
class Settings:
    """span: words of a shingle. threshold: least share of common shingles. least_words: shorter records don't count.
    tile: rows of a shard that one tree holds at most."""

    span: int = 3
    threshold: float = 0.5
    least_words: int = 30
    tile: int = 2048


class _Numbers(dict):
    """The number of each word, given when it is first asked for; fresh holds the hashes of the latest."""

    def __init__(self):
        self.fresh: list[int] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(xxhash.xxh3_64_intdigest(word))
        return n


class Known:
    """Counts of frequent words or shingles: sorted hashes and the logs of their counts. Most of those that aren't known are told by a bitmap."""

    def __init__(self, names: np.ndarray, logs: np.ndarray):
        self.names, self.logs = names, logs
        self.bits = np.zeros(1 << 22, bool)
        self.bits[names & np.uint64((1 << 22) - 1)] = True

    def logs_of(self, x: np.ndarray) -> np.ndarray:
        """The log count of each member of x, 0 for those that aren't known."""
        out = np.zeros(len(x), np.float32)
        some = np.flatnonzero(self.bits[x & np.uint64((1 << 22) - 1)])
        if len(some):
            y = x[some]
            i = np.minimum(np.searchsorted(self.names, y), len(self.names) - 1)
            out[some] = np.where(self.names[i] == y, self.logs[i], np.float32(0))
        return out


class Shingler:
    """Words and shingles as 64-bit hashes; one per worker, with a bounded memory of words and, if counts of words are given, of their weights."""

    def __init__(self, span: int, seed: int = 0, counts: Known | None = None):
        self.span, self.seed, self.counts = span, seed, counts
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.hash, self.weight = _Numbers(), np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the words of each text: places in hash and weight."""
        if len(self.numbers) > 500_000:
            self._forget()
        number = self.numbers.__getitem__
        out = []
        for t in texts:
            ws = [] if not t else t.translate(BLANKS).split() if t.isascii() else WORD.findall(t)
            out.append(np.fromiter(map(number, ws), np.int64, len(ws)))
        if self.numbers.fresh:
            new = np.array(self.numbers.fresh, np.uint64)
            self.numbers.fresh.clear()
            self.hash = np.concatenate([self.hash, new])
            if self.counts is not None:
                self.weight = np.concatenate([self.weight, self.counts.logs_of(new)])
        return out

    def key(self, words: np.ndarray) -> int:
        """64 bits that stand for a text's words."""
        return xxhash.xxh3_64_intdigest(words.tobytes(), seed=self.seed)

    @staticmethod
    def check(words: np.ndarray) -> int:
        """Other 64 bits, which tell apart texts whose keys are the same."""
        return xxhash.xxh64_intdigest(words.tobytes(), seed=1)

    def shingles(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and, for each, the place of one occurrence."""
        n = len(words) - self.span + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.span):
            h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h, return_index=True)


def records(nodes: DataFrame) -> DataFrame:
    """(id, version, text): title, summary and full_content joined by one space, null as empty, lower-cased; ids null don't count."""
    part = [F.coalesce(c, F.lit("")) for c in ("title", "summary", "full_content")]
    return nodes.filter("id is not null").select("id", F.coalesce("version", F.lit(-1)).alias("version"), F.lower(F.concat_ws(" ", *part)).alias("text"))


def fold(shingles: np.ndarray) -> bytes:
    """Fingerprint of a shingle set: bit i is the parity of its members that hash to i.

    It is linear, so the Hamming distance of two fingerprints never exceeds the size of the sets' symmetric difference.
    """
    bits = WIDE if len(shingles) > WIDE_FROM else BITS
    parity = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


class Prints:
    """Short fingerprints of all rows, and the wide ones of those that have one."""

    def __init__(self, column: list[bytes]):
        has = np.array([len(x) > BITS // 8 for x in column], dtype=bool)
        self.wide_at = np.where(has, np.cumsum(has) - 1, -1)
        self.wide = np.frombuffer(b"".join(x for x, w in zip(column, has) if w), np.uint64).reshape(-1, WIDE // 64)
        self.short = np.empty((len(column), BITS // 64), np.uint64)
        self.short[~has] = np.frombuffer(b"".join(x for x, w in zip(column, has) if not w), np.uint64).reshape(-1, BITS // 64)
        self.short[has] = np.bitwise_xor.reduce(self.wide.reshape(len(self.wide), WIDE // BITS, BITS // 64), axis=1)

    def near(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs of rows may differ by at most so many members."""
        ok = _popcount(self.short[a] ^ self.short[b]) <= most
        i = np.flatnonzero(ok & (self.wide_at[a] >= 0) & (self.wide_at[b] >= 0))
        ok[i] = _popcount(self.wide[self.wide_at[a[i]]] ^ self.wide[self.wide_at[b[i]]]) <= most[i]
        return ok


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


class Forest:
    """Many vantage-point trees at once, each met with itself while it grows, level by level.

    A node of a tree takes one of the rows it holds as its vantage point, meets all its rows with it, and splits the rest at the
    median of their Hamming distances to it. Held rows go to one half, and as guests to the outer half too if the triangle bounds of
    its distances leave room for a near row; guests go to every half that has room. No pair within the radius is lost, since each
    half is a shell of distances [low, high], and |d(x, point) - d(y, point)| <= d(x, y).
    """

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, ratio: float):
        self.prints, self.sizes, self.ratio = prints, sizes, ratio
        #: Trees grown, rows met with a vantage point, and rows that the bounds kept out of a half, for tests and figures.
        self.trees = self.met = self.pruned = 0

    def pairs(self, row: np.ndarray, tree: np.ndarray, held: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): the pairs of rows of one tree, at least one of them held, with a distance of at most ratio * (the sum of their sizes).

        Each entry is a row in a tree. cross: held rows of this entry's tree don't meet each other, only guests.
        """
        out = [np.zeros((2, 0), np.int64)]
        node = tree
        self.trees += len(np.unique(tree))
        while len(row):
            order = np.lexsort((~held, node))
            row, node, held, cross = row[order], node[order], held[order], cross[order]
            first = np.ones(len(row), bool)
            first[1:] = node[1:] != node[:-1]
            start = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            n_held = np.add.reduceat(held, start)
            keep = (n_held > 0)[of]  # guests alone have nothing to meet
            if not keep.all():
                row, node, held, cross = row[keep], of[keep], held[keep], cross[keep]
                continue
            point = row[start]
            rest = ~first
            row, of, held, cross = row[rest], of[rest], held[rest], cross[rest]
            if not len(row):
                break
            far = np.empty(len(row), np.int32)
            for i in range(0, len(row), 1 << 15):  # bounded copies of the prints
                part = slice(i, i + (1 << 15))
                far[part] = _popcount(self.prints[row[part]] ^ self.prints[point[of[part]]])
            self.met += len(row)
            near = (far <= self.ratio * (self.sizes[row] + self.sizes[point[of]])) & ~(held & cross)
            out.append(np.stack([row[near], point[of[near]]]))
            row, node, held, cross = self._split(row, of, held, cross, far, len(point))
        return tuple(np.concatenate(out, axis=1))

    def _split(self, row, of, held, cross, far, n) -> tuple[np.ndarray, ...]:
        """Entries of the next level; node 2k is the inner half of k, 2k + 1 the outer one."""
        h = np.flatnonzero(held)
        h = h[np.lexsort((far[h], of[h]))]
        count = np.bincount(of[h], minlength=n)
        begin = np.cumsum(count) - count
        mid = np.full(n, -1, np.int64)
        some = count > 0
        mid[some] = far[h[begin[some] + (count[some] - 1) // 2]]
        outer = far > mid[of]
        half = 2 * of + outer
        low, high, most = np.full(2 * n, 1 << 30), np.full(2 * n, -1), np.zeros(2 * n, np.int64)
        np.minimum.at(low, half[h], far[h])
        np.maximum.at(high, half[h], far[h])
        np.maximum.at(most, half[h], self.sizes[row[h]])
        parts = [(row[h], half[h], held[h], cross[h])]
        for side in (0, 1):
            to = 2 * of + side
            radius = self.ratio * (self.sizes[row] + most[to])
            asks = ~held | (~outer & ~cross & (side == 1))
            asks &= high[to] >= 0
            room = asks & (far - high[to] <= radius) & (low[to] - far <= radius)
            self.pruned += int(asks.sum() - room.sum())
            g = np.flatnonzero(room)
            parts.append((row[g], to[g], np.zeros(len(g), bool), cross[g]))
        return tuple(np.concatenate(x) for x in zip(*parts))


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by the named columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(n).to_numpy() for n in names]
        if held:
            last = held[-1]
            same = all(last.column(n)[-1].as_py() == c[0] for n, c in zip(names, cols))
            ends = not same or any(c[0] != c[-1] for c in cols)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
            elif ends:
                stop = int(np.argmax(np.any([c != c[0] for c in cols], axis=0)))
                yield pa.Table.from_batches([*held, b.slice(0, stop)])
                held, b = [], b.slice(stop)
                cols = [c[stop:] for c in cols]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows > 1 else []
        if len(change) and not held:
            yield pa.Table.from_batches([b.slice(0, int(change[-1]))])
            b = b.slice(int(change[-1]))
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


class Work:
    """What tasks do with batches of records; counts is the broadcast of known words and shingles with their log counts."""

    def __init__(self, s: Settings, seed: int = 0, counts=None):
        self.s, self.seed, self.counts = s, seed, counts

    def survey(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 2: a record that counts, with the key of its words, its number of shingles and their fingerprint; 1: one that doesn't; 0: a word and its records in these
        batches; 3: a shingle that several records of these batches have, with their number."""
        sh = Shingler(self.s.span, self.seed)
        words: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0
        for b in batches:
            kinds, keys, checks, sizes, prints = [], [], [], [], []
            for numbers in sh.texts(b.column("text").to_pylist()):
                w = sh.hash[numbers]
                counts = len(w) >= self.s.least_words
                kinds.append(2 if counts else 1)
                keys.append(sh.key(w))
                checks.append(sh.check(w))
                sizes.append(None)
                prints.append(None)
                if counts:
                    words.append(np.unique(w))
                    sets.append(sh.shingles(w)[0])
                    held += len(w)
                    sizes[-1], prints[-1] = len(sets[-1]), fold(sets[-1])
                if held > COUNTED_TOGETHER:
                    yield self._counts(words, sets)
                    words, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), b.column("id"), b.column("version"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(checks, np.uint64).view(np.int64)), pa.array(np.zeros(len(keys), np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())], SURVEYED)
        yield self._counts(words, sets)

    @staticmethod
    def _counts(words: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        none = np.zeros(0, np.uint64)
        w, n = np.unique(np.concatenate([none, *words]), return_counts=True)
        h, m = np.unique(np.concatenate([none, *sets]), return_counts=True)
        h, m = h[m >= OFTEN], m[m >= OFTEN]
        size = len(w) + len(h)
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([0, 3], np.int32), [len(w), len(h)])), pa.nulls(size, pa.string()), pa.nulls(size, pa.int32()),
            pa.array(np.concatenate([w, h]).view(np.int64)), pa.nulls(size, pa.int64()), pa.array(np.concatenate([n, m])), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], SURVEYED)

    def _sets(self, batches: Iterator[pa.RecordBatch], counts: Known | None = None) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
        """Of each batch the keys, words' weights (if counts are given), shingles and shingles' places of the texts that count."""
        sh = Shingler(self.s.span, self.seed, counts)
        for b in batches:
            keys, weights, sets, places = [], [], [], []
            for numbers in sh.texts(b.column("text").to_pylist()):
                if len(numbers) >= self.s.least_words:
                    w = sh.hash[numbers]
                    h, at = sh.shingles(w)
                    keys.append(sh.key(w))
                    sets.append(h)
                    places.append(at)
                    if counts is not None:
                        weights.append(sh.weight[numbers])
            yield keys, weights, sets, places

    def prefixes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, salt, key): each text under the rarest of its shingles; the last bit of shard is 0 for rows that may be the smaller text
        of a pair, 1 for those that can only be the larger. Shingles that are known to be in more texts than a tile holds are
        salted, so that no task gets all their texts; salt is -1 for all others.

        Two sets with a Jaccard index of at least t share a member among the first n - ceil(t n) + 1 of each, in any order that
        is the same for all; here that of the reported counts of shingles, then those of their words. So no pair is lost,
        however the order came about. Of the smaller text, n - ceil(2t / (1 + t) n) + 1 of n are enough.
        """
        t = self.s.threshold
        words_known, sets_known = (Known(*x) for x in self.counts.value)
        for keys, weights, sets, places in self._sets(batches, words_known):
            shards, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
            every = sets_known.logs_of(np.concatenate([np.zeros(0, np.uint64), *sets]))
            end = 0
            for weight, h, at in zip(weights, sets, places):
                known, end = every[end : end + len(h)], end + len(h)
                sums = sum(weight[at + k] for k in range(self.s.span))
                take = len(h) - int(np.ceil(t * len(h) - 1e-9)) + 1
                small = len(h) - int(np.ceil(2 * t / (1 + t) * len(h) - 1e-9)) + 1
                order = np.lexsort((h, np.round(sums, 2), known))[:take]
                shards.append(h[order] & ~np.uint64(1) | (np.arange(take) >= small).astype(np.uint64))
                often.append(known[order])
            key = np.repeat(np.array(keys, np.uint64).view(np.int64), [len(x) for x in shards[1:]])
            texts = np.exp(np.concatenate(often).astype(np.float64))
            parts = np.where(texts > self.s.tile, np.ceil(1.25 * texts / self.s.tile), 1).astype(np.int64)
            salt = np.where(parts > 1, (key ^ key >> 32) % parts, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards).view(np.int64)), pa.array(salt), pa.array(key)], ["shard", "salt", "key"])

    def shared(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, key, larger, tile) of the shards with more than one text, one of which may be the smaller of a pair; of salted shards all.

        The partition is sorted by shard (without its last bit), salt, shard and key, so such a text comes first in its shard.
        """
        last: tuple | None = None  # shard, salt, key, place in the shard, whether the shard counts; not yet given out

        def out(shard, salt, key, place) -> pa.RecordBatch:
            # the first piece of a salt is the tile of that number; what a salt has beyond a tile comes after all salts
            piece = place // self.s.tile
            tile = np.where(salt < 0, piece, salt + (piece << 20))
            return pa.RecordBatch.from_arrays([pa.array(shard >> 1), pa.array(key), pa.array((shard & 1).astype(bool)), pa.array(tile.astype(np.int32))], ["shard", "key", "larger", "tile"])

        for b in batches:
            shard, salt, key = (b.column(c).to_numpy() for c in ("shard", "salt", "key"))
            fresh = np.ones(len(shard), bool)
            fresh[1:] = (shard[1:] != shard[:-1]) | (key[1:] != key[:-1])
            if last is not None and len(shard):
                fresh[0] = (shard[0], key[0]) != (last[0], last[2])
            shard, salt, key = shard[fresh], salt[fresh], key[fresh]
            if not len(shard):
                continue
            base, counts = 0, False
            if last is not None:
                shard, salt, key, base, counts = np.insert(shard, 0, last[0]), np.insert(salt, 0, last[1]), np.insert(key, 0, last[2]), last[3], last[4]
            group = shard >> 1
            first = np.ones(len(shard), bool)
            first[1:] = (group[1:] != group[:-1]) | (salt[1:] != salt[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(shard)), 0))
            place = np.arange(len(shard)) - start + np.where(start == 0, base, 0)
            good = (shard[start] & 1) == 0
            if last is not None:
                good = np.where(start == 0, counts, good)
            salted = salt >= 0
            more = (np.append(~first[1:], False) | (place > 0)) & good | salted
            last = (shard[-1], salt[-1], key[-1], int(place[-1]), bool(good[-1]))
            more[-1] = False
            yield out(shard[more], salt[more], key[more], place[more])
        if last is not None and ((last[3] > 0 and last[4]) or last[1] >= 0):
            yield out(*(np.array([last[i]]) for i in (0, 1, 2, 3)))

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each shard (and pair of its tiles) whose fingerprints are near enough, by a vantage-point tree each; sorted by
        shard, low, high. Texts that may be the smaller of a pair are held by the tree, the others are guests."""
        for g in _groups(batches, "shard", "low", "high"):
            key = g.column("key").to_numpy()
            a, b = self.candidates(g)[:2]
            a, b = np.minimum(key[a], key[b]), np.maximum(key[a], key[b])
            both = np.unique(np.stack([a, b])[:, a != b], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def candidates(self, g: pa.Table) -> tuple[np.ndarray, np.ndarray, Forest]:
        """(a, b, forest): pairs of rows of whole shards or pairs of tiles that the trees and then the wide fingerprints let pass."""
        t = self.s.threshold
        ratio = (1 - t) / (1 + t) + 1e-9
        size, tile, larger, shard, low, high = (g.column(c).to_numpy() for c in ("size", "tile", "larger", "shard", "low", "high"))
        prints = Prints(g.column("print").to_pylist())
        fresh = np.ones(len(size), bool)
        fresh[1:] = (shard[1:] != shard[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        tree = 2 * (np.cumsum(fresh) - 1)
        within, mine = low == high, tile == low
        # two tiles: the small texts of the first with all of the second, then those of the second with the larger of the first
        one = np.flatnonzero(within | ~mine | ~larger)
        two = np.flatnonzero(~within & (mine == larger))
        row = np.concatenate([one, two])
        first = np.arange(len(row)) < len(one)
        held = np.where(first, ~larger[row] & (within[row] | mine[row]), ~larger[row])
        forest = Forest(prints.short, size, ratio)
        a, b = forest.pairs(row, tree[row] + ~first, held, ~within[row])
        ok = prints.near(a, b, ratio * (size[a] + size[b]))
        return a[ok], b[ok], forest

    def hashes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, sets, _ in self._sets(batches):
            ends = np.concatenate([[0], np.cumsum([len(h) for h in sets], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "set"])


class NearDuplicates:
    """All steps over one table of records (id, version, text); see pairs() and members."""

    def __init__(self, rows: DataFrame, s: Settings = Settings()):
        self.rows, self.s = rows, s
        seed = 0
        while True:  # another seed if two texts have one key
            self.work = Work(s, seed)
            survey = cut(rows.mapInArrow(self.work.survey, "kind int, id string, version int, key long, check long, n long, size int, print binary"))
            ids = survey.filter("kind in (1, 2)").groupBy("id").agg(F.max(F.struct("version", "key", "kind", "check")).alias("c"), F.count("*").alias("n"))
            ids = cut(ids.select("id", "n", "c.*"))
            #: (id, key): every record that counts, with its text's key; equal keys are exact copies.
            self.members = ids.filter("kind = 2").select("id", "key")
            self.reps = cut(ids.filter("kind = 2").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), (F.min("check") != F.max("check")).alias("mixed")))
            if self.reps.filter("mixed").isEmpty():
                break
            seed += 1
        #: (key, size, print) of every text that counts.
        self.prints = survey.filter("kind = 2").select("key", "size", "print").dropDuplicates(["key"])
        copies = self.members.join(self.reps.filter("copies > 1").select("key"), "key", "left_semi").join(self.reps.select("id"), "id", "left_anti")
        lookup = (
            ids.filter("n > 1").select("id", F.col("version").alias("only")).join(copies.select("id"), "id", "left_anti")
            .unionByName(copies.select("id", F.lit(None).cast("int").alias("only"))).withColumn("listed", F.lit(True)))
        #: (id, text) of one row per distinct text, but for rows delivered twice; only superseded rows and copies need the lookup.
        self.texts = rows.join(broadcast_if_small(cut(lookup), 400_000), "id", "left").filter("listed is null or only = version").select("id", "text")
        self.work = Work(s, seed, rows.sparkSession.sparkContext.broadcast((self._logs(survey, 0), self._logs(survey, 3))))

    @staticmethod
    def _logs(survey: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent words or shingles, sorted, and the logs of their counts over all records."""
        t = survey.filter(F.col("kind") == kind).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "key").limit(SENT).toArrow()
        names = t.column("key").to_numpy().view(np.uint64)
        order = np.argsort(names)
        return names[order], np.log(t.column("n").to_numpy()[order]).astype(np.float32)

    def placed(self) -> DataFrame:
        """The rows of all shards, each pair of tiles of a long shard on its own, with their fingerprints; sorted for Work.meet."""
        shard = F.shiftright("shard", 1)
        shards = cut(
            self.texts.mapInArrow(self.work.prefixes, "shard long, salt int, key long").repartition(shard, "salt").sortWithinPartitions(shard, "salt", "shard", "key")
            .mapInArrow(self.work.shared, "shard long, key long, larger boolean, tile int"))
        long = cut(shards.filter("tile > 0").groupBy("shard").agg(F.collect_set("tile").alias("tiles")))  # tile numbers, not texts
        rows = shards.withColumns({"low": F.lit(0), "high": F.lit(0)})
        if not long.isEmpty():  # each pair of tiles of a long shard is a task of its own
            tiles = F.coalesce(F.array_union("tiles", F.array(F.lit(0))), F.array(F.lit(0)))
            other = F.explode(tiles)
            rows = shards.join(broadcast_if_small(long), "shard", "left").withColumn("other", other).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "other")
        return (
            rows.join(self.prints, "key").repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high")
            .select("shard", "low", "high", "tile", "larger", "key", "size", "print"))

    def links(self) -> DataFrame:
        """(a, b): pairs of keys of different texts whose Jaccard index is at least the threshold, exactly."""
        met = self.placed().mapInArrow(self.work.meet, "a long, b long")
        near = cut(met.distinct())
        wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(self.reps, "key").select("id")
        sets = self.texts.join(broadcast_if_small(cut(wanted), 400_000), "id").mapInArrow(self.work.hashes, "key long, set array<bigint>").dropDuplicates(["key"])
        both = near.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.filter(common >= (F.size("x") + F.size("y") - common) * self.s.threshold - 1e-9).select("a", "b")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of records at or above the threshold, exact copies included."""
        m = self.members
        across = cut(self.links()).join(m.select(F.col("key").alias("a"), F.col("id").alias("i")), "a").join(m.select(F.col("key").alias("b"), F.col("id").alias("j")), "b").select("i", "j")
        more = m.join(self.reps.filter("copies > 1").select("key"), "key", "left_semi")
        within = more.select("key", F.col("id").alias("i")).join(more.select("key", F.col("id").alias("j")), "key").filter("i < j").select("i", "j")
        return across.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): the connected records of each record, named by the least id, and the number of other
        texts it is linked to directly. Records without a link form groups of their own or of their exact copies."""
        links = cut(self.links())
        both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        label = cut(self.reps.select("key", F.col("id").alias("group_id")))
        while True:  # the least name of the neighbours, then the name that this name has got itself
            heard = both.join(label.select(F.col("key").alias("b"), "group_id"), "b").groupBy("a").agg(F.min("group_id").alias("g"))
            step = label.join(heard, label.key == heard.a, "left").select("key", F.least("group_id", F.coalesce("g", "group_id")).alias("group_id"))
            named = self.reps.select(F.col("id").alias("group_id"), F.col("key").alias("k")).join(label.select(F.col("key").alias("k"), F.col("group_id").alias("up")), "k").select("group_id", "up")
            new = cut(step.join(named, "group_id", "left").select("key", F.least("group_id", F.coalesce("up", "group_id")).alias("group_id")))
            if new.join(label.withColumnRenamed("group_id", "old"), "key").filter("group_id <> old").isEmpty():
                break
            label = new
        n = both.groupBy("a").agg(F.count("*").alias("n"))
        return (
            self.members.join(label, "key").join(n, F.col("key") == F.col("a"), "left")
            .select("id", "group_id", F.coalesce("n", F.lit(0)).alias("n_links")))
