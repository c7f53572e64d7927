"""Best-fit packing of documents into sequences of a fixed token capacity.

Tokenizing and placing run in Spark; the driver sees two histograms only,
of piece lengths and of the room left in sequences, each at most as long as
the capacity, and returns plans of bounded size.

Large pieces follow a linear grouping scheme: sorted by length, they are cut
into groups of equal cardinality and counted as long as their group's
longest; few sizes remain, for which configurations (how many of each size
one sequence holds) are chosen to fill the capacity, the largest piece
first.  Actual documents then take the slots of their group, which leaves
room.  Small pieces go best-fit, longest first, into the sequence with the
least room that holds them, and open sequences of their own at the end.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, stored

CAPACITY, END, GROUPS, SMALL = 4096, 1, 1024, 256
VOCABULARY = "word_bpe_49k.json"
SPACE = re.compile(r"[ \n\t\r]+")
#: White space at which str.split cuts and the words here end not.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word of Latin letters and the marks behind it.  The vocabulary splits it
#: there too, and reads capitals as small letters; U+0130 is not among the
#: letters, as its small form is two characters.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?%$#&*()]*)")


class Ids(dict):
    """word -> number of an entry that holds its ids.

    The vocabulary drops white space and never joins across it, so words are
    encoded once and remembered up to a bound.  A word not yet seen is put
    together from its letters and its marks; letters that are new are encoded
    many at a time, for each ends with a token that ends a word."""

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model, self.most = Tokenizer.from_file(path), most
        ends = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.parts: dict[str, np.ndarray] = {}
        self.new: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self._add([np.array([END], np.uint32)], [1])  # entry 0: what ends a text

    def _add(self, ids: list[np.ndarray], sizes: list[int]) -> None:
        """New entries of so many ids each."""
        both, size = np.concatenate(ids), np.array(sizes, np.int64)
        begin = self.used + np.cumsum(size) - size
        while self.used + len(both) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(size) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used:self.used + len(both)] = both
        self.begin[self.known:self.known + len(size)] = begin
        self.size[self.known:self.known + len(size)] = size
        self.used, self.known = self.used + len(both), self.known + len(size)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = self.known + len(self.new) - 1
        return n

    def _encode(self, word: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([word], add_special_tokens=False)[0].ids if word else [], np.uint32)

    def _learn(self) -> None:
        """Entries of the words that are new."""
        plain = [PLAIN.fullmatch(w) for w in self.new]
        ask = list({m[1].lower() for m in plain if m} - self.parts.keys())
        ids = self._encode(" ".join(ask))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(ask) and (len(ids) == 0 or cuts[-1] == len(ids)):
            self.parts.update(zip(ask, np.split(ids, cuts[:-1])))
        else:
            self.parts.update((w, self._encode(w)) for w in ask)
        ids, sizes = [], []
        for word, m in zip(self.new, plain):
            found = self._encode(word) if not m else self.parts[m[1].lower()]
            ids.append(found)
            sizes.append(len(found))
            if m and m[2]:
                marks = self.parts.get(m[2])
                if marks is None:
                    marks = self.parts[m[2]] = self._encode(m[2])
                ids.append(marks)
                sizes[-1] += len(marks)
        if ids:
            self._add(ids, sizes)
        self.new = []

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each ended by END, and the bounds of each."""
        if self.known > self.most or self.used > 8 * self.most:
            self.forget()
        words = [SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in (t or "" for t in texts)]
        number = np.fromiter(chain.from_iterable(chain(map(self.__getitem__, ws), (0,)) for ws in words), np.int64)
        self._learn()
        size = self.size[number]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[number] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        texts_end = end[np.cumsum([len(ws) + 1 for ws in words]) - 1] if words else end
        return ids, np.concatenate([[0], texts_end])


@cache
def shared_ids(path: str) -> Ids:
    """One for all tasks that a worker process runs."""
    return Ids(path)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, path: str | None, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and two numbers that count
    pieces of one length within the task.  Without ``path`` each task looks up
    where its machine has the vocabulary."""

    def start():
        return {"ids": shared_ids(path or tokenizer_path()), "seen": np.zeros(capacity + 1, np.int64),
                "part": TaskContext.get().partitionId()}

    def fn(batch, s):
        row, number, begin, size, crc, nth = [], [], [], [], [], []
        every, bounds = s["ids"].of(batch.column("text").to_pylist())
        every = every.astype("<u4")
        for i, (first, last) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            for n, at in enumerate(range(first, last, capacity)):
                cut = every[at:min(at + capacity, last)]
                row.append(i)
                number.append(n)
                begin.append(at - first)
                size.append(len(cut))
                crc.append(zlib.crc32(cut))
                nth.append(s["seen"][len(cut)])
                s["seen"][len(cut)] += 1
        return [batch.column("doc_id").take(pa.array(row)), number, begin, size, crc,
                np.full(len(row), s["part"]), nth]

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn,
                     "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long",
                     slice_rows=256, start=start)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``rank`` among the rows of equal ``key``, from the counts per task:
    no task sees all rows of a key.  df is stored and has part and nth."""
    base = (df.groupBy(key, "part").agg(F.count("*").alias("n"))
            .withColumn("base", F.sum("n").over(Window.partitionBy(key).orderBy("part")) - F.col("n")))
    return (df.join(base.select(key, "part", "base"), [key, "part"])
            .withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base"))


def _histogram(df: DataFrame, key: str, capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    for k, n in df.groupBy(key).count().collect():   # at most capacity + 1 rows
        out[k] = n
    return out


def fill(room: int, sizes: np.ndarray) -> list[int]:
    """Indexes into ``sizes`` (ascending) of up to three that fill room best,
    fewer items first on ties; more where four of the smallest fit."""
    out = []
    while len(sizes) and sizes[0] <= room:
        usable = sizes[:np.searchsorted(sizes, room, "right")]
        if 4 * sizes[0] <= room and room > 2 * usable[-1]:
            out.append(len(usable) - 1)
            room -= int(usable[-1])
            continue
        one = len(usable) - 1
        best, pick = int(usable[one]), [one]
        if best < room:
            j = np.searchsorted(usable, room - usable, "right") - 1
            two = np.where(j >= 0, usable + usable[np.maximum(j, 0)], 0)
            a = int(two.argmax())
            if two[a] > best:
                best, pick = int(two[a]), [a, int(j[a])]
        if best < room and 3 * usable[0] <= room:
            # First items in even steps bound the table; the other two are free.
            some = np.arange(len(usable))[::-(-(-len(usable) // 200))]
            pair = usable[some][:, None] + usable[None, :]
            j = np.searchsorted(usable, room - pair, "right") - 1
            three = np.where(j >= 0, pair + usable[np.maximum(j, 0)], 0)
            a, b = np.unravel_index(int(three.argmax()), three.shape)
            if three[a, b] > best:
                best, pick = int(three[a, b]), [int(some[a]), int(b), int(j[a, b])]
        out += pick
        break
    return out


def longest(room: int, sizes: np.ndarray) -> list[int]:
    """The index of the largest size that fits, if any."""
    return [int(np.searchsorted(sizes, room, "right")) - 1] if len(sizes) and sizes[0] <= room else []


def plan_large(counts: np.ndarray, capacity: int, groups: int, small: int):
    """The plan of fewer sequences of two ways to choose configurations."""
    return min((_plan_large(counts, capacity, groups, small, f) for f in (fill, longest)), key=lambda p: p[1])


def _plan_large(counts: np.ndarray, capacity: int, groups: int, small: int, choose):
    """(runs, sequences): large pieces in descending order of length, from
    number ``first`` on, ``per`` of them to each of successive sequences from
    ``sequence`` on, in places from ``slot`` on.  Columns first, sequence,
    per, slot."""
    lengths = np.arange(capacity, small, -1)
    count = counts[lengths]
    total = int(count.sum())
    if not total:
        return np.empty((0, 4), np.int64), 0
    ends = np.cumsum(count)
    step = -(-total // groups)
    begin = np.arange(0, total, step)
    size = lengths[np.searchsorted(ends, begin, "right")]          # each group's longest
    left = np.minimum(step, total - begin)
    taken = np.zeros(len(begin), np.int64)
    runs, sequence = [], 0
    for g in range(len(begin)):
        while left[g] > 0:
            use, room = {g: 1}, capacity - int(size[g])
            spare = left.copy()
            spare[g] -= 1
            while True:
                have = np.flatnonzero(spare > 0)[::-1]     # ascending sizes
                picks = choose(room, size[have])
                if not picks:
                    break
                for k in have[picks].tolist():
                    if spare[k]:
                        spare[k] -= 1
                        room -= int(size[k])
                        use[k] = use.get(k, 0) + 1
            times = min(int(left[k]) // n for k, n in use.items())
            slot = 0
            for k, n in sorted(use.items()):
                runs.append((int(begin[k] + taken[k]), sequence, n, slot))
                taken[k] += n * times
                left[k] -= n * times
                slot += n
            sequence += times
    return np.array(sorted(runs), np.int64), sequence


def plan_small(counts: np.ndarray, room: np.ndarray, capacity: int, small: int) -> np.ndarray:
    """Best fit on histograms.  Rows (length, first, room, bin, per, offset):
    the small pieces of a length from number ``first`` on go, ``per`` to
    each, to the sequences that had ``room`` left, from number ``bin`` on; room
    capacity + 1 means new sequences."""
    now: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]   # (room at first, bin, how many)
    for r in np.flatnonzero(room):
        now[r].append((int(r), 0, int(room[r])))
    new, out = 0, []
    for size in range(small, 0, -1):
        left, first = int(counts[size]), 0
        while left:
            r = next((r for r in range(size, capacity + 1) if now[r]), None)
            if r is None:
                r, per = capacity, capacity // size
                have = -(-left // per)
                now[capacity].append((capacity + 1, new, have))
                new += have
            origin, at, have = now[r].pop()
            per = r // size
            full = min(have, left // per)
            if full:
                out.append((size, first, origin, at, per, capacity - r))
                now[r - per * size].append((origin, at, full))
                if full < have:
                    now[r].append((origin, at + full, have - full))
                left -= full * per
                first += full * per
            else:
                out.append((size, first, origin, at, left, capacity - r))
                now[r - left * size].append((origin, at, 1))
                if have > 1:
                    now[r].append((origin, at + 1, have - 1))
                first += left
                left = 0
    return np.array(out, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS,
         small: int = SMALL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Null and empty texts are the end id alone.  Only documents longer than
    the capacity are cut.  Repeated rows, and null ids, are packed like any
    others; extra columns are ignored; an empty table has no pieces."""
    cut = stored(pieces(docs, path, capacity), "pieces")
    counts = _histogram(cut, "length", capacity)
    rows = ranked(cut, "length")
    runs, n_large = plan_large(counts, capacity, groups, small)
    longer = np.cumsum(counts[::-1])[::-1] - counts        # pieces longer than each length
    firsts = runs[:, 0]

    def place(batch, _):
        number = longer[np.array(batch.column("length"))] + np.array(batch.column("rank"))
        k = np.searchsorted(firsts, number, "right") - 1
        j, per = number - firsts[k], runs[k, 2]
        return [batch.column(c) for c in COLUMNS] + [runs[k, 1] + j // per, runs[k, 3] + j % per]

    large = arrow_map(rows.filter(F.col("length") > small), place, DDL + ", sequence_id long, slot long")
    by_slot = Window.partitionBy("sequence_id").orderBy("slot")
    large = stored(large.withColumn("offset", F.sum("length").over(by_slot) - F.col("length")), "large")
    used = large.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))

    def number(batch, s):
        r, nth = np.array(batch.column("room")), np.empty(batch.num_rows, np.int64)
        for i, x in enumerate(r.tolist()):
            nth[i] = s["seen"][x]
            s["seen"][x] += 1
        return [batch.column("sequence_id"), r, np.full(len(r), s["part"]), nth]

    def start():
        return {"seen": np.zeros(capacity + 1, np.int64), "part": TaskContext.get().partitionId()}

    used = stored(arrow_map(used, number, "sequence_id long, room long, part int, nth long", start=start), "used")
    plan = plan_small(counts, _histogram(used, "room", capacity), capacity, small)
    keys = plan[:, 0] * (1 << 48) + plan[:, 1]             # a length, then the number within it
    order = np.argsort(keys)
    plan, keys = plan[order], keys[order]

    def fit(batch, _):
        size, rank = (np.array(batch.column(c)) for c in ("length", "rank"))
        k = np.searchsorted(keys, size * (1 << 48) + rank, "right") - 1
        j = rank - plan[k, 1]
        return [batch.column(c) for c in COLUMNS] + [
            plan[k, 2], plan[k, 3] + j // plan[k, 4], plan[k, 5] + (j % plan[k, 4]) * size]

    little = arrow_map(rows.filter(F.col("length") <= small), fit,
                       DDL + ", room long, rank long, offset long")
    bins = ranked(used, "room").select("room", "rank", "sequence_id")
    placed = (little.join(bins, ["room", "rank"], "left")
              .withColumn("sequence_id", F.coalesce("sequence_id", F.col("rank") + n_large)))
    out = [*COLUMNS, "sequence_id", "offset"]
    return large.select(out).unionByName(placed.select(out))


DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = [c.split()[0] for c in DDL.split(", ")]
