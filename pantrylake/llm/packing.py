"""Packing documents into fixed windows under a token mixture, dealt to source queues by exact proportions.

The ids of all queues form one stream that is cut into windows. A binary tree over the queues deals the stream: of the
first m ids that reach a node, its left half gets floor((m * left weight + carry) / weight), in integers, so every count
is known in closed form, never falls, and stays within an id a level of its exact share, however small the share is.
Every partition cuts its own documents without hearing from the others. When a queue runs out, its weight becomes 0: the
nodes on its path get a new version from that id on, which takes over the deficit (the carry), and all other nodes stay
as they are. So the schedule of n queues takes n log n numbers. All windows but the last are full.

Documents are encoded once into a staged table; its tasks number their rows, so a document's place in its queue is the
queue's sum over earlier tasks plus its place within the task. Only sums by (queue, task) are shuffled.

Defined cases: a null text counts as empty and is just its end id; a null source is a queue of its own; repeated rows
are packed as often as they come; every source has its own queue, and the driver holds one total for each; an empty
table gives no rows. A control string of the vocabulary in a text becomes its id, as the tokenizers library has it
(controls=False: ordinary text). Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import inf, lcm
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, map_arrow, staged

LENGTH, END, PERIOD = 2048, 1, 32
#: op2's target: a source's weight is its share of the ids to this power, so that small sources come more often at first.
TEMPER = 0.7
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file lies on this machine (it is never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queued(docs: DataFrame) -> DataFrame:
    """(doc_id, queue, text): queue is the source after "=", or "" for a null."""
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.col("text").cast("string").alias("text"))


def _encoded(vocabulary: str, controls: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .pieces import encoder, slices, text_bytes

        tool = encoder(vocabulary_path(vocabulary), "word", controls)
        part, seen = TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            data, edges = text_bytes(batch.column("text"))
            ids, counts = tool.encode(data, edges)
            full = counts + 1
            ends = np.cumsum(full)
            out = np.empty(int(ends[-1]) if len(ends) else 0, f"<u{tool.width}")
            is_end = np.zeros(len(out), bool)
            is_end[ends - 1] = True
            out[is_end], out[~is_end] = END, ids
            within = []
            for queue, n in zip(batch.column("queue").to_pylist(), full.tolist()):
                within.append(seen.get(queue, 0))
                seen[queue] = within[-1] + n
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(np.concatenate([[0], tool.width * ends]).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), pa.array(np.full(len(full), part, np.int32)), pa.array(within, pa.int64()), pa.array(full), packed],
                ["doc_id", "queue", "part", "within", "n", "ids"],
            )

    return run


class Tree:
    """Deals a stream to leaves in proportion to their weights. Node k has the halves 2k and 2k + 1; leaves come last.

    A version of a node: the ids that had reached it and its left half when the version began, the weights of its left
    half and of itself, and the left half's deficit then.
    """

    def __init__(self, weights: list[int]):
        self.size = 1 << max(0, len(weights) - 1).bit_length()
        weight = [0] * self.size + list(weights) + [0] * (self.size - len(weights))
        for k in range(self.size - 1, 0, -1):
            weight[k] = weight[2 * k] + weight[2 * k + 1]
        # half an id to begin with, so that counts are rounded and not cut
        self.versions = [[]] + [[(0, 0, weight[2 * k], weight[k], weight[k] // 2)] for k in range(1, self.size)]

    def _left(self, k: int, m: int) -> int:
        found = self.versions[k]
        at, left, own, whole, carry = found[0] if len(found) == 1 else found[bisect_right(found, m, key=itemgetter(0)) - 1]
        return left + ((m - at) * own + carry) // whole if whole else left

    def served(self, leaf: int, m: int) -> tuple[int, int]:
        """Of the first m ids: how many go to the leaf, and how many to those before it."""
        before, k, bit = 0, 1, self.size >> 1
        while bit:
            left = self._left(k, m)
            if leaf & bit:
                before, m, k = before + left, m - left, 2 * k + 1
            else:
                m, k = left, 2 * k
            bit >>= 1
        return m, before

    def counts(self, m: int) -> list[int]:
        """What each leaf has of the first m ids."""
        at = [0, m] + [0] * (2 * self.size - 2)
        for k in range(1, self.size):
            at[2 * k] = self._left(k, at[k])
            at[2 * k + 1] = at[k] - at[2 * k]
        return at[self.size :]

    @staticmethod
    def _up(version: tuple, right: bool, j: int) -> int:
        """Where in a node's stream the id j of one of its halves is, under a version that it falls in."""
        at, left, own, whole, carry = version
        if right:  # the least m with m - floor((m * own + carry) / whole) > j, less one
            return at + ((j - (at - left)) * whole + carry) // (whole - own)
        return at - (-((j - left + 1) * whole - carry) // own) - 1

    def place(self, leaf: int, j: int) -> int:
        """Where in the stream the leaf's id j is (both from 0)."""
        k = self.size + leaf
        while k > 1:
            right, k = bool(k & 1), k >> 1
            found = self.versions[k]
            begun = (lambda v: v[0] - v[1]) if right else itemgetter(1)
            j = self._up(found[0] if len(found) == 1 else found[bisect_right(found, j, key=begun) - 1], right, j)
        return j

    def retire(self, leaf: int, m: int, weight: int) -> None:
        """After the first m ids the leaf gets no more. The deficits on its path go on."""
        k, bit = 1, self.size >> 1
        while bit:
            at, left, own, whole, carry = self.versions[k][-1]
            done, rest = divmod((m - at) * own + carry, whole)
            now = left + done
            new_own, new_whole = (own if leaf & bit else own - weight), whole - weight
            self.versions[k].append((m, now, new_own, new_whole, rest * new_whole // whole))
            m, k = (m - now, 2 * k + 1) if leaf & bit else (now, 2 * k)
            bit >>= 1

    def run_out(self, totals: list[int], weights: list[int]) -> None:
        """Retire each leaf at the first id that it no longer has: a tournament, whose paths alone are played again."""
        never = (inf, -1)
        first = [never] * self.size + [(n, i) if w else never for i, (n, w) in enumerate(zip(totals, weights))]
        first += [never] * (2 * self.size - len(first))

        def play(k: int) -> None:
            version, halves = self.versions[k][-1], []
            for right in (False, True):
                j, leaf = first[2 * k + right]
                halves.append((self._up(version, right, j), leaf) if leaf >= 0 else never)
            first[k] = min(halves)

        for k in range(self.size - 1, 0, -1):
            play(k)
        end = sum(n for n, w in zip(totals, weights) if w)
        while first[1][1] >= 0 and first[1][0] < end:
            at, leaf = first[1]
            self.retire(leaf, at, weights[leaf])
            k = self.size + leaf
            first[k] = never
            while k > 1:
                k >>= 1
                play(k)


@dataclass
class Group:
    """The stream from id `first` to id `last`, dealt to some queues."""

    first: int
    last: int
    length: int
    tree: Tree
    queues: list[int]

    @property
    def served(self) -> list[list[int]]:
        """By window (the first PERIOD whole ones from the group's start), then queue of the group: ids served."""
        steps = range(min(PERIOD, (self.last - self.first) // self.length) + 1)
        cum = [self.tree.counts(i * self.length)[: len(self.queues)] for i in steps]
        return [[y - x for x, y in zip(a, b)] for a, b in zip(cum, cum[1:])]


#: Weights are scaled to at least so many units in all, so that a carry is cut by less than 2**-64 of an id.
UNITS = 1 << 64


def schedule(totals: list[int], weights: list[float] | None = None, length: int = LENGTH) -> list[Group]:
    """Groups that serve all queues' ids. weights: target proportions (default: so that all queues end together).

    Queues without a positive weight come after all others, and then end together.
    """
    weighted = [i for i, n in enumerate(totals) if n and weights and weights[i] > 0]
    chosen = set(weighted)
    rest = [i for i, n in enumerate(totals) if n and i not in chosen]
    groups, first = [], 0
    for queues, share in ((weighted, weights), (rest, totals)):
        if not queues:
            continue
        exact = [Fraction(share[i]) for i in queues]
        unit = lcm(*[x.denominator for x in exact])
        whole = [int(x * unit) for x in exact]
        if share is not totals and sum(whole) < UNITS:
            whole = [x * (UNITS // sum(whole) + 1) for x in whole]
        own = [totals[i] for i in queues]
        tree = Tree(whole)
        if share is not totals:
            tree.run_out(own, whole)
        groups.append(Group(first, first + sum(own), length, tree, queues))
        first += sum(own)
    return groups


class Cutter:
    """Cuts ranges of a queue into pieces of windows; within a window, pieces are in the order of groups and queues."""

    def __init__(self, groups: list[Group]):
        self.groups = groups
        self.end = groups[-1].last if groups else 0
        self.of = {queue: (g, leaf) for g in groups for leaf, queue in enumerate(g.queues)}

    @staticmethod
    def _served(group: Group, leaf: int, r: int) -> tuple[int, int]:
        """Of the first r ids of the stream: how many the queue has, and how many those before it in a window."""
        mine, before = group.tree.served(leaf, min(max(r, group.first), group.last) - group.first)
        return mine, min(r, group.first) + before

    def cut(self, queue: int, start: int, end: int):
        """(position, length, window, offset) of the pieces of [start, end), as arrays."""
        import numpy as np

        group, leaf = self.of[queue]
        length, out = group.length, []
        window = (group.first + group.tree.place(leaf, start)) // length
        begun, ahead = self._served(group, leaf, window * length)
        while True:
            upto, ahead_after = self._served(group, leaf, min((window + 1) * length, self.end))
            to = min(end, upto)
            if to > start:
                out.append((start, to - start, window, ahead_after - ahead + start - begun))
                start = to
            if start >= end:
                break
            if upto - begun <= 1:  # a rare queue: go on where its next id is
                window = (group.first + group.tree.place(leaf, start)) // length
                begun, ahead = self._served(group, leaf, window * length)
            else:
                window, begun, ahead = window + 1, upto, ahead_after
        return list(np.array(out, np.int64).reshape(-1, 4).T)


def _pieces(shared):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from .pieces import slices

        cutter, queues = shared.value
        for batch in slices(batches, "ids", 1 << 20):  # a piece is seven numbers, made as Python's first
            cols = {k: batch.column(k).to_pylist() for k in ("doc_id", "queue", "start", "n")}
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for row, ids in enumerate(batch.column("ids")):
                begin, n = cols["start"][row], cols["n"][row]
                at, size, window, offset = cutter.cut(queues[cols["queue"][row]], begin, begin + n)
                raw = ids.as_buffer()
                wide = memoryview(np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4").tobytes())
                at = (at - begin).tolist()
                size = size.tolist()
                out["ids_crc32"] += [zlib.crc32(wide[4 * i : 4 * (i + k)]) for i, k in zip(at, size)]
                out["doc_id"] += [cols["doc_id"][row]] * len(at)
                out["doc_tokens"] += [n] * len(at)
                out["start"] += at
                out["length"] += size
                out["sequence_id"] += window.tolist()
                out["offset"] += offset.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return run


def pack(docs: DataFrame, weights: dict[str | None, float] | float | None = None, vocabulary: str = VOCABULARY, controls: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    weights: target proportions by source (None for a null source), where sources that it leaves out come last; or a
    number, the power of their share of the ids; or nothing, so that all sources end together.
    """
    spark = docs.sparkSession
    encoded = staged(map_arrow(queued(docs), _encoded(vocabulary, controls), "doc_id long, queue string, part int, within long, n long, ids binary"), "encoded")
    sums = encoded.groupBy("queue", "part").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))), "queues")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("sum").alias("n")).collect()}  # a row for each source
    names = sorted(totals)
    if isinstance(weights, dict):
        stated = {"" if k is None else f"={k}": float(v) for k, v in weights.items()}
        target = [stated.get(q, 0.0) for q in names]
    else:
        target = [totals[q] ** weights for q in names] if weights is not None else None
    cutter = Cutter(schedule([totals[q] for q in names], target))
    shared = spark.sparkContext.broadcast((cutter, {q: i for i, q in enumerate(names)}))
    placed = encoded.join(checked_broadcast(sums.select("queue", "part", "before")), ["queue", "part"])
    placed = placed.select("doc_id", "queue", (F.col("before") + F.col("within")).alias("start"), "n", "ids")
    return map_arrow(placed, _pieces(shared), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2(docs: DataFrame) -> DataFrame:
    return pack(docs, TEMPER)
