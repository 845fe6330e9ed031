"""Byte-pair encoding over counted types.

A type is a string of its symbols, each the hex of its bytes in angle brackets, so that a merge is a
plain left-to-right replacement. Of equally frequent pairs the smallest (left, right) wins.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import secrets
import socket
import tempfile
import uuid
import zlib
from contextlib import nullcontext
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of types that one task learns from, and of each shard where it learns from more.
ONE_TASK = 1 << 23


def store(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
    at = f"{base.rstrip('/')}/bpe-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _forget(stored: DataFrame) -> None:
    if files := stored.inputFiles():
        path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def vocabulary(types: DataFrame) -> DataFrame:
    """(token, cnt) -> (token, cnt, sym)."""
    return types.select("token", "cnt", F.regexp_replace(F.hex(F.encode("token", "UTF-8")), "(..)", "<$1>").alias("sym"))


def pairs(vocab: DataFrame) -> DataFrame:
    """(left, right, cnt): neighbours in each type, weighted by its count; overlapping ones all count."""
    s = vocab.select("cnt", F.split("sym", "<").alias("s")).filter("size(s) > 2")  # the first piece is empty, the others end with >
    p = s.select("cnt", F.explode(F.expr("transform(sequence(1, size(s) - 2), i -> struct(s[i] as l, s[i + 1] as r))")).alias("p"))
    p = p.groupBy("p.l", "p.r").agg(F.sum("cnt").alias("cnt"))
    return p.select(F.concat(F.lit("<"), "l").alias("left"), F.concat(F.lit("<"), "r").alias("right"), "cnt")


def best(counted: DataFrame) -> DataFrame:
    return counted.orderBy(F.desc("cnt"), "left", "right").limit(1)


def merged(left: str, right: str) -> str:
    return left[:-1] + right[1:]


def merge(vocab: DataFrame, left: str, right: str) -> DataFrame:
    return vocab.withColumn("sym", F.replace("sym", F.lit(left + right), F.lit(merged(left, right))))


def _passed(left: str, right: str, rank: int, dropout: float, seed: int) -> bool:
    """Whether a pair is passed over in a step: a hash decides, the same wherever it is asked."""
    return zlib.crc32(f"{seed}:{rank}:{left}{right}".encode()) % 65536 < dropout * 65536


SEPARATOR = 256


def _named(merges: list[tuple]) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Merges as numbers of symbols (left, right, new), and each number's symbol: bytes, the separator of types, then others as they come."""
    names = [f"<{b:02X}>" for b in range(256)] + [""]
    ids = {x: i for i, x in enumerate(names)}

    def number(x: str) -> int:
        if x not in ids:
            ids[x] = len(names)
            names.append(x)
        return ids[x]

    return [(number(left), number(right), number(merged(left, right))) for _, left, right, *_ in merges], names


def _filed(a: np.ndarray) -> np.ndarray:
    """The array in a file that goes when nothing holds it any more."""
    with tempfile.TemporaryFile() as f:
        out = np.memmap(f, a.dtype, "w+", shape=a.shape)
    out[:] = a
    return out.view(np.ndarray)


class Shard:
    """Some types in a row, a separator around each. A symbol's number stands at its first byte (at) and at its last (end).
    filed: whether the arrays lie in files of the temporary folder."""

    def __init__(self, tokens: pa.Array, counts: np.ndarray, symbols: int, filed: bool = False):
        tokens = tokens.cast(pa.large_binary())
        _, offsets, data = tokens.buffers()
        offsets = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        lens = np.diff(offsets)
        kind = np.uint16 if symbols < (1 << 16) - 1 else np.int32
        self.dead = np.iinfo(kind).max
        self.starts = offsets - offsets[0] + np.arange(len(offsets))  # of separators, one more than types
        self.at = np.full(int(lens.sum()) + len(offsets), SEPARATOR, kind)
        mask = np.ones(len(self.at), bool)
        mask[self.starts] = False
        self.at[mask] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(self.at) > len(offsets) else 0
        del mask
        self.end = self.at.copy()
        most = int(counts.max(initial=0))
        self.weight = np.repeat(counts.astype(np.uint32 if most < 1 << 32 else np.int64), lens + 1)  # of each place but the last separator
        self.width = np.ones(257, np.int64)
        place = np.int32 if len(self.at) < 1 << 31 else np.int64
        order = np.argsort(self.at, kind="stable").astype(place)
        if filed:
            self.at, self.end, self.weight, order = map(_filed, (self.at, self.end, self.weight, order))
        cuts = np.searchsorted(self.at[order], np.arange(257))
        self.found = {b: [order[cuts[b] : cuts[b + 1]]] for b in np.flatnonzero(np.diff(cuts)).tolist()}

    def pairs(self) -> np.ndarray:
        """Counts of the pairs of bytes, overlapping ones all."""
        out, step = np.zeros(1 << 16), 1 << 22
        for i in range(0, len(self.at) - 1, step):
            a, b, w = self.at[i : i + step], self.at[i + 1 : i + step + 1], self.weight[i : i + step]
            ok = (a[: len(b)] != SEPARATOR) & (b != SEPARATOR)
            out += np.bincount(a[: len(b)][ok].astype(np.int64) << 8 | b[ok], w[: len(b)][ok], 1 << 16)
        return out.astype(np.int64)

    def _standing(self, symbol: int) -> np.ndarray:
        """Where a symbol stands, in order."""
        places = self.found[symbol]
        x = places[0] if len(places) == 1 else np.sort(np.concatenate(places))
        x = x[self.at[x] == symbol]
        self.found[symbol] = [x]
        return x

    def merge(self, left: int, right: int, new: int) -> tuple | None:
        """Merges a pair from left to right. The symbols before the merged pairs and those after them, each with their count, that of
        merged pairs beside each other and that of all; None where there are none."""
        if new >= len(self.width):
            self.width = np.append(self.width, np.zeros(max(1024, new + 1 - len(self.width)), np.int64))
        self.width[new] = self.width[left] + self.width[right]
        if left not in self.found or right not in self.found:
            return None
        wide, at, end = self.width[left], self.at, self.end
        if sum(map(len, self.found[left])) <= sum(map(len, self.found[right])):
            i = self._standing(left)
            i = i[at[i + wide] == right]
        else:
            j = self._standing(right)
            i = j[end[j - 1] == left] - j.dtype.type(wide)
        if left == right and len(i):  # of those that overlap every second one, from the left
            no = np.arange(len(i))
            first = np.append(True, i[1:] != i[:-1] + wide)
            i = i[(no - np.maximum.accumulate(np.where(first, no, 0))) % 2 == 0]
        if not len(i):
            return None
        j = i + i.dtype.type(wide)
        e = j + j.dtype.type(self.width[right])
        beside = e[:-1] == i[1:]
        alone, last = np.append(True, ~beside), np.append(~beside, True)
        w = self.weight[i].astype(np.float64)
        before, after = (self._counted(s, x) for s, x in ((end[i[alone] - 1], w[alone]), (at[e[last]], w[last])))
        at[j] = self.dead
        end[j - 1] = self.dead
        at[i] = new
        end[e - 1] = new
        self.found.setdefault(new, []).append(i)
        return *before, *after, int(w[1:][beside].sum()), int(w.sum())

    @staticmethod
    def _counted(symbols: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(symbols, w)
        n[SEPARATOR : SEPARATOR + 1] = 0
        some = np.flatnonzero(n)
        return some, n[some].astype(np.int64)

    def spelled(self, names: list[str], step: int = 50_000):
        """The types' symbols as strings, by stretches of types."""
        names = pa.array(names, pa.string())
        for k in range(0, len(self.starts) - 1, step):
            cuts = self.starts[k : k + step + 1]
            x = self.at[cuts[0] : cuts[-1]]
            ok = (x != self.dead) & (x != SEPARATOR)
            ends = np.append(0, np.cumsum(ok))[cuts - cuts[0]]
            yield pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(x[ok]))), "")


def _summed(symbols: tuple, counts: tuple) -> tuple[list, list]:
    """The symbols of all shards, each once, with their counts together."""
    if len(symbols) == 1:
        return symbols[0].tolist(), counts[0].tolist()
    some, at = np.unique(np.concatenate(symbols), return_inverse=True)
    out = np.zeros(len(some), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return some.tolist(), out.tolist()


class Pairs:
    """Counts of pairs and a heap of the frequent ones; an entry's count may be too large, never too small."""

    def __init__(self, counted: np.ndarray):
        self.names = _named([])[1]
        self.ids = {x: i for i, x in enumerate(self.names)}
        self.total = {int(x) >> 8 << 32 | int(x) & 255: int(counted[x]) for x in np.flatnonzero(counted)}
        self.heap, self.least = [], 1 + max(self.total.values(), default=0)

    def _entry(self, pair: int, n: int) -> tuple:
        return -n, self.names[pair >> 32], self.names[pair & 0xFFFFFFFF], pair

    def top(self, many: int) -> list[tuple]:
        """Takes the most frequent pairs off the heap, in order."""
        out: list[tuple] = []
        while len(out) < many:
            if not self.heap:
                if self.least <= 1:
                    break
                below, self.least = self.least, max(1, self.least // 8)
                self.heap = [self._entry(p, n) for p, n in self.total.items() if self.least <= n < below]
                heapq.heapify(self.heap)
                continue
            x = heapq.heappop(self.heap)
            n = self.total.get(x[3], 0)
            if n == -x[0]:
                if not out or out[-1] != x:
                    out.append(x)
            elif self.least <= n < -x[0]:
                heapq.heappush(self.heap, self._entry(x[3], n))
        return out

    def next(self, rank: int, most: int, dropout: float, seed: int) -> list[tuple]:
        """The merges (left, right, count) from a rank on that follow one another whatever the ones before them change, `most` of them or fewer.

        As in together(); a merge that makes a symbol that there is already can add to pairs of any others, so it is the last.
        """
        many = most + 1
        while True:
            top = self.top(many)
            for x in top:
                heapq.heappush(self.heap, x)
            picked, used, left_over = [], set(), list(top)
            bound = -top[-1][0] if len(top) == many else 0
            while len(picked) < most:
                x = None
                for x in left_over:
                    if picked and (x[1] in used or x[2] in used or x[1] == x[2]):
                        bound, x = max(bound, -x[0]), None
                        break
                    if not dropout or not _passed(x[1], x[2], rank + len(picked), dropout, seed):
                        break
                else:
                    x = None
                if x is None:
                    break
                left_over.remove(x)
                picked.append(x)
                used |= {x[1], x[2]}
                new = merged(x[1], x[2])
                if x[1] == x[2] or new in self.ids or any(merged(y[1], y[2]) == new for y in picked[:-1]):
                    break
            if picked or len(top) < many:
                break
            many *= 2  # all of them passed over
        keep = next((k for k in range(1, len(picked)) if -picked[k][0] <= bound), len(picked))
        return [(x[1], x[2], -x[0]) for x in picked[:keep]]

    def number(self, name: str) -> int:
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
        return self.ids[name]

    def merged(self, left: int, right: int, new: int, changes: list[tuple]) -> None:
        """Takes over what a merge changed in each shard."""
        if not changes:
            return
        add = self._add
        before, n_before, after, n_after, beside, n = zip(*changes)
        add(left << 32 | right, -sum(n))
        for x, c in zip(*_summed(before, n_before)):
            add(x << 32 | left, -c)
            add(x << 32 | new, c)
        for x, c in zip(*_summed(after, n_after)):
            add(right << 32 | x, -c)
            add(new << 32 | x, c)
        if beside := sum(beside):
            add(right << 32 | left, -beside)
            add(new << 32 | new, beside)

    def _add(self, pair: int, n: int) -> None:
        all_n = self.total.get(pair, 0) + n
        if all_n:
            self.total[pair] = all_n
            if n > 0 and all_n >= self.least:
                heapq.heappush(self.heap, self._entry(pair, all_n))
        else:
            del self.total[pair]


LEARNT = "rank int, left string, right string, token string, cnt long, sym string"
COLUMNS = [c.split()[0] for c in LEARNT.split(", ")]


def _table(it, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(it), schema).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


GIVEN = pa.schema([("token", pa.string()), ("cnt", pa.int64())])


def _prompt(connection):
    """The connection, which from now on sends at once: else what is over 16 KB waits until its length, sent before it, is acknowledged."""
    with socket.socket(fileno=os.dup(connection.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return connection


class Tasks:
    """Tasks that run at once, each with a connection to the first; a barrier's own exchange takes a second each time."""

    def __init__(self, tasks: int):
        self.no, self.others = 0, []
        if tasks > 1:
            context = BarrierTaskContext.get()
            self.no = context.partitionId()
            host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
            with Listener((host, 0), backlog=tasks, authkey=(key := secrets.token_bytes(16))) if not self.no else nullcontext() as here:
                port, key = context.allGather(f"{here.address[1]} {key.hex()}" if here else "")[0].split()
                self.others = [_prompt(x) for x in ([here.accept() for _ in range(tasks - 1)] if here else [Client((host, int(port)), authkey=bytes.fromhex(key))])]

    def tell(self, x):
        """What the first says."""
        if self.no:
            return self.others[0].recv()
        for other in self.others:
            other.send(x)
        return x

    def ask(self, x) -> list:
        """What all say, to the first."""
        if self.no:
            self.others[0].send(x)
            return []
        return [x, *(other.recv() for other in self.others)]


def _stretches(it, most: int):
    """Batches of types, joined until they hold over `most` bytes."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b.cast(GIVEN))
        if sum(x.nbytes for x in held) > most:
            yield held
            held = []
    if held:
        yield held


def _learn_here(k: int, dropout: float, seed: int, at_once: int, most: int):
    """Learns from one task's types, or from those of several that run at once: each merges in its own and tells what that changed,
    the first keeps the pairs' counts and says what comes next. Types beyond `most` bytes are further shards of the task, in files."""
    def run(it):
        types, shards = [], []
        for held in _stretches(it, most):
            given = _table(held, GIVEN)
            types.append((_whole(given["token"]), _whole(given["cnt"])))
            shards.append(Shard(types[-1][0], types[-1][1].to_numpy(), k + 257, filed=len(shards) > 0))
        tasks, merges = Tasks(at_once), []
        first = tasks.ask(sum((shard.pairs() for shard in shards), np.zeros(1 << 16, np.int64)))
        lead = None if tasks.no else Pairs(sum(first))
        del first
        while True:
            step, chosen = [], []
            if lead and len(merges) < k:
                chosen = lead.next(len(merges), min(TOGETHER, k - len(merges)), dropout, seed)
                step = [(lead.ids[left], lead.ids[right], lead.number(merged(left, right))) for left, right, _ in chosen]
            step = tasks.tell(step)
            if not step:
                break
            told = tasks.ask([[c for shard in shards if (c := shard.merge(*x))] for x in step])
            if lead:
                for x, *changes in zip(step, *told):
                    lead.merged(*x, [c for some in changes for c in some])
                merges += [(len(merges) + i, *x) for i, x in enumerate(chosen)]
        names = tasks.tell(lead.names if lead else None)
        none = lambda n, kind: pa.nulls(n, kind)
        if merges:
            rank, left, right, cnt = zip(*merges)
            yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int32()), pa.array(left), pa.array(right), none(len(merges), pa.string()), pa.array(cnt, pa.int64()), none(len(merges), pa.string())], names=COLUMNS)
        for shard, (tokens, counts) in zip(shards, types):
            i = 0
            for sym in shard.spelled(names):
                n = len(sym)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), none(n, pa.string()), none(n, pa.string()), tokens.slice(i, n), counts.slice(i, n), sym], names=COLUMNS)
                i += n

    return run


def _slots(spark) -> int:
    """Tasks that can run at once; one where executors come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def learn(types: DataFrame, k: int = 8000, dropout: float = 0.0, seed: int = 0, one_task: int = ONE_TASK) -> tuple[list[tuple], DataFrame]:
    """([(rank, left, right, cnt)], vocabulary after them): k merges, or fewer when no pair is left.

    Types of up to one_task bytes together are learnt from in one task, more in several that run at once;
    where fewer can, each of them takes several shards. With one_task 0 rounds of Spark jobs learn, which are
    slow; the result is the same. Pair counts are kept and only what a merge changes is counted anew.
    dropout: the share of pairs that is passed over in a step.
    """
    types = store(types.select("token", "cnt"))
    size = types.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    if one_task:
        tasks = max(1, math.ceil(size / one_task))
        tasks = min(tasks, max(1, _slots(types.sparkSession))) if tasks > 1 else 1
        out = store(types.repartition(tasks, "token").mapInArrow(_learn_here(k, dropout, seed, tasks, max(1, 3 * one_task)), LEARNT, barrier=tasks > 1))
        merges = [tuple(r) for r in out.filter("rank >= 0").orderBy("rank").select("rank", "left", "right", "cnt").collect()]
        return merges, out.filter("rank < 0").select("token", "cnt", "sym")
    vocab = store(vocabulary(types))
    counted, out, since = store(pairs(vocab)), [], 0
    while len(out) < k:
        rank = len(out)
        chance = F.crc32(F.concat(F.lit(f"{seed}:{rank}:"), "left", "right").cast("binary")) % 65536
        most = 1 if dropout else min(TOGETHER, k - rank)
        seen = (counted.filter(chance >= dropout * 65536) if dropout else counted).orderBy(F.desc("cnt"), "left", "right").limit(most + 1).collect()
        step = together([tuple(r) for r in seen], most)
        if not step:
            break
        out += [(rank + i, *x) for i, x in enumerate(step)]
        hit = vocab.filter(" OR ".join(f"contains(sym, '{left}{right}')" for left, right, _ in step))
        after, rest = hit, vocab
        for left, right, _ in step:
            after, rest = merge(after, left, right), merge(rest, left, right)
        delta = pairs(after).unionByName(pairs(hit).withColumn("cnt", -F.col("cnt")))
        old, counted = counted, store(counted.unionByName(delta).groupBy("left", "right").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0"))
        _forget(old)
        vocab, since = rest, since + len(step)
        if since >= 8:
            vocab, since = store(vocab), 0
    return out, vocab


#: Merges of one round at most.
TOGETHER = 32


def together(top: list[tuple], most: int) -> list[tuple]:
    """Of the most frequent pairs, in order, those that come next one after the other whatever the ones before them change.

    A merge changes the counts of pairs that share a symbol with it, and a pair that it makes is no more
    frequent than one of those. So pairs without a symbol in common follow one another as long as they are more
    frequent than the first that shares one; a pair of twice the same symbol stands alone.
    """
    used: set[str] = set()
    for i, (left, right, n) in enumerate(top):
        if left in used or right in used or left == right:
            return top[: max(1, next(j for j in range(i + 1) if j == i or top[j][2] <= n))][:most]
        used |= {left, right}
    return top[:most] if len(top) <= most else top[: max(1, next((j for j in range(most) if top[j][2] <= top[most][2]), most))]


def _encode_here(merges: list[tuple]):
    steps, names = _named(merges)

    def run(it):
        for held in _stretches(it, ONE_TASK):
            given = _table(held, GIVEN)
            tokens, counts = _whole(given["token"]), _whole(given["cnt"])
            shard, i = Shard(tokens, counts.to_numpy(), len(names)), 0
            for x in steps:
                shard.merge(*x)
            for sym in shard.spelled(names):
                yield pa.RecordBatch.from_arrays([tokens.slice(i, len(sym)), counts.slice(i, len(sym)), sym], names=["token", "cnt", "sym"])
                i += len(sym)

    return run


def encode(types: DataFrame, merges: list[tuple]) -> DataFrame:
    """(token, cnt) -> (token, cnt, sym): the merges applied one after the other; their number is the vocabulary's, whatever the corpus."""
    return types.select("token", "cnt").mapInArrow(_encode_here(merges), "token string, cnt long, sym string")
