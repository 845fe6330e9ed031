"""Hierarchical Pitman-Yor scoring of texts (operator 7).

Every context of one, two and three preceding words that stands in the training texts, however rare,
has a restaurant; its parent is the context without its first word, and one root is parent to all of
one word. A dish's tables in a restaurant are its customers in the parent.

Seats are sampled by Gibbs sweeps over the dishes: a dish's customers all leave their restaurant, its
tables leave the parent, and a number of tables is drawn anew from its exact conditional given all
other seats, with generalised Stirling numbers for the ways to share them (see Tree.sweep). Dishes of
one restaurant take turns in `colours` turns a sweep. After `burn` sweeps the predictive
probabilities of `samples` sweeps are averaged: held-out texts of sf0.1 have -3.0517 (log10, a token)
as a mean of two sweeps with none burnt, -3.0509 as one of six after four and after eight.

Tokens are dealt into buckets by the word before them, packed by batches of documents; so a bucket
holds whole subtrees and sweeps them by itself, given the root. There are three rounds. In the first
every context of one word sends the root a customer for each of its dishes, as if each had one table;
the root is seated by Gibbs draws and answers each bucket with the words it asked for. The second
seats all contexts under that root by the `burn` sweeps, keeps their seats and sends the root the tables
that each dish has then, under which it is seated anew. The third goes on from these seats with the
other sweeps, scores its tokens and sends a sum for each document. Tokens are packed anew for each
round, so that the shared disk holds them once.

A word with over `hot` training tokens is, as a context, told apart by classes of the word before it
(and of the one before that, where that word is hot as well): each class is a context of one word with
about hot / 2 tokens. So no bucket grows with the most frequent word. `hot` follows the corpus alone
(2 ** 18, or 2 ** -20 of the tokens where that is more), and 2 ** 22 such words at most reach the
driver and the tasks.

Words are told by 56 bits of a hash, the second word back by 22 bits of it, the third by 10. Draws are hashes of dish and
sweep, so they don't depend on how rows are dealt. Before a text stands its end, and before that one
of 64 signs by its id.

Limits: a dish of over 1024 customers in one restaurant has its tables drawn in stretches that double,
each with the chance at its middle, instead of from the exact conditional. The root keeps
the customers of the second round through the sweeps that are averaged.

Defined cases: null, empty and wordless texts are one end token; without training rows no word is
known and every token has the base probability of an unknown one with V = 0; a null doc_id counts as
'' for the remainder; repeated rows are scored and counted each; texts of any length are read whole;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, store, table
from .labelled import remainder

#: Bytes of a word's hash, and of a context's within its bucket.
WORD, HEAD = 7, 6
END = xxhash.xxh64_intdigest(b"\n") >> 8 * (8 - WORD) << 8 * (8 - WORD)
#: Discount and strength of the root and of contexts of one, two and three words.
ROOT = (0.5, 10.0)
LEVELS = ((0.75, 1.0), (0.85, 1.0), (0.9, 1.0))
EXACT, FEW = 1024, 16
#: Cells of a matrix of draws at most.
CELLS = 1 << 16
#: Dishes taken together, so that what is reckoned of them stays in a core's cache.
BLOCK = 1 << 13
#: Tokens of a stretch of documents that are packed together.
TOKENS = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SIGNS = _mix(np.uint64(END) + np.arange(1, 65, dtype=np.uint64))


def _chance(key: np.ndarray, no: int) -> np.ndarray:
    """A number in [0, 1) for each key and draw."""
    return (_mix(key + np.uint64((no + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) * 2.0**-53


# ---- seats ----


@functools.cache
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: ways to share c customers among t tables, each weighted by (1 - discount)(2 - discount).. of its further customers."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1, 0] = -np.inf if c or discount else stay[0]
            out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


@functools.cache
def _ways(discount: float) -> np.ndarray:
    return np.exp(stirling(discount)[: FEW + 1, : FEW + 1])


def predict(c, t, all_c, all_t, parent, level: tuple[float, float]):
    """The predictive probability of a dish with c customers at t tables in a restaurant with all_c at all_t."""
    d, s = level
    return (np.maximum(c - d * t, 0) + (s + d * all_t) * parent) / (s + all_c)


_BITS = np.random.PCG64(0)
_DRAWS = np.random.Generator(_BITS)
_ODD = 0xDA3E39CB94B95BDB << 64 | 0x9FB21C651E98DF25


def _binomial(seed: int, n: int, p: float) -> int:
    """A draw that its seed decides; to set a generator's state is faster than to make one."""
    _BITS.state = {"bit_generator": "PCG64", "state": {"state": seed * _ODD & (1 << 128) - 1, "inc": seed << 1 | 1}, "has_uint32": 0, "uinteger": 0}
    return int(_DRAWS.binomial(n, p))


def _stretches(key, no, c, rest, base, d, s):
    """Tables of many customers who sit down in stretches, the first 64 one by one."""
    t, k = np.ones(len(c)), 64
    draws = np.arange(no * 8192 + 2, no * 8192 + 65, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(c), CELLS // 64):  # as _chance() gives them, all draws of some dishes together
        z = slice(i, i + CELLS // 64)
        chance, own, sit = (_mix(key[z] + draws) >> np.uint64(11)) * 2.0**-53, t[z], c[z] > np.arange(1, 64)[:, None]
        for j, (x, ok) in enumerate(zip(chance, sit), 1):
            fresh = (s + d * (rest[z] + own)) * base[z]
            own += (x < fresh / (fresh + np.maximum(j - d * own, 1e-9))) & ok
    while (at := np.flatnonzero(c > k)).size:
        n = np.minimum(k, c[at] - k)
        fresh = (s + d * (rest[at] + t[at])) * base[at]
        p = fresh / (fresh + np.maximum(k + (n - 1) / 2 - d * t[at], 1e-9))
        seeds = _mix(key[at] + np.uint64(no * 8192 + k))
        t[at] += [_binomial(x, a, b) for x, a, b in zip(seeds.tolist(), n.tolist(), np.minimum(p, 1).tolist())]
        k += k
    return t


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash its place among the distinct ones, in their order, and for each of these where it first stands.

    Sorted are the hashes' upper bits, each with its place below them; where these bits don't tell two hashes apart, the whole ones.
    """
    bits = np.uint64(len(x).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = x & ~low
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    order = (both & low).view(np.int64)
    y = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(y[1:], y[:-1], out=new[1:])
    both >>= bits
    if (new[1:] & (both[1:] == both[:-1])).any():
        order = np.argsort(x, kind="stable")
        y = x[order]
        np.not_equal(y[1:], y[:-1], out=new[1:])
    code = np.empty(len(x), np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return code, order[new]


def _numbered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of hashes and numbers into each: all distinct hashes in their order, and the numbers' places among them, one after the other."""
    every = np.concatenate([x for x, _ in parts])
    code, at = _codes(every)
    cuts = np.cumsum([0, *(len(x) for x, _ in parts)])
    return every[at], np.concatenate([code[i:j][n] for i, j, (_, n) in zip(cuts, cuts[1:], parts)])


def _pairs(high: np.ndarray, low: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers in ascending order, packed with `wide` bits for the lower ones, and where each stood. Where there is room,
    its place is sorted along below each pair, so that nothing has to be fetched by it."""
    both = high.astype(np.uint64) << np.uint64(wide)
    both |= low.astype(np.uint64)
    bits = len(both).bit_length()
    if int(both.max(initial=0)).bit_length() + bits > 64:
        order = np.argsort(both, kind="stable")
        return both[order], order
    both <<= np.uint64(bits)
    both |= np.arange(len(both), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << bits) - 1)).astype(np.int32)
    both >>= np.uint64(bits)
    return both, order


def _news(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers in ascending order the distinct ones, and for each its place among these."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new], np.cumsum(new, dtype=np.int32) - np.int32(1)


class Tree:
    """Restaurants of the contexts of some tokens: u, v, x are the words before w, the nearest first; train says which tokens are customers.
    u and w are hashes, or the distinct ones in their order and each token's place among them; v and x have 32 bits at most. seated:
    with one table for each dish, else seats are to be taken.

    Restaurants are numbered by their parent and their own word, dishes by their restaurant and word, so that whatever belongs
    together stands together. Of each level from 0 (one word): rooms (restaurants: the word, from level 1 on packed below the parent),
    key (dishes: the restaurant and, in its lower bits, the place in words), up (the dish in the parent; at level 0 the place in
    words), rest (its restaurant), c customers, t tables; all_c, all_t by restaurant. leaf: each token's dish at the deepest level.
    """

    def __init__(self, u, v, x, w, train, seated: bool = True):
        (heads, u), (self.words, self.w) = (y if isinstance(y, tuple) else _numbered([(y, slice(None))]) for y in (u, w))
        self.rooms, self.wides, order = [heads], [0], None
        rest = u
        for y in (v, x):  # tokens in the order of their contexts, one word further with each turn
            self.wides.append(int(y.max(initial=0)).bit_length())
            both, at = _pairs(rest, y if order is None else y[order], self.wides[-1])
            order = at if order is None else order[at]
            rooms, rest = _news(both)
            self.rooms.append(rooms)
        last, self.wide = len(self.rooms) - 1, len(self.words).bit_length()
        self.key, self.up, self.rest = [None] * (last + 1), [None] * (last + 1), [None] * (last + 1)
        both, at = _pairs(rest, self.w[order], self.wide)
        order = order[at]
        self.key[last], code = _news(both)
        self.leaf = np.empty(len(code), np.int32)
        self.leaf[order] = code
        self.c = [None] * last + [np.bincount(code, train[order], len(self.key[last])).astype(np.int32)]
        del both, at, order, code, rest
        for k in range(last, -1, -1):
            self.rest[k], words = (self.key[k] >> np.uint64(self.wide)).astype(np.int32), self._said(k)
            if k:
                above = (self.rooms[k] >> np.uint64(self.wides[k])).astype(np.int32)
                both, at = _pairs(above[self.rest[k]], words, self.wide)
                self.key[k - 1], code = _news(both)
                self.up[k] = np.empty(len(code), np.int32)
                self.up[k][at] = code
            else:
                self.up[k] = words
        self.t, self.all_c, self.all_t = [None] * (last + 1), [None] * (last + 1), [None] * (last + 1)
        self.no, self.last, self.part, self.shares = 0, None, None, None
        if seated:
            self.stand()

    def stand(self) -> None:
        """One table for each dish that has customers."""
        for k in range(len(self.key) - 1, -1, -1):
            self._sit(k, np.minimum(self.c[k], 1))

    def _said(self, k: int, at=slice(None)) -> np.ndarray:
        """The places in words of the dishes `at`."""
        return (self.key[k][at] & np.uint64((1 << self.wide) - 1)).astype(np.int32)

    def _sit(self, k: int, t: np.ndarray) -> None:
        """All tables of a level whose customers are known."""
        self.t[k], n = t, len(self.rooms[k])
        self.all_c[k], self.all_t[k] = np.bincount(self.rest[k], self.c[k], n), np.bincount(self.rest[k], t, n)
        if k:
            self.c[k - 1] = np.bincount(self.up[k], t, len(self.key[k - 1])).astype(np.int32)

    def seats(self) -> tuple[bytes, bytes]:
        """The tables of all dishes, packed, and a digest of the dishes."""
        t = np.concatenate(self.t)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if t.max(initial=0) <= np.iinfo(k).max)
        return np.dtype(kind).str.encode().ljust(4) + _pack(t.astype(kind)), self._keys()

    def take(self, seats: bytes, keys: bytes, no: int) -> None:
        """Takes the seats that the same tree had after `no` sweeps."""
        if keys != self._keys():
            raise ValueError("the dishes of the two rounds differ")
        t = _unpack(seats[4:], seats[:4].decode().strip(), sum(map(len, self.key)))
        cuts = np.cumsum([0, *map(len, self.key)])
        for k in range(len(self.key) - 1, -1, -1):
            self._sit(k, t[cuts[k] : cuts[k + 1]].astype(np.int32))
        self.no, self.part, self.shares = no, None, None

    def _keys(self) -> bytes:
        """Tells the dishes and their order."""
        return b"".join(xxhash.xxh3_64_digest(np.ascontiguousarray(x)) for x in (self.words, *self.rooms, *self.key))

    def sent(self) -> np.ndarray:
        """Customers that each of the words has in the root."""
        return np.bincount(self.up[0], self.t[0], len(self.words)).astype(np.int64)

    def spoken(self) -> np.ndarray:
        """Each token's place in words."""
        return self.w

    def trained(self) -> np.ndarray:
        """Training tokens of each of the words."""
        return np.bincount(self._said(len(self.key) - 1), self.c[-1], len(self.words)).astype(np.int64)

    def chances(self, root: np.ndarray) -> np.ndarray:
        """Predictive probability of each dish at the deepest level, as by predict(): a share of its own and one of its parent's.
        Between sweeps they change in those restaurants alone that have dishes to seat."""
        if self.part is None:
            self._parted()
        if self.shares is None:
            self.shares = [self._share(k, slice(None)) for k in range(len(self.key))]
        else:
            for k, at in enumerate(self.live):
                self.shares[k][0][at], self.shares[k][1][at] = self._share(k, at)
        p = root
        for (own, given), up in zip(self.shares, self.up):
            p = p[up]
            p *= given
            p += own
        return p

    def _share(self, k: int, at) -> tuple[np.ndarray, np.ndarray]:
        """Of the dishes `at`: their own part of their probability, and the factor of their parent's."""
        d, s = LEVELS[k]
        share, rest = 1 / (s + self.all_c[k]), self.rest[k][at]
        own = np.maximum(self.c[k][at] - d * self.t[k][at], 0)
        own *= share[rest]
        return own, ((s + d * self.all_t[k]) * share)[rest]

    def mean(self, root: np.ndarray, samples: int) -> np.ndarray:
        """Mean of chances() after each of so many sweeps. In the restaurants that have dishes to seat (live; so have their parents, then)
        it is summed sweep by sweep. All other dishes have the same shares after each sweep, and so those of their parents' means."""
        if self.part is None:
            self._parted()
        part, levels, place = self.part, [], None
        for k, (live, rests) in enumerate(zip(self.live, self.rests)):
            d, _ = LEVELS[k]
            number = np.empty(len(self.rooms[k]), np.int64)
            number[rests] = np.arange(len(rests))
            up = self.up[k][live] if place is None else place[self.up[k][live]]
            place = np.empty(len(self.key[k]), np.int64)
            place[live] = np.arange(len(live))
            levels.append((up, number[self.rest[k][live]], place[self.ats[k]], np.maximum(self.c[k][live] - d * self.t[k][live], 0), np.empty(len(live)), np.zeros(len(live))))
        del number, place
        said = root[self.said]
        for _ in range(samples):
            part._sweep(said, 2)
            above = root
            for k, (up, rest, at, own, p, total) in enumerate(levels):
                d, s = LEVELS[k]
                share = 1 / (s + part.all_c[k])
                given = (s + d * part.all_t[k]) * share
                own[at] = np.maximum(part.c[k] - d * part.t[k], 0)
                for i in range(0, len(p), BLOCK):
                    z = slice(i, i + BLOCK)
                    room = rest[z]
                    x = above.take(up[z])
                    x *= given.take(room)
                    x += own[z] * share.take(room)
                    p[z] = x
                    total[z] += x
                above = p
        self._back()
        p = root
        for k, live in enumerate(self.live):
            own, given = self._share(k, slice(None))
            p = p[self.up[k]]
            p *= given
            p += own
            p[live] = levels[k][-1] / samples
        return p

    def _parted(self) -> None:
        """The dishes with two training tokens or more, by restaurant and hash, as a tree of their own (part); all others keep one customer
        or none at each level. Of the whole tree, ats and rests are its dishes and restaurants, said its words, live all dishes of its restaurants."""
        part = self.part = Tree.__new__(Tree)
        last = len(self.key) - 1
        n, self.ats, self.rests, self.live = self.c[last], [None] * (last + 1), [None] * (last + 1), [None] * (last + 1)
        for k in range(last, -1, -1):
            self.ats[k] = np.flatnonzero(n > 1)
            if k:
                n = np.bincount(self.up[k], n, len(self.key[k - 1]))
        part.key, part.up, part.rest, part.c, part.t, part.all_c, part.all_t = ([None] * (last + 1) for _ in range(7))
        dish, context = _mix(self.words + np.uint64(2)), None
        for k, at in enumerate(self.ats):
            rest = self.rest[k][at]
            new = np.diff(rest, prepend=-1) != 0
            rooms, number = self.rooms[k][rest[new]], np.cumsum(new) - 1
            if k:  # a context's hash is of its parent's and its own word
                above = context[np.searchsorted(self.rests[k - 1], (rooms >> np.uint64(self.wides[k])).astype(np.int32))]
                context = _mix(above ^ _mix((rooms & np.uint64((1 << self.wides[k]) - 1)) + np.uint64(1)))
            else:
                context = _mix(rooms + np.uint64(0x9E3779B97F4A7C15))
            self.rests[k], key = rest[new], _mix(context[number] + dish[self._said(k, at)])
            bits = np.uint64(len(rooms).bit_length())
            order = np.argsort(number.astype(np.uint64) << np.uint64(64) - bits | key >> bits) if bits else np.zeros(0, np.int64)
            at = self.ats[k] = at[order]
            part.key[k], part.rest[k], part.c[k], part.t[k] = key[order], number, self.c[k][at].astype(np.int64), self.t[k][at].astype(np.int64)
            part.all_c[k], part.all_t[k] = self.all_c[k][self.rests[k]], self.all_t[k][self.rests[k]]
            some = np.zeros(len(self.rooms[k]), bool)
            some[self.rests[k]] = True
            self.live[k] = np.flatnonzero(some[self.rest[k]])
            up = self.up[k][at]
            if k:
                place = np.empty(len(self.key[k - 1]), np.int64)
                place[self.ats[k - 1]] = np.arange(len(self.ats[k - 1]))
                part.up[k] = place[up]
            else:
                self.said, part.up[k] = np.unique(up, return_inverse=True)
        part.no, part.last = self.no, None

    def _back(self) -> None:
        """The seats of the part's dishes, into the whole tree."""
        for k, (at, rests) in enumerate(zip(self.ats, self.rests)):
            self.c[k][at], self.t[k][at] = self.part.c[k], self.part.t[k]
            self.all_c[k][rests], self.all_t[k][rests] = self.part.all_c[k], self.part.all_t[k]
        self.no = self.part.no

    def sweep(self, root: np.ndarray, colours: int | None = 2, times: int = 1) -> None:
        """Seats all dishes anew, the deepest contexts first; dishes of one customer have one table anyhow. colours: turns that
        the dishes of each restaurant take, with None every dish has a turn of its own. times: sweeps one after the other."""
        if self.part is None:
            self._parted()
        for said in [root[self.said]] * times:
            self.part._sweep(said, colours)
        self._back()

    def _turns(self, k: int, colours: int | None) -> list[np.ndarray]:
        """The dishes of several customers, by turn and in it by customers."""
        many = np.flatnonzero(self.c[k] > 1)
        turn = np.arange(len(many))
        if colours:
            rest = self.rest[k][many]
            new = np.diff(rest, prepend=-1) != 0
            turn = (turn - np.maximum.accumulate(np.where(new, turn, 0))) % colours
            turns = [many[turn == x] for x in range(colours)]
        else:
            turns = np.split(many, len(many)) if len(many) else []
        return [at[np.argsort(np.minimum(self.c[k][at], EXACT + 1).astype(np.uint16), kind="stable")] for at in turns if len(at)]  # in what order the largest come is all the same

    def _sweep(self, root: np.ndarray, colours: int | None) -> None:
        """Of a tree whose dishes stand by restaurant and key."""
        for k in range(len(self.key) - 1, -1, -1):
            if k < len(self.key) - 1:
                turns = self._turns(k, colours)
            else:  # customers of the deepest contexts stay
                if self.last is None or self.last[0] != colours:
                    self.last = colours, self._turns(k, colours)
                turns = self.last[1]
            for at in turns:
                size, i = self.c[k][at], 0
                above = self._chance_of(k - 2, slice(None), root) if k else None
                new = np.empty(len(at), np.int64)
                wide = 2
                while i < len(at):  # together those whose tables fit a matrix of one width
                    if size[i] > EXACT:
                        new[i:] = self._draw(k, at[i:], root, 0, above)
                        break
                    while wide < size[i]:
                        wide *= 2
                    j = min(int(np.searchsorted(size, wide, "right")), i + max(1, min(BLOCK, CELLS // wide)))
                    new[i:j] = self._draw(k, at[i:j], root, wide, above)
                    i = j
                self._seat(k, at, new)
            for j in range(k - 1, -1, -1):  # above, dishes have other customers now; a table needs one at least, and no dish with customers stays without
                t = self.t[j]
                at = np.flatnonzero((t > self.c[j]) | ((t < 1) & (self.c[j] > 0)))
                self._seat(j, at, np.clip(t[at], np.minimum(self.c[j][at], 1), self.c[j][at]))
        self.no += 1

    def _chance_of(self, k: int, at: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Predictive probability of some dishes at level k (-1: of words in the root)."""
        if k < 0:
            return root[at]
        rest = self.rest[k][at]
        return predict(self.c[k][at], self.t[k][at], self.all_c[k][rest], self.all_t[k][rest], self._chance_of(k - 1, self.up[k][at], root), LEVELS[k])

    def _seat(self, k: int, at: np.ndarray, new: np.ndarray) -> None:
        more = new - self.t[k][at]
        self.t[k][at] = new
        ok = more != 0
        at, more = at[ok], more[ok]
        by = more.astype(np.float64)  # of the totals' type: numpy adds that faster
        np.add.at(self.all_t[k], self.rest[k][at], by)
        if k:
            up = self.up[k][at]
            np.add.at(self.c[k - 1], up, more)
            np.add.at(self.all_c[k - 1], self.rest[k - 1][up], by)

    def _draw(self, k: int, at: np.ndarray, root: np.ndarray, wide: int, above: np.ndarray | None) -> np.ndarray:
        """Tables of the dishes `at`, given everyone else. P(t) is S[c, t] times, for each table in turn, the weight of a
        new table and the parent's probability of the dish after the tables before it. wide 0: in stretches.
        above: probabilities of the dishes two levels up."""
        d, s = LEVELS[k]
        c, old = self.c[k][at], self.t[k][at]
        others = self.all_t[k][self.rest[k][at]] - old
        up = self.up[k][at]
        if k:
            pd_, ps = LEVELS[k - 1]
            pr = self.rest[k - 1][up]
            pc, pt = (self.c[k - 1][up] - old).astype(np.float64), self.t[k - 1][up].astype(np.float64)
            pall, ptall, pp = self.all_c[k - 1][pr] - old, self.all_t[k - 1][pr], above[self.up[k - 1][up]]
        if not wide:
            base = root[up] if not k else predict(pc, np.minimum(pt, pc), pall, ptall, pp, LEVELS[k - 1])
            return _stretches(self.key[k][at], self.no, c, others, base, d, s)
        if wide == 2:
            q = root[up] if not k else (np.maximum(pc + 1 - pd_ * np.minimum(pt, pc + 1), 0) + (ps + pd_ * ptall) * pp) / (ps + pall + 1)
            fresh = (s + d * (others + 1)) * q  # weight of the second table
            return 1 + (1 - d <= _chance(self.key[k][at], self.no) * (1 - d + fresh))
        if wide <= FEW:  # small enough for plain products, table by table
            ways, more, under = _ways(d), 0.0 if not k else (ps + pd_ * ptall) * pp, None if not k else ps + pall
            p, prod, last = np.empty((wide, len(at))), 1.0, 0.0
            for i in range(wide):
                if k:
                    seated = pc + i
                    q = (np.maximum(seated - pd_ * np.minimum(pt, seated), 0) + more) / (under + i)
                else:
                    q = root[up]
                prod = (s + d * (others + i)) * q * prod
                last = np.add(ways[:, i + 1][c] * prod, last, out=p[i])
            return np.minimum(1 + (p <= _chance(self.key[k][at], self.no) * last).sum(axis=0), c)
        i = np.arange(wide)[None, :]
        if k:
            seated = pc[:, None] + i
            q = (np.maximum(seated - pd_ * np.minimum(pt[:, None], seated), 0) + ((ps + pd_ * ptall) * pp)[:, None]) / (ps + pall[:, None] + i)
        else:
            q = root[up][:, None]
        log = stirling(d)[:, 1 : wide + 1][c] + np.cumsum(np.log((s + d * (others[:, None] + i)) * q), axis=1)
        p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
        return np.minimum(1 + (p <= (_chance(self.key[k][at], self.no) * p[:, -1])[:, None]).sum(axis=1), c)


def root_tables(w: np.ndarray, m: np.ndarray, v: int, all_t: float, no: int) -> np.ndarray:
    """Tables of the root's dishes, with m customers each, given all_t tables; the same wherever it is drawn."""
    d, s = ROOT
    t = np.minimum(m, 1)
    at = np.flatnonzero(m > 1)
    at = at[np.argsort(m[at], kind="stable")]
    sizes, chance, i = m[at], _chance(w[at], no), 0
    ways, fresh = stirling(d), np.cumsum(np.log((s + d * (all_t + np.arange(EXACT))) / (v + 1)))
    while i < len(at):
        size = sizes[i]
        j = len(at) if size > EXACT else int(np.searchsorted(sizes, size, "right"))
        z = at[i:j]
        if size > EXACT:
            t[z] = _stretches(w[z], no, m[z], np.full(len(z), all_t), np.full(len(z), 1 / (v + 1)), d, s)
        else:
            log = ways[size, 1 : size + 1] + fresh[:size]
            p = np.cumsum(np.exp(log - log.max()))
            t[z] = 1 + np.minimum(p.searchsorted(chance[i:j] * p[-1], "right"), size - 1)
        i = j
    return t


def root_chances(m: np.ndarray, t: np.ndarray, v: int, all_m: float, all_t: float) -> np.ndarray:
    return predict(m, t, all_m, all_t, 1 / (v + 1), ROOT)


# ---- tokens ----


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True)


def _unpack(b: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


_R = np.random.default_rng(11)
BYTES, PLACES = _R.integers(0, 1 << 64, 256, np.uint64), _R.integers(0, 1 << 64, 1024, np.uint64) | np.uint64(1)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin, with the last one's end, and their bytes."""
    _, offsets, data = words.buffers()
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    return np.frombuffer(offsets, kind)[words.offset : words.offset + len(words) + 1].astype(np.int64), np.frombuffer(data, np.uint8)


def _hashes(words: pa.Array, step: int = 1 << 13) -> np.ndarray:
    """A hash of each word: the sum of its bytes' random numbers, each times its place's, mixed. No word is empty."""
    out = np.zeros(len(words), np.uint64)
    if not len(words):
        return out
    offsets, data = _bytes(words)
    for i in range(0, len(words), step):
        ends = offsets[i : i + step + 1]
        part, start, lens = data[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)
        place = np.arange(len(part)) - np.repeat(start, lens)
        weight = PLACES[place & 1023]
        if lens.max() > 1024:
            weight *= (2 * (place >> 10) + 1).astype(np.uint64)
        out[i : i + step] = np.add.reduceat(BYTES[part] * weight, start) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(out) & ~np.uint64((1 << 8 * (8 - WORD)) - 1)


#: Masks of so many first and last bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LAST = FIRST << np.arange(64, -1, -8, dtype=np.uint64) % np.uint64(64)


def _marks(words: pa.Array, step: int = 1 << 13) -> np.ndarray:
    """What tells tokens apart within a stretch, faster than _hashes() where they are many: length, first and last eight bytes, mixed;
    of words of over 16 bytes the hash of all."""
    out = np.empty(len(words), np.uint64)
    if not len(words):
        return out
    offsets, data = _bytes(words)
    for i in range(0, len(words), step):
        ends = offsets[i : i + step + 1]
        part = np.zeros(ends[-1] - ends[0] + 16, np.uint8)
        part[8:-8] = data[ends[0] : ends[-1]]
        eight = np.ndarray(len(part) - 7, np.uint64, part, 0, (1,))  # the eight bytes from each place on
        at = ends - ends[0]
        n = np.diff(at)
        some = np.minimum(n, 8)
        h = _mix((eight[at[:-1] + 8] & FIRST[some]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h ^= eight[at[1:]] & LAST[some]
        out[i : i + step] = _mix(h)
    long = np.flatnonzero(np.diff(offsets) > 16)
    if len(long):
        out[long] = _mix(_hashes(words.take(pa.array(long))) + np.uint64(1))
    return out


def _cut(h: np.ndarray, wide: int) -> bytes:
    """The upper bytes of each hash."""
    return h.view(np.uint8).reshape(-1, 8)[:, 8 - wide :].tobytes()


def _uncut(b: bytes, wide: int) -> np.ndarray:
    out = np.zeros((len(b) // wide, 8), np.uint8)
    out[:, 8 - wide :] = np.frombuffer(b, np.uint8).reshape(-1, wide)
    return out.view(np.uint64).ravel()


def _deltas(h: np.ndarray, wide: int) -> bytes:
    """The upper bytes of hashes, each less the one before, packed; shorter where they ascend."""
    h = h & ~np.uint64((1 << 8 * (8 - wide)) - 1)
    return len(h).to_bytes(4, "little") + _pack(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, 8 - wide :].T)


def _undeltas(b: bytes, wide: int) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - wide :] = _unpack(b[4:], np.uint8, n * wide).reshape(wide, n).T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _split(it):
    """Stretches of documents of about TOKENS tokens, or of one longer document: ids, held out or not, signs before the text, the words
    one after the other, how many each document has."""
    for b in it:
        if not b.num_rows:
            continue
        ids, text = b.column(0), pc.ascii_lower(pc.fill_null(b.column(1), ""))
        held, sign = b.column(2).to_numpy(zero_copy_only=False).astype(bool), b.column(3).to_numpy(zero_copy_only=False)
        no = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)) // (6 * TOKENS)
        for a, z in zip(cuts := np.concatenate([[0], np.flatnonzero(np.diff(no)) + 1]).tolist(), [*cuts[1:], b.num_rows]):
            split = pc.ascii_split_whitespace(text.slice(a, z - a))
            flat, n = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
            if not full.all():  # white space at a text's ends
                n = np.bincount(np.repeat(np.arange(z - a), n)[full], minlength=z - a)
                flat = flat.filter(pa.array(full))
            yield ids.slice(a, z - a), held[a:z], sign[a:z].astype(np.int64), flat, n


def _texts(it):
    """The stretches with their distinct words, the tokens' places among them (the end comes next after them) and the documents' lengths
    in tokens instead of their words."""
    for ids, held, sign, flat, n in _split(it):
        (coded, at), lens = _codes(_marks(flat)), n + 1
        words = flat.take(pa.array(at))
        code = np.empty(int(lens.sum()), np.int32)
        ends = np.cumsum(lens) - 1
        word = np.ones(len(code), bool)
        word[ends] = False
        code[ends], code[word] = len(words), coded
        yield ids, held, sign, words, code, lens


def _frequent(share: float):
    """Words that hold at least that share of a stretch's training tokens, with their counts there."""
    def run(it):
        for _, held, _, words, n in _split(it):
            need, train = max(1, share * (len(words) + len(n))), np.flatnonzero(np.repeat(~held, n))
            marks = _marks(words)[train]
            bins = (marks >> np.uint64(44)).view(np.int64)  # only words in bins that hold as many are told apart
            some = np.flatnonzero((np.bincount(bins) >= need)[bins])
            code, at = _codes(marks[some])
            c = np.bincount(code, minlength=len(at))
            ok = np.flatnonzero(c >= need)
            ends = [x for x in [int((~held).sum())] if x >= need]
            vocab, c = np.append(_hashes(words.take(pa.array(train[some[at[ok]]]))), np.full(len(ends), END, np.uint64)), np.append(c[ok], ends)
            yield pa.RecordBatch.from_arrays([pa.array(vocab.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    return run


#: Bits of a word's hash by which it is told as the second and the third word back; 32 together.
SECOND, THIRD = 22, 10


def _second(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SECOND)).astype(np.uint32)


def _third(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - THIRD)).astype(np.uint32)


class Hot:
    """Classes of the contexts that hot words are."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hot: int):
        order = np.argsort(words)
        self.words, self.classes = words[order], np.maximum(2, np.ceil(counts[order] / (hot / 2))).astype(np.uint64)
        self.second = np.unique(_second(words))

    def place(self, u: np.ndarray) -> np.ndarray:
        """The place of each word among the hot ones, -1 for others."""
        if not len(self.words):
            return np.full(len(u), -1)
        at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
        return np.where(self.words[at] == u, at, -1)

    def classed(self, u: np.ndarray, at: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Hot words u, at their places, together with their class. v, x: the words before by their bits."""
        by = _mix(v.astype(np.uint64) + np.where(np.isin(v, self.second), (x.astype(np.uint64) + np.uint64(1)) << np.uint64(24), np.uint64(0)))
        return _mix(u + by % self.classes[at])


def _bucket(u: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(u + np.uint64(77)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)


PACKED = "bucket long, batch long, kind int, n int, words binary, heads binary, wide int, u binary, w binary, before binary, train binary, docs int, doc binary, runs binary, held binary, ids binary, nulls binary, lens binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    columns = [c.split() for c in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n, b"" if k == "binary" else 0) for r in rows], _TYPES[k]) for n, k in columns], names=[n for n, _ in columns])


def _local(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and each token's number among them."""
    if len(code) * 64 < size:
        some, local = np.unique(code, return_inverse=True)
    else:
        mark = np.zeros(size, bool)
        mark[code] = True
        some = np.flatnonzero(mark)
        number = np.empty(size, np.int32)
        number[some] = np.arange(len(some))
        local = number[code]
    return some, local.astype(np.uint16 if len(some) <= 1 << 16 else np.uint32)


def _planes(a: np.ndarray) -> bytes:
    """The numbers' low bytes, then the next ones and so on, packed."""
    return _pack(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _unplanes(b: bytes, wide: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8, n * wide).reshape(wide, n).T).view({2: np.uint16, 4: np.uint32}[wide]).ravel()


def _deal(keys: np.ndarray, hot: Hot, whole: bool, docs: bool = True):
    """A row for each stretch and bucket with the stretch's tokens there, in their order, and their contexts of one word; the
    whole of it has also the words before that and, with docs, the documents and one more row for the stretch's documents.
    Not whole, each pair of context and token is there once, in order of the contexts: u has the pairs of each, train each pair's training tokens."""
    buckets = len(keys)

    def run(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for no, (ids, held, sign, words, code, lens) in enumerate(_texts(it)):
            words = _hashes(words)
            order = np.argsort(words)  # words are numbered in the order of their hashes
            place = np.empty(len(words) + 1, np.int32)
            place[order], place[-1] = np.arange(len(words)), len(words)
            code, vocab = place[code], np.concatenate([words[order], [np.uint64(END)], SIGNS])
            batch, n, size = (part << 32) + no, len(code), len(vocab)
            first = np.concatenate([[0], np.cumsum(lens)[:-1]])
            pads = (size - 64 + sign).astype(np.int32)
            back = [code]
            for k in range(3):  # the words before, shifted; at a text's start its end, then its sign
                y = np.empty_like(code)
                y[1:] = back[-1][:-1]
                y[first] = size - 65 if k == 0 else pads
                back.append(y)
            w, u, v, x = back
            if whole:
                v, x = _second(vocab)[v], _third(vocab)[x]
            doc, train = np.repeat(np.arange(len(lens), dtype=np.int32), lens), ~np.repeat(held, lens)
            contexts, at = vocab, hot.place(vocab)
            if len(some := np.flatnonzero((at >= 0)[u])):
                sv, sx = (v[some], x[some]) if whole else (_second(vocab[v[some]]), _third(vocab[x[some]]))
                classed = hot.classed(vocab[u[some]], at[u[some]], sv, sx)
                number, new = _codes(classed)
                u[some] = size + number
                contexts = np.concatenate([vocab, classed[new]])
            of = _bucket(contexts, buckets)
            seen = np.zeros(len(contexts), bool)
            seen[u] = True
            heads = np.argsort(of, kind="stable")
            heads = heads[seen[heads]]  # by bucket, each with its number there
            head_cuts = np.searchsorted(of[heads], np.arange(buckets + 1))
            number = np.empty(len(contexts), np.uint32)
            number[heads] = np.arange(len(heads)) - head_cuts[of[heads]]
            if whole:
                bucket = of[u]
                order = np.argsort(bucket, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
                u, w, doc, train = number[u[order]], w[order], doc[order] if docs else None, train[order]
                before = (v << np.uint32(THIRD) | x)[order]
            else:
                number[heads] = np.arange(len(heads))
                both = number[u].astype(np.uint64) << np.uint64(33) | w.astype(np.uint64) << np.uint64(1) | train
                both.sort()
                train = (both & np.uint64(1)).astype(np.uint32)
                both >>= np.uint64(1)
                starts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                pairs, train = both[starts], np.add.reduceat(train, starts, dtype=np.uint32)
                u, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64((1 << 32) - 1)).astype(np.int32)
                cuts = np.searchsorted(u, head_cuts)
            rows, held_rows = [], 0
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                z, own = slice(cuts[k], cuts[k + 1]), heads[head_cuts[k] : head_cuts[k + 1]]
                m = int(cuts[k + 1] - cuts[k])
                lu = u[z] if whole else np.bincount(u[z] - head_cuts[k], minlength=len(own))
                lu = lu.astype(np.uint16 if max(len(own), m) < 1 << 16 else np.uint32)
                words, lw = _local(w[z], size)
                rows.append({
                    "bucket": int(keys[k]), "batch": batch, "kind": 1, "n": m, "words": _deltas(vocab[words], WORD), "heads": _deltas(contexts[own], HEAD), "wide": lu.itemsize + 8 * lw.itemsize, "u": _planes(lu), "w": _planes(lw),
                    "train": np.packbits(train[z]).tobytes() if whole else _planes(train[z]),
                })
                if whole:
                    rows[-1]["before"] = _planes(before[z])
                if whole and docs:
                    d = doc[z]
                    new = np.flatnonzero(np.diff(d, prepend=-1))
                    rows[-1] |= {"docs": len(new), "doc": _planes(np.diff(d[new], prepend=0).astype(np.uint32)), "runs": _planes(np.diff(new, append=m).astype(np.uint32))}
                held_rows += m
                if held_rows > 1 << 18:
                    yield _rows(rows)
                    rows, held_rows = [], 0
            if whole and docs:
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                rows.append({"bucket": -1 - batch, "batch": batch, "docs": len(ids), "ids": _pack(ids.fill_null(0).to_numpy(zero_copy_only=False)), "nulls": np.packbits(~known).tobytes(), "lens": _pack(lens), "held": np.packbits(held).tobytes()})
            if rows:
                yield _rows(rows)

    return run


def _tokens(df: pd.DataFrame) -> tuple[tuple, tuple, np.ndarray]:
    """The tokens' contexts of one word and the tokens, both as by _numbered, and which are training tokens."""
    rows = list(df.itertuples())
    heads = _numbered([(_undeltas(r.heads, HEAD), _unplanes(r.u, r.wide % 8, r.n)) for r in rows])
    words = _numbered([(_undeltas(r.words, WORD), _unplanes(r.w, r.wide // 8, r.n)) for r in rows])
    return heads, words, np.concatenate([np.unpackbits(np.frombuffer(r.train, np.uint8), count=r.n) for r in rows]).astype(bool)


def _tree(df: pd.DataFrame, seated: bool = True):
    """The tree of a bucket's tokens, and for each row its stretch, documents and their numbers of tokens, in order."""
    df = df.sort_values("batch")
    u, w, train = _tokens(df)
    before = np.concatenate([_unplanes(r.before, 4, r.n) for r in df.itertuples()])
    about = [(r.batch, np.cumsum(_unplanes(r.doc, 4, r.docs)).astype(np.uint32), _unplanes(r.runs, 4, r.docs).astype(np.int64)) for r in df.itertuples() if r.docs]
    return Tree(u, before >> np.uint32(THIRD), before & np.uint32((1 << THIRD) - 1), w, train, seated), about


def _shares(words: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The words by part of the vocabulary, in an order that they themselves give."""
    wb = (_mix(words) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((words, wb))
    cuts = np.searchsorted(wb[order], np.arange(buckets + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]


ASKED = "wb long, bucket long, n int, words binary, c binary, m binary"


def _ask(buckets: int):
    """First round: for each part of the vocabulary, the bucket's words with their training tokens and the contexts of one word that they follow."""
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        rows, every = list(df.itertuples()), [_undeltas(x, HEAD) for x in df.heads]
        heads, u = _numbered([(x, np.repeat(np.arange(len(x)), _unplanes(r.u, r.wide % 8, len(x)))) for r, x in zip(rows, every)])
        words, w = _numbered([(_undeltas(r.words, WORD), _unplanes(r.w, r.wide // 8, r.n)) for r in rows])
        seen, wide = np.concatenate([_unplanes(r.train, 4, r.n) for r in rows]), len(heads).bit_length()
        both = (w.astype(np.uint64) << np.uint64(wide) | u.astype(np.uint64))[seen > 0]
        both.sort()
        pairs = (_news(both)[0] >> np.uint64(wide)).astype(np.int64)
        c, m = np.bincount(w, seen, len(words)).astype(np.int64), np.bincount(pairs, minlength=len(words)).astype(np.int64)
        out = [(k, key[0], len(z), _cut(words[z], WORD), _pack(c[z]), _pack(m[z])) for k, z in _shares(words, buckets)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _answer(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the vocabulary: a row with all of it (bucket -1), and to each bucket all tokens and customers of its words, in the order it asked."""
    asked = [(r.bucket, _uncut(r.words, WORD), _unpack(r.c, np.int64, r.n), _unpack(r.m, np.int64, r.n)) for r in df.itertuples()]
    words, at = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
    c, m = (np.bincount(at, np.concatenate([x[k] for x in asked]), len(words)).astype(np.int64) for k in (2, 3))
    out, i = [(key[0], -1, len(words), _cut(words, WORD), _pack(c), _pack(m))], 0
    for bucket, w, _, _ in asked:
        z = at[i : i + len(w)]
        out.append((key[0], bucket, len(w), b"", _pack(c[z]), _pack(m[z])))
        i += len(w)
    return pd.DataFrame(out, columns=[x.split()[0] for x in ASKED.split(", ")])


def _totals(v: int | None = None, all_t: float = 0.0, no: int = 0):
    """Sums over the vocabulary: tokens, known words and customers; or, with v, the root's tables given all_t of them."""
    def run(it):
        for b in it:
            sums = np.zeros(3)
            for n, words, c, m in zip(*(b.column(k).to_pylist() for k in range(4))):
                c, m = _unpack(c, np.int64, n), _unpack(m, np.int64, n)
                sums += (c.sum(), (c > 0).sum(), m.sum()) if v is None else (root_tables(_uncut(words, WORD), m, v, all_t, no).sum(), 0, 0)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=["a", "b", "c"])

    return run


TOLD = "batch long, kind int, docs int, bucket long, doc binary, base binary, score binary, known binary, held binary, ids binary, nulls binary, lens binary"


def _halves(a: np.ndarray) -> bytes:
    """Numbers in six bytes each: to single precision, and what that leaves to half precision."""
    near = a.astype(np.float32)
    return near.tobytes() + ((a - near) * 1024).astype(np.float16).tobytes()


def _unhalves(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.float32, n).astype(np.float64) + np.frombuffer(b, np.float16, n, 4 * n).astype(np.float64) / 1024


def _told(tree: Tree, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens and customers of the tree's words."""
    told = {r.wb: r for r in answers.itertuples()}
    c, m = np.zeros(len(tree.words), np.int64), np.zeros(len(tree.words), np.int64)
    for k, z in _shares(tree.words, buckets):
        if told[k].n != len(z):
            raise ValueError("the words of the two rounds differ")
        c[z], m[z] = _unpack(told[k].c, np.int64, len(z)), _unpack(told[k].m, np.int64, len(z))
    return c, m


def _base(root: tuple, words: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The root's chances of some words with m customers there."""
    _, v, all_m, all_t, given, no = root
    return root_chances(m, root_tables(words, m, v, given, no), v, all_m, all_t)


def _burn(root: tuple, burn: int, buckets: int):
    """Second round: seats the bucket's contexts by `burn` sweeps. For each part of the vocabulary the words with their training tokens
    and the tables they have in contexts of one word; and a row (wb -1) with all seats."""
    def run(key: tuple, df: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = [x.split()[0] for x in ASKED.split(", ")]
        if not len(df):
            return pd.DataFrame(columns=columns)
        tree = _tree(df)[0]
        base = _base(root, tree.words, _told(tree, answers, buckets)[1])
        tree.sweep(base, times=burn)
        own, m = tree.trained(), tree.sent()
        out = [(k, key[0], len(z), _cut(tree.words[z], WORD), _pack(own[z]), _pack(m[z])) for k, z in _shares(tree.words, buckets)]
        seats, keys = tree.seats()
        return pd.DataFrame([*out, (-1, key[0], 0, b"", seats, keys)], columns=columns)

    return run


def _score(root: tuple, burn: int, samples: int, buckets: int):
    """Last round: sums of each stretch's documents over the bucket's tokens; the rows of the documents' names go through as they are."""
    n, v = root[:2]

    def run(key: tuple, df: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = [x.split()[0] for x in TOLD.split(", ")]
        if key[0] < 0:
            return df.assign(doc=b"", base=b"", score=b"", known=b"")[columns]
        if not len(df):
            return pd.DataFrame(columns=columns)
        tree, about = _tree(df, seated=False)
        c, m = _told(tree, answers, buckets)
        base = _base(root, tree.words, m)
        given = answers[answers.wb < 0]
        for r in given.itertuples():
            tree.take(r.c, r.m, burn)
        if not len(given):
            tree.stand()
        log = np.log10(tree.mean(base, samples))[tree.leaf]
        spoken = tree.spoken()
        plain, known = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))[spoken], (c > 0).astype(np.int32)[spoken]
        del tree
        out, i = [], 0
        for batch, doc, runs in about:
            cuts = i + np.concatenate([[0], np.cumsum(runs)[:-1]])
            i += int(runs.sum())
            a, b, c = (np.add.reduceat(x[:i], cuts) for x in (plain, log, known))
            out.append((batch, 1, len(doc), key[0], _planes(np.diff(doc, prepend=np.uint32(0))), _halves(a), b.astype(np.float32).tobytes(), _planes(c.astype(np.uint32)), b"", b"", b"", b""))
        return pd.DataFrame(out, columns=columns)

    return run


def _total(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
    r = df[df.kind == 0].iloc[0]
    n = r.docs
    out = np.zeros((3, n))
    for x in df[df.kind == 1].sort_values("bucket").itertuples():  # in one order, as sums of fractions depend on it
        doc = np.cumsum(_unplanes(x.doc, 4, x.docs))
        out[0, doc] += _unhalves(x.base, x.docs)
        out[1, doc] += np.frombuffer(x.score, np.float32)
        out[2, doc] += _unplanes(x.known, 4, x.docs)
    ids = pd.array(_unpack(r.ids, np.int64, n), dtype="Int64").copy()
    ids[np.unpackbits(np.frombuffer(r.nulls, np.uint8))[:n].astype(bool)] = pd.NA
    held = np.unpackbits(np.frombuffer(r.held, np.uint8))[:n].astype(bool)
    return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": _unpack(r.lens, np.int64, n), "n_known": out[2].astype(np.int64), "base_score": out[0], "score": out[1]})


def _evenly(spark: SparkSession, buckets: int) -> np.ndarray:
    """A key for each bucket, such that Spark's hash deals each to a partition of its own of as many."""
    keys = spark.range(buckets * (20 + buckets.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    out, free = np.full(buckets, -1, np.int64), iter(range(buckets * (20 + buckets.bit_length()), 1 << 62))
    out[[r.p for r in keys]] = [r.id for r in keys]
    out[out < 0] = [next(free) for _ in range((out < 0).sum())]
    return out


def _rooted(asked: DataFrame) -> tuple[DataFrame, tuple]:
    """The answers to what buckets asked, and the root's totals, seated by Gibbs draws: tokens, known words, customers, tables, and with
    what the last draw was given, so that each bucket can draw the same."""
    answers = store(asked.filter("wb >= 0").groupBy("wb").applyInPandas(_answer, ASKED))
    whole = answers.filter("bucket = -1").select("n", "words", "c", "m")
    add = lambda f: [x or 0.0 for x in whole.mapInArrow(f, "a double, b double, c double").agg(F.sum("a"), F.sum("b"), F.sum("c")).first()]
    n, v, all_m = map(int, add(_totals()))
    all_t = float(v)
    for no in range(3):
        last = all_t
        all_t = add(_totals(v, last, no))[0]
    return answers, (n, v, all_m, all_t, last, no)


def score(docs: DataFrame, held_out, bucket_chars: int = 8 << 20, burn: int = 4, samples: int = 6, hot: int | None = None) -> DataFrame:
    """held_out: a column. (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    sign = F.floor(remainder(640) / 10).cast("int")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"), sign.alias("sign"))
    chars, rows = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    about = chars // 6 + rows  # tokens, roughly
    spark = docs.sparkSession
    buckets, hot = max(12, math.ceil(chars / bucket_chars)), hot or max(1 << 18, about >> 20)
    often = d.mapInArrow(_frequent(hot / 4 / max(about, 1)), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).filter(F.col("c") >= hot).collect()
    classes = Hot(np.array([r.w for r in often], np.int64).view(np.uint64), np.array([r.c for r in often], np.int64), hot)
    keys = _evenly(spark, buckets)
    asked = store(d.mapInArrow(_deal(keys, classes, False), PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_ask(buckets), ASKED))
    answers, root = _rooted(asked)
    forget(asked)
    given = answers.filter("bucket >= 0")
    if burn:
        dealt = d.mapInArrow(_deal(keys, classes, True, False), PACKED).repartition(buckets, "bucket")
        burnt = store(dealt.groupBy("bucket").cogroup(given.repartition(buckets, "bucket").groupBy("bucket")).applyInPandas(_burn(root, burn, buckets), ASKED))
        forget(answers)
        answers, root = _rooted(burnt)
        seats = store(burnt.filter("wb < 0"))
        forget(burnt)
        given = answers.filter("bucket >= 0").unionByName(seats)
    dealt = d.mapInArrow(_deal(keys, classes, True), PACKED).repartition(buckets, "bucket")
    told = store(dealt.groupBy("bucket").cogroup(given.repartition(buckets, "bucket").groupBy("bucket")).applyInPandas(_score(root, burn, samples, buckets), TOLD))
    forget(answers, *[seats] if burn else [])
    out = told.groupBy("batch").applyInPandas(_total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(root[0]).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder(10) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
