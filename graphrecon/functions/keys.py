"""Keys: undirected pairs, stable random order, rounding of reported numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 60


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def canonical(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Replace the columns ``a, b`` by ``u <= v``."""
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(
        F.least(F.col(a), F.col(b)).alias("u"), F.greatest(F.col(a), F.col(b)).alias("v"), *rest
    )


def order_key(seed: int, role: str, *parts: Column) -> Column:
    """Uniform 60-bit key of (seed, role, parts): the same on every engine and every rerun.

    The first 15 hex digits of an md5, read as a number. Sorting by it shuffles; the
    top bits cut the table into even slices without looking at the data.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(role), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


#: Pairs whose keys are made at once, and the longest text whose md5 is one block.
_PAIRS_AT_ONCE, _ONE_BLOCK = 32768, 55
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORDS = [(1, 0), (5, 1), (3, 5), (7, 0)]  # of the block, that the steps of a round take


def chosen_pairs(seed: int, role: str, left: Sequence, right: Sequence, share: float) -> np.ndarray:
    """For each pair of two id lists whether ``order_key(seed, role, lesser, greater)`` is in the first ``share``.

    For tasks that hold blocks of ids and form no row per pair. Texts of one block are hashed side by side.
    """
    limit = np.uint64(int(share * 2**KEY_BITS))
    names = [str(i).encode() for i in (*left, *right)]
    rank = {i: n for n, i in enumerate(sorted({*left, *right}))}
    place = np.array([rank[i] for i in (*left, *right)])
    heads, size = [f"{seed}|{role}|".encode() + n + b"|" for n in names], np.array([len(n) for n in names])
    turned = place[: len(left), None] >= place[None, len(left) :]
    chosen = np.zeros(turned.shape, bool)
    for before, after in {(a, b) for a in set(size[: len(left)].tolist()) for b in set(size[len(left) :].tolist())}:
        rows, columns = np.flatnonzero(size[: len(left)] == before), np.flatnonzero(size[len(left) :] == after)
        for swap in (False, True):
            at_a, at_b = np.nonzero(turned[np.ix_(rows, columns)] == swap)
            at_a, at_b = rows[at_a], columns[at_b]
            first, second = (at_b + len(left), at_a) if swap else (at_a, at_b + len(left))
            start = len(heads[0]) - len(names[0]) + (after if swap else before)
            keys = _md5_keys(heads, names, first, second, start, before + after + start - (after if swap else before))
            chosen[at_a, at_b] = keys >> np.uint64(64 - KEY_BITS) < limit
    return chosen


def _md5_keys(heads: list[bytes], tails: list[bytes], first: np.ndarray, second: np.ndarray, start: int, length: int) -> np.ndarray:
    """First 64 bits of the md5 of ``heads[first] + tails[second]``; all these heads have ``start`` bytes, the whole texts ``length``."""
    if length > _ONE_BLOCK:
        begun = {h: hashlib.md5(heads[h], usedforsecurity=False) for h in set(first.tolist())}
        found = []
        for h, t in zip(first.tolist(), second.tolist()):
            one = begun[h].copy()
            one.update(tails[t])
            found.append(one.digest()[:8])
        return np.frombuffer(b"".join(found), ">u8").astype(np.uint64)

    def blocks(texts: list[bytes], wanted: np.ndarray, make: Callable[[bytes], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words, and for each text its place there."""
        used = np.unique(wanted)
        place = np.zeros(len(texts), np.int32)
        place[used] = np.arange(len(used))
        table = np.frombuffer(b"".join(make(texts[k]).ljust(64, b"\0") for k in used.tolist()), "<u4").reshape(-1, 16)
        return np.ascontiguousarray(table.T), place[wanted]

    end = b"\x80" + bytes(_ONE_BLOCK - length) + (8 * length).to_bytes(8, "little")
    keys = np.empty(len(first), np.uint64)
    if not len(first):
        return keys
    (front, first), (back, second) = blocks(heads, first, lambda text: text), blocks(tails, second, lambda text: bytes(start) + text + end)
    same = [(front[k] == front[k, 0]).all() and (back[k] == back[k, 0]).all() for k in range(16)]
    for at in range(0, len(first), _PAIRS_AT_ONCE):
        i, j = first[at : at + _PAIRS_AT_ONCE], second[at : at + _PAIRS_AT_ONCE]
        words = [front[k, 0] | back[k, 0] if same[k] else front[k][i] | back[k][j] for k in range(16)]
        keys[at : at + len(i)] = _md5_heads(words, len(i))
    return keys


def _md5_heads(words: list[np.ndarray | np.uint32], count: int) -> np.ndarray:
    """First 64 bits of the md5 of ``count`` blocks, given as their sixteen words (one number: the same in all blocks)."""
    begun = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(count, x) for x in begun)
    spare, other = np.empty_like(a), np.empty_like(a)
    for step in range(64):
        turn = step // 16
        if turn == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=spare), b, out=spare)
            np.bitwise_xor(spare, d, out=spare)
        elif turn == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=spare), d, out=spare)
            np.bitwise_xor(spare, c, out=spare)
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=spare), d, out=spare)
        else:
            np.bitwise_or(np.bitwise_not(d, out=spare), b, out=spare)
            np.bitwise_xor(spare, c, out=spare)
        factor, offset = _WORDS[turn]
        np.add(a, spare, out=a)
        np.add(a, words[(factor * step + offset) % 16], out=a)
        np.add(a, np.uint32(_SINES[step]), out=a)
        by = _TURNS[turn][step % 4]
        np.left_shift(a, np.uint32(by), out=other)
        np.right_shift(a, np.uint32(32 - by), out=a)
        np.bitwise_or(a, other, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, begun[0]), (b, begun[1])))
    return high << np.uint64(32) | low


def random_positions(size: Column, want: Column, *seed: Column) -> Column:
    """``want`` or more distinct positions out of ``0 .. size-1`` in random order, as an array.

    A small range is shuffled whole. In a large one, drawing with replacement and keeping first
    occurrences gives the same law as a shuffle; four draws per wanted position leave no
    realistic chance of falling short (a range above 4*want loses under half of them).
    The array is at most ``4 * want`` long, whatever ``size`` is.
    """
    size, draws = size.cast("bigint"), (want * 4).cast("bigint")
    zero = F.lit(0).cast("bigint")
    shuffled = F.transform(
        F.array_sort(
            F.transform(
                F.sequence(zero, F.least(size, draws) - 1),
                lambda i: F.struct(F.xxhash64(*seed, i).alias("h"), i.alias("i")),
            )
        ),
        lambda s: s["i"],
    )
    drawn = F.array_distinct(
        F.transform(F.sequence(zero, draws - 1), lambda j: F.pmod(F.xxhash64(*seed, j), size))
    )
    empty = F.array().cast("array<bigint>")
    usable = (size > 0) & (draws > 0)
    return F.when(~usable, empty).when(size <= draws, shuffled).otherwise(drawn)


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for a report; adding zero turns a negative zero into a plain one."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named twice, or inside an array lambda, would be computed anew each time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
