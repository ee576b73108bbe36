"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items' words has a state for each set of substrings that end at the same places.
A document's words run through it, and at each word the automaton knows the longest stretch ending
there that is part of some item. Stretches of ``window`` words, and whole items that are shorter, are
benchmark passages. Documents aren't shuffled: each task streams its rows past the automaton.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.batches import add_columns
from graphrecon.session import materialize

WINDOW = 13
#: Words of one automaton (some 300 bytes a word in each Python worker); more items go in turns.
BLOCK_WORDS = 500_000

# Words are runs of 0-9, a-z and all beyond ASCII, after A-Z have become a-z. In UTF-8 every byte of
# a character beyond ASCII is 0x80 or more, so single bytes decide.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items that hold each window."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}  # item ids by the state of each prefix
        whole: dict[int, set[str]] = {}  # by the state of a whole short item
        shortest = window
        kept = [(name, [self.words.setdefault(w, len(self.words) + 1) for w in words]) for name, words in items]
        for name, ids in kept:
            last = 0
            for word in ids:
                last = self._extend(last, word)
                if name is not None:
                    ends.setdefault(last, set()).add(name)
            if 0 < len(ids) < window:
                whole.setdefault(last, set()).update([] if name is None else [name])
                shortest = min(shortest, len(ids))
        self.shortest = shortest
        # From long states to short: a state has the items of all states that link to it. Only those
        # at which a window ends, the first of length ``window`` on a path of links, are asked for.
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for state in order:
            above = self.link[state]
            if above > 0 and self.length[above] >= window and state in ends:
                ends.setdefault(above, set()).update(ends[state])
        self.base = [0] * len(self.link)  # the state that holds the window ending here
        self.items: dict[int, frozenset] = {}
        self.short = [0] * len(self.link)  # the nearest state, here or above, of a whole short item
        for state in reversed(order):
            above = self.link[state]
            if self.length[state] >= window:
                self.base[state] = self.base[above] or state
                if self.base[state] == state:
                    self.items[state] = frozenset(ends.get(state, ()))
            self.short[state] = state if state in whole else self.short[above]
        self.whole = {s: frozenset(names) for s, names in whole.items()}

    def _extend(self, last: int, word: int) -> int:
        """The state after ``word``, for one more item where the path may be there already."""
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, word, known)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            fits = self.length[there] == self.length[at] + 1
            self.link[new] = there if fits else self._clone(at, word, there)
        return new

    def _clone(self, at: int, word: int, state: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[state]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[state])
        self.link[state] = copy
        while at >= 0 and self.next[at].get(word) == state:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside benchmark passages (disjoint, in order), and the items met."""
        get, window, shortest = self.words.get, self.window, self.shortest
        ids = [get(w, 0) for w in words]
        spans: list[tuple[int, int]] = []
        met: set[str] = set()
        if shortest > len(ids) or not self.words:
            return spans, met
        following, link, length = self.next, self.link, self.length
        base, short, items, whole = self.base, self.short, self.items, self.whole
        # A stretch ends at the next word that no item has; shorter ones than any window can't matter.
        start, total = 0, len(ids)
        while start < total:
            try:
                stop = ids.index(0, start)
            except ValueError:
                stop = total
            if stop - start >= shortest:
                state = matched = 0
                for at in range(start, stop):
                    word = ids[at]
                    step = following[state].get(word)
                    while step is None and state:
                        state = link[state]
                        matched = length[state]
                        step = following[state].get(word)
                    if step is None:
                        continue
                    state, matched = step, matched + 1
                    if matched < shortest:
                        continue
                    size = 0
                    if matched >= window:
                        size = window
                        met |= items[base[state]]
                    # Of the state itself only lengths up to ``matched`` end here.
                    inner = short[state]
                    while inner and length[inner] > matched:
                        inner = short[link[inner]]
                    while inner:
                        size = max(size, length[inner])
                        met |= whole[inner]
                        inner = short[link[inner]]
                    if size:
                        low = at + 1 - size
                        while spans and spans[-1][1] >= low:
                            low = min(low, spans.pop()[0])
                        spans.append((low, at + 1))
            start = stop + 1
        return spans, met


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    names: tuple[str, str, str] = ("n_words", "spans", "items_met"),
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word ranges inside benchmark passages) and ``items_met``.

    Null and empty texts, of documents and items alike, have no words and no spans. Items of one
    text all count; a null item id marks spans but isn't listed. Repeated documents are judged
    each. Without items, or with an empty table, nothing is met. Columns of ``docs`` named like an
    added one (``names`` gives others) are replaced.

    Items up to ``block_words`` words (counted first) are one automaton, sent to every task. More
    of them are split into blocks by a hash, and each block in turn runs over all documents, the result
    written between two turns; so a task holds one block at any time, whatever the items' number.
    """
    named = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (4 * block_words)))  # four characters a word, at least, on average
    added = dict(zip(names, ("long", "array<struct<a:int,b:int>>", "array<string>")))
    rows = docs
    for block in range(blocks):
        mine = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        held = [(r["id"], words_of(r["text"])) for r in mine.toLocalIterator()]
        built: list[Automaton] = []  # by the first lot of a task

        def run(texts, before=None, met_before=None, held=held, built=built):
            if not built:
                built.append(Automaton(held, window))
            counts, spans, met = [], [], []
            for at, text in enumerate(texts):
                words = words_of(text)
                found, names = built[0].match(words)
                if before is not None:
                    found = _merged([*found, *((s["a"], s["b"]) for s in before[at])])
                    names |= set(met_before[at])
                counts.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in found])
                met.append(sorted(names))
            return counts, spans, met

        rows = add_columns(rows, [text, *names[1:]] if block else [text], added, run)
        if block + 1 < blocks:
            rows = materialize(rows)
    return rows


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))


def contaminated(n_hit, n_words, share: int = 20):
    """The rule: some words are hit, and they are a ``1 / share`` of all words or more."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    share: int = 20,
    longest: int | None = None,
    window: int = WINDOW,
    **options,
) -> DataFrame:
    """``docs`` without contaminated documents, and without overlong benchmark spans in the others.

    A document goes whole if its hit words reach ``1 / share`` of its words. In the ones that stay,
    spans of ``longest`` words or more are cut from the text, with what stands between their words; None leaves the
    texts as they are. Edge cases: see ``benchmark_matches``.
    """
    columns = docs.columns
    names = ("__n_words", "__spans", "__items_met")
    found = benchmark_matches(docs, items, text, window=window, names=names, **options)
    stay = found.where(~contaminated(hit_words(F.col("__spans")), F.col("__n_words"), share))
    if longest is not None:

        def cut(texts, spans):
            long = [[(s["a"], s["b"]) for s in own if s["b"] - s["a"] >= longest] for own in spans]
            return [[without_words(t, own) if own else t for t, own in zip(texts, long)]]

        stay = add_columns(stay, [text, "__spans"], {text: "string"}, cut)
    return stay.select([F.col(f"`{c}`") for c in columns])


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, each from its first word's start to its last one's end."""
    data = text.encode("utf-8", "surrogatepass")
    plain, places, at = data.translate(_BYTES), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, since = [], 0
    for a, b in spans:
        out.append(data[since : places[a][0]])
        since = places[b - 1][1]
    return b"".join([*out, data[since:]]).decode("utf-8", "surrogatepass")


def item_digest(items) -> F.Column:
    """Lowercase hex SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
