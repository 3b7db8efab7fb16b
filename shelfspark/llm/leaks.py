"""Evaluation texts leaking into training text.

Only letters and digits count, without case, in the one form of look-alike text, so it doesn't matter how a
passage is set out. A passage of ``span`` letters with at most ``budget`` edits, split into budget + 1 pieces,
has one piece without an edit (pigeonhole). Pieces at every offset of every item go into an Aho-Corasick
automaton; each document is scanned once. An exact hit is a seed. A window with few edits has many pieces on
almost one diagonal: seeds in too thin company are left, which loses none. The others are verified by Myers'
bit-parallel distance, for many at once: first the 3 pieces' length that the passage must have on one side of the
seed, then every window of ``span`` letters that holds it. A passage that other text cuts into is put together
from fragments that follow each other in the item and in the document.

Items of one test share phrases in their own surroundings; that is the test's manner. A window is an item's
passage only if its edits are few beside the letters that aren't manner. Those are counted over all items,
whatever block an item is in. An item that stands twice, or is quoted by another, shares the surroundings too, so
its letters stay its own and each item whose passage it is comes out.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.run import cut as cut_lineage
from .lookalike import one_form

MARKUP = re.compile(r"<[^<>]{1,80}>|&(?:[a-z]{2,8}|#\d{1,6});", re.IGNORECASE)
_NOT_LETTERS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """The letters and digits of a text, without markup."""
    return _NOT_LETTERS.sub("", one_form(MARKUP.sub(" ", text)).lower())


def distances(bitmap: np.ndarray, start: np.ndarray, m: int, texts: np.ndarray) -> np.ndarray:
    """Myers' bit-parallel distance for many pairs: the least edits that turn the ``m`` (at most 64) letters from
    each start into some substring of its text. ``bitmap`` has a row of bits for each letter, set where it
    stands; the masks of a pattern are cut out of it. ``texts`` holds the letters' row numbers."""
    words = bitmap.shape[1]
    flat = bitmap.ravel()
    out = np.empty(len(start), np.int32)
    one, top, full = np.uint64(1), np.uint64(m - 1), np.uint64(2**m - 1 if m < 64 else 2**64 - 1)
    for lo in range(0, len(start), CHUNK):
        at = start[lo : lo + CHUNK] + 64  # the first word is empty, for starts before the first letter
        word, low = at >> 6, (at & 63).astype(np.uint64)
        high = np.uint64(63) - low
        t = np.ascontiguousarray(texts[lo : lo + CHUNK].T) * words
        pv, mv = np.full(len(at), full), np.zeros(len(at), np.uint64)
        score = np.full(len(at), m, np.int32)
        best = score.copy()
        for column in t:
            k = column + word
            eq = ((flat[k] >> low) | (flat[k + 1] << one << high)) & full
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> top) & one).view(np.int64).astype(np.int32)
            score -= ((mh >> top) & one).view(np.int64).astype(np.int32)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
        out[lo : lo + CHUNK] = best
    return out


def prefix_distances(bitmap: np.ndarray, start: np.ndarray, m: int, texts: np.ndarray) -> np.ndarray:
    """Myers' bit-parallel distance from an anchor: for each pair and each k up to ``m`` (at most 64), the least edits that turn
    the first k letters from the start into a beginning of the text. The vertical differences give all k at once."""
    flat, words = bitmap.ravel(), bitmap.shape[1]
    one, full = np.uint64(1), np.uint64(2**m - 1 if m < 64 else 2**64 - 1)
    out = np.empty((len(start), m + 1), np.int16)
    for lo in range(0, len(start), CHUNK):
        at = start[lo : lo + CHUNK] + 64
        word, low = at >> 6, (at & 63).astype(np.uint64)
        high = np.uint64(63) - low
        t = np.ascontiguousarray(texts[lo : lo + CHUNK].T) * words
        pv, mv = np.full(len(at), full), np.zeros(len(at), np.uint64)
        best = np.broadcast_to(np.arange(1, m + 1, dtype=np.int16), (len(at), m)).copy()
        for j, column in enumerate(t, 1):
            k = column + word
            eq = ((flat[k] >> low) | (flat[k + 1] << one << high)) & full
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            ph, mh = ph << one | one, mh << one
            pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
            step = np.unpackbits(pv.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :m].astype(np.int8)
            step -= np.unpackbits(mv.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :m].view(np.int8)
            score = np.cumsum(step, axis=1, dtype=np.int16)
            score += j
            np.minimum(best, score, out=best)
        out[lo : lo + CHUNK, 1:] = best
        out[lo : lo + CHUNK, 0] = 0
    return out


CHUNK, SEEDS = 4096, 500


def cut(codes: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Rows of ``length`` codes from each start; 0, which no item has, outside."""
    padded = np.concatenate([np.zeros(PAD, codes.dtype), codes, np.zeros(PAD + length, codes.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, length)[np.clip(start + PAD, 0, len(padded) - length)]


PAD = 256
SHORT, AROUND, OWN = 5, 10, 3  # letters of a phrase and on both sides of it; an edit needs OWN letters that aren't manner


def edits_between(a: str, b: str) -> int:
    """Levenshtein distance of two short texts."""
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def edits_at_start(a: str, b: str) -> list[int]:
    """For each length k, the least edits that turn the first k letters of ``a`` into a beginning of ``b``."""
    row, out = list(range(len(b) + 1)), [0]
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        out.append(min(row))
    return out


@dataclass
class Finder:
    """The items' side of a block: (key, letters, manner), ``manner`` the places whose ``SHORT`` letters are the test's
    manner. Built once in each worker process, from what was broadcast."""

    items: list[tuple]
    span: int = 50
    budget: int = 6
    gap: int = 400  # letters of other text that may cut into a passage
    least: int = 12  # letters of a fragment of a passage that other text cuts into
    piece: int = field(init=False)

    def __post_init__(self) -> None:
        self.piece = self.span // (self.budget + 1)
        self.name = uuid.uuid4().hex
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("items", "span", "budget", "gap", "least", "piece", "name")} | {"_ready": False}

    @property
    def reach(self) -> int:
        """No passage reaches further in a document: cuts close fragments of ``least`` letters, short of a span."""
        return self.span // self.least * (self.gap + 2 * self.piece) + 4 * self.span

    def prepare(self) -> None:
        import ahocorasick

        grams: dict[str, list[int]] = defaultdict(list)
        offset, at, parts = [], 0, []
        for _, text, *_ in self.items:
            offset.append(at)
            for i in range(len(text) - self.piece + 1):
                grams[text[i : i + self.piece]].append(at + i)
            parts.append(text)
            at += len(text) + 1  # one code between items
        self.joined = "\0".join(parts)
        self.length = len(self.joined)
        self.rows = {c: k for k, c in enumerate(sorted({*self.joined} - {"\0"}), 1)}
        self.table = np.zeros(0x110000, np.int32)
        for c, k in self.rows.items():
            self.table[ord(c)] = k
        spots = self.coded(self.joined)
        bits = np.zeros((len(self.rows) + 1, (self.length // 64 + 4) * 64), bool)
        bits[spots, np.arange(self.length) + 64] = spots > 0
        self.bitmap = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        bits = np.zeros_like(bits)
        bits[spots[::-1], np.arange(self.length) + 64] = spots[::-1] > 0
        self.reversed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.offset = np.array(offset or [0])
        self.ends = np.append(self.offset[1:] - 1, self.length)
        self.counts = np.array([len(x) for x in grams.values()] or [0])
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.where = np.array([i for x in grams.values() for i in x] or [0])
        own = np.ones(self.length + SHORT, np.int64)
        for start, (_, _, *manner) in zip(offset, self.items, strict=True):
            for i in manner[0] if manner else ():
                own[start + i : start + i + SHORT] = 0
        self.own = np.concatenate([[0], np.cumsum(own)])  # letters of the item's own, up to each place
        # Edits that each window may have, and the most of those of the windows that hold a piece
        start = np.arange(self.length + 1)
        item = np.searchsorted(self.offset, start, "right") - 1
        inside = start + self.span <= self.ends[item]
        may = self.own[np.minimum(start + self.span, self.length)] - self.own[start]
        self.may = np.where(inside, np.minimum(self.budget, may // OWN), -1)
        reach = self.span - self.piece + 1
        self.most = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(reach - 1, -1), self.may]), reach).max(axis=1)
        self.trie = ahocorasick.Automaton()
        for k, gram in enumerate(grams):
            self.trie.add_word(gram, k)
        if grams:
            self.trie.make_automaton()
        self._ready = bool(grams)

    def coded(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece of an item that stands in a text: text, place in the texts, place in the items."""
        hit_text, hit_end, hit_gram = [], [], []
        base = 0
        for k, text in enumerate(texts):
            for end, gram in self.trie.iter(text):
                hit_text.append(k)
                hit_end.append(base + end)
                hit_gram.append(gram)
            base += len(text) + 1
        gram = np.array(hit_gram, np.int64)
        n = self.counts[gram] if len(gram) else np.zeros(0, np.int64)
        text = np.repeat(np.array(hit_text, np.int64), n)
        place = np.repeat(np.array(hit_end, np.int64) - self.piece + 1, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item_at = self.where[np.repeat(self.firsts[gram], n) + inside] if len(gram) else np.zeros(0, np.int64)
        return text, place, item_at

    def runs(self, text: np.ndarray, place: np.ndarray, item_at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal exact runs of at least a piece: text, item, place in the items, in the texts, and length."""
        order = np.lexsort((item_at, place - item_at, text))
        text, place, item_at = text[order], place[order], item_at[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (place[1:] - item_at[1:] != place[:-1] - item_at[:-1]) | (item_at[1:] != item_at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text)) - 1
        item = np.searchsorted(self.offset, item_at[first], "right") - 1
        return text[first], item, item_at[first], place[first], item_at[last] - item_at[first] + self.piece

    def company(self, place: np.ndarray, item_at: np.ndarray, at_place: np.ndarray, at_item: np.ndarray, width: int) -> np.ndarray:
        """How many pieces at most stand within a span and ``width`` diagonals of each given one. Counted by cells."""
        rows = (len(self.joined) + int(place.max(initial=0)) + 2) // width + 4
        cell = lambda d, i: (i // self.span + 1) * rows + (d - i + self.length) // width + 1
        keys, n = np.unique(cell(place, item_at), return_counts=True)
        total = np.zeros(len(at_place), np.int64)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                key = cell(at_place, at_item) + a * rows + b
                k = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                total += np.where(keys[k] == key, n[k], 0) if len(keys) else 0
        return total

    def find(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text, item) by position, for texts of letters."""
        if not self._ready:
            self.prepare()
        if not self._ready:
            return set()
        p, span, budget = self.piece, self.span, self.budget
        every = self.hits(texts)
        if not len(every[0]):
            return set()
        text, item, i, d, n = self.runs(*every)
        joined = "\0".join(texts)
        codes = self.coded(joined)
        found = {*zip(text[n >= span].tolist(), item[n >= span].tolist(), strict=True)}
        # both ends of a run are seeds: a passage may end within it
        seed_i, seed_d = np.concatenate([i, i + n - p]), np.concatenate([d, d + n - p])
        pair = np.concatenate([text, text]) * len(self.items) + np.concatenate([item, item])
        keep = ~np.isin(pair, np.array([a * len(self.items) + b for a, b in found], np.int64))
        seed_i, seed_d, pair = seed_i[keep], seed_d[keep], pair[keep]
        # A window with e edits has span + 1 - p - p * e pieces or more, within e diagonals of each other. Twice the span, at twice
        # a span's edits and a third more, is plain whatever letters are manner, if it has the pieces that twice the budget leaves.
        most = self.most[seed_i]
        near_by = self.company(every[1], every[2], seed_d, seed_i, budget + 1)
        single = (most > 0) & (near_by >= span + 1 - p - p * most)
        both = self.company(every[1] // 2, every[2] // 2, seed_d // 2, seed_i // 2, budget + 2) >= 2 * span + 1 - p - 2 * p * budget
        keep = single | both
        seed_i, seed_d, pair = seed_i[keep], seed_d[keep], pair[keep]
        near = 3 * p
        left = distances(self.bitmap, np.maximum(seed_i - near + p, -64), near, cut(codes, seed_d - near + p - budget, near + budget))
        right = distances(self.bitmap, seed_i, near, cut(codes, seed_d, near + budget))
        keep = np.minimum(left, right) <= budget
        # Edits of a window are those left and right of its seed: one side may use up the budget, not both.
        seed_i, seed_d, pair = seed_i[keep], seed_d[keep], pair[keep]
        first = np.zeros(len(pair), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        order = np.argsort(~first, kind="stable")  # a seed of each pair first: most pairs need no other
        seed_i, seed_d, pair = seed_i[order], seed_d[order], pair[order]
        while len(pair):
            keep = ~np.isin(pair, np.array([a * len(self.items) + b for a, b in found], np.int64))
            seed_i, seed_d, pair = seed_i[keep], seed_d[keep], pair[keep]
            a, b, c = seed_i[:SEEDS], seed_d[:SEEDS], pair[:SEEDS]
            seed_i, seed_d, pair = seed_i[SEEDS:], seed_d[SEEDS:], pair[SEEDS:]
            # All windows that hold the seed: edits left of it and right of it
            m = span - p
            before = prefix_distances(self.reversed, self.length - a, m, cut(codes, b - m - budget, m + budget)[:, ::-1])
            behind = prefix_distances(self.bitmap, a + p, m, cut(codes, b + p, m + budget))
            edits = before + behind[:, ::-1]  # by the letters before the seed
            start = np.maximum(a[:, None] - np.arange(m + 1), 0)
            may = self.may[start]
            found |= self._pairs(c[(edits <= may).any(axis=1)])
            edits = np.where(may >= 0, edits, 4 * span)
            at = edits.argmin(axis=1)
            few = edits.min(axis=1) <= budget + 2
            start, begin, c, least = (a - at)[few], (b - at - budget)[few], c[few], edits.min(axis=1)[few]
            for step in (-span, span):
                good = least + self._edits(codes, start + step, begin + step - budget, c, 4) <= budget * 8 // 3
                found |= self._pairs(c[good])
        return found | self.pieced(joined, text, item, i, d, n, found)

    def _pairs(self, pair: np.ndarray) -> set[tuple[int, int]]:
        return {(int(x) // len(self.items), int(x) % len(self.items)) for x in np.unique(pair)}

    def _edits(self, codes: np.ndarray, start: np.ndarray, begin: np.ndarray, pair: np.ndarray, room: int = 2) -> np.ndarray:
        """Edits of the windows at ``start``; more than any budget where a window isn't within its item."""
        item = pair % len(self.items)
        ok = (start >= self.offset[item]) & (start + self.span <= self.ends[item])
        out = np.full(len(start), 4 * self.span)
        out[ok] = distances(self.bitmap, start[ok], self.span, cut(codes, begin[ok], self.span + room * self.budget))
        return out

    def pieced(self, joined: str, text, item, i, d, n, found: set[tuple[int, int]]) -> set[tuple[int, int]]:  # noqa: ANN001
        """Passages put together from fragments. A fragment is a chain of exact runs with a few edits between."""
        out: set[tuple[int, int]] = set()
        pair = text * len(self.items) + item
        order = np.lexsort((i, d, pair))
        uniq, inverse = np.unique(pair, return_inverse=True)
        total = np.bincount(inverse, n, len(uniq)) if len(pair) else np.zeros(0)
        own = np.bincount(inverse, self.own[i + n] - self.own[i], len(uniq)) if len(pair) else np.zeros(0)
        order = order[((total >= self.span // 2) & (own >= 2 * OWN))[inverse[order]]] if len(pair) else order
        for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
            who = int(pair[group[0]])
            key = (who // len(self.items), who % len(self.items))
            if key not in found and self._chains(joined, [(int(i[g]), int(d[g]), int(n[g])) for g in group]):
                out.add(key)
        return out

    def _chains(self, joined: str, runs: list[tuple[int, int, int]]) -> bool:
        """Whether runs (place in items, in texts, length; in order of the text) chain to a passage of span letters.

        A run keeps its best state for each number of edits: letters, where its fragment began, cuts, own letters of
        the fragments before. Only runs that end within ``gap`` before another can lead to it.
        """
        p, scrap = self.piece, 2 * self.piece
        states: list[dict] = []
        far = self.gap + self.span + scrap
        low = 0
        for k, (i, d, n) in enumerate(runs):
            now = {(0, n >= self.least): (n, i, 0, 0)}
            while runs[low][1] < d - far:
                low += 1
            for j in range(low, k):
                pi, pd, pn = runs[j]
                skip, jump = i - pi - pn, d - pd - pn
                lap = max(0, -skip, -jump)  # runs may share letters
                if skip > scrap or lap >= min(n, pn) or jump > self.gap or (lap >= p and skip != jump):
                    continue
                ways = []
                if abs(jump - skip) <= self.budget:
                    if skip <= 0 or jump <= 0:
                        ways.append((max(abs(jump - skip), skip, 0), -1))
                    else:
                        ways.append((edits_between(self.joined[i - skip : i], joined[d - jump : d]), -1))
                if jump > 0 and skip > -p:
                    ways.append(self._scrap(joined, i, d, skip, jump))
                for cost, right in ways:
                    for (edits, _), (got, began, cuts, own) in states[j].items():
                        if edits + cost > self.budget:
                            continue
                        got += n - lap + max(skip, 0)
                        if right < 0:
                            new = (got - cost if cost < skip else got - max(skip, 0), began, cuts, own)
                        else:
                            if pi + pn + max(skip, 0) - right - began < self.least:
                                continue
                            new = (got - cost, i - right, cuts + 1, own + self._own(began, pi + pn))
                        key = (edits + cost, i + n - new[1] >= self.least)
                        if key not in now or new > now[key]:
                            now[key] = new
            for (edits, ok), (got, began, cuts, own) in now.items():
                if ok and cuts and got >= self.span and own + self._own(began, i + n) >= OWN * max(2, edits):
                    return True
            states.append(now)
        return False

    def _scrap(self, joined: str, i: int, d: int, skip: int, jump: int) -> tuple[int, int]:
        """The least edits of ``skip`` letters that lie at a cut, some before it and some behind, and how many behind."""
        if skip <= 0:
            return 0, 0
        a, room = self.joined[i - skip : i], min(jump, skip + 2)
        before = edits_at_start(a, joined[d - jump : d - jump + room])
        behind = edits_at_start(a[::-1], joined[d - room : d][::-1])
        return min((before[skip - k] + behind[k], k) for k in range(skip + 1))

    def _own(self, a: int, b: int) -> int:
        """A fragment's letters that are the item's own."""
        return int(self.own[b] - self.own[a])


def manner(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, places): where an item's ``SHORT`` letters also stand in another item in surroundings that it hasn't.

    Counted over all items: each item's distinct surroundings of a phrase against all there are.
    """
    t = F.col(text)
    at = F.sequence(F.lit(0), F.length(t) - SHORT)
    each = F.transform(at, lambda k: F.struct(k.alias("k"), F.xxhash64(F.substr(t, k + 1, F.lit(SHORT))).alias("g"), F.xxhash64(F.substr(t, F.greatest(k + 1 - AROUND, F.lit(1)), F.least(k, F.lit(AROUND)) + SHORT + AROUND)).alias("s")))
    rows = items.filter(F.length(t) >= SHORT).select(key, F.explode(each).alias("x")).select(key, "x.*")
    mine = rows.groupBy("g", key).agg(F.count_distinct("s").alias("mine"), F.collect_list("k").alias("at"))
    every = rows.groupBy("g").agg(F.count_distinct("s").alias("every"))
    shared = mine.join(every, "g").filter("mine < every").select(key, F.explode("at").alias("k"))
    return shared.groupBy(key).agg(F.array_sort(F.collect_list("k")).alias("places"))


def leaked_items(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = 50, budget: int = 6, block_letters: int = 400_000,
) -> DataFrame:
    """(doc_id, item_id): each document that holds ``span`` letters of an item's text with at most ``budget`` edits.

    The documents aren't shuffled: they are streamed past the automaton of the items. Items are the stated query
    set; their distinct texts go in blocks of about ``block_letters`` letters (a bound on what is broadcast), each
    block a pass over the corpus; the result doesn't depend on it. Null and empty texts match nothing; items shorter
    than ``span`` can't be found; items with one text all come out; a text of any length is read whole, in stretches
    that overlap by the longest passage; repeated rows give one row; other columns don't matter.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in (*documents.select(doc_id).schema, *items.select(item_id).schema)}
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).dropna().distinct()
    named = cut_lineage(named.select("item_id", letters_of("t").alias("t")).filter(F.length("t") >= span).withColumn("key", F.md5("t")))
    texts = named.groupBy("key").agg(F.max("t").alias("t"))
    sized = cut_lineage(texts.join(manner(texts, "key", "t"), "key", "left"))
    total = sized.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_letters))
    out = None
    for b in range(blocks):
        rows = sized.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        if not rows and (out is not None or b < blocks - 1):
            continue
        finder = spark.sparkContext.broadcast(Finder(sorted((r["key"], r["t"], r["places"] or []) for r in rows), span, budget))
        found = docs.mapInPandas(lambda batches, finder=finder: scan(batches, ready(finder.value)), f"doc_id {kinds[doc_id]}, key string")
        out = found if out is None else out.unionByName(found)
    return out.distinct().join(named.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()


@F.pandas_udf(T.StringType())
def letters_of(s: pd.Series) -> pd.Series:
    return s.map(letters)


_READY: dict[str, Finder] = {}


def ready(finder: Finder) -> Finder:
    """The finder as this worker process has built it; one is kept."""
    if finder.name not in _READY:
        _READY.clear()
        _READY[finder.name] = finder
    return _READY[finder.name]


STRETCH, BATCH = 40_000, 60_000


def scan(batches: Iterator[pd.DataFrame], finder: Finder, stretch: int = STRETCH) -> Iterator[pd.DataFrame]:
    ids, texts, held = [], [], 0
    overlap = finder.reach

    def flush() -> pd.DataFrame:
        got = finder.find(texts)
        return pd.DataFrame([(ids[a], finder.items[b][0]) for a, b in got], columns=["doc_id", "key"]).drop_duplicates()

    for batch in batches:
        for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
            text = letters(text)
            for at in range(0, max(len(text) - overlap, 1), stretch):
                part = text[at : at + stretch + overlap]
                if len(part) < finder.piece:
                    continue
                ids.append(doc)
                texts.append(part)
                held += len(part)
                if held >= BATCH:
                    yield flush()
                    ids, texts, held = [], [], 0
    if texts:
        yield flush()
