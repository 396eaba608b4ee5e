"""Evaluation passages that stand in corpus documents (problem 8).

Method: one Aho-Corasick automaton over the normalised passages, questions and answers of the test items (runs of a few words, squeezed to letters and
digits) scans each document once; every hit is extended word by word in both directions, and offsets are mapped
back to the original text.

With at most one changed word in eight, 25 words in a row hold at least 22 unchanged ones in at most four runs, so
one run has six words or more: seeds of five words miss no case. From a seed the passage is aligned with the document
in both directions, change by change: each changed, missing or added word counts once, wherever it stands.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeate.session import kept_by_worker

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[A-Za-z]+|#\d+);")
_NOT_ALNUM = re.compile(r"[\W_]+")
_GAP = re.compile(r"\s|<|&nbsp;|&#160;")


def squeeze(text: str) -> str:
    """Letters and digits only, lower case, without tags and entities: case, punctuation, spacing and markup gone."""
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else "", text)
    return _NOT_ALNUM.sub("", text.lower())


def offsets(text: str) -> list[int]:
    """Place in the original of each character of the squeezed text."""
    out, at = [], 0
    marks = [(m.start(), m.end(), squeeze(m[0])) for m in _TAG.finditer(text)]
    plain = len(text.lower()) == len(text)  # else a character has a longer lower case
    for a, b, inner in [*marks, (len(text), len(text), "")]:
        if plain:
            out += [k for k in range(at, a) if text[k].isalnum()]
        else:
            for k in range(at, a):
                out += [k] * len(_NOT_ALNUM.sub("", text[k].lower()))
        out += [a] * len(inner)
        at = b
    return out


def passage_words(text: str) -> list[str]:
    return [w for w in (squeeze(x) for x in text.split()) if w]


#: Parts of a test item. Of a passage ``least_words`` words in a row count, of a question or an answer all of them.
PARTS = ("passage", "question", "answer")


class PassageIndex:
    """Automaton over runs of ``seed`` words of each test text; ``rows`` are (item_id, text) or (item_id, text, part).

    Questions and answers of fewer than ``seed`` words are not looked for: they say nothing by themselves.
    """

    def __init__(self, rows: list[tuple], least_words: int = 25, change_every: int = 8, seed: int = 5):
        self.every = change_every
        self.words: list[list[str]] = []
        self.items: list[int] = []
        self.parts: list[str] = []
        self.least: list[int] = []
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for item, text, *part in rows:
            words = passage_words(text or "")
            least = least_words if part in ([], ["passage"]) else max(seed, len(words))
            if len(words) < least:
                continue
            whole = least == len(words)
            self.least.append(least)
            self.parts.append(part[0] if part else "passage")
            # where all words count, one of (changes + 1) pieces is unchanged; else any run of seed words may be
            pieces = len(words) // change_every + 1
            cuts = [len(words) * k // pieces for k in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]) if whole else ((j, j + seed) for j in range(len(words) - seed + 1)):
                seeds.setdefault("".join(words[a:b]), []).append((len(self.words), a))
            self.words.append(words)
            self.items.append(item)
        self.seed = seed
        for text, places in seeds.items():
            self.automaton.add_word(text, (len(text), tuple(places)))
        if seeds:
            self.automaton.make_automaton()
        self.pairs = [[a + b for a, b in zip(words, words[1:])] for words in self.words]
        self.back = [[w[::-1] for w in words[::-1]] for words in self.words]

    def _extend(self, words: list[str], doc: str, j: int, pos: int, bounds: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
        """``(words followed, end)`` from word j on with 0, 1, 2, ... changes: the furthest that the document follows.

        Unchanged words are always followed at once; a change replaces a word by one of the document (up to the next
        boundary), leaves it out or adds one. Where boundaries are lost, the next three words show where it goes on.
        """
        first, n, most = j, len(words), len(words) // self.every
        level, seen, out = [(j, pos, pos)], set(), []
        for c in range(most + 1):
            ends, ahead = [], {}
            for j, pos, end in level:
                while j < n and doc.startswith(words[j], pos):
                    pos += len(words[j])
                    j, end = j + 1, pos
                if (j, pos) not in seen:
                    seen.add((j, pos))
                    ends.append((j, pos, end))
            out.append(max([(j - first, end) for j, _, end in ends] + out[-1:]))
            if out[-1][0] == n - first or c == most:
                break
            for j, pos, end in ends:
                stops = {b[k] for b in bounds if (k := bisect_right(b, pos)) < len(b)}
                level_next = [(j + 1, pos, end), *((j + 1, x, end) for x in stops), *((j, x, end) for x in stops)]
                for k in (0, 1):
                    look = "".join(words[j + k : j + k + 3])
                    if len(look) >= 5 and (at := doc.find(look, pos, pos + 24 * (k + 1) + len(look))) >= 0:
                        level_next.append((j + k, at, end))
                for x in level_next:
                    if x[0] <= n:
                        ahead[x[:2]] = x
            level = list(ahead.values())
        return out

    def _best(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> tuple[int, int, int, int]:
        """(words, changed, end to the left, end to the right) of the longest window that keeps the share of changes."""
        best = (0, 0, 0, 0)
        for a, (n, back) in enumerate(left):
            for b, (m, stop) in enumerate(right):
                if (a + b) * self.every <= n + m and (n + m, -a - b) > (best[0], -best[1]):
                    best = (n + m, a + b, back, stop)
        return best

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, words, changed, start, end)`` per leaked text, with offsets in the original text."""
        return [hit[:1] + hit[2:] for hit in self.find_parts(text)]

    def find_parts(self, text: str) -> list[tuple[int, str, int, int, int, int]]:
        """The same with the part of the item: ``(item_id, part, words, changed, start, end)``."""
        if not len(self.automaton):
            return []
        doc = squeeze(text)
        seeds: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(doc):
            for which, j in places:
                seeds.setdefault(which, []).append((end + 1 - length, j))
        # a change breaks at most two pairs of neighbours, the others stand in the document: a cheap look before the alignment
        for which in [*seeds]:
            need = self.least[which] - 1 - 2 * (self.least[which] // self.every)
            if sum(pair in doc for pair in self.pairs[which]) < need:
                del seeds[which]
        if not seeds:
            return []
        where, rev = offsets(text), doc[::-1]
        gaps = [k for k in range(1, len(where)) if where[k] - where[k - 1] > 1]
        wide = [k for k in gaps if _GAP.search(text, where[k - 1], where[k])]
        forth = tuple([*x, len(doc)] for x in (gaps, wide))
        back_to = tuple([*(len(doc) - k for k in reversed(x)), len(doc)] for x in (gaps, wide))
        out = []
        for which, hits in seeds.items():
            words, best, done = self.words[which], (0, 0, 0, 0), set()
            for pos, j in sorted(hits):
                if (pos, j) in done:  # on an unchanged run that has been extended
                    continue
                right = self._extend(words, doc, j, pos, forth)
                if right[-1][0] + j < self.least[which]:  # too short, however much fits to the left
                    continue
                left = self._extend(self.back[which], rev, len(words) - j, len(doc) - pos, back_to)
                at = pos
                for k in range(j, j + right[0][0]):
                    done.add((at, k))
                    at += len(words[k])
                got = self._best(left, right)
                if (got[0], -got[1]) > (best[0], -best[1]):
                    best = got
            if best[0] >= self.least[which]:
                out.append((self.items[which], self.parts[which], best[0], best[1], len(doc) - best[2], best[3]))
        return sorted((i, p, w, c, where[a], where[b - 1] + 1) for i, p, w, c, a, b in out)


_OUT = "doc_id long, item_id long, part string, words int, changed int, start int, stop int"


def item_texts(items: DataFrame) -> DataFrame:
    """``(item_id, text, part)`` of test items with passage, question and answer."""
    return items.select("item_id", F.explode(F.array(*[F.struct(F.col(p).alias("text"), F.lit(p).alias("part")) for p in PARTS])).alias("t")).select("item_id", "t.text", "t.part")


def find_leaks(documents: DataFrame, items: DataFrame, least_words: int = 25, change_every: int = 8, max_items: int = 100_000) -> DataFrame:
    """``(doc_id, item_id, part, words, changed, start, stop)``: a document holds that many words of the item's text.

    ``items`` has item_id, text and, if not all are passages, part (see `item_texts`). The texts are broadcast and the
    automaton is built once per worker from at most ``max_items`` of them (checked by a count); more are scanned in blocks
    of that size, one after the other. Of a passage ``least_words`` words in a row are a leak, of a question or an
    answer all words, each with one change in ``change_every``. Null texts give nothing, repeated documents count each,
    whole texts are scanned, empty tables give an empty result. No shuffle.
    """
    part = F.col("part") if "part" in items.columns else F.lit("passage")
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"), part.alias("part")).where("text is not null")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text is not null")
    n_blocks = max(1, -(-listed.count() // max_items))

    def scan(block: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, sorted((tuple(r) for r in block.collect()), key=str)))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            token, rows = shared.value
            index = kept_by_worker(token, lambda: PassageIndex(rows, least_words, change_every))
            for batch in batches:
                out = [(i, *hit) for i, text in zip(batch["doc_id"], batch["text"]) for hit in index.find_parts(text)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "part", "words", "changed", "start", "stop"])

        return docs.mapInPandas(work, _OUT)

    blocks = [listed] if n_blocks == 1 else [listed.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(n_blocks)) == k) for k in range(n_blocks)]
    return reduce(DataFrame.unionByName, [scan(b) for b in blocks])
