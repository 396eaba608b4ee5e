"""Oversized texts split at natural boundaries (problem 7).

Method: structure-tree packing. The text is parsed into a tree (headings, blank-line blocks, lines, sentences,
clauses, words); sibling subtrees are merged bottom-up to the limit and only nodes above the limit are descended
into. A word above the limit is cut by force. Consecutive pieces share an overlap that begins at a word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Levels of the structure tree from coarse to fine; a cut goes behind each match.
_LEVELS = (
    ("section", re.compile(r"\n+(?=[ \t]*(?:#{1,6} |\d+(?:\.\d+)*\.? +[A-Z][^\n.]{0,80}\n|[A-Z][^\n.:]{2,80}\n[=\-]{3,}))")),
    ("block", re.compile(r"\n[ \t]*\n\s*")),
    ("item", re.compile(r"\n(?=[ \t]*(?:[-*•]|\d+[.)]|>|<(?:li|p|tr|h\d)\b))")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…][\"'”’)\]]*(?:\s+|(?=[A-Z][a-z]))|[。！？]")),
    ("clause", re.compile(r"[;:,–—][ \t]+|[;|]")),
    ("word", re.compile(r"[ \t\n]+")),
)


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    boundary: str


def _spans(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    """Children of a node at one level; clause marks inside a word without blanks are no boundary."""
    name, mark = _LEVELS[level]
    cuts = [start]
    for m in mark.finditer(text, start, end):
        at = m.end()
        if name == "clause" and not text[at - 1].isspace():
            continue
        if start < at < end and at > cuts[-1]:
            cuts.append(at)
    return list(zip(cuts, cuts[1:] + [end]))


def _pack(text: str, start: int, end: int, limit: int, level: int, out: list[Piece]) -> None:
    """Merge siblings bottom-up to the limit, descend only into the oversized ones."""
    if end - start <= limit:
        out.append(Piece(start, end, "whole"))
        return
    if level == len(_LEVELS):
        for a in range(start, end, limit):
            out.append(Piece(a, min(a + limit, end), "forced"))
        return
    spans = _spans(text, start, end, level)
    if len(spans) == 1:
        _pack(text, start, end, limit, level + 1, out)
        return
    held: tuple[int, int] | None = None
    for a, b in spans:
        if held and b - held[0] <= limit:
            held = (held[0], b)
            continue
        if held:
            out.append(Piece(*held, _LEVELS[level][0]))
            held = None
        if b - a <= limit:
            held = (a, b)
        else:
            _pack(text, a, b, limit, level + 1, out)
    if held:
        out.append(Piece(*held, _LEVELS[level][0]))


def _merge(pieces: list[Piece], limit: int) -> list[Piece]:
    """Neighbours that fit together become one piece again (leftovers of descended nodes)."""
    out: list[Piece] = []
    for p in pieces:
        if out and p.end - out[-1].start <= limit:
            out[-1] = Piece(out[-1].start, p.end, p.boundary)
        else:
            out.append(p)
    return out


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """Pieces ``(start, own_start, end, boundary)`` in code points; ``text[start:end]`` has at most ``limit``.

    ``own_start`` is where the piece continues the one before, ``start`` up to ``overlap`` earlier, moved forward
    to the begin of a word (inside a forced cut it is exact). The own parts are the text without gap. A text within
    the limit is one piece. ``boundary`` tells what the piece ends at; ``forced`` cuts inside a word happen only
    where a word (no space, tab or newline) is longer than the limit.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap below it")
    if len(text) <= limit:
        return [(0, 0, len(text), "whole")]
    body = limit - overlap
    pieces: list[Piece] = []
    _pack(text, 0, len(text), body, 0, pieces)
    pieces = _merge(_unforce(text, pieces, body, limit), body)
    starts = [m.end() for m in re.finditer(r"[ \t\n]+", text)]
    out = []
    for k, p in enumerate(pieces):
        begin = p.start
        if k:
            reach = min(overlap, limit - (p.end - p.start))
            low = max(pieces[k - 1].start, p.start - reach)
            at = bisect_left(starts, low)
            if at < len(starts) and starts[at] < p.start:
                begin = starts[at]
            elif pieces[k - 1].boundary == "forced":
                begin = low
        out.append((begin, p.start, p.end, p.boundary))
    # a cut at a mark inside an oversized word is still a cut inside the word
    words = [m.span() for m in re.finditer(r"[^ \t\n]{%d,}" % (limit + 1), text)]
    return [(s, own, e, "forced" if any(a < e < b for a, b in words) else "word" if how == "forced" else how) for s, own, e, how in out]


def _unforce(text: str, pieces: list[Piece], body: int, limit: int) -> list[Piece]:
    """Words between ``body`` and ``limit`` long need no cut: they stand alone, without overlap."""
    out: list[Piece] = []
    k = 0
    while k < len(pieces):
        if pieces[k].boundary != "forced":
            out.append(pieces[k])
            k += 1
            continue
        j = k
        while j + 1 < len(pieces) and pieces[j + 1].boundary == "forced" and not text[pieces[j].end - 1] in " \t\n":
            j += 1
        a, b = pieces[k].start, pieces[j].end
        word = len(text[a:b].rstrip(" \t\n"))
        if word > limit:
            out += pieces[k : j + 1]
        else:
            if word:
                out.append(Piece(a, a + word, "word"))
            out += [Piece(x, min(x + body, b), "word") for x in range(a + word, b, body)]
        k = j + 1
    return out


_OUT = "text_id long, doi string, chunk_index int, piece int, start int, own_start int, stop int, boundary string, cut string, piece_text string"


def split_oversized(texts: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of every text above the limit: ``text_id, doi, chunk_index, piece, start, own_start, stop, boundary, cut, piece_text``.

    Lengths are code points. Null, blank and short texts give no rows (JVM-side filter before Python), repeated rows
    are split each by themselves, extra columns are ignored, an empty table gives an empty result. No shuffle: a
    text is split where it lies, one at a time.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, doi, k, text in zip(batch["text_id"], batch["doi"], batch["chunk_index"], batch["chunk_text"]):
                pieces = split_text(text, limit, overlap)
                cut = "forced" if any(how == "forced" for *_, how in pieces) else "natural"
                for n, (a, own, b, how) in enumerate(pieces):
                    rows.append((i, doi if isinstance(doi, str) else None, None if pd.isna(k) else int(k), n, a, own, b, how, cut, text[a:b]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"chunk_index": "Int32"})

    big = texts.where(F.char_length("chunk_text") > limit).select(F.col("text_id").cast("long"), "doi", F.col("chunk_index").cast("int"), "chunk_text")
    return big.mapInPandas(work, _OUT)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """``(text_id, cut)``: ``forced`` if the row had to be cut inside a word, else ``natural``.

    Every piece carries the verdict of its row; the first one stands for it, so repeated ids stay apart and nothing
    is shuffled.
    """
    return pieces.where("piece = 0").select("text_id", "cut")
