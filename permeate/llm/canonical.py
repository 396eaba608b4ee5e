"""Free-entered values mapped to a canonical list (problem 2).

Method: one Aho-Corasick automaton over canonical names and aliases finds embedded mentions, the longest
non-overlapping one wins; values without a mention go to token-set similarity. Values the list does not hold are
reported with the id -1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from uuid import uuid4

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeate.session import cut, kept_by_worker

# Words that say nothing about which substance is meant.
FILLER = frozenset(
    "a an the of in to and for with used use see paper text analytical grade anhydrous solution solutions stock buffer "
    "detergent detergents solubilising solubilizing unknown final conc concentration total approx about ca pure purified "
    "ultrapure acs reagent powder salt hydrate monohydrate dihydrate tetrahydrate hexahydrate n a na none tbc other per "
    "litre liter millilitre milliliter micrograms percent molar millimolar micromolar nanomolar mm um nm m mol mmol umol nmol pmol l ml ul dl "
    "mg ug ng g kg v w vol wt dm m3 dm3 l1 ml1 mmoll h2o".split()
)
# Common chemical words. Where the list does not hold one, it is another substance and no misspelling.
CHEMICAL = frozenset(
    "lithium sodium potassium rubidium cesium caesium ammonium magnesium calcium strontium barium manganese iron cobalt nickel copper zinc cadmium silver mercury lead aluminium tin chromium "
    "fluoride chloride bromide iodide oxide hydroxide sulfide sulfate sulfite nitrate nitrite phosphate carbonate acetate formate citrate tartrate oxalate succinate malonate thiocyanate cyanide azide borate perchlorate "
    "methyl ethyl propyl butyl pentyl hexyl heptyl octyl nonyl decyl undecyl dodecyl tridecyl tetradecyl maltoside glucoside thiomaltoside thioglucoside galactoside "
    "methanol ethanol propanol isopropanol butanol glycerol glycol urea glycine alanine valine proline arginine lysine glucose fructose maltose sucrose trehalose raffinose lactose bicine tricine".split()
)
_FORMULA = re.compile(r"^(?=.*[A-Z].*[A-Z0-9])(?:[A-Z][a-z]?\d*|\(|\)\d*)+$")
_HYDRATE = re.compile(r"\s*[·•∙.*x×]\s*\d*\s*h\s*2\s*o\s*$", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}


def flat(text: str | None) -> str:
    """Compatibility form, lower case, Greek letters spelled out, quotes and underscores gone."""
    if text is None:
        return ""
    out = unicodedata.normalize("NFKC", text).lower()
    for letter, word in _GREEK.items():
        out = out.replace(letter, word)
    return re.sub(r"\s+", " ", re.sub(r"[\"'“”‘’_]+", " ", out)).strip()


def formula_key(text: str | None, keep_case: bool = False) -> str:
    """A formula without blanks, subscripts and crystal water."""
    if text is None:
        return ""
    out = _HYDRATE.sub("", unicodedata.normalize("NFKC", text).strip().strip("\"'"))
    out = re.sub(r"\s+", "", out)
    return out if keep_case else out.lower()


def tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1] if last[-1] <= most else most + 1


def allowed(length: int) -> int:
    """Edits a word of this length may be away from a list word."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


class Near:
    """Words of a table within some edits of a given one.

    An edit changes the counts of at most two letters by one, a swap none: comparing letter counts (one numpy step per
    length) leaves few words for the edit distance, and loses none.
    """

    _LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}

    def __init__(self, words: list[str]):
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        self.by = {n: (np.array([self.counts(w) for w in ws]), ws) for n, ws in by.items()}

    def counts(self, word: str) -> np.ndarray:
        out = np.zeros(len(self._LETTERS) + 1, dtype=np.int16)
        for c in word:
            out[self._LETTERS.get(c, -1)] += 1
        return out

    def within(self, word: str, most: int, tolerance) -> list[tuple[int, str]]:
        """``(edits, word)`` within ``most`` and within the ``tolerance`` of the found word's length."""
        mine, out = self.counts(word), []
        for length in range(len(word) - most, len(word) + most + 1):
            if length not in self.by:
                continue
            limit = min(most, tolerance(length))
            table, words = self.by[length]
            apart = table - mine
            far = np.maximum(np.where(apart > 0, apart, 0).sum(axis=1), np.where(apart < 0, -apart, 0).sum(axis=1))
            for k in np.flatnonzero(far <= limit):
                n = edits(word, words[k], limit)
                if n <= limit:
                    out.append((n, words[k]))
        return out


class CanonicalList:
    """The list with its automaton; ``match`` gives (ref_id, how, score) of a value with its fields.

    ``rows`` are (ref_id, name, formula, abbreviation). Ties between entries that fit equally well are broken by
    the other field of the value, then they count as not held (-1).
    """

    # Parts of systematic names that are left out in daily use: anomer and ring prefixes.
    _PREFIX = frozenset({"n", "beta", "b", "d", "alpha"})

    def __init__(self, rows: list[tuple[int, str | None, str | None, str | None]]):
        self.names: dict[str, set[int]] = {}
        self.short: dict[str, set[int]] = {}
        self.formulas: dict[str, set[int]] = {}
        self.exact_formulas: dict[str, set[int]] = {}
        self.words: dict[str, set[int]] = {}
        self.bags: dict[int, list[frozenset[str]]] = {}
        for ref, name, formula, short in rows:
            if name and name.strip():
                for form in self._forms(flat(name)):
                    self.names.setdefault(form, set()).add(ref)
                bag = frozenset(self._content(tokens(flat(name))))
                self.bags.setdefault(ref, []).append(bag)
                for w in bag:
                    self.words.setdefault(w, set()).add(ref)
            if short and short.strip():
                self.short.setdefault("".join(tokens(flat(short))), set()).add(ref)
            if formula and formula.strip():
                self.formulas.setdefault(formula_key(formula), set()).add(ref)
                self.exact_formulas.setdefault(formula_key(formula, True), set()).add(ref)
        self.automaton = ahocorasick.Automaton()
        for table in (self.names, self.short):
            for form, refs in table.items():
                known = self.automaton.get(form, None)
                self.automaton.add_word(form, (len(form), frozenset(refs) | (known[1] if known else frozenset())))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.near_words, self.near_names = Near(list(self.words)), Near(list(self.names))
        self.rows = {r[0]: r for r in rows}
        self.closest = lru_cache(100_000)(self._closest)
        self.field = lru_cache(100_000)(self._field)

    def _content(self, words: list[str]) -> list[str]:
        """Words that tell entries apart; all of them if none would be left."""
        left = [w for w in words if w not in self._PREFIX]
        return left or words

    def _forms(self, name: str) -> set[str]:
        """Squeezed spellings of a name: in full, without prefixes, and head noun first ('acid, boric')."""
        words = tokens(name)
        content = self._content(words)
        out = {"".join(words), "".join(content)}
        if len(words) > 1:
            out |= {words[-1] + "".join(words[:-1]), content[-1] + "".join(content[:-1])}
        return {x for x in out if len(x) > 2}

    # ------------------------------------------------------------ one field

    def _mention(self, text: str) -> tuple[frozenset[int], int, list[str]]:
        """Longest non-overlapping mentions of list entries at word borders: (entries, characters, other words)."""
        words = tokens(text)
        if not len(self.automaton) or not words:
            return frozenset(), 0, words
        squeezed = "".join(words)
        starts, ends, at = {}, {}, 0
        for k, w in enumerate(words):
            starts[at] = k
            at += len(w)
            ends[at] = k + 1
        hits = []
        for end, (length, refs) in self.automaton.iter(squeezed):
            a, b = end + 1 - length, end + 1
            if a in starts and b in ends:
                hits.append((length, starts[a], ends[b], refs))
        hits.sort(key=lambda h: (-h[0], h[1]))
        used: set[int] = set()
        best: list[tuple[int, frozenset[int]]] = []
        for length, a, b, refs in hits:
            if used.isdisjoint(range(a, b)):
                used.update(range(a, b))
                best.append((length, refs))
        if not best:
            return frozenset(), 0, words
        refs = best[0][1]
        for _, other in best[1:]:
            refs = refs & other or refs
        return refs, best[0][0], [w for k, w in enumerate(words) if k not in used]

    def _closest(self, word: str) -> tuple[tuple[str, int], ...]:
        """List words at the least edit distance within the tolerance, with the distance."""
        if word in self.words:
            return ((word, 0),)
        found = self.near_words.within(word, allowed(len(word)), allowed)
        if not found:
            return ()
        least = min(found)[0]
        return tuple((w, far) for far, w in sorted(found) if far == least)

    def _similar(self, text: str) -> tuple[frozenset[int], float]:
        """Token-set similarity: every content word must stand for a list word and all words of an entry be met."""
        words = [w for w in self._content(tokens(text)) if not self._noise(w)]
        if not words or any(w in CHEMICAL and w not in self.words for w in words):
            return frozenset(), 0.0
        out = self._cover(words)
        if not out[0]:
            # words run together, or a blank inside a word
            joined = "".join(words)
            spans = self.near_names.within(joined, 3, allowed)
            if spans:
                far = min(spans)[0]
                return frozenset().union(*[self.names[form] for n, form in spans if n == far]), 1 - far / max(1, len(joined))
        return out

    def _noise(self, w: str) -> bool:
        return w in FILLER or (w.isdigit() and w not in self.words) or bool(re.fullmatch(r"\d+(?:e\d+|mm|um|nm|m|mg|ug|ng|g|ml|l)?", w) and w not in self.words)

    def _cover(self, words: list[str]) -> tuple[frozenset[int], float]:
        options = [self.closest(w) for w in words]
        if any(not o for o in options):
            return frozenset(), 0.0
        cost = sum(o[0][1] for o in options)
        refs: set[int] | None = None
        for o in options:
            here = set().union(*[self.words[w] for w, _ in o])
            refs = here if refs is None else refs & here
        met = {w for o in options for w, _ in o}
        full = {r for r in refs or () if any(bag <= met for bag in self.bags[r])}
        return frozenset(full), 1 - cost / max(1, sum(map(len, words)))

    def _field(self, text: str | None) -> tuple[frozenset[int], str, float]:
        """Entries one field stands for: by formula, by mention, by similarity, or none."""
        plain = flat(text)
        if not plain:
            return frozenset(), "blank", 0.0
        exact = self.exact_formulas.get(formula_key(text, True)) or self.formulas.get(formula_key(text))
        if exact:
            return frozenset(exact), "formula", 1.0
        plain = _AMOUNT.sub("", plain) or plain
        refs, _, rest = self._mention(plain)
        if refs and all(self._noise(w) or w in self._PREFIX for w in rest):
            return refs, "mention", 1.0
        near, score = self._similar(plain)
        if near:
            return near, "similar", score
        if any(not self._noise(w) for w in tokens(plain)):
            return frozenset(), "unknown", 0.0
        return frozenset(), "empty", 0.0

    # ------------------------------------------------------------ a value

    def match(self, name: str | None, formula: str | None) -> tuple[int, str, float]:
        a, b = self.field(name), self.field(formula)
        if a[0] and b[0] and (both := a[0] & b[0]):
            if len(both) == 1:
                return next(iter(both)), a[1], max(a[2], b[2])
        first, second = (a, b) if _RANK[a[1]] <= _RANK[b[1]] else (b, a)
        other = formula if first is a else name
        if first[1] == "similar" and second[1] == "unknown" and _FORMULA.match(formula_key(other, True)):
            return -1, "unmatched", 0.0  # the formula is that of another substance
        for refs, how, score in (first, second):
            if len(refs) == 1:
                return next(iter(refs)), how, score
            if refs:
                return -1, "ambiguous", score
        return -1, "unmatched", 0.0

    # ------------------------------------------------------------ blocks of a longer list

    def relevant(self, name: str | None, formula: str | None) -> set[int]:
        """Entries of this block that can bear on a value: its formulas, mentions, fully met entries, names near the whole,
        and for each of its words one witness of every list word it may stand for.

        The entries found in all blocks, taken as a list of their own, match the value as the whole list does.
        """
        out: set[int] = set()
        for text in (name, formula):
            plain = flat(text)
            if not plain:
                continue
            out |= self.exact_formulas.get(formula_key(text, True), set()) | self.formulas.get(formula_key(text), set())
            for version in {plain, _AMOUNT.sub("", plain) or plain}:
                words = tokens(version)
                squeezed = "".join(words)
                if len(self.automaton):
                    for _, (_, refs) in self.automaton.iter(squeezed):
                        out |= refs
                for w in set(words):
                    for known, _ in self.closest(w):
                        out.add(min(self.words[known]))
                for kept in (words, self._content(words), [w for w in words if not self._noise(w)], [w for w in self._content(words) if not self._noise(w)]):
                    if kept:
                        out |= self._cover(kept)[0]
                        for _, form in self.near_names.within("".join(kept), 3, allowed):
                            out |= self.names[form]
        return out


#: An amount at the end of a value.
_AMOUNT = re.compile(r"[\s,(–-]+(?:approx\.?|ca\.?|about|~|≈)?\s*\d+(?:[.,]\d+)?(?:\s*[x×*]\s*10\s*\^?\s*-?\d+|e[-+]?\d+)?\s*(?:[munpµμ]?m\b|[munpkµμ]?mol\b|[munkµμ]?g\b|[mu µμ]?l\b|molar|millimolar|micromolar|%|percent|vol%|micrograms).*$", re.I)
#: A mention outranks a formula, which entries may share; both outrank similarity.
_RANK = {"mention": 0, "formula": 1, "similar": 2, "unknown": 3, "empty": 4, "blank": 5}

_VERDICT = "name string, formula string, ref_id long, how string, score double"


def map_to_list(values: DataFrame, reference: DataFrame, max_list_rows: int = 100_000) -> DataFrame:
    """``(row_id, path, ref_id, how, score)`` for each value whose name or formula is not blank; -1 where none fits.

    ``values`` has row_id, path, name, formula; ``reference`` ref_id, canonical_name, formula, abbreviation. Each distinct
    value is matched once and its verdict joined back; a hot value is split by AQE. The list is broadcast and its automaton
    built once per worker while it has at most ``max_list_rows`` rows (checked). A longer list goes in blocks of that
    size: each block tells the entries that can bear on a value, and the value is then matched against those of all blocks,
    which gives what the whole list gives. Nulls, blanks and empty tables give no rows; repeated values count each; extra
    columns are ignored.
    """
    value = values.select(F.col("row_id").cast("long").alias("row_id"), "path", "name", "formula")
    value = value.where(r"coalesce(name, '') rlike '(?U)\\S' or coalesce(formula, '') rlike '(?U)\\S'")
    distinct = value.select("name", "formula").distinct()
    listed = reference.select("ref_id", "canonical_name", "formula", "abbreviation")
    n_blocks = max(1, -(-listed.count() // max_list_rows))
    if n_blocks == 1:
        verdicts = _matched(distinct, listed)
    else:
        distinct = cut(distinct)
        # dealt by the hash, so a block may exceed the limit by what chance gives
        blocks = [_relevant(distinct, listed.where(F.pmod(F.xxhash64("ref_id"), F.lit(n_blocks)) == k)) for k in range(n_blocks)]
        verdicts = _matched_each(reduce(DataFrame.unionByName, blocks))
    same = value["name"].eqNullSafe(verdicts["name"]) & value["formula"].eqNullSafe(verdicts["formula"])
    return value.join(verdicts, same).select("row_id", "path", "ref_id", "how", "score")


def _known(shared) -> CanonicalList:
    token, rows = shared.value
    return kept_by_worker(token, lambda: CanonicalList(rows))


def _share(listed: DataFrame):
    rows = [tuple(r) for r in listed.collect()]
    return listed.sparkSession.sparkContext.broadcast((uuid4().hex, rows))


def _matched(distinct: DataFrame, listed: DataFrame) -> DataFrame:
    shared = _share(listed)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known(shared)
        for batch in batches:
            found = [known.match(_text(n), _text(f)) for n, f in zip(batch["name"], batch["formula"])]
            yield batch.assign(ref_id=[x[0] for x in found], how=[x[1] for x in found], score=[x[2] for x in found])

    return distinct.mapInPandas(work, _VERDICT)


_ENTRY = "struct<ref_id: bigint, canonical_name: string, formula: string, abbreviation: string>"


def _relevant(distinct: DataFrame, block: DataFrame) -> DataFrame:
    shared = _share(block)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known(shared)
        for batch in batches:
            rows = [[dict(zip(("ref_id", "canonical_name", "formula", "abbreviation"), known.rows[r])) for r in sorted(known.relevant(_text(n), _text(f)))] for n, f in zip(batch["name"], batch["formula"])]
            yield batch.assign(entries=rows)

    return distinct.mapInPandas(work, f"name string, formula string, entries array<{_ENTRY}>")


def _matched_each(found: DataFrame) -> DataFrame:
    """Verdict of each value against its own entries, those of all blocks together."""
    together = found.groupBy("name", "formula").agg(F.flatten(F.collect_list("entries")).alias("entries"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts = []
            for n, f, entries in zip(batch["name"], batch["formula"], batch["entries"]):
                rows = [(e["ref_id"], e["canonical_name"], e["formula"], e["abbreviation"]) for e in entries]
                verdicts.append(CanonicalList(sorted(rows, key=lambda r: r[0])).match(_text(n), _text(f)))
            yield pd.DataFrame({"name": batch["name"], "formula": batch["formula"], "ref_id": [x[0] for x in verdicts], "how": [x[1] for x in verdicts], "score": [x[2] for x in verdicts]})

    return together.mapInPandas(work, _VERDICT)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None
