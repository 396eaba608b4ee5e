"""Template residue and error pages in place of real content (problem 10).

Method: the lines and sentences of all documents that hold a cue of residue are masked (numbers, names, script words,
meaningless words become classes), equal masks are counted by a JVM aggregate, and the distinct masks are mined into
message templates by a fixed-depth prefix tree. Each template is classified once, from its constant tokens and from the
evidence of all its documents: does it stand where content should, or inside a real text? The verdict is joined back
to the documents. Unfilled slots inside ordinary records are detected apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permeate.session import cut

KINDS = ("placeholder", "filler", "error_page", "script_notice")

# ---------------------------------------------------------------- segments and masks

_CUT = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+|(?<=>)(?=<(?:h\d|hr|p|div|br|li)\b)|<br\s*/?>", re.I)
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
WILD = "<*>"

# Names of script languages and of scripts in general.
SCRIPT_WORDS = frozenset("javascript java-script ecmascript js noscript script scripts scripting client-side skript skripte skripten".split())
# Vocabulary of the usual meaningless Latin text.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_WEAK_LATIN = frozenset("do ut et ad in ex ea non qui id est sed sit in quis".split())
# The letter rows of common keyboards.
_ROWS = ("qwertzuiop", "qwertyuiop", "asdfghjkl", "yxcvbnm", "zxcvbnm")
# Words that no run of random letters holds.
_COMMON = frozenset("the of and to is was were are with for that this from by on it der die das und ist nicht mit le les des et est une dans pour el los las que con una não uma il di che".split())

_STATUS = re.compile(r"^\W*(?:<(?:h\d|title)>)?\W*[1-5]\d\d\W*(?:</(?:h\d|title)>)?\W*$")
_FRAME = re.compile(r"^[\w.$<>]+\([\w.]+:\d+\)$")


def segments(text: str) -> list[str]:
    """Sentences and lines of a text, stripped, without empty ones."""
    return [s for s in (x.strip() for x in _CUT.split(text)) if s]


def mashed(word: str) -> bool:
    """Letters hit at random on the keyboard: hardly a vowel, or few different letters in one keyboard run."""
    if len(word) < 3 or not word.isascii() or word.isupper():
        return False
    w = word.lower()
    vowels = sum(c in "aeiou" for c in w)
    if vowels == 0 and "y" not in w[1:]:
        return True
    pool = set(w)
    near = any(max(row.find(c) for c in pool) - min(row.find(c) for c in pool) <= 6 for row in _ROWS if pool <= set(row))
    return near and (len(pool) <= 4 or vowels <= 0.2 * len(w))


def mask(segment: str) -> tuple[str, ...]:
    """Tokens in lower case with the variable ones as classes.

    Numbers and, in long segments, names inside the sentence become ``<*>``; status codes stay, because they tell what
    happened. Script words become ``<script>``. A segment of meaningless Latin or of random letters becomes one token per
    class, whatever its length, so all of them meet in one template.
    """
    words = segment.split()
    names = len(words) >= 8
    out = []
    for k, w in enumerate(words):
        low = w.lower()
        if w.isalpha() and not (names and k and len(w) > 5 and w[0].isupper()):
            out.append("<script>" if low in SCRIPT_WORDS else low)
        elif names and k and len(w) > 5 and w[0].isupper() and low.strip(".,;:!?") not in SCRIPT_WORDS:
            out.append(WILD)
        elif _DIGIT.search(w):
            out.append(low if _STATUS.match(w) else "<frame>" if _FRAME.match(w) else WILD)
        else:
            bare = low.strip(".,;:!?\"'()[]")
            out.append("<script>" + low[low.find(bare) + len(bare) :] if bare in SCRIPT_WORDS else low)
    return tuple(out)


# ---------------------------------------------------------------- prefix tree


class PrefixTree:
    """Fixed-depth prefix tree of message templates.

    Level 1 is the token count, the next ``depth`` levels are the first tokens; a leaf holds groups. A mask joins the
    group with the largest share of equal tokens if that reaches ``similar``; tokens that differ become wildcards, and
    the weight and the evidence of the mask are added to the group.
    """

    def __init__(self, depth: int = 2, similar: float = 0.5):
        self.depth, self.similar = depth, similar
        self.root: dict = {}

    def add(self, words: tuple[str, ...], docs: int = 1, stand: float = 0.0, repeats: int = 0) -> list:
        """The group ``[template tokens, documents, stand, repeats, masks]`` of a mask, made or widened as needed."""
        groups = self.root.setdefault((len(words), *words[: self.depth]), [])
        best, score = None, -1
        for g in groups:
            same = sum(map(eq, g[0], words))
            if same > score:
                best, score = g, same
                if same == len(words):
                    break
        if best is None or score < self.similar * len(words):
            best = [words, 0, 0.0, 0, []]
            groups.append(best)
        elif score < len(words):
            best[0] = tuple(a if a == b else WILD for a, b in zip(best[0], words))
        best[1] += docs
        best[2] += stand
        best[3] += repeats
        best[4].append(words)
        return best

    def groups(self) -> Iterator[list]:
        for leaf in self.root.values():
            yield from leaf


# ---------------------------------------------------------------- slots

# Slot notations of template languages and word processors.
_NAME = r"[A-Za-z][A-Za-z0-9_.\- ]{0,40}?"
_SLOTS = re.compile(
    rf"""
    \{{\{{\s*{_NAME}\s*\}}\}} | \{{%-?\s*{_NAME}\s*-?%\}} | <%=?\s*{_NAME}\s*%> | \$\{{\s*{_NAME}\s*\}} | \#\{{\s*{_NAME}\s*\}}
  | @@\s*{_NAME}\s*@@ | %%\s*{_NAME}\s*%% | <<\s*{_NAME}\s*>> | \(\(\s*{_NAME}\s*\)\) | \[\[\s*{_NAME}\s*\]\]
  | (?<![A-Za-z0-9_])__\s?{_NAME}\s?__(?![A-Za-z0-9_]) | (?<![A-Za-z0-9_])_{{4,}}(?![A-Za-z0-9_])
  | %\([A-Za-z_]\w*\)[sdf] | \{{\$[A-Za-z_]\w*\}} | \[%\s*{_NAME}\s*%\] | (?<![\w$])\$(?-i:[A-Z][A-Z_]{{2,}})\b(?!\$) | (?-i:\b[A-Z][A-Z_]{{2,}}_HERE\b) | &lt;\s*(?-i:[A-Z][A-Z_]{{2,}})\s*&gt;
  | (?<![\w\#])([\#^!=:+&~|])\1(?-i:[A-Z][A-Z_]{{2,40}})\1\1(?!\w) | (?<![\w^])\^\^[a-z_]{{3,40}}\^\^(?!\w) | (?<![\w:])::[a-z_]{{3,40}}::(?!\w)
  | \[\s*(?:insert|your|enter|add|todo|tbd|placeholder|fill\ in|name\ of|type)\b[^\[\]\n]{{0,60}}\]
  | <\s*(?:insert|your|enter|add|todo|placeholder|fill\ in)\b[^<>\n]{{0,60}}>
    """,
    re.X | re.I,
)
# Words behind a slot that show that the text speaks about it.
_ABOUT = re.compile(r"^[\"'”’`]?\s*(?:field|fields|slot|slots|tag|tags|variable|variables|placeholder|syntax|marker|markers|notation|column|key|token|lane|parameter)\b", re.I)
_OPENERS = ("{{", "{%", "<%", "${", "#{", "@@", "%%", "<<", "((", "[[", "__", "%(", "{$", "[%", "_HERE", "&lt;", "##", "^^", "!!", "==", "::", "++", "&&", "~~", "||")
_DOLLAR = re.compile(r"\$[A-Z]{3}")
_BRACKET = re.compile(r"[\[<]\s*(?:insert|your|enter|add|todo|tbd|placeholder|fill in|name of|type)\b", re.I)
# A name between single marks. Such marks have other uses too, so it must look like a variable (`plain_slots`).
_PLAIN = re.compile(r"(?<!\w)([<\[{#$%@|~«‹])([A-Za-z][A-Za-z_]{2,40})([>\]}#$%@|~»›])(?!\w)")
_CLOSING = dict(zip("<[{#$%@|~«‹", ">]}#$%@|~»›"))
# Element names of HTML with three or more letters.
_HTML = frozenset(
    "abbr address area article aside audio base bdi bdo big blockquote body button canvas caption center cite code col colgroup data datalist del details dfn dialog dir div embed fieldset figcaption figure font footer form frame frameset "
    "head header hgroup html iframe img input ins kbd label legend link main map mark menu meta meter nav noframes noscript object optgroup option output param picture pre progress ruby samp script search section select slot small source "
    "span strike strong style sub summary sup svg table tbody template textarea tfoot thead time title track var video wbr".split()
)


def plain_slots(text: str) -> int:
    """Names between single marks that stand for a value: written in capitals or with underscores, or one of at least two
    different lower-case names in the same marks. Elements that are closed in the text and HTML elements are markup."""
    found: dict[str, list[str]] = {}
    for m in _PLAIN.finditer(text):
        mark, name, end = m.groups()
        if _CLOSING[mark] != end or (mark == "<" and (f"</{name}" in text or (name.lower() in _HTML and not name.isupper()))):
            continue
        if _ABOUT.match(text[m.end() : m.end() + 30]):
            continue
        found.setdefault(mark, []).append(name)
    n = 0
    for names in found.values():
        sure = sum(x.isupper() or "_" in x for x in names)
        low = {x for x in names if x.islower()}
        n += sure + (len(low) if len(low) > 1 else 0)
    return n


def open_slots(text: str) -> int:
    """Unfilled slots; one that the text speaks about (``the {{title}} field``, in quotes) is none."""
    n = 0
    if any(x in text for x in _OPENERS) or ("$" in text and _DOLLAR.search(text)) or (("[" in text or "<" in text) and _BRACKET.search(text)):
        for m in _SLOTS.finditer(text):
            if _ABOUT.match(text[m.end() : m.end() + 30]):
                continue
            if m.start() and text[m.start() - 1] in "\"'“‘`" and m.end() < len(text) and text[m.end()] in "\"'”’`":
                continue
            n += 1
    return n or plain_slots(text)


# ---------------------------------------------------------------- cues and rules

# Words that residue of a kind is made of, with their weight.
_CUES = {
    "script_notice": {
        2: "javascript ecmascript js noscript script scripts scripting skript skripte skripten",
        1: "browser navigateur navegador cookies enable enabled disable disabled allow allowed activate activated active activer activez activar aktivieren aktiviert habilite habilitar erlauben turn turned switch switched off blocked block "
        "blocker unblock require requires required need needs must support supported reload loading drawn displayed view show run permit permitted accept checking without please bitte veuillez autoriser benötigt erforderlich einschalten eingeschaltet deaktiviert nécessite désactivé desactivado habilitado unterstützt",
    },
    "error_page": {
        2: "error errors erreur fehler http gateway nginx apache traceback exception unavailable forbidden unauthorized unauthorised timeout introuvable indisponible wartung wartungsarbeiten serverfehler oops whoops sorry maintenance offline "
        "notfound wentwrong unexpected uncaught undefined unreachable retry exceeded sentimos fehlgeschlagen aufgetreten expired denied refused crashed inaccessible mantenimiento désolé caducado denegado",
        1: "page server request requested session connection reset moved removed deleted exist exists loaded displayed try again later login log sign permission administrator webmaster contact desk help back end database site website "
        "service access internal wrong record entry article address url link report problem id failed time timed out down lost unable cannot could status code bad many problem occurred working find load connect connections reach reached authorized authorised limit rate blocked broken went wrong something "
        "existe existiert angeforderte solicitada verbindung código codigo seite eintrag datei nicht gefunden geladen erreichbar verfügbar datenbank dienst server bitte versuchen später zugriff verweigert anmelden notice serveur veuillez réessayer accès refusé demandée "
        "página registro servidor servicio encontrado encuentra encontró disponible inténtelo acceso sesión cargar",
    },
    "filler": {
        3: "beispieltext blindtext platzhaltertext mustertext fülltext lipsum",
        2: "placeholder dummy lorem ipsum filler blah tbd todo platzhalter relleno bla foo",
        1: "sample text abstract summary content title description paragraph goes here coming soon replace later insert something enter write your test example blind copy added appear exemple ejemplo texte texto entry record yet announced follows folgt bar baz",
    },
}
_WEIGHT = {kind: {w: n for n, words in by.items() for w in words.split()} for kind, by in _CUES.items()}
#: A line needs different words of this weight for a kind (and of a sixth of its words of three letters and more), or of weight 2 if they are half of its words of three letters and more.
_ENOUGH = 3
_STRONG = frozenset(w for by in _CUES.values() for n, words in by.items() if n > 1 for w in words.split()) | {"browser"}

_ANY = frozenset(w for by in _WEIGHT.values() for w in by)
_INTRO = re.compile(r"(?:\d+\.\s*)?[^\W\d_][\w\-]*(?: [\w\-]+){0,3}[,:=]\s*")
# Words of letters of one row half, or without vowels, as random typing gives.
_KEYS = re.compile(r"\b(?:[asdfg]{3,}|[hjkl]{3,}|[qwertz]{3,}|[yxcvbnm]{3,}|[bcdfghjklmnpqrstvwxz]{3,})\b")

# Reason phrases of failed requests.
_REASONS = (
    r"bad request|unauthori[sz]ed|forbidden|(?:page |file |record |entry )?not found|method not allowed|not acceptable|request time-?\s?out|request timed out|conflict|gone|"
    r"too many requests|internal (?:server )?error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?\s?out|gateway timed out|"
    r"access denied|sign-in needed|log-?in required|payment required|payload too large|unsupported media type|temporarily unavailable|time-out|timed out|unavailable"
).replace(" ", r"\ ")
# Forms that messages of failed requests and programs have.
_ERROR = re.compile(
    rf"""
    ^\W*(?:http(?:/\d(?:\.\d)?)?\s*)?(?:error|erreur|fehler|code|status)?\s*[:#]?\s*[1-5]\d\d\s*[:–—-]?\s*\(?(?:{_REASONS})\b
  | ^\W*(?:{_REASONS})\W*$
  | ^\W*(?:error|http\ error|erreur|fehler)\s*[:#]?\s*[1-5]\d\d\b | <h\d>\s*[1-5]\d\d\b | <title>\s*[1-5]\d\d\b
  | "(?:status|code|statuscode)"\s*:\s*"?[45]\d\d\b | "error"\s*:\s*["{{]
  | ^\W*traceback\ \(most\ recent\ call\ last\) | ^\W*file\ ".+",\ line | ^\s*at\ (?:<frame>|[\w.$<>]+\([\w.]+:\d+\)) | ^\W*exception\ in\ thread | ^\W*segmentation\ fault
  | ^\W*(?:[\w.]*)(?:error|exception)(?::\s|\W*$) | ^\W*fatal\ error\b | ^\W*stack\ trace:
  | \b(?:nginx|apache|iis|lighttpd)\b.{{0,12}}(?:gateway|/\d|server\ at)
    """,
    re.X | re.I,
)
_DEMAND = re.compile(r"^\W*(?:please |you (?:must|need to|have to|should) |kindly |to (?:view|continue|see|use|read|open)\b.{0,40})?(?:enable|allow|activate|turn on|switch on|permit|accept|unblock) (?:the use of )?<script>|<noscript\b", re.I)
# Stock sentences that stand where content should.
_STOCK = re.compile(
    r"""
    ^\W*(?:your|the|this)?\s*(?:summary|abstract|text|content|title|description|body|caption|article)\s+(?:text\s+)?(?:goes\ here|will\ (?:appear|follow|go|be\ added)|comes\ here|to\ (?:come|follow|be\ added))
  | ^\W*(?:this\ is\ )?(?:a\ |some\ |just\ )?(?:sample|dummy|filler|placeholder|example|test|blind)\ (?:text|abstract|content|paragraph|copy|entry|record)\b
  | ^\W*(?:content|text|abstract|summary|details?|description|more)\s+(?:is\ |are\ )?coming\ soon\b | ^\W*coming\ soon\W*$
  | ^\W*(?:type|write|enter|add|insert|put)\ (?:something|your\ text|some\ text|text|content|a\ description)\b
  | ^\W*replace\ (?:this|me|later)\b | ^\W*(?:to\ be\ (?:written|added|completed|filled)|tbd|todo|lorem\ ipsum)\W*$
    """,
    re.X | re.I,
)


# What a message has whose words alone do not tell.
_FORMS = re.compile(r'rror|xception|^\W*(?:<h\d>)?\W*[1-5]\d\d\b|^\s*at |^\W*[Ff]ile "|gone', re.I | re.M)


def cue_words(text: str) -> list[str]:
    """Words in lower case; ``not found`` and ``went wrong`` count as one, for alone their words say little."""
    return _WORD.findall(text.lower().replace("not found", "notfound").replace("went wrong", "wentwrong"))


def cue_scores(words: list[str]) -> dict[str, int]:
    """Weight of the different cue words of each kind that has enough of them."""
    own = set(words)
    out = {}
    if len(_ANY & own) == 0:
        return out
    long = sum(len(w) > 2 for w in own)
    for kind, weight in _WEIGHT.items():
        n = sum(weight[w] for w in weight.keys() & own)
        if (n >= _ENOUGH and 6 * n >= long) or (n > 1 and 2 * n >= long):
            out[kind] = n
    return out


def _lead(segment: str) -> str:
    """The segment without a label or adverbial of at most four words before its first comma or colon, if cues stand behind
    it only: the same sentence is then one template, however it is introduced."""
    m = _INTRO.match(segment)
    if m and _ANY.isdisjoint(cue_words(m[0])) and not _DIGIT.search(m[0]) and not _ANY.isdisjoint(cue_words(segment[m.end() :])):
        return _lead(segment[m.end() :])
    return segment


def meaningless(segment: str) -> str | None:
    """``latin``, ``letters`` or ``one word`` for text without sense, else None."""
    raw = _WORD.findall(segment)
    words = [w.lower() for w in raw]
    parts = segment.split()
    if len(parts) > 2 and len(set(parts)) == 1 and words:
        return "one word"
    if len(words) < 3:
        return None
    if sum(w in _LATIN for w in words) >= 0.7 * len(words) and sum(w in _LATIN and w not in _WEAK_LATIN for w in words) >= 3:
        return "latin"
    if len(set(words)) == 1 or (len(words) >= 5 and len(set(words)) <= 0.5 * len(words) + 1):
        top, n = Counter(words).most_common(1)[0]
        if n >= 0.6 * len(words) and len(top) > 1:
            return "one word"
    if len(words) >= 4 and len(_COMMON.intersection(words)) < 2 and not re.search(r"[>|]", segment) and sum(map(mashed, raw)) >= 0.6 * len(words):
        return "letters"
    return None


#: Least share of its documents in which a template with a known form must stand in place of content, and without one.
SURE_STAND, STAND = 0.25, 0.5
#: Documents without evidence that are added to those of a template, so that one or two do not decide much.
PRIOR = 1


def judge(template: str, docs: int, stand: float, repeats: int) -> str | None:
    """Kind of a template, once for all its segments; None for one that belongs to real text.

    ``stand`` counts the documents in which it stands in place of content, ``repeats`` those made of its repetition.
    A known form needs the first in a quarter of the documents, mere words in half of them: sentences that only speak
    of errors, scripts or samples stand inside real texts.
    """
    share = (stand + PRIOR * STAND) / (docs + PRIOR)
    if share < SURE_STAND:
        return None
    plain = template.replace(WILD, " ")
    words = cue_words(plain.replace("<script>", " javascript "))
    scores = cue_scores(words)
    if _DEMAND.search(template):
        return "script_notice"
    if _ERROR.search(template):
        return "error_page"
    if _STOCK.match(template) or template in ("<latin>", "<letters>", "<one word>") or repeats >= 0.5 * docs:
        return "filler"
    if share < STAND or not scores:
        return None
    if "javascript" not in words and "browser" not in words:
        scores.pop("script_notice", None)
    elif "script_notice" in scores:
        return "script_notice"
    return max(scores, key=lambda k: (scores[k], k)) if scores else None


# ---------------------------------------------------------------- one document


@dataclass
class Marked:
    """What one document shows: ``lines`` are (mask, characters, stands in place of content, is repeated)."""

    lines: list[tuple[tuple[str, ...], int, float, int]] = field(default_factory=list)
    slots: int = 0


#: A real text around a line is short up to so many sentences; the line then stands in place of content if it ends or begins the text.
SHORT = 5


def mark(text: str) -> Marked:
    """Cue-bearing lines of a text and its unfilled slots. Every line is looked at; lines without a cue are ordinary.

    A line stands in place of content if cue-bearing lines are at least half of the text, or if at most ``SHORT``
    ordinary sentences stand with it, all before or all behind it.
    """
    out = Marked(slots=open_slots(text))
    words = cue_words(text)
    different = set(words)
    # without cue words, repetition or letters at random no line of the text can be a candidate
    odd = len(_LATIN & different) > 2 or len(_KEYS.findall(text)) >= 0.2 * len(words)
    again = len(different) <= 0.75 * len(words)
    if not odd and not again and _STRONG.isdisjoint(different) and len(_ANY & different) < 2 and not _FORMS.search(text):
        return out
    parts = segments(text)
    times = Counter(parts)
    total = sum(map(len, parts)) or 1
    found: dict[int, tuple[tuple[str, ...], int]] = {}
    for k, s in enumerate(parts):
        repeated = int(times[s] > 1 and times[s] * len(s) >= 0.5 * total and (times[s] > 2 or times[s] >= len(parts) - 1) and _WORD.search(s) is not None and not _DIGIT.search(s))
        own = cue_words(s)
        sense = meaningless(s) if odd or (again and len(set(own)) <= 0.5 * len(own) + 1) else None
        if sense:
            found[k] = ((f"<{sense}>",), repeated)
        elif repeated or cue_scores(own) or ((_FORMS.search(s) or not _ANY.isdisjoint(own)) and (_ERROR.search(s) or _STOCK.match(s))):
            if not (out.slots and open_slots(s)):
                found[k] = (mask(_lead(s)), repeated)
    if not found:
        return out
    # short lines without a cue (menus, headings) are no content of their own
    ordinary = [k for k, s in enumerate(parts) if k not in found and len(s.split()) >= 4]
    share = sum(len(parts[k]) for k in found) / total
    first, last = (ordinary[0], ordinary[-1]) if ordinary else (0, 0)
    for k, (words_, repeated) in found.items():
        stands = not ordinary or share >= 0.5 or (len(ordinary) <= SHORT and (k > last or k < first))
        out.lines.append((words_, len(parts[k]), float(stands), repeated))
    return out


# ---------------------------------------------------------------- tables

_MARKED = "rid long, doc_id long, mask array<string>, chars long, stand double, repeats int, slots int"


def mark_lines(documents: DataFrame) -> DataFrame:
    """One row per document and distinct mask of its cue-bearing lines, and one with null mask for its slots."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, doc_id, text in zip(batch["rid"], batch["doc_id"], batch["text"]):
                seen = mark(text)
                if seen.slots:
                    rows.append((rid, doc_id, None, 200 * seen.slots, 0.0, 0, seen.slots))
                merged: dict[tuple[str, ...], list] = {}
                for words, chars, stand, repeated in seen.lines:
                    m = merged.setdefault(words, [0, 0.0, 0])
                    m[0], m[1], m[2] = m[0] + chars, max(m[1], stand), max(m[2], repeated)
                rows += [(rid, doc_id, list(words), *m, 0) for words, m in merged.items()]
            yield pd.DataFrame(rows, columns=["rid", "doc_id", "mask", "chars", "stand", "repeats", "slots"])

    texts = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.mapInPandas(work, _MARKED)


def mine(marked: DataFrame, depth: int = 2, similar: float = 0.5) -> DataFrame:
    """``(mask, template, kind, docs, stand)``: each distinct mask with its template and the template's one verdict.

    Equal masks are counted map-side. The distinct ones are brought together by branch (token count and first tokens)
    and sorted, so a task holds the tree of one branch at a time, whatever the number of documents behind it.
    """
    counted = marked.where("mask is not null").groupBy("mask").agg(F.count("*").alias("docs"), F.sum("stand").alias("stand"), F.sum("repeats").alias("repeats"))
    branch = F.concat_ws(" ", F.size("mask").cast("string"), F.slice("mask", 1, depth))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, tree = None, PrefixTree(depth, similar)

        def finished() -> pd.DataFrame:
            rows = []
            for words, docs, stand, repeats, masks in tree.groups():
                template = " ".join(words)
                kind = judge(template, docs, stand, repeats)
                rows += [(list(m), template, kind, docs, stand) for m in masks]
            return pd.DataFrame(rows, columns=["mask", "template", "kind", "docs", "stand"])

        for batch in batches:
            for b, words, docs, stand, repeats in zip(batch["branch"], batch["mask"], batch["docs"], batch["stand"], batch["repeats"]):
                if b != here:
                    yield finished()
                    here, tree = b, PrefixTree(depth, similar)
                tree.add(tuple(words), int(docs), float(stand), int(repeats))
        yield finished()

    by_branch = counted.withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch", "mask")
    return by_branch.mapInPandas(work, "mask array<string>, template string, kind string, docs long, stand double")


def find_residue(documents: DataFrame, depth: int = 2, similar: float = 0.5) -> DataFrame:
    """``(doc_id, kind)``: documents whose text is template residue or an error page.

    Null and blank texts give nothing, whole texts are read, repeated documents count each, extra columns are
    ignored, an empty table gives an empty result. One Arrow-batched pass over the texts writes the cue-bearing lines
    (few per document) to the shared folder; templates are mined from them and their verdicts joined back by mask, a
    hot mask being split by AQE. The kind with the most text behind it counts; a script notice outranks the error
    words that go with it.
    """
    marked = cut(mark_lines(documents))
    verdicts = mine(marked, depth, similar).where("kind is not null").select("mask", "kind")
    lines = marked.where("mask is not null").join(verdicts, "mask").select("rid", "doc_id", "kind", "chars")
    slots = marked.where("slots > 0").select("rid", "doc_id", F.lit("placeholder").alias("kind"), "chars")
    summed = lines.unionByName(slots).groupBy("rid", "doc_id", "kind").agg(F.sum("chars").alias("chars"))
    rank = F.when(F.col("kind") == "script_notice", 1).otherwise(0)
    order = F.struct("chars", rank, "kind")
    return summed.groupBy("rid", "doc_id").agg(F.max_by("kind", order).alias("kind")).select("doc_id", "kind")


def mine_templates(documents: DataFrame, least: int = 2) -> DataFrame:
    """``(template, kind, n)``: templates of cue-bearing lines met in at least ``least`` documents, with their verdict."""
    mined = mine(mark_lines(documents.withColumn("doc_id", F.lit(0)) if "doc_id" not in documents.columns else documents))
    return mined.groupBy("template", "kind").agg(F.max("docs").alias("n")).where(F.col("n") >= least)
