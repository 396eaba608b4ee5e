"""Broken prompt and response pairs (problem 5).

Method: ordered rules for emptiness, refusal phrases in several languages, copied prompts, language or script
mismatch, unclosed delimiters and abrupt endings. Every triggered defect type is emitted with its place in the
order; the primary one is the first.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the rules; the first that holds is the primary defect.
DEFECTS = ("empty", "refusal", "copy", "other_language", "truncated")

# Function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are with for that this from at by on it as an or not which be has have had no near once where when under does did do what how why could but into than its both we you i there any yes cannot after before while during through along across against under",
    "de": "der die das und ist nicht ein eine einen einem einer des dem den mit für von zu zur zum im bei auf nach wurde wird werden sind hat aus zwischen keine kein sich als auch oder wie welche welcher wir ich sie es etwas dieser diese dieses über wegen ohne",
    "fr": "le la les des du de un une et est ne pas que qui dans pour par sur avec au aux se sans à ce cette ces nous vous je il elle sont été puis plus chez quel quelle quels quelles comment en d l a son sa ses leur leurs",
    "es": "el la los las de del un una y es no que en por para con se su al lo sin más está este esta esto como cuál qué cómo entre sobre hay después nos fue son algo ha",
    "pt": "o a os as de do da dos das um uma e é não que em por para com se na no nos nas ao sem mais foi são entre há esta este como qual depois em pela pelo fica",
    "it": "il lo la i gli le di del della dei delle un una e è non che in per con si su al alla nel nella sono più tra dopo questa questo come quale serve senza anche",
    "nl": "de het een en is niet van in op te met voor dat die bij naar aan om ook uit wordt werd zijn geen tussen wij we ik zit als of maar dan nog deze dit welke hoe na zonder",
    "sv": "och att det som en på är av för med den till inte om ett från har vid mellan utan var eller denna detta",
    "pl": "i w na z do nie jest się że to jak po od za przez oraz dla ale co ten ta jego bez między",
}
_WEIGHT: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _WEIGHT.setdefault(_w, {})[_lang] = 1.0
for _w, _langs in _WEIGHT.items():
    for _lang in _langs:
        _langs[_lang] = 1.0 / len(_langs)

# Letters and word endings that speak for a language, with their weight per word.
_SIGNS = (
    (re.compile(r"[ñ]|ción$|ciones$"), {"es": 1.0}),
    (re.compile(r"[óíáú]"), {"es": 0.8, "pt": 0.4}),
    (re.compile(r"[ãõ]|ção$|ções$"), {"pt": 1.0}),
    (re.compile(r"é"), {"fr": 0.6, "es": 0.2, "pt": 0.2}),
    (re.compile(r"[èêçœîôû]|tés?$"), {"fr": 0.7, "pt": 0.1}),
    (re.compile(r"[äöüß]|ung$|keit$"), {"de": 0.8, "sv": 0.1}),
    (re.compile(r"[òì]|zione$|zioni$"), {"it": 0.8}),
    (re.compile(r"heid$|ijk$|ij"), {"nl": 0.7}),
    (re.compile(r"[łśżźćńęą]"), {"pl": 1.0}),
    (re.compile(r"[åø]"), {"sv": 0.8}),
)

# Ways to decline, by language.
REFUSAL = re.compile(
    r"""
    \b(?:can(?:no|')t|can\ not|could\ not|unable\ to|not\ able\ to|not\ going\ to|won't|will\ not|refuse\ to|must\ decline\ to|have\ to\ decline\ to)\s+
        (?:be\ able\ to\ )?(?:help|assist|answer|comply|respond|reply|discuss|provide|continue|support|do\ (?:this|that)|give)\b
        (?!\ to\ |\ in\ )
  | \b(?:have\ to|must|need\ to)\ (?:refuse|decline)\b
  | \b(?:i|we)(?:'ll|\ will|\ would)?\ (?:have\ to\ |must\ )?(?:refuse|decline)\b
  | \b(?:have\ to\ |rather\ |must\ |'ll\ |will\ )pass\ on\ (?:this|that)\b
  | \bguidelines\ (?:do\ not|don't|forbid|prevent|prohibit)
  | \b(?:not|n't)\ (?:be\ )?appropriate\ for\ me\b
  | \bagainst\ (?:the\ rules|my|our)\b
  | \bnot\ feel\ comfortable\b | \bn't\ feel\ comfortable\b | \bnot\ comfortable\ (?:with|answering|working)\b
  | \b(?:will\ not|won't)\ get\ an\ answer\b
  | \btopics?\ (?:that\ )?i\ (?:don't|do\ not|cannot|can't)\ (?:cover|discuss)\b
  | \bsomething\ i\ (?:won't|will\ not|can't|cannot|don't)\b
  | \boutside\ (?:of\ )?what\ i\ (?:may|can|am)\b
  | \b(?:not\ (?:allowed|permitted)|n't\ (?:allowed|permitted))\ to\ (?:answer|help|assist|respond|discuss|share|provide)
  | \bmy\ (?:guidelines|policy|policies|instructions|rules)\b.{0,40}\b(?:not|forbid|prevent|prohibit)
  | \b(?:kann|darf|möchte|werde)\b(?:(?!\.).){0,60}?\bnicht\b(?:(?!\.).){0,30}?\b(?:helfen|beantworten|antworten|weiterhelfen|unterstützen|nachkommen|bearbeiten|geben)\b
  | \b(?:kann|darf|möchte)\b(?:(?!\.).){0,40}?\b(?:keine|kein)\b(?:(?!\.).){0,30}?\b(?:antwort|auskunft|hilfe)\b
  | \b(?:muss|möchte)\b(?:(?!\.).){0,30}?\bablehnen\b | \blehne\b(?:(?!\.).){0,40}?\bab\b
  | \bne\ (?:peux|puis|pouvons|suis|saurais)\b(?:(?!\.).){0,40}?\b(?:aider|répondre|traiter|fournir|assister|autorisé|mesure)\b
  | \b(?:je|nous)\ (?:dois|refuse|refusons|devons)\b(?:(?!\.).){0,30}?\b(?:refuser|décliner|répondre|demande)\b
  | \bm'est\ (?:impossible|interdit)\b
  | \bno\ (?:puedo|podemos|me\ es\ posible|es\ posible|estoy)\b(?:(?!\.).){0,40}?\b(?:ayudar|ayudarle|ayudarte|responder|contestar|atender|proporcionar|autorizad[oa])\b
  | \b(?:debo|tengo\ que)\ (?:rechazar|declinar|negarme)\b
  | \bnão\ (?:posso|podemos|me\ é)\b(?:(?!\.).){0,40}?\b(?:ajudar|responder|atender)\b
  | \bnon\ (?:posso|possiamo)\b(?:(?!\.).){0,40}?\b(?:aiutare|aiutarti|rispondere)\b
  | \bkan\ (?:ik|u|je)?\b(?:(?!\.).){0,40}?\b(?:niet|geen)\b(?:(?!\.).){0,20}?\b(?:helpen|antwoord(?:en)?|beantwoorden)\b
    """,
    re.X | re.I,
)

_LABEL = re.compile(r"^\s*[*_#>\s]*(?:question|q|answer|a|response|prompt|task|input|output|you ask(?:ed)?|user|assistant|frage|antwort|réponse|pregunta|respuesta)\s*[*_]*\s*:\s*[*_]*\s*", re.I)
_CONTEXT = re.compile(r"\n\s*[*_#\s]*(?:context|kontext|contexte|contexto)\s*:?[*_]*\s*:?", re.I)
_CODE = re.compile(r"^\s*```[a-z]*\s*|\s*```\s*$", re.I)
# Abbreviations that do not end a sentence.
_OPEN_ABBREVIATION = re.compile(r"\b(?:e\.g|i\.e|vs|cf|fig|figs|approx|ca|eq|ref|refs|resp|z\.b|d\.h|bzw|p\.ej|p\.ex)\.$", re.I)
_CUT_NUMBER = re.compile(r"\b(?:from|to|of|at|by|about|than|between|and|von|auf|bei|um|de|à|a|con)\s+\d+\.$", re.I)
_END = re.compile(r"[.!?。！？](?:[\"'”’»)\]*_`]|</?\w+>)*$")
#: A full clause may be followed by a source in brackets or after a dash.
_SOURCE = re.compile(r"\s*(?:\[[^\[\]]{1,30}\]|\([^()]{1,60}\)|[–—-]\s*as (?:stated|said|reported|shown|given) in [\w\s]{2,40})$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])(?:\s+|$)")


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def straight(text: str) -> str:
    return unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'")


@lru_cache(maxsize=200_000)
def _speaks_for(word: str) -> tuple[tuple[str, float], ...]:
    """Languages a word speaks for, by its being a function word and by its letters and ending, with their weights."""
    signs = [weights for sign, weights in _SIGNS if sign.search(word)]
    return tuple(x for weights in (_WEIGHT.get(word, {}), *signs) for x in weights.items())


@lru_cache(maxsize=50_000)
def language(text: str, least: float = 1.2) -> str | None:
    """Language of a text by its function words, or by a non-Latin script; None where too little speaks for one."""
    letters = [] if text.isascii() else [c for c in text if c.isalpha()]
    if len(letters) >= 4:
        other = [c for c in letters if ord(c) > 0x24F and not 0x1E00 <= ord(c) <= 0x1EFF and not 0x370 <= ord(c) <= 0x3FF]
        if len(other) > 0.5 * len(letters):
            return "script:" + unicodedata.name(other[0], "?").split()[0]
    score: dict[str, float] = {}
    for w in words(text):
        for lang, weight in _speaks_for(w):
            score[lang] = score.get(lang, 0.0) + weight
    if not score:
        return None
    ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    if ranked[0][1] < least or (len(ranked) > 1 and ranked[0][1] < 1.15 * ranked[1][1]):
        return None
    return ranked[0][0]


def question_of(prompt: str) -> str:
    """The prompt up to its context."""
    found = _CONTEXT.search(prompt)
    return prompt[: found.start()] if found else prompt


def is_empty(response: str | None) -> bool:
    """Nothing of its own: no letter or digit once labels, markup and code fences are gone."""
    if response is None:
        return True
    text = re.sub(r"<[^<>]*>", " ", response)
    text = re.sub(r"```[a-z]*", " ", text, flags=re.I)
    while True:
        shorter = _LABEL.sub("", text, count=1)
        if shorter == text:
            break
        text = shorter
    return not any(c.isalnum() for c in text)


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?。！？])\s+|\n+", text.strip()) if x.strip()]


def _content(text: str) -> set[str]:
    """Words that carry content: no function words, nothing shorter than four letters, numbers."""
    return {w for w in words(text) if (len(w) > 3 and w not in _WEIGHT) or w.isdigit()}


def is_refusal(response: str, prompt: str | None = None) -> bool:
    """Declines to answer, at any length: a sentence refuses and none beside it answers.

    A sentence answers if most of its content words stand in the context of the prompt but not in its question, or, without
    a context, if it carries numbers; apologies, reasons and advice do not. So a refusal in many words counts, and an answer
    that says somewhere that something cannot be provided does not.
    """
    text = straight(response)
    if not REFUSAL.search(text):
        return False
    parts = sentences(text)
    beside = [x for x in parts if not REFUSAL.search(x)]
    if len(beside) == len(parts):  # the phrase runs over a border
        return True
    asked = _content(question_of(prompt)) if prompt else set()
    given = _content(prompt) - asked if prompt else set()
    for x in beside:
        own = _content(x) - asked
        if given and len(own) >= 3 and len(own & given) >= 0.6 * len(own):
            return False
        if not given and len(own) >= 3 and any(w.isdigit() for w in own):
            return False
    return True


def is_copy(prompt: str | None, response: str) -> bool:
    """Only the prompt or its question, once or repeated, with or without a label, in any case and punctuation."""
    if not prompt:
        return False
    text = response
    while True:
        shorter = _LABEL.sub("", text, count=1)
        if shorter == text:
            break
        text = shorter
    said, asked, whole = words(text), words(question_of(prompt)), words(prompt)
    if not said or not asked:
        return False
    last = re.split(r"(?<=[.!?])\s+(?=\S)", question_of(prompt).strip())
    forms = [asked] + [words(" ".join(last[k:])) for k in range(1, len(last))]
    forms = [f for f in forms if len(f) >= 3]
    for form in forms:
        n = len(form)
        if len(said) % n == 0 and said == form * (len(said) // n):
            return True
    # several different forms in a row, or the prompt with part of its context
    rest = said
    while rest:
        hit = max((f for f in forms if rest[: len(f)] == f), key=len, default=None)
        if hit is None:
            break
        rest = rest[len(hit) :]
    if not rest:
        return True
    if len(said) > len(asked) and " ".join(said) in " ".join(whole) and any(said[: len(f)] == f for f in forms):
        return True
    return len(said) >= 0.9 * len(whole) and " ".join(said) in " ".join(whole)


def is_other_language(prompt: str | None, response: str) -> bool:
    if not prompt:
        return False
    text = re.sub(r"```.*?```", " ", response, flags=re.S)
    if text.lstrip().startswith(("{", "[")):
        return False
    there = language(text)
    if there is None:
        return False
    here = language(question_of(prompt)) or language(prompt)
    return here is not None and here != there


def _unclosed(text: str) -> bool:
    if text.count("```") % 2:
        return True
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for c in re.sub(r"(?m)^\s*\d+\)", "", text):
        if c in "([{":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
    return bool(stack)


def _broken_json(text: str) -> bool:
    inner = _CODE.sub("", text).strip()
    if not inner.startswith(("{", "[{", "[\"", "[\n")):
        return False
    try:
        json.loads(inner)
    except (ValueError, RecursionError):
        return True
    return False


def is_truncated(response: str) -> bool:
    """Breaks off: open brackets, fences or JSON, a list item unlike the others, a sentence without its end.

    Answers of a few words and lists need no full stop; a source in brackets may follow the last clause.
    """
    text = response.strip()
    if _broken_json(text) or _unclosed(text):
        return True
    if text.startswith(("{", "[")) or text.endswith("```"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    plain = re.sub(r"[*_`]+$", "", last).strip()
    if _OPEN_ABBREVIATION.search(plain) or _CUT_NUMBER.search(plain):
        return True
    if _ITEM.match(last) and not last.startswith("**"):
        body = _ITEM.sub("", last).strip()
        if not body:
            return True
        items = [_ITEM.sub("", x).strip() for x in lines if _ITEM.match(x)]
        others = items[:-1]
        if others and all(_END.search(x) for x in others):
            return not _END.search(body)
        if others and all(re.search(r":\s*\S", x) for x in others):
            measured = all(re.search(r":\s*\d", x) for x in others)
            return not re.search(r":\s*\d+(?:[.,]\d+)?\s*[^\W\d_]+" if measured else r":\s*\S", body)
        if _END.search(body) or len(words(body)) <= 5:
            return bool(re.search(r"[:,;(–-]$", body))
        return True
    if re.search(r"[,;:(–—-]$", plain):
        return True
    clause = _SOURCE.sub("", plain).strip()
    if clause != plain and len(words(clause)) >= 3:
        return False
    if _END.search(plain) or plain.endswith(("…", "...")):
        return False
    if len(sentences(text)) > 1:
        return True
    return not is_short_answer(plain)


_FUNCTION = frozenset(w for w in _WEIGHT if w not in ("yes", "no", "not", "i", "a", "it", "you", "there"))
# Yes, no and approximations.
_PLAIN = re.compile(r"(?:yes|no|none|ja|nein|oui|non|sí|si|unknown|unbekannt|inconnu|desconocido)", re.I)
_VALUE = re.compile(r"(?:about|approx(?:imately)?\.?|around|roughly|nearly|circa|ca\.?|~|≈|etwa|ungefähr|environ|unos|ph|=|:|\s)*[+-]?\d+(?:[.,]\d+)*\s*(?:%|°|[^\W\d_]{0,12}(?:/[^\W\d_]{1,6})?)", re.I)
# Words that begin a statement of absence, and forms of to be.
_ABSENT = re.compile(r"(?:no|none|not|nothing|kein\w*|nichts|aucune?|rien|ning[uú]n\w*|nada)\b.*\b(?:is|are|was|were|ist|sind|wird|werden|est|sont|es|está|fue)\s+\w{3,}", re.I)


def is_short_answer(text: str) -> bool:
    """An answer of a few words that needs no full stop: yes or no, a value, a name with or without a value, a statement of
    absence. Whatever holds a function word begins a sentence or stands within one, and more than eight words are one."""
    bare = re.sub(r"[*_`\"'“”]+", "", text).strip()
    if _PLAIN.fullmatch(bare) or _VALUE.fullmatch(bare):
        return True
    if _ABSENT.fullmatch(bare):
        return True
    parts = [x.strip() for x in bare.split(",")]
    if len(parts) > 1 and _VALUE.fullmatch(parts[-1]):
        bare = " ".join(parts[:-1])
    own = words(bare)
    return len(own) <= 8 and _FUNCTION.isdisjoint(own)


def defects(prompt: str | None, response: str | None) -> list[str]:
    """All triggered defect types in their order. An empty response triggers nothing else."""
    if is_empty(response):
        return ["empty"]
    out = []
    if is_refusal(response, prompt):
        out.append("refusal")
    if is_copy(prompt, response):
        out.append("copy")
    if is_other_language(prompt, response):
        out.append("other_language")
    if is_truncated(response):
        out.append("truncated")
    return out


def flag_pairs(pairs: DataFrame, row_id: str = "resp_id", prompt: str = "prompt", response: str = "response") -> DataFrame:
    """``(resp_id, rank, defect)``: every triggered defect, rank 0 being the primary one.

    Null responses are empty; a null prompt can be neither copied nor of another language. Sound pairs give no row,
    repeated rows count each, texts are read in whole, empty tables give an empty result. No shuffle: one
    Arrow-batched pass over the three columns.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, p, r in zip(batch["resp_id"], batch["prompt"], batch["response"]):
                found = defects(p if isinstance(p, str) else None, r if isinstance(r, str) else None)
                out += [(i, k, d) for k, d in enumerate(found)]
            yield pd.DataFrame(out, columns=["resp_id", "rank", "defect"])

    cols = [F.col(f"`{row_id}`").cast("long").alias("resp_id"), F.col(f"`{prompt}`").alias("prompt"), F.col(f"`{response}`").alias("response")]
    return pairs.select(*cols).mapInPandas(work, "resp_id long, rank int, defect string")
