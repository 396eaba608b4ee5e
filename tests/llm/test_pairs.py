"""Problem 5: broken prompt and response pairs."""

import pytest

from permeate.llm.pairs import defects, flag_pairs, language

P = "Be brief and exact. What is the role of Glu88 in Galkin?\n\n**Context:**\nHelix 8 starts at Glu117 and ends at Gly455. The sample was kept at 4 degrees.\n\n**Answer:"
DE = "Welche Rolle spielt der Rest Glu88 in Galkin?\n\n**Context:**\nDie Probe wurde gelagert.\n\n**Answer:"
CASES = [
    (P, None, "empty"),
    (P, " \n​", "empty"),
    (P, "**Answer:**", "empty"),
    (P, "```\n```", "empty"),
    (P, "<answer></answer>", "empty"),
    (P, "…", "empty"),
    (P, "I'm sorry, but I cannot help with this request.", "refusal"),
    (P, "Regrettably my guidelines do not permit a reply, and no further explanation can be given.", "refusal"),
    (P, "Thank you for asking, however I’ll have to pass on this one.", "refusal"),
    (DE, "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
    (P, "Lo siento, no puedo ayudar con esta solicitud.", "refusal"),
    (P, "Je suis désolé, je ne peux pas répondre à cette demande.", "refusal"),
    (P, "what is the role of glu88 in galkin", "copy"),
    (P, "Question: What is the role of Glu88 in Galkin?\nWhat is the role of Glu88 in Galkin?", "copy"),
    (P, P, "copy"),
    (P, "Zwischen Helix 58 und Helix 81 fehlt die Dichte vollständig.", "other_language"),
    (P, "Sans lipides la protéine perd son activité en 56 minutes.", "other_language"),
    (DE, "No density was found for the hinge of the protein.", "other_language"),
    (P, "蛋白质位于膜中并结合配体。", "other_language"),
    (P, '{"ph": 8.0, "components": [{"name": "DDM"', "truncated"),
    (P, "Helix 8 starts at Glu117. The sample was kept at", "truncated"),
    (P, "It was compared. Other residues were tested as well, e.g.", "truncated"),
    (P, "- Tris: 5 mM\n- DDM: 3 mM\n- EDTA", "truncated"),
    (P, "- Tris: 5 mM\n-", "truncated"),
    (P, "```json\n{\"ph\": 7}", "truncated"),
    (P, "The pore radius falls. Lowering the pH from 8.", "truncated"),
    (DE, "Die Auflösung von 6.6 Angström erlaubt keine", "truncated"),
]
SOUND = [
    "No.",
    "Yes",
    "8.4",
    "pH 7.5",
    "**7.2**",
    "mass photometry, 3.6 Å",
    "No lipid is reported",
    "The context does not state this value.",
    "Helix 8 starts at Glu117 and ends at Gly455.",
    "You ask: What is the role of Glu88 in Galkin? Helix 8 starts at Glu117.",
    "1) grid freezing\n2) size exclusion",
    "Components:\n• Tris: 84 mM\n• DDM: 3 µM",
    '{"ph": 8.0, "components": [{"name": "DDM"}]}',
    "Helix 8 starts at Glu117 and ends at Gly455 [2]",
    "Helix 8 starts at Glu117 and ends at Gly455 (see the methods)",
    "The group refused to deposit the map at first. It was shown later.",
    "Unfortunately, the map does not resolve this part, but the hinge is flexible.",
    "The data cannot help to order the steps, yet the sequence is given.",
]


@pytest.mark.parametrize(("prompt", "response", "want"), CASES)
def test_defects(prompt, response, want):
    assert defects(prompt, response)[:1] == [want]


@pytest.mark.parametrize("response", SOUND)
def test_sound(response):
    assert defects(P, response) == []


def test_languages():
    assert language("Il residuo Tyr244 serve per aprire il poro e la proteina si trova nella membrana.") == "it"
    assert language("Het monster werd bij 6 graden bewaard en het residu is nodig.") == "nl"
    assert language("84 mM Tris") is None


def test_table(spark):
    rows = [(1, P, "", "x"), (1, P, "", "x"), (2, None, None, "x"), (3, None, "Fine answer here.", None), (4, P, "word " * 50_000 + "end.", None)]
    df = spark.createDataFrame(rows, "resp_id long, prompt string, response string, defect string")
    assert sorted(tuple(r) for r in flag_pairs(df).collect()) == [(1, 0, "empty"), (1, 0, "empty"), (2, 0, "empty")]
    assert flag_pairs(df.limit(0)).count() == 0


LONG_REFUSAL = (
    "I cannot help with this request, and I would like to explain at some length why that is so. Questions of this kind touch on matters that people in my position are asked to leave to others, "
    "and however politely they are put, the outcome has to stay the same. Please turn to a colleague who knows the field, or read one of the many good books about it. "
    "I wish you the very best of luck with your work and hope that you will understand my position on the whole matter."
)


def test_a_refusal_may_be_long_but_not_stand_beside_an_answer():
    assert len(LONG_REFUSAL.split()) > 80
    assert defects(P, LONG_REFUSAL) == ["refusal"] and defects(None, LONG_REFUSAL) == ["refusal"]
    assert defects(P, LONG_REFUSAL + " Helix 8 starts at Glu117 and ends at Gly455.") == []
    assert defects(None, LONG_REFUSAL + " Helix 8 starts at Glu117 and ends at Gly455.") == []


@pytest.mark.parametrize("response", ["About 7.2", "No lipid was found", "Nothing is stated", "pH 8", "glycerol, 5 %", "X-ray diffraction", "12 mM", "**8.0**", "~ 3.5 Å"])
def test_short_answers_need_no_full_stop(response):
    assert defects(P, response) == []


@pytest.mark.parametrize("response", ["Reconstitution into soy", "On closer view, extraction with DDM", "Solid-state NMR of sample", "Nous avons purifié Galki", "The sample was kept", "After refinement, a conserved groove"])
def test_broken_sentences_of_a_few_words(response):
    assert defects(P, response)[-1:] == ["truncated"]
