"""Problem 10: template residue and error pages."""

import pytest

from permeate.llm import templates
from permeate.llm.templates import PrefixTree, find_residue, judge, mark, mask, mine_templates, open_slots, segments

REAL = "In this state, the pore radius falls to 4.2 angstrom at Ile530. Loss of Phe9 abolished signal relay in Halomonas minor."
LONG = " ".join(f"Helix {i} starts at Ile{i + 3} and ends at Phe{i + 20} in bicelles." for i in range(6))
CASES = [
    ("{{ title }}: In this state, {{ residue }} binds a lipid.", "placeholder"),
    (REAL + " The radius is @@value@@ angstrom.", "placeholder"),
    ("Helix <%= number %> starts at <%= residue %>.", "placeholder"),
    ("We kept [insert protein here] at [insert value here] degrees.", "placeholder"),
    ("[your title goes here]: " + REAL, "placeholder"),
    ("Loss of _____ abolished _____ in _____.", "placeholder"),
    (REAL + " The map at <VALUE> angstrom shows <LIGAND>.", "placeholder"),
    (REAL + " The map at [VALUE] angstrom.", "placeholder"),
    ("#TITLE#\n" + REAL, "placeholder"),
    (REAL + " The map at {value} angstrom shows {ligand}.", "placeholder"),
    ("Lorem ipsum dolor sit amet. Elit velit nulla labore sed.", "filler"),
    ("Text goes here. Text goes here.", "filler"),
    ("Crystal form of Galkin in nanodiscs\n" + "Musterzeile. " * 7, "filler"),
    ("blah blah blah blah blah etc etc", "filler"),
    ("hkkj hlhh ljjkkjlk faffsasdf jjkkkkk jhljhjkk", "filler"),
    ("Crystal form of X\nDummy abstract, replace later.", "filler"),
    ("nginx-like gateway\n<h1>504 Gateway time-out</h1><hr>Something went wrong on our side.", "error_page"),
    ("Traceback (most recent call last):\n  File \"serve/fetch.py\", line 3, in render\nKeyError: 'title'", "error_page"),
    (REAL + "\nError 502: bad gateway.", "error_page"),
    ('{"status": 404, "error": "Not Found", "message": "x"}', "error_page"),
    ("401 Sign-in needed", "error_page"),
    ("Seite nicht gefunden.", "error_page"),
    ("Erreur 404 – la notice 12 est introuvable.", "error_page"),
    ("Please enable JavaScript to view this page.", "script_notice"),
    ("Scripts blocked; the plot will not be drawn.", "script_notice"),
    ("Bitte aktivieren Sie JavaScript, um den Eintrag zu sehen.", "script_notice"),
    ("We’re sorry but the article doesn’t work properly without client-side scripts enabled.", "script_notice"),
    ("Error 404: record on ions not found.", "error_page"),
    ("Please enable JavaScript for particle picking.", "script_notice"),
    ("<h1>503</h1> the particles were left out", "error_page"),
    ("Error 500 before the map was loaded", "error_page"),
    ("Traceback (most recent call last): particles", "error_page"),
    ("Ordinary line\nat org.app.View(View.java:88)", "error_page"),
]
# wordings of other sites, in four languages
CASES += [(t, "error_page") for t in ("This page isn’t working", "Something went wrong.", "Die angeforderte Seite existiert nicht", "La página solicitada no existe", "Uncaught TypeError: x is undefined", "Verbindung fehlgeschlagen")]
CASES += [(t, "script_notice") for t in ("JavaScript is disabled in your browser.", "Für diese Seite wird JavaScript benötigt.", "Ce site nécessite JavaScript.", "Necesita habilitar JavaScript.")]
CASES += [(t, "filler") for t in ("n/a n/a n/a", "foo bar baz", "Text folgt.", "Ceci est un texte d’exemple.", "No content yet.")]
CASES += [(t, "placeholder") for t in ("%(title)s binds %(ligand)s", "$TITLE binds $LIGAND", "TITLE_HERE: helix of RESIDUE_HERE", "{$title} binds {$ligand}", "[% title %] binds", "==TITLE== binds ==X_Y==", "::title:: binds", "^^title^^ binds")]
ALONE = [
    "In C++ the std::vector of US$ prices was sorted; see go_here and == equal == signs.",
    "== Methods ==\nThe grid was blotted for 3 seconds.",
    "The rate of the exporter fell per second with a mean error of 3 angstrom when the volume of the third helix of the protein in the membrane of the cell was changed by loss of the residue near the pore.",
    REAL,
    "The web viewer is written in JavaScript and draws 80 atoms per second.",
    "The form has a {{title}} field, which the curators filled for all 9 maps.",
    "The {111} plane and the set {A, B, C} of chains are drawn in grey.",
    "The [Fe4S4] cluster and [Mg] site bind <3 ligands; see (X) and [4].",
    "Buffers were kept at $27 per litre, and the 100% input lane {input} is shown.",
    "The *gelida* strain grew at <i>low</i> salt and <sup>high</sup> light.",
    "Unknown residues are written XXX in the sequence STLAQIECWXXXXPVVDLKA.",
    "Ipsum contacts and the dolor-type toxin fold are treated elsewhere.",
    "",
]
# sentences that only speak of errors and scripts; their templates stand inside real texts
INSIDE = [
    "Access to the pore is denied to ions larger than Leu.",
    "Users of the earlier viewer were told to enable JavaScript; the new one draws Galkin on the server.",
    "Refinement failed 4 times with an internal server error before the map was accepted.",
    'Two of the old links answered with "page not found" and were left out of the table of 9 entries.',
    "Blank grids served as dummy samples, and lorem-type filler was removed from 12 remarks.",
]


def kinds(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.kind for r in find_residue(df, **more).collect()}


def test_kinds(spark):
    texts = [t for t, _ in CASES] + ALONE + [f"{LONG} {s} {LONG}" for s in INSIDE]
    found = kinds(spark, texts)
    assert [found.get(i) for i in range(len(texts))] == [k for _, k in CASES] + [None] * (len(ALONE) + len(INSIDE))


def test_verdicts_come_from_all_documents_of_a_template(spark):
    """A short document with a sentence that stands inside real texts elsewhere is real, by the tree only."""
    said = "Refinement of map number {} failed with an internal server error twice."
    texts = [f"{LONG} {said.format(w)} {LONG}" for w in "alpha beta gamma delta epsilon zeta eta theta".split()] + [said.format("omega")]
    assert kinds(spark, texts) == {}
    assert kinds(spark, texts, similar=1.1) == {8: "error_page"}  # without merging each line has its own evidence only


def test_lines_share_a_template_however_introduced():
    a, b = mark("At low salt, the server request failed with an error.").lines[0], mark("FUNCTION: By contrast, the server request failed with an error.").lines[0]
    assert a[0] == b[0] == ("the", "server", "request", "failed", "with", "an", "error.")


def test_templates_merge_what_differs():
    tree = PrefixTree(depth=2)
    for i in range(5):
        tree.add(mask(f"Error {600 + i}: the entry {i} is gone for ever and {i} days"))
    (group,) = tree.groups()
    assert group[1] == 5 and group[0][1] == "<*>" and group[0][0] == "error"
    assert mask("Error 404 in JavaScript 12") == ("error", "404", "in", "<script>", "<*>")


def test_judge_weighs_form_and_place():
    assert judge("error 404: not found.", 10, 4.0, 0) == "error_page"
    assert judge("error 404: not found.", 10, 0.0, 0) is None
    assert judge("the server request failed with an error.", 10, 3.0, 0) is None
    assert judge("the server request failed with an error.", 10, 9.0, 0) == "error_page"
    assert judge("<script> blocked; the <*> will not be drawn.", 1, 1.0, 0) == "script_notice"


def test_slots():
    assert open_slots("see <i>x</i> and <div>") == 0 and open_slots("<b>PDB</b>") == 0
    assert open_slots("{{a}} and {{b}}") == 2 and open_slots("quoted '{{a}}'") == 0
    assert open_slots("one {lane} only") == 0 and open_slots("{lane} and {value}") == 2


def test_segments_cover_the_text():
    assert "".join(segments("A b. C d!\nE")) == "A b.C d!E"


def test_table(spark):
    rows = [(1, CASES[0][0], "k"), (1, CASES[0][0], "k"), (2, None, None), (3, " ", None), (4, REAL * 2000, None), (None, "Error 404: not found.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumnsRenamed({}).selectExpr("*", "'x' as mask", "1 as rid")
    found = sorted((tuple(r) for r in find_residue(df).collect()), key=str)
    assert found == [(1, "placeholder"), (1, "placeholder"), (None, "error_page")]
    assert find_residue(df.limit(0)).count() == 0
    assert mine_templates(spark.createDataFrame([(i, "Error 404: not found.") for i in range(4)], "doc_id long, text string")).first().n == 4


def test_partitions_do_not_matter(spark):
    texts = [t for t, _ in CASES] * 3 + ALONE + [f"{LONG} {s} {LONG}" for s in INSIDE] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = (sorted(tuple(r) for r in find_residue(df.repartition(n)).collect()) for n in (1, 13))
    assert one == many


def test_a_hot_line_is_counted_whole(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Error 404: not found.', concat('Loss of Phe', id, ' abolished relay.')) as text")
    assert find_residue(df).groupBy("kind").count().collect()[0]["count"] == 6667
    assert templates.mine_templates(df).collect()[0].n == 6667
