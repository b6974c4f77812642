"""Slots, filler, templates and verdicts."""

import pandas as pd
import pytest
from conftest import rows

from silomesh.llm import residue
from silomesh.llm.slots import field_name, is_request, mask_slots, slot

CASES = [
    "Contact: {{ owner }}", "We hold %%title%% rows.", "of ${silo.region} rows", "see %(table_count)s now", "<%= summary_2 %>", "lies between {% if region %} and 3", "[[LAST_UPDATE]]", "@@silo.downloadSize@@", "__YOUR_NAME_7__", "by $SOURCE_LINK_6$ rows",
    "for #{title} only", "the {steward} said", "<<contact>>", "<Your first column>", "&lt;item.silotitle&gt;", "{{ 'topic' | t }}", "{{ publisher | default('') }}", "{{{columnList}}}", "[Insert licence here]", "(Enter title)", "[abstract goes here]",
    "[Hier steward ergänzen]", "[Bitte silo title eintragen]", "[date à compléter]", "[Indiquez date]", "[steward por completar]", "(Escriba column list)", "TODO: write owner", "FIXME row count missing, fill in", "TBD: related silos", "Licence: ?????", "run to XXXX,",
    "_____ (publisher) to", "... (curator to follow)", "Lorem ipsum dolor sit amet irure enim.", "asdf zxcv jkl; sdfg", "blah blah blah blah", "sample text. sample text. sample text. sample text.",
]
SOUND = [
    'Write "${owner}" in the layout file.', "replaces each `{{ region }}` marker by the value", "const label = `${table}.${column}`;", 'print(f"{name}: {score}")', "export OUT=${BASE_DIR}/graph", "with $d = 1 - s$ for $s$ above", "- x, Samples: [lorem|ipsum|dolor]",
    "the press used lorem ipsum; the printed edition of 1999", "Rule 3: a term of XXX is the Roman number thirty", "awk '{ print $1, $2 }' edges.csv", "- name, Samples: [{A}|{B}]", "# a title", "what?? no",
    "<html><head><title>Silo</title></head></html>", "", "[N/A]", "(see the owner)", "test the test",
]


@pytest.mark.parametrize("text", CASES)
def test_slots_are_found(text):
    assert slot(text)


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_have_no_slot(text):
    assert not slot(text)


def test_fields_and_requests():
    assert field_name("silo.sourceLink_3") == "silosourcelink" and field_name("'topic' | t") == "topic"
    assert is_request("Your last update") and is_request("owner goes here") and not is_request("owner") and not is_request("add rows here")
    masked, found, left = mask_slots("by {{ owner }} and {{ custodian }} in `%%title%%`, " + "[Insert " + "the " * 40 + "licence here]")
    assert masked == "by <SLOT> and {{ custodian }} in `%%title%%`, <SLOT>" and found and [n for n, _ in left] == ["custodian"]


def test_suggested_classes():
    for t in ("The page is overloaded at the moment", "HTTP Status <N> - Gone", "Error <N>", "To use this table javascript is needed, yours seems to be off.", "Seite nicht gefunden", "Cette fiche est introuvable", "La tabla no se pudo cargar", "Please enable javascript to view this page."):
        assert residue.classify(t) == "message", t
    for t in ("Home", "<ID> Sign in", "Back to the start page", "Contact the help desk", "<N>", "# <ID>", "Try again later."):
        assert residue.classify(t) == "frame", t
    for t in ("The values of label run from <N> to <N>, with a long tail.", "<TIME> ERROR file for <ID> not found, skipped"):
        assert residue.classify(t) == "content", t
    assert residue.classify("This is placeholder text for the description.") == "filler"


def test_mining_merges_alike_segments():
    m = residue.mine_leaf(pd.DataFrame({"masked": ["The page is down now", "The card is down now", "We keep all old rows"], "n": [5, 2, 1]}))
    t = dict(zip(m.masked, m.template))
    assert t["The page is down now"] == t["The card is down now"] == "The <*> is down now" and t["We keep all old rows"] == "We keep all old rows"


def test_residue_of_documents(spark):
    docs = [
        (1, "Home | Help | About\n404 Page not found\nThe page is overloaded at the moment. Try again later.\nBack to the start page"), (2, "SilentTheatreRoute_angle | Silo portal <html><head><title>This card does not exist any more!</title></head><body><h1>This card does not exist any more!</h1></body></html>"),
        (3, "The values of label run from 3 to 9, with a long tail.\nPage not found was the title of the ferry exhibition in Corora, seen by 76 visitors."), (4, None), (5, "  \n"), (6, "Known gaps\n\nThe owner of the table is {{ owner }}."), (7, "The board publishes a new list every week. Dies ist ein Blindtext."),
        (8, "12:00:01 ERROR silo x: file for y not found, skipped\n12:00:02 HTTP 503 from mirror"), (9, "Home | Help"), (10, "The board publishes a new list every week."), (11, "Please enable JavaScript to view this page."), (11, "Please enable JavaScript to view this page."), (12, "word " * 50000),
        (13, "word " * 50000 + "%%title%%"), (14, "12:01:05 loader started fine. Lorem words. This text is placeholder text for a card."), (15, "Table:\nError 404 page not found"), (16, " | ".join(["Home", "Help", "About"] * 40) + "\nPage not found"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as verdict", "'x' as masked", "0 as slot")
    got = residue.find_residue(df)
    assert sorted({tuple(r) for r in got.collect()}) == [(1, "message"), (2, "message"), (6, "slot"), (7, "filler"), (11, "message"), (13, "slot"), (14, "filler"), (15, "message"), (16, "message")]
    assert residue.find_residue(df.limit(0)).count() == 0


def test_repeated_ids_come_out_once(spark):
    df = spark.createDataFrame([(1, "Error 404"), (1, "Error 404")], "doc_id long, text string")
    assert rows(residue.find_residue(df)) == [(1, "message")]


def found(spark, docs):
    return {r[0]: r[1] for r in residue.find_residue(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_what_a_sentence_stands_among_decides(spark):
    """Wording that no list knows: it is judged by the pages it stands on, and only as a template."""
    plain = [f"The values of label run from {i} to {i + 9}, with a long tail. The board in Zimoun lists {i} mansions." for i in range(20)]
    asks = "One reader asked whether table {0} could not be found or was renamed."
    docs = [(i, f"{plain[i]} {asks.format(i)}") for i in range(9)] + [(20, asks.format(77))]
    docs += [(30 + i, f"Access denied\nOur gnomes have eaten all of wheel {i} tonight.") for i in range(6)] + [(40, "Home | Help\nAccess denied\nOur gnomes have eaten all of wheel 9 tonight.\nBack to the start page")]
    docs += [(50 + i, f"This is dummy text. Squeaky words {i} that nobody has to read go on here.") for i in range(6)] + [(60, f"{plain[3]} Squeaky words 12 that nobody has to read go on here.")]
    docs += [(70 + i, f"{plain[i]} A raw {{{{ owner }}}} in old cards of {i} silos means that the loader failed.") for i in range(6)]
    docs += [(80, f"{plain[1]} The values of label run from {{{{ owner }}}} to 12, with a long tail.")]
    docs += [(90 + i, f"{plain[i]} Ask {m} for more.") for i, m in enumerate(("{{ custodian }}", "%%custodian%%", "<<custodian>>", "[[CUSTODIAN]]"))] + [(95, plain[2] + " x = `{base}`; y = {base}; z = {base}")]
    got = found(spark, docs)
    assert got == {i: "message" for i in (*range(30, 36), 40)} | {i: "filler" for i in (*range(50, 56), 60)} | {80: "slot"} | {i: "slot" for i in range(90, 94)}


def test_templates_matter(spark, monkeypatch):
    """Without the tree every segment would be judged alone: the same sentence about many things has no evidence then."""
    docs = [(i, f"The values of label run from {i} to {i + 9}, with a long tail. The board in Zimoun lists {i} mansions. A key is {i}. A page could not be found under {w} in the old list.") for i, w in enumerate(("heron", "ferry", "mill", "loom", "arch", "quay"))]
    docs += [(9, "A page could not be found under lantern in the old list.")]
    assert found(spark, docs) == {}
    monkeypatch.setattr(residue, "mine_templates", lambda work, distinct: distinct.selectExpr("masked", "masked as template"))
    assert found(spark, docs) == {9: "message"}


def test_leaves_of_any_size_give_one_template(spark):
    from silomesh.runtime import Workspace

    words = spark.range(5000).selectExpr("concat('We hold the entry k', id, 'x of the list') as masked", "1L as n")
    assert residue.mine_templates(Workspace(spark, "t"), words).select("template").distinct().count() == 1
