"""Name variants: golden groups, rewritings, and names that must stay apart."""

from quillspan.llm.name_variants import link_names, pairs_of, rewritings, shortened, tokens

GROUPS = [
    ["University of Dunbridge", "DUNBRIDGE UNIVERSITY", "Univ. of Dunbridge", "The University of Dunbridge", "Dunbridge, University of", "U. of Dunbridge", "Uni of Dunbridge (UD)", "Department of Medicine, University of Dunbridge", "Univeristy of Dunbrdige"],
    ["Dunbridge Metropolitan University", "Metropolitan University of Dunbridge", "Dunbridge Met University", "Dunbridge Metro. Uni"],
    ["St Olave's Hospital Dunbridge", "ST. OLAVES HOSPITAL DUNBRIDGE", "Saint Olave’s Hospital, Dunbridge", "Dunbridge St Olave's Hosp (SOHD)"],
    ["St Olave's Hospital Marlwick", "Saint Olave's Hospital, Marlwick"],
    ["Marlwick Clinical Trials Unit", "Marlwick CTU", "Clinical Trials Unit (CTU), Marlwick"],
    ["Marlwick City Council", "marlwick city cncl"], ["Marlwick County Council"],
    ["Marlwick Analytics Limited", "Analytics (Marlwick) Ltd", "MARLWICK ANALYTICS"],
    ["William Tarrowby", "Bill Tarrowby", "Dr W. Tarrowby", "TARROWBY, William", "Tarrowby, W.", "Tarrowby William"],
    ["Susan Penhallow", "Prof. Sue Penhallow"], ["Simon Penhallow"], ["S Penhallow"],
]


def test_groups(spark):
    names = [(n, g) for g, names in enumerate(GROUPS) for n in names]
    data = [(i, n) for i, (n, _) in enumerate(names)] + [(900, None), (901, ""), (902, "?!"), (903, None)]
    rows = spark.createDataFrame([(i, n, "clash", "clash") for i, n in data], "name_id long, party_name string, form string, word string")
    got = {r.name_id: r.entity for r in link_names(rows, "name_id", "party_name").collect()}
    assert len(got) == len(data)
    entity = {}
    for i, (n, g) in enumerate(names):
        entity.setdefault(g, {}).setdefault(got[i], []).append(n)
    assert {g: len(e) for g, e in entity.items()} == {g: 1 for g in entity}, entity
    assert len({next(iter(e)) for e in entity.values()}) == len(GROUPS)
    assert len({got[i] for i in (900, 901, 902, 903)}) == 4


def test_pairs_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "Marlwick Hospice"), (2, "The Marlwick Hospice"), (3, "Marlwick Hospice"), (4, "Dunbridge Hospice")], "name_id long, party_name string")
    assert sorted(tuple(r) for r in pairs_of(link_names(rows, "name_id", "party_name"), "name_id", "entity").collect()) == [(1, 2), (1, 3), (2, 3)]


def test_empty_and_long(spark):
    rows = spark.createDataFrame([(1, "word " * 3000)], "name_id long, party_name string")
    assert link_names(rows, "name_id", "party_name").count() == 1
    assert link_names(rows.limit(0), "name_id", "party_name").collect() == []


def test_rewritings():
    assert rewritings(tokens("Beth Varrick")) == ["p:elizabeth varrick", "i:e varrick", "i:v elizabeth"]
    assert rewritings(tokens("Varrick, E.")) == ["i:e varrick"]
    assert "p:christopher moss" in rewritings(tokens("Chris Moss")) and "p:christine moss" in rewritings(tokens("Chris Moss"))
    assert rewritings([]) == []


def test_struck_out_forms_meet_when_one_slip_away():
    for a, b in (("marlwick", "malrwick"), ("marlwick", "marlwic"), ("marlwick", "marlwixk"), ("marlwick", "marllwick")):
        assert set(shortened(a)) & set(shortened(b))
