import pytest

from tests.helpers import QUERY_LOG, messages, opened


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    return opened(spark, tmp_path_factory.mktemp("query"), {"day": QUERY_LOG})


CASES = {
    "": 7,
    "level>=W": ["parcel late delay=45", "lamp broken", "note without a place"],
    "level>W": ["lamp broken", "note without a place"],
    "level<D": ["kettle on"],
    "level<=D": ["kettle on", "letter sorted"],
    "level:V,I": ["kettle on", "letter posted", "door opened"],
    "-level:V,I,E": ["letter sorted", "parcel late delay=45"],
    "level>=W level<=W": ["parcel late delay=45"],
    "category:mail": ["letter sorted", "letter posted", "parcel late delay=45"],
    "category:Mail,Home": 5,
    "category:Mail level>=W": ["parcel late delay=45"],
    "category:Mail category:Home": [],
    "-category:Mail": ["kettle on", "lamp broken", "note without a place", "door opened"],
    "-category:Mail -category:Home": ["note without a place", "door opened"],
    "category>=Mail": 3,
    "tag:~Post": ["letter sorted", "letter posted", "parcel late delay=45"],
    "Tag:~post": 3,
    'category:"Mail"': 3,
    "delay": ["parcel late delay=45"],
    '"delay=45"': ["parcel late delay=45"],
    "DELAY": ["parcel late delay=45"],
    "late delay": ["parcel late delay=45"],
    "delay late": [],
    "-timeout": [],
    "-delay": ["parcel late delay=45"],
    "/letter (sort|post)ed/": ["letter sorted", "letter posted"],
    "/LETTER SORTED/": ["letter sorted"],
    "/letter sorted/ /letter posted/": ["letter posted"],
    "since:08:40 until:09:00": ["letter posted", "parcel late delay=45"],
    "since:08:40 since:09:40": ["note without a place", "door opened"],
    "since:2027-03-05T09:40": ["note without a place", "door opened"],
    "since:-40m": ["lamp broken", "note without a place", "door opened"],
    "since:-20m": ["note without a place", "door opened"],
    "until:2027-03-05": [],
    "until:2027-03-06": 7,
}


@pytest.mark.parametrize("query", CASES)
def test_selects(source, query):
    expected = CASES[query]
    found = source.query(query)
    assert found.problems == []
    got = messages(found.df)
    assert (len(got) if isinstance(expected, int) else got) == expected


PROBLEMS = {
    "colour:red": (7, ["colour: no such field here; there are level, since, until, category, tag"]),
    "category:Mial": (7, ["category: no entry has 'Mial'"]),
    "category:Mail,Mial": (3, ["category: no entry has 'Mial'"]),
    "-category:Mial": (7, ["category: no entry has 'Mial'"]),
    "tag:~zzz": (7, ["tag: no entry has a value with 'zzz' in it"]),
    "since:yesterday": (7, None),
    'since:"2027-03-05 09:40"': (7, None),
    "category:": (7, ["category: nothing to look for after the sign"]),
    "level:": (7, ["level: nothing to look for after the sign"]),
    "level:Nope category:": (7, ["level: 'Nope' is none of V, D, I, W, E", "category: nothing to look for after the sign"]),
    "/(/": (7, None),
    "level>=W colour:red": (3, None),
}


@pytest.mark.parametrize("query", PROBLEMS)
def test_problems(source, query):
    n, told = PROBLEMS[query]
    found = source.query(query)
    assert found.count == n
    assert found.problems == told if told is not None else len(found.problems) == 1


def test_counts_lift_their_own_control(source):
    rows = {(r["control"], r["value"], r["bucket"]): r["n"] for r in source.query("category:Mail").counts(4).collect()}
    assert {k[1]: n for k, n in rows.items() if k[0] == "facet:category"} == {"Mail": 3, "Home": 2, "Door": 1}
    assert {k[1]: n for k, n in rows.items() if k[0] == "facet:tag"} == {"PostSort": 2, "PostVan": 1}
    assert {k[1]: n for k, n in rows.items() if k[0] == "level"} == {"1": 1, "2": 1, "3": 1}
    narrowed = {(r["control"], r["value"], r["bucket"]): r["n"] for r in source.query("since:09:20").counts(4).collect()}
    assert sum(n for k, n in narrowed.items() if k[0] == "timeline") == 7
    assert sum(n for k, n in narrowed.items() if k[0] == "level") == 3


def test_single_scan_equals_separate_counts(source):
    from tidelog.operators import facets

    found = source.query("category:Mail level>=D")
    rows = {(r["control"], r["value"], r["bucket"]): r["n"] for r in found.counts(5).collect()}
    apart = {("facet:tag", r["value"], None): r["n"] for r in facets.facet_counts(source.entries, found.query, "tag").collect()}
    apart |= {("facet:category", r["value"], None): r["n"] for r in facets.facet_counts(source.entries, found.query, "category").collect()}
    apart |= {("level", str(r["level_ord"]), None): r["n"] for r in facets.level_counts(source.entries, found.query).collect()}
    apart |= {("timeline", str(r["level_ord"]), r["bucket"]): r["n"] for r in facets.timeline(source.entries, found.query, *source.bounds, 5).collect()}
    assert rows == apart


def test_top_values_are_by_total(source):
    listed, more = source.query("category:Home").top("category")
    assert [r["value"] for r in listed.collect()] == ["Mail", "Home", "Door"]
    assert more == 0


def test_context_ignores_the_query(source):
    assert messages(source.context(3, 1)) == ["letter posted", "parcel late delay=45", "lamp broken"]


def test_results_api(source, tmp_path):
    from tidelog.operators.results import Selection

    found = source.query("category:Mail")
    assert [r["message"] for r in found.page(1, 1).collect()] == ["letter posted"]
    assert found.position_of(3) == 2 and found.position_of(0) == -1
    text, notice = found.copy(Selection(0, 2), cap=2)
    assert text.count("\n") == 1 and notice == "Copied 2 of 3 entries"
    assert found.copy(Selection.at(0))[1] is None
    assert found.export(str(tmp_path / "out.log"), single=True) == 3
    assert (tmp_path / "out.log").read_text().count("letter ") == 2
    assert found.is_stale("category:Home") and not found.is_stale("category:Mail")
    assert Selection(1, 3).moved(5, 5) == Selection.at(4)
    assert Selection(1, 3).moved(-9, 5, extend=True) == Selection(1, 0)
    assert Selection(3, 4).within(2) == Selection(1, 1)


def test_dictionary_and_detail(source):
    assert [(r["value"], r["total"]) for r in source.dictionary("category").collect()] == [("Mail", 3), ("Home", 2), ("Door", 1)]
    assert source.detail(5)["Category"] == "none"
    assert source.detail(3)["Level"] == "Warn"
