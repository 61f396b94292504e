import pytest
from llm_fixtures import SF, make_docs, ready, real_docs  # noqa: F401

from attestlake.llm.license_scan import TEMPLATES, Scanner, scan_licenses, wording
from attestlake.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_own_wording_wins(name):
    assert Scanner(TEMPLATES).confirm(wording(TEMPLATES[name]))[::2] == (name, [])


def test_saving_ranks_templates():
    scanner = Scanner(TEMPLATES)
    ranked = scanner.rank(wording("This work is licensed under the GNU General Public License, version 3."))
    assert ranked[0][1].startswith("GPL-") and ranked[0][0] > 20  # the versions differ in one character
    assert scanner.confirm(wording(TEMPLATES["GPL-3.0"].upper()))[0] == "GPL-3.0"
    assert scanner.confirm(wording("the license of this garden is unknown to everyone here")) is None
    assert scanner.confirm(wording("This work is licensed under the GNU General Public License, version 4.")) is None


def test_scan(ready, make_docs):
    mit = TEMPLATES["MIT-full"]
    rows = [
        (1, "Some words. Released under the MIT License. More words."),
        (1, "Some words. Released under the MIT License. More words."),
        (2, None),
        (3, ""),
        (4, "no notice at all " * 20_000 + "\nLicensed under CC BY-NC 4.0."),
        (5, "é😀 " + mit.replace(" ", "\n  ", 9).upper()),
        (6, mit.replace("free of charge", "without charge")),
        (7, "license " * 50),
        (8, "Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0."),
        (None, "released under the mit license"),
        (9, TEMPLATES["GPL-3.0-header"] + "\n\n" + TEMPLATES["BSD"] + "."),
    ]
    found = scan_licenses(make_docs(rows)).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append((r.license, r.exact))
    assert by_doc[1] == [("MIT", True)] * 2 and by_doc[None] == [("MIT", True)]
    assert by_doc[4] == [("CC-BY-NC-4.0", True)]
    assert by_doc[5] == [("MIT-full", True)]
    (changed,) = [r for r in found if r.doc_id == 6]
    assert changed.license == "MIT-full" and not changed.exact
    assert changed.missing == ["free", "of"] and changed.added == ["without"]
    assert sorted(by_doc[8]) == [("Apache-2.0", True), ("CC-BY-4.0", True)]
    assert sorted(by_doc[9]) == [("BSD", True), ("GPL-3.0-header", True)]
    assert not {2, 3, 7} & set(by_doc)
    (first,) = {(r.start, r.end) for r in found if r.doc_id == 1}
    assert rows[0][1][slice(*first)] == "Released under the MIT License."
    assert scan_licenses(make_docs([])).count() == 0
    assert scan_licenses(make_docs(rows), {}).count() == 0


def test_query_against_plain_search(spark, real_docs):
    lines = {n: TEMPLATES[n] for n in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    want = sorted(
        (r.doc_id, n) for r in real_docs.collect() for n, line in lines.items() for _ in range(r.text.count(line))
    )
    got = sorted((r.doc_id, r.license) for r in QUERIES["op5_license_scan"](spark, SF).collect())
    assert want and got == want


def test_cues_come_from_the_templates(ready, make_docs):
    own = {"house": "Proprietary and confidential. Do not distribute.", "tiny": "Ask us before you copy it", "none": "!!!"}
    rows = [(1, "Notes.\n" + own["house"] + " More."), (2, "proprietary  AND\nconfidential. do not distribute"), (3, "so: ask us before you copy it!"), (4, "nothing here")]
    found = scan_licenses(make_docs(rows), own).collect()
    assert sorted((r.doc_id, r.license, r.exact) for r in found) == [(1, "house", True), (2, "house", True), (3, "tiny", True)]


@pytest.mark.parametrize("gap", ["\n", "  ", "\r\n ", "\t"])
def test_notices_broken_anywhere(ready, make_docs, gap):
    rows = []
    for i, name in enumerate(sorted(TEMPLATES)):
        words = TEMPLATES[name].split(" ")
        rows += [(100 * i + at, " ".join(words[:at]) + gap + " ".join(words[at:])) for at in range(1, len(words)) if at < 4 or at == len(words) - 1]
    found = {r.doc_id: (r.license, r.exact) for r in scan_licenses(make_docs(rows)).collect()}
    assert found == {doc_id: (sorted(TEMPLATES)[doc_id // 100], True) for doc_id, _ in rows}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_match_has_a_cue(name):
    """As many words as a match may lack are taken out, the cues first."""
    import re

    from attestlake.llm.license_scan import MISSING_SHARE, cue_pattern, cue_words

    words = wording(TEMPLATES[name])
    lacking = int(MISSING_SHARE * len(words))
    for _ in range(lacking):
        words.remove(next(w for w in [*cue_words(TEMPLATES), *words] if w in words))
    assert re.search(cue_pattern(TEMPLATES), " ".join(words))
