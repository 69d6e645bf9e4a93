import re

from trekframe.llm import license_scan as L
from trekframe.llm.common import table
from tests.llm.data import edge_docs, empty_docs


def tells(a, b, name):
    """Whether bigrams a tell the version and variant of template b."""
    words = lambda x: {w for g in x for w in g.split()} & L.VARIANTS
    needed = set(L.needs(name, sorted(b)))
    return words(a) == words(b) and (not needed or bool(a & needed))


def brute(text, templates, t):
    """Best (dice, name) over all lines, paragraphs and the whole, without any bound."""
    norm = re.sub("[^a-z0-9\n]+", " ", (text or "").lower())
    parts = norm.split("\n") + re.split("\n *\n", norm) + [norm]
    best = []
    for part in parts:
        a = set(L.bigrams(part))
        for name, template in templates.items():
            b = set(L.bigrams(template))
            if a and (dice := 2 * len(a & b) / (len(a) + len(b))) >= t and tells(a, b, name):
                best.append((-dice, name))
    return min(best, default=(0.0, None))


def check(docs, templates=None):
    want = {r.doc_id: brute(r.text, templates or L.TEMPLATES, L.THRESHOLD) for r in docs.select("doc_id", "text").collect()}
    got = L.license_scan(docs, templates).collect()
    assert len(got) == docs.count()
    for g in got:
        assert (g.license, round(g.dice, 9)) == (want[g.doc_id][1], round(-want[g.doc_id][0], 9)), g
    return got


def test_documents(spark, sf_dir):
    assert any(g.license for g in check(table(spark, sf_dir, "documents")))


def test_edges_and_variants(spark):
    full = L.TEMPLATES["MIT notice"]
    texts = [full, full.upper() + "\n", full[: len(full) // 2], "x\n" + full.replace(". ", ".\n") + "\n\ny", "intro\n\n" + full.replace(": ", ":\n") + "\n\nend", "Licensed under the Apache License, Version 2.0", "prose mentioning a license"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g.doc_id: g.license for g in check(docs)}
    assert got[0] == got[1] == got[4] == "MIT notice" and got[6] is None
    check(edge_docs(spark).where("doc_id is not null"))
    assert L.license_scan(empty_docs(spark)).count() == 0


def test_anchors_never_lose_a_match():
    for text in L.TEMPLATES.values():
        grams = L.bigrams(text)
        words = L.anchors(grams, L.THRESHOLD)
        left = [g for g in grams if not words & set(g.split())]
        assert len(left) < L.bounds(len(grams), L.THRESHOLD)[0]


def test_notices_inside_longer_lines_and_over_paragraphs(spark):
    apache, gpl, bsd = (L.TEMPLATES[k] for k in ("Apache-2.0 notice", "GPL-3.0 notice", "BSD-2-Clause conditions"))
    prose = " ".join(f"we walked {i} miles along river{i} and of the hill{i} under" for i in range(30)) + ". "
    texts = {
        "Apache-2.0 notice": apache.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n\nUnless"),
        "GPL-3.0 notice": gpl.replace(" This program is distributed", "\n\nThis program is distributed"),
        "BSD-2-Clause conditions": bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. "),
        "CC-BY-4.0 sentence": L.TEMPLATES["CC-BY-4.0 sentence"],
    }
    rows = [(i, f"{prose}\n\n{t}\n\n{prose}" if "\n" in t else f"We met there. {t} {prose}") for i, t in enumerate(texts.values())]
    changed = L.TEMPLATES["GPL-3.0 sentence"].replace("licensed", "being freely licensed")
    rows += [(4, f"{prose} {changed} {prose}"), (5, prose + "a license is a permission; the software is released under terms. " + prose)]
    got = {r.doc_id: (r.license, r.dice) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def windows(text):
        """Best over all windows of words, without any bound but the length."""
        words, best = re.sub("[^a-z0-9]+", " ", text.lower()).split(), []
        for name, template in L.TEMPLATES.items():
            b = set(L.bigrams(template))
            longest = max(int(len(b) * 1.5 + 1e-9), len(re.sub("[^a-z0-9]+", " ", template.lower()).split()) - 1)
            for at in range(len(words)):
                a = set()
                for x, y in zip(words[at : at + longest], words[at + 1 : at + longest + 1]):
                    a.add(f"{x} {y}")
                    if (dice := 2 * len(a & b) / (len(a) + len(b))) >= L.THRESHOLD and tells(a, b, name):
                        best.append((-dice, name))
        dice, name = min(best, default=(0.0, None))
        return name, -dice

    for i, text in rows:
        want = windows(text)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9, (i, got[i], want)
    assert [got[i][0] for i in range(4)] == ["Apache-2.0 line", *list(texts)[1:]]  # the line begins the notice, scores as much and sorts first
    assert got[4][0] == "GPL-3.0 sentence" and got[5] == (None, 0.0)


def test_relatives_get_their_own_name_or_none(spark):
    """Expected names are the licences' own, written here without the templates."""
    want = {
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 1.": "GPL-1.0",
        "This work is licensed under the GNU General Public License, version 4.": None,
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
        "This work is licensed under a Creative Commons Attribution 2.5 Generic License.": None,
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under the Apache License, Version 1.1.": None,
        "Released under the MIT License.": "MIT",
        "Released under the GNU License.": None,
    }
    prose = " ".join(f"we walked {i} miles along river{i}" for i in range(20))
    rows = [(10 * i + k, t) for i, line in enumerate(want) for k, t in enumerate((line, f"{prose}\n{line}\n{prose}", f"We say so. {line} {prose}"))]
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (line, name) in enumerate(want.items()):
        for k in range(3):
            found = got[10 * i + k].license
            assert (found is None) if name is None else (found or "").startswith(name + " "), (line, k, found)
    both = spark.createDataFrame([(1, "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    assert L.license_scan(both).first().licenses == "GPL-3.0 sentence,MIT line"
