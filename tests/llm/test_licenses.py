import re

from conftest import ODD
from torquil.llm import licenses as L


def test_base_phrases_and_templates(documents):
    mit = L.TEMPLATES["mit"]
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 25 != 7)
    rows = [
        (1, "Released under the MIT License. And under the mit license! CC-BY-NC too"),
        (2, "under the mit-license apache license, version 2.0 cc by éc cc by"),
        (3, "intro words here " * 9 + mit + " tail"),
        (4, "# " + changed.upper()),
        (5, "under the mit\x00license"),
        (6, "cc by nc " * 500),
        (7, "cc by nc by nc cc cc by nc"),
        *ODD,
    ]
    got = sorted([tuple(r)[:6] for r in L.license_scan(documents(rows)).collect()], key=str)
    want = []
    for i, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        at = [(j, label) for p, label in L.PHRASES.items() for q in [p.encode().split()] for j in range(len(w)) if w[j : j + len(q)] == q]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in L.license_scan(documents(rows)).collect()}
    assert labels[3] == ("mit", 1.0) and labels[4][0] == "mit" and 0.7 <= labels[4][1] < 1 and labels[901] == ("", 0.0)
    assert L.license_scan(documents([])).count() == 0


def test_rows_without_or_with_the_same_id(documents):
    odd = [(None, "under the mit license"), (None, "x cc by nc"), (5, "nothing"), (5, "cc by nc"), (None, "x cc by nc")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word or 0, r.labels) for r in L.license_scan(documents([*odd, (None, L.TEMPLATES["mit"])])).collect())
    assert got == sorted([(0, 4, 1, 0, "mit"), (0, 4, 1, 1, "cc-by-nc"), (0, 4, 1, 1, "cc-by-nc"), (5, 1, 0, 0, ""), (5, 3, 1, 0, "cc-by-nc"), (0, len(L.words(L.TEMPLATES["mit"].encode())), 0, 0, "mit")])
