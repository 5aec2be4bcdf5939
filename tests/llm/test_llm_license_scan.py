"""Licence notices against edit distances of all spans of whole words."""

import random
import re

import pytest
from cases import collected, documents, messy_rows, ordered, small_documents

from matchgrain.llm import license_scan as scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_base(text):
    w = words(text)
    places = [(i, label) for phrase, label in scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def fewest(w, notice):
    """The fewest edits of the notice over all spans of words, or None if there are more than allowed."""
    name, k = notice.name.split(), notice.edits
    best = None
    for a in range(len(w)):
        if w[a : a + len(name)] != name:
            continue
        at = a + len(name)
        if not notice.words:
            return 0
        for b in range(at + 1, len(w) + 1):
            span = " ".join(w[at:b])
            if len(span) > len(notice.words) + k:
                break
            if len(span) >= len(notice.words) - k and (d := distance(notice.words, span)) <= k and (best is None or d < best):
                best = d
    return best


def harmed(r, text, edits):
    t = list(text)
    for _ in range(edits):
        i = r.randrange(len(t))
        kind = r.randrange(3)
        if kind == 0:
            t[i] = r.choice("abcxyz é")
        elif kind == 1:
            t.insert(i, r.choice("qz e"))
        elif len(t) > 1:
            del t[i]
    return "".join(t)


def texts():
    r = random.Random(3)
    rows = []
    for i in range(160):
        n = r.choice(scan.NOTICES)
        middle = harmed(r, n.whole, r.randrange(n.edits + 3))
        rows.append((i, f"{'Word ' * r.randrange(4)}({middle.title()}); {harmed(r, r.choice(scan.NOTICES).whole, 1)}-tail"))
    more = ["MIT-License mit license, MIT licence", "exit license", "wit license", "GNU General Public License" * 2, "cc by cc by", "CC BY-NC-SA 4.0", "the the the gnu general public licence gnu genral public license", "mit", "lıcense mit lıcense"]
    return rows + [(1000 + i, t) for i, t in enumerate(more)] + messy_rows()


def test_as_by_all_spans(spark):
    rows = texts()
    got = {(r["doc_id"], r["labels"], r["n_words"]): r for r in scan.license_notices(documents(spark, rows)).collect()}
    assert collected(scan.license_notices(documents(spark, rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == ordered([(i, *plain_base(t)) for i, t in rows])
    for i, t in rows:
        w = words(t)
        if len(w) > 400:
            continue
        best = {n: d for n in scan.NOTICES if (d := fewest(w, n)) is not None}
        base = plain_base(t)
        labels = ",".join(sorted({n.label for n in best} | set(filter(None, base[4].split(",")))))
        r = got[i, labels, len(w)]
        assert r["score"] == (1.0 if base[1] else max((1 - d / len(n.whole) for n, d in best.items()), default=0.0))
        for s in r["spans"]:
            n = next(n for n in scan.NOTICES if n.whole == s["notice"] and n.label == s["label"])
            assert distance(n.whole, " ".join(w[s["first_word"] : s["end_word"]])) == s["edits"] <= n.edits
        assert {s["notice"]: 0 for s in r["spans"]}.keys() == {n.whole for n in best}


def test_a_piece_survives_any_permitted_edits():
    r = random.Random(4)
    for n in scan.NOTICES:
        assert "".join(p for p, _ in scan.pieces(n)) == (n.words if not n.name else f" {n.name} ")
        for _ in range(0 if n.name else 200):
            text = harmed(r, n.words, n.edits)
            assert any(p in text for p, _ in scan.pieces(n))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]], ids=["empty", "no text"])
def test_nothing_to_scan(spark, rows):
    assert collected(scan.license_notices(documents(spark, rows)), "doc_id", "n_words", "labels", "score") == [(i, 0, "", 0.0) for i, _ in rows]


def test_clean_texts_have_no_labels(spark):
    rows = [(i, t) for i, t in small_documents() if not re.search(r"licen[sc]e|reserved|creative|\bcc\b|public", t or "", re.I)]
    assert {r["labels"] for r in scan.license_notices(documents(spark, rows)).collect()} == {""}
