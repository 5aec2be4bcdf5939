import numpy as np
import pytest
from cases import collected, messy_rows, ordered, small_documents, stored, words

from matchgrain.llm import jaccard_join as j
from matchgrain.llm.components import components


def plain(rows, threshold=75):
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, len(s), smallest.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def chains():
    """Copies with one word more changed each time, so that links go on from one to the next, and many short lists."""
    r = np.random.default_rng(3)
    rows, n = [], 100
    for g in range(6):
        text = [f"t{x}" for x in r.integers(0, 3000, 160)]
        for _ in range(25):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            text[int(r.integers(0, 160))] = f"new{n}"
    return rows


@pytest.mark.parametrize("near", [j.NEAR, 1])
@pytest.mark.parametrize("rows", [messy_rows(), small_documents() + chains(), []], ids=["messy", "small", "empty"])
def test_components_as_by_all_pairs(spark, tmp_path, monkeypatch, rows, near):
    monkeypatch.setattr(j, "NEAR", near)
    docs = stored(spark, tmp_path, rows)
    want = plain(rows)
    assert collected(j.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == ordered(want)


def test_one_of_each(spark, tmp_path):
    rows = messy_rows()
    docs = stored(spark, tmp_path, rows)
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    found = j.jaccard_components(docs).collect()
    smallest = {}
    for r in found:
        smallest.setdefault(r.c, []).append(r.doc_id)
    want = [min((i for i in ids if i is not None), default=None) for ids in smallest.values()]
    assert ordered([(r.doc_id,) for r in kept.collect()]) == ordered([(i,) for i in want])


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.v: r.c for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
