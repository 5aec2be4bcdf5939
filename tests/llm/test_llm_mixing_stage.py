"""The pipeline's mixing stage: realised totals by domain, and toxic documents in corpora that hold few of them."""

import random

import pytest
from cases import documents

from matchgrain.llm import mixing

OWN = {"clean": "essay lemma proof", "low": "zxq qwv vkk", "toxic": "hate vile slur"}


def corpus(shares, n=1200):
    """Rows, labels of every third one and each row's domain; texts of one domain share three telling words."""
    r, rows, labels, domain = random.Random(3), [], [], {}
    for i in range(n):
        d = r.choices(list(shares), list(shares.values()))[0]
        ws = [f"w{r.randrange(300)}" for _ in range(40)] + OWN[d].split()
        r.shuffle(ws)
        rows.append((i, " ".join(ws)))
        domain[i] = d
        if i % 3 == 0:
            labels.append((i, int(d == "clean"), int(d == "toxic")))
    return rows, labels, domain


@pytest.mark.parametrize(
    "shares",
    [{"clean": 0.62, "low": 0.35, "toxic": 0.03}, {"clean": 0.95, "low": 0.04, "toxic": 0.01}, {"clean": 0.8, "low": 0.08, "toxic": 0.12}],
    ids=["much low", "little low, 1% toxic", "12% toxic"],
)
def test_realised_totals_and_few_toxic(spark, shares):
    rows, labels, domain = corpus(shares)
    docs = documents(spark, rows)
    kept = mixing.keep_mixed(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [r.doc_id for r in kept.collect()]
    tokens = {d: 43 * sum(domain[i] == d for i in got) for d in OWN}
    assert tokens["toxic"] == 0
    clean = 43 * sum(d == "clean" for d in domain.values())
    assert len({i for i in got if domain[i] == "clean"}) * 43 == clean and tokens["clean"] == pytest.approx(clean, rel=0.1)
    assert tokens["low"] / tokens["clean"] == pytest.approx(mixing.TARGETS["low"] / mixing.TARGETS["clean"], rel=0.2)
    assert sorted(got) == sorted(r.doc_id for r in mixing.keep_mixed(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
