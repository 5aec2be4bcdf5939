"""Small tables with the traps that every operator must stand, and plain versions of what several tests need."""

import random
import re

import duckdb
import pyarrow as pa

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def small_documents(n=None):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SMALL}/documents.parquet') order by doc_id").fetchall()
    return rows[:n]


def messy_rows():
    """(doc_id, text): nulls, empty, white space only, one word, marks, copies, ties, repeated rows, a very long text."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "Ωmega", "日本語", "naïve,", "<b>", "100%", "a|b", " x", "end."]
    talk = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    a, b, c = talk(120), talk(60), talk(200)
    rows = [
        (1, a), (2, a), (2, a), (3, a.replace("w1", "w2", 1) + " tail"), (4, b + "\n" + c), (5, talk(30) + " " + b + "\n" + talk(40)),
        (6, None), (None, None), (7, ""), (8, " \t\n "), (9, "one"), (10, "one"), (11, "two words here now"), (12, "TWO words here now"),
        (None, a), (None, talk(90)), (13, "x " * 300), (14, "same line here\n" * 40), (15, c.upper()), (16, c + " " + c), (-3, b),
        (17, talk(20000)), (18, "abc" * 500), (19, "q" * 5000), (20, talk(10) + " \n \n " + talk(5) + "\n \n"), (21, "a\n \nb  c 　 d \x85 \x85e"), (22, talk(70)), (22, talk(70)),
    ]
    return rows


#: Names that operators use inside, as further columns of the input.
CLASHING = ("rid", "spans", "row", "name", "n", "c", "h", "p", "rate", "n_tokens", "held_out", "block", "length", "piece", "component_id", "kept", "_row", "path", "file", "host", "vote")


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    more = ("x",) * len(CLASHING)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *more) for i, t in rows], schema)


def stored(spark, tmp_path, rows, files=3):
    path = str(tmp_path / "documents.parquet")
    documents(spark, rows).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def collected(frame, *cols):
    """Rows as a sorted list of tuples; nulls sort first."""
    got = [tuple(r[c] for c in cols) for r in frame.select(*cols).collect()]
    return ordered(got)


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, x) for x in t))


def table(rows, names):
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
