"""Ranked lexical search in whole numbers: postings dealt by term, joined with the items' terms, summed by item and document.

The postings table has one row for each term and document, dealt to partitions by the term's bucket and a salt (a frequent
term fills many partitions) and sorted by term, so that a scan for some terms skips the rest. A frequent term's
postings can change a ranking only if a document is near the top without them, so an item's terms are split exactly:

1. the item's rarest terms name some documents, whose full k-th best score is a floor that the answer's k-th cannot go below;
2. terms whose largest possible scores together stay below the floor cannot lift a document to it by themselves; postings of
   the other terms are joined and summed by item and document;
3. sums that reach the floor with all that is missing are completed from the postings left out, and ranked.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.

Defined results: a null or empty text has no terms and is in no count; every row of the documents is a document of its own,
repeated ids included; equal scores go by ascending id, a null id last; of rows that repeat an item's id the one with the
smallest text asks, and a null id is an id like any other; an item without terms, or whose terms no document holds, gives no
rows; further columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, remove, short, stored, text_slices

#: Bytes of terms stay (A-Z as a-z), all others part them.
_TERMS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Items' distinct terms that the tokeniser gets to know, so that it leaves out others; beyond that a join leaves them out.
KNOWN_TERMS = 200_000
#: An item's rarest terms with up to so many postings, and one more, name the documents that give the floor.
SEED_POSTINGS = 1_000
#: Documents, times k, of an item that are scored in full for the floor.
SEEDS = 3
#: The term, which no text has, of one row for each document with terms; its count is the document's number of terms.
EVERY = ""

POSTINGS = "term string, rid long, doc_id long, tf long, n long"


def postings(docs: DataFrame, known: set[bytes] | None = None) -> DataFrame:
    """A row for each document and term (of ``known``, if given), and one with the term ``EVERY``; ``n``: the document's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, ids, texts in text_slices(short(batches), ["rid", "doc_id", "text"]):
            term: list[bytes] = []
            tf: list[int] = []
            n, rows = [], []
            for t in texts:
                found = t.translate(_TERMS).split()
                count = Counter(found)
                if known is not None:
                    count = {k: count[k] for k in count.keys() & known}
                size = len(term)
                if found:
                    term.append(EVERY.encode())
                    tf.append(len(found))
                term += count.keys()
                tf += count.values()
                n.append(len(found))
                rows.append(len(term) - size)
            at = pa.array([i for i, r in enumerate(rows) for _ in range(r)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(term, pa.binary()).cast(pa.string()), rids.take(at), ids.cast(pa.int64()).take(at), pa.array(tf, pa.int64()), pa.array(n, pa.int64()).take(at)], names=["term", "rid", "doc_id", "tf", "n"]
            )

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, POSTINGS)


def asked_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, repeats``; ``item`` numbers the items."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    one = durable(items.groupBy("item_id").agg(F.min("text").alias("text")).select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    return one.select("item", "item_id", F.explode(terms).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("repeats"))


def bucketed(rows: DataFrame) -> tuple[DataFrame, str]:
    """The postings written by term and salt, each file sorted by term."""
    n = partitions(rows.sparkSession)
    salt = F.pmod(F.xxhash64("rid"), F.lit(4 * n))
    return stored(rows.repartition(n, F.col("term"), salt).sortWithinPartitions("term", "rid"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, known_terms: int = KNOWN_TERMS, seed_postings: int = SEED_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents among all of ``docs``."""
    spark = docs.sparkSession
    terms = durable(asked_terms(items))
    wanted = terms.select("term").distinct()
    some = wanted.limit(known_terms + 1).collect()
    few = len(some) <= known_terms
    rows = postings(docs, {r["term"].encode() for r in some} if few else None)
    if not few:
        rows = rows.join(wanted.unionByName(spark.createDataFrame([(EVERY,)], "term string")), "term", "left_semi")
    table, path = bucketed(rows)
    total = table.where(F.col("term") == EVERY).agg(F.count("*").alias("docs"), F.sum("tf").alias("terms")).first()
    if not total["docs"]:
        remove(spark, path)
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_docs, n_terms = total["docs"], total["terms"]
    length = F.expr(f"100L - 75L + (75L * n * {n_docs}L) div {n_terms}L")
    table = table.where(F.col("term") != EVERY).withColumn("m", length).withColumn("part", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).drop("m", "n", "tf")

    held = table.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = terms.join(held, "term").withColumn("w", weight * F.col("repeats"))
    weighed = durable(weighed.select("item", "term", "df", "w", (F.col("w") * F.col("most")).alias("bound")))

    # 1. A floor for each item: the k-th best full score among the documents that its rarest terms name.
    rare = Window.partitionBy("item").orderBy("df", "term")
    first = weighed.withColumn("before", F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < seed_postings)
    named = table.join(first.select("item", "term", "w"), "term").groupBy("item", "rid").agg(F.sum(F.col("w") * F.col("part")).alias("part_score"))
    seeds = named.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part_score"), "rid"))).where(F.col("at") <= SEEDS * k)
    seeds = durable(seeds.select("item", "rid"))
    full = table.join(seeds, "rid").join(weighed.select("item", "term", "w"), ["item", "term"]).groupBy("item", "rid").agg(F.sum(F.col("w") * F.col("part")).alias("score"))
    kth = full.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("at") == k).select("item", F.col("score").alias("floor"))

    # 2. Terms that together cannot reach the floor are left out at first.
    least = Window.partitionBy("item").orderBy("bound", "term")
    split = weighed.join(kth, "item", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(0)), F.lit(1)))
    split = split.withColumn("late", F.sum("bound").over(least.rowsBetween(Window.unboundedPreceding, 0)) < F.col("floor"))
    missing = F.sum(F.when(F.col("late"), F.col("bound")).otherwise(0)).over(Window.partitionBy("item"))
    split = durable(split.withColumn("need", F.col("floor") - missing).select("item", "term", "w", "late", "need"))
    sums = table.join(split.where(~F.col("late")), "term").groupBy("item", "rid")
    sums = sums.agg(F.sum(F.col("w") * F.col("part")).alias("early"), F.first("doc_id").alias("doc_id"), F.first("need").alias("need"))
    near, near_path = stored(sums.where(F.col("early") >= F.col("need")).drop("need"))

    # 3. What was left out, for the documents that can still reach the floor.
    rest = table.select("rid", "term", "part").join(near.select("item", "rid"), "rid").join(split.where("late").select("item", "term", "w"), ["item", "term"])
    late = rest.groupBy("item", "rid").agg(F.sum(F.col("w") * F.col("part")).alias("later"))
    scored = near.join(late, ["item", "rid"], "left").withColumn("score", F.col("early") + F.coalesce("later", F.lit(0))).where(F.col("score") > 0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")
    top = scored.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    out = durable(top.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score"))
    remove(spark, path)
    remove(spark, near_path)
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents
), d AS (SELECT rid, doc_id, len(t) AS n, t FROM w WHERE len(t) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
held AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, docs),
i AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark GROUP BY item_id
  ) GROUP BY item_id, term
), s AS (
  SELECT item_id, p.rid, any_value(doc_id) AS doc_id,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN held USING (term) JOIN p USING (term) JOIN d ON d.rid = p.rid, total GROUP BY item_id, p.rid
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
