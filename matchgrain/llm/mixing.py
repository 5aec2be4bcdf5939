"""Mixing documents to domain target weights by soft membership, with DataFrame functions only.

The labelled table defines the domains: ``toxic`` (toxic = 1), ``clean`` (quality = 1) and ``low`` (the rest). A presence
naive Bayes over the most telling words, present or absent, gives every document a posterior over the domains. Nonnegative document rates are
then fitted so that the expected token total of each domain meets its target: projected-gradient least squares, in the norm
in which the token masses of the documents that are still in (rate above 0) are white, so that few steps are needed; a step
that does not bring the totals nearer is halved. A step only depends on one number a domain, so a document's rate is
recomputed from the steps so far; nothing a document holds ever reaches the driver. What no rates can meet is reported:
``gap`` is the largest distance of a domain's total from its target, as a share of the target.

Defined results: a null or empty text has 0 tokens and the posterior of a text without telling words; labels without a document, null labels
and repeated labels (the worst counts) do no harm; without any labels every posterior is uniform; where labels tell no words
apart (or there are none) every rate is 1, the gap says how far off that is, and the pipeline's stage keeps every document;
every row of the documents gives one row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DOMAINS = ("clean", "low", "toxic")
#: Shares of the mix; the first domain keeps its mass, which fixes the scale of the others.
TARGETS: Mapping[str, float] = {"clean": 0.88, "low": 0.1, "toxic": 0.02}
#: Labelled rows that the classifier is fitted on (those of smallest hash), and words that it keeps.
LABELLED_ROWS = 20_000
FEATURES = 512
#: A word is telling if its likelihood ratio statistic reaches this (half of it, in nats). Large samples have enough words far
#: above; in small ones few words reach much more, and without some the posteriors span no mix that meets the targets.
LEAST_GAIN = 3.0
#: and if it is so many times as frequent in one domain as in another: hundreds of words that differ a little, which large
#: samples single out too, go together, and a sum over them would outvote what tells domains apart.
LEAST_RATIO = 8.0
#: What the absence of a telling word counts against its presence: words that a domain's texts share are absent together.
ABSENCE = 0.4
SMOOTHING = 0.5
#: Steps are taken until every total is within this share of its target. They end before where no rates meet the targets: no
#: part of a step brings the totals nearer, or ``STALLS`` steps on end close less than ``LEAST_CLOSED`` of the gap.
TOLERANCE = 1e-4
STEPS, HALVINGS = 100, 8
STALLS, LEAST_CLOSED = 2, 0.1
#: Share of the token mass added to the diagonal of the domains' Gram matrix: domains that the posteriors hardly tell apart
#: then move by small steps instead of being pulled apart by rounding errors.
RIDGE = 1e-6

_SPACE = r"[\x20\x09-\x0D]+"
#: White space, or the edge from a letter or digit to a mark. Neither begins with a letter or digit, which the first part
#: says of the commonest ones at once.
_WORD_EDGE = r"(?![a-z0-9])(?:[\s\p{Z}]+|(?<=[a-z0-9\p{L}\p{N}])(?=[^\s\p{Z}\p{L}\p{N}]))"
#: The telling words are looked up in this many buckets.
BUCKETS = 256


def features(text: Column) -> Column:
    """Lower-case words and runs of marks that follow them, with repeats."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD_EDGE)


def bucket(word: Column | str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def n_tokens(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), _SPACE)
    # Only the first and the last part can be empty.
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


#: Log odds of the domains for a text without telling words and, for each of these, its bucket and what its presence adds.
Model = tuple[list[float], list[tuple[str, int, list[float]]]]


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED_ROWS, most_words: int = FEATURES) -> Model:
    """The classifier. Reads the documents of at most ``most_rows`` labels."""
    label = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        .select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1).alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    # The sample is bounded, so it may be broadcast.
    known = docs.select("doc_id", "text").join(F.broadcast(label), "doc_id").select("domain", F.array_distinct(features(F.col("text"))).alias("words"))
    of = [F.count_if(F.col("domain") == k) for k in range(len(DOMAINS))]
    total = [int(x or 0) for x in known.agg(*[c.alias(f"n{k}") for k, c in enumerate(of)]).first()]
    n = sum(total)
    if n == 0:
        return [-log(len(DOMAINS))] * len(DOMAINS), []
    # explode_outer: for explode, the optimiser would filter by the size of ``words`` before the join, over all documents.
    found = known.select("domain", F.explode_outer("words").alias("word")).where("word <> ''").groupBy("word").agg(*[c.alias(f"n{k}") for k, c in enumerate(of)])
    df = sum((F.col(f"n{k}") for k in range(len(DOMAINS))), F.lit(0))
    gain = sum((F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * F.log(F.col(f"n{k}") * n / (df * total[k]))).otherwise(0.0) for k in range(len(DOMAINS)) if total[k]), F.lit(0.0))
    share = [(F.col(f"n{k}") + SMOOTHING * df / n) / (total[k] + SMOOTHING) for k in range(len(DOMAINS)) if total[k]]
    strong = F.greatest(*share, F.lit(0.0)) >= LEAST_RATIO * F.least(*share, F.lit(1.0))
    telling = found.withColumn("gain", gain).withColumn("bucket", bucket("word")).where((F.col("gain") >= LEAST_GAIN) & strong).orderBy(F.desc("gain"), "word").limit(most_words).collect()
    none = [log((t + 1) / (n + len(DOMAINS))) for t in total]
    odds = []
    for row in telling:
        seen = [row[f"n{k}"] for k in range(len(DOMAINS))]
        base = sum(seen) / n
        share = [(s + SMOOTHING * base) / (t + SMOOTHING) for s, t in zip(seen, total, strict=True)]
        none = [a + ABSENCE * log(1 - p) for a, p in zip(none, share, strict=True)]
        odds.append((row["word"], row["bucket"], [log(p) - ABSENCE * log(1 - p) for p in share]))
    return none, odds


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``p``, the posterior over the domains."""
    prior, odds = model
    k = range(len(DOMAINS))
    scored = docs.withColumn("n_tokens", n_tokens(F.col("text")))
    if odds:
        entry = "array<struct<w:string,o:array<double>>>"
        listed: list[list[Column]] = [[] for _ in range(BUCKETS)]
        for word, at, by in odds:
            listed[at].append(F.struct(F.lit(word).alias("w"), F.array(*map(F.lit, by)).alias("o")))
        buckets = F.array(*[F.array(*entries).cast(entry) for entries in listed])
        here = F.array_intersect(features(F.col("text")), F.array(*[F.lit(w) for w, _, _ in odds]))
        hits = F.transform(F.col("_here"), lambda w: F.filter(F.element_at(buckets, bucket(w) + 1), lambda e: e.w == w)[0].o)
        scored = scored.withColumn("_here", here).withColumn("_hits", hits)
        score = F.aggregate("_hits", F.array(*map(F.lit, prior)), lambda acc, o: F.array(*[acc[i] + o[i] for i in k]))
    else:
        score = F.array(*map(F.lit, prior))
    scored = scored.withColumn("_score", score)
    shifted = F.transform("_score", lambda x: F.exp(x - F.array_max("_score")))
    out = scored.withColumn("_e", shifted).withColumn("p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    return out.drop("_here", "_hits", "_score", "_e")


def dot(p: Column, by: Sequence[float]) -> Column:
    return sum((p[k] * F.lit(float(x)) for k, x in enumerate(by)), F.lit(0.0))


def rate_after(steps: Sequence[Sequence[float]]) -> Column:
    """A document's rate after the projected steps so far, from its posterior ``p``."""
    if not steps:
        return F.lit(1.0)
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(listed, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((F.col("p")[k] * s[k] for k in range(len(DOMAINS))), F.lit(0.0))))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small linear system, one equation a domain."""
    rows = [list(map(float, m)) + [float(b)] for m, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        j = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[j] = rows[j], rows[i]
        for r in range(n):
            if r != i:
                f = rows[r][i] / rows[i][i]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def distance(mass: Sequence[float], wanted: Sequence[float]) -> float:
    """The largest distance of a total from its target, as a share of the target (of a millionth of all, if that is more)."""
    least = 1e-6 * sum(wanted)
    return max(abs(m - w) / max(w, least) for m, w in zip(mass, wanted, strict=True))


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, most: int = STEPS) -> tuple[list[list[float]], float]:
    """The projected steps that bring the domains' expected token totals to their targets, and the gap that is left.

    Documents start at rate 1. Each step is one aggregation over ``members`` (``n_tokens``, ``p``) to a few numbers: the
    totals, and the Gram matrix of the documents that are still in.
    """
    k = range(len(DOMAINS))
    t = F.col("n_tokens").cast("double")

    def totals(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        r = members.withColumn("r", rate_after(steps))
        still = F.when(F.col("r") > 0, t).otherwise(0.0)
        now = r.agg(*[F.sum(still * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}{j}") for i in k for j in k if j <= i], *[F.sum(F.col("r") * t * F.col("p")[i]).alias(f"m{i}") for i in k]).first()
        return [now[f"m{i}"] or 0.0 for i in k], [[now[f"g{max(i, j)}{min(i, j)}"] or 0.0 for j in k] for i in k]

    mass, gram = totals([])
    total = sum(mass)
    if total == 0:
        return [], 0.0
    scale = mass[0] / targets[DOMAINS[0]] if targets[DOMAINS[0]] else total
    wanted = [targets[d] * scale for d in DOMAINS]
    steps: list[list[float]] = []
    gap, stalled = distance(mass, wanted), 0
    for _ in range(most):
        if gap <= TOLERANCE or stalled == STALLS:
            break
        whole = solve([[gram[i][j] + (RIDGE * total if i == j else 0.0) for j in k] for i in k], [m - w for m, w in zip(mass, wanted, strict=True)])
        for half in range(HALVINGS):
            step = [x / (1 << half) for x in whole]
            mass_then, gram_then = totals([*steps, step])
            if distance(mass_then, wanted) < gap:
                break
        else:  # nothing brings the totals nearer
            break
        steps.append(step)
        mass, gram, before, gap = mass_then, gram_then, gap, distance(mass_then, wanted)
        stalled = stalled + 1 if before - gap < LEAST_CLOSED * before else 0
    return steps, gap


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its own columns, or those in ``keep``, but for those named like a result) with ``n_tokens``, ``p_<domain>``, ``rate`` and ``gap``.

    Texts are read once for the posteriors, which are written with the row; rates are worked out on what is written.
    """
    made = {"n_tokens", "rate", "gap", "p", "_here", "_hits", "_score", "_e", *(f"p_{d}" for d in DOMAINS)}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in made])
    kept = docs.columns if keep is None else [c for c in keep if c in docs.columns]
    model = fit(docs, labels)
    members, _ = stored(posteriors(docs, model).select(*kept, "n_tokens", "p"))
    # Without telling words all posteriors are alike, and there is nothing to choose between.
    steps, gap = fit_rates(members.select("n_tokens", "p"), targets, STEPS if model[1] else 0)
    return members.select(*kept, "n_tokens", *[F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.round(rate_after(steps), 9).alias("rate"), F.lit(round(gap, 9)).alias("gap"))


def op6_mixing_rates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mixing_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])


def keep_mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` in the numbers that their fitted rates ask for (pipeline stage).

    A document comes ``rate`` times: the whole part as copies, the rest by the hash of the row, so a rerun draws the same
    rows. Two rules stand above the draw: what is more likely toxic than anything else goes, so the toxic target is a ceiling,
    and what is as likely clean as anything else stays, at least once.
    """
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    slim = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), chance.alias("_chance"))
    drawn = F.floor(F.col("rate") + F.col("_chance"))
    copies = F.when(F.col("p_toxic") > F.greatest("p_clean", "p_low"), 0).when(F.col("p_clean") >= F.greatest("p_low", "p_toxic"), F.greatest(F.lit(1), drawn)).otherwise(drawn).cast("int")
    kept = mixing_rates(slim, labels, keep=["_row", "_chance"]).select("_row", copies.alias("copies")).where("copies > 0")
    return kept.select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row")).select("_row.*")
