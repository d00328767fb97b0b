"""Personal data by weak supervision, as column expressions and aggregates only.

Candidate spans come from the base patterns and from looser ones. Labelers vote
on each: the strict pattern, a gazetteer, words of context before it, and its
shape; a labeler may abstain. How reliable a labeler is follows from how the
votes agree, by expectation-maximisation over the counts of vote patterns. The
posteriors then train a logistic span classifier, which adds spans to the base
ones. Base spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.llm.common import documents, numbered, stored

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. Possessive forms match what the plain ones do and
# never step back; an e-mail starts where a run of its characters does, or where the
# match before it ended; shorter digit runs, which no card rule takes, are passed over.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: looser forms: an address with "at" and "dot" spelled out, a number in groups without its country
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,10}",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: a text without these cannot hold a match; most texts stop here
NEEDED = {
    ("email", True): "@",
    ("ip", True): r"[0-9]\.[0-9]",
    ("card", True): r"[0-9](?:[\x20-]?[0-9]){12}",
    ("phone", True): r"\+[0-9]",
    ("email", False): r"[(\[]at[)\]]",
    ("phone", False): r"[0-9]{3}[ .-][0-9]{4}",
}
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10|127|172|192|[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-1][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|7|33|34|44|49)(?![0-9]{14})|\(?[2-9][0-9]{2}\)?[ .-])",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|payment|credit|debit|account)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|dial)\W*(?:\w+\W+){0,2}$",
}
SHAPE = {
    "email": r"^[A-Za-z0-9][^@\[(]{0,63}(?:@|\s?[\[(])",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}(?:\1[0-9]{1,3})?)$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,5}){1,4}$",
}
VOTES = ["strict", "gazetteer", "context", "shape"]
CONTEXT_CHARS = 40
MATCHES = "array<struct<kind:int,strictly:boolean,gap:int,value:string,before:string>>"
ROUNDS = 40


def matches(text: Column, kind: str, base: bool) -> Column:
    """(gap, value, before) of a pattern's leftmost matches without overlap: the code points between the last one and this.

    What lies between the matches is had by splitting at them. Both lists are
    walked once, side by side.
    """
    pattern = (BASE if base else LOOSE)[kind]
    held = F.when(text.rlike(NEEDED[kind, base]), text)
    gaps = F.transform(
        F.split(held, pattern, -1),
        lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before")),
    )
    found = F.zip_with(
        gaps,
        F.regexp_extract_all(held, F.lit(pattern), F.lit(0)),
        lambda g, value: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("strictly"), g["gap"].alias("gap"),
            value.alias("value"), g["before"].alias("before"),
        ),
    )
    # after the last match there is one more gap
    return F.coalesce(F.filter(found, lambda m: m["value"].isNotNull()), F.array().cast(MATCHES))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right every second digit counts double, its digits added."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (F.length(number) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def passes(value: Column, kind: str) -> Column:
    """The base rule's test of a match."""
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def by_kind(choose: Callable[[str], Column]) -> Column:
    """One column per kind, the row's own."""
    out = choose(KINDS[-1])
    for i, kind in enumerate(KINDS[:-1]):
        out = F.when(F.col("kind") == i, choose(kind)).otherwise(out)
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """(row_id, kind, start, end, base, votes, digits) of all candidates in rows (row_id, found).

    Starts are running sums of gaps and matches, so a text takes time in
    proportion to its matches. Votes are 1 for, -1 against, 0 abstains; a loose
    match has no check to pass. Digit runs too short or long for a card are left out.
    """
    each = rows.select("row_id", F.posexplode("found").alias("at", "m")).select("row_id", "at", "m.*")
    ordered = W.partitionBy("row_id", "kind", "strictly").orderBy("at")
    n = F.length("value")
    end = F.sum(F.col("gap") + n).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    value, before, count = F.col("value"), F.col("before"), F.length(digits(F.col("value")))
    ok = F.col("strictly") & by_kind(lambda k: passes(value, k))

    def vote(yes: Column, no: int) -> Column:
        return F.when(yes, 1).otherwise(no)

    return (
        each.withColumn("end", end)
        .where((F.col("kind") != KINDS.index("card")) | count.between(13, 19))
        .select(
            "row_id",
            "kind",
            (F.col("end") - n).alias("start"),
            "end",
            ok.alias("base"),
            F.when(F.col("strictly"), vote(ok, -1)).otherwise(0).alias("strict"),
            vote(by_kind(lambda k: value.rlike(GAZETTEER[k])), -1).alias("gazetteer"),
            vote(by_kind(lambda k: before.rlike(CONTEXT[k])), 0).alias("context"),
            vote(by_kind(lambda k: value.rlike(SHAPE[k])), -1).alias("shape"),
            F.least(count, F.lit(24)).alias("digits"),
        )
    )


def fit_reliabilities(patterns: list[Row]) -> dict[int, tuple[float, dict[str, list[list[float]]]]]:
    """By kind: log prior odds, and per labeler the chances of each vote given that a span is not, or is, personal data.

    ``patterns`` are counted vote patterns, a few hundred at most however many
    spans there are. Votes -1, 0, 1 are independent given the truth; counts are
    smoothed, so a labeler that never speaks stays neutral.
    """
    out = {}
    for kind in range(len(KINDS)):
        rows = [r for r in patterns if r["kind"] == kind]
        belief = [1 / (1 + math.exp(-sum(r[v] for v in VOTES))) for r in rows]
        prior, chances = 0.0, {v: [[1 / 3] * 3, [1 / 3] * 3] for v in VOTES}
        for _ in range(ROUNDS):
            yes = sum(b * r["n"] for b, r in zip(belief, rows))
            no = sum((1 - b) * r["n"] for b, r in zip(belief, rows))
            prior = math.log((yes + 1) / (no + 1))
            for v in VOTES:
                # a labeler is taken to be right more often than wrong before it is heard
                tally = [[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]]
                for b, r in zip(belief, rows):
                    tally[0][r[v] + 1] += (1 - b) * r["n"]
                    tally[1][r[v] + 1] += b * r["n"]
                if v == "strict":  # a failed check is near proof, whatever the other votes agree on
                    tally[1][0] = 0.01 * (tally[1][1] + tally[1][2])
                chances[v] = [[t / sum(side) for t in side] for side in tally]
            logits = [prior + sum(math.log(chances[v][1][r[v] + 1] / chances[v][0][r[v] + 1]) for v in VOTES) for r in rows]
            belief = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in logits]
        out[kind] = (prior, chances)
    return out


def posterior(kind: Column, votes: dict[str, Column], model: dict) -> Column:
    """The chance that a span is personal data, from its votes."""
    logit = F.lit(0.0)
    for k, (prior, chances) in model.items():
        own = F.lit(prior)
        for v, vote in votes.items():
            ratio = [math.log(chances[v][1][i] / chances[v][0][i]) for i in range(3)]
            own = own + F.when(vote == -1, ratio[0]).when(vote == 0, ratio[1]).otherwise(ratio[2])
        logit = F.when(kind == k, own).otherwise(logit)
    return 1 / (1 + F.exp(-logit))


def features(of: Column) -> dict[str, Column]:
    """The classifier's inputs: each vote within its kind, and how far the digits are from the kind's usual number."""
    usual = {"email": 0, "ip": 9, "card": 16, "phone": 11}
    out = {}
    for k, name in enumerate(KINDS):
        here = (of["kind"] == k).cast("double")
        out[f"{name}_is"] = here
        for v in VOTES:
            out[f"{name}_{v}"] = here * of[v]
        if usual[name]:
            out[f"{name}_digits"] = here * F.abs(of["digits"] - usual[name])
    return out


def train(spans: DataFrame) -> tuple[float, dict[str, float]]:
    """Intercept and weights of the span classifier from all candidates.

    Every candidate counts. Without candidates all weights are 0 and the
    intercept is negative, so nothing would be added.
    """
    keys = ["kind", *VOTES, "digits"]
    counted = stored(
        spans.groupBy(*keys).agg(F.count("*").alias("n")), "votes"
    )
    model = fit_reliabilities(counted.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect())
    chance = posterior(F.col("kind"), {v: F.col(v) for v in VOTES}, model)
    rows = counted.select("*", chance.alias("chance"), F.struct(*keys).alias("s"))
    inputs = features(F.col("s"))
    both = rows.select(
        *[c.alias(name) for name, c in inputs.items()],
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), (F.col("chance") * F.col("n")).alias("weight")),
                F.struct(F.lit(0.0).alias("label"), ((1 - F.col("chance")) * F.col("n")).alias("weight")),
            )
        ).alias("goal"),
    ).select(*inputs, "goal.label", "goal.weight")
    if counted.isEmpty():
        return -10.0, dict.fromkeys(inputs, 0.0)
    data = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(both.where("weight > 0"))
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(data)
    return float(fitted.intercept), dict(zip(inputs, map(float, fitted.coefficients.toArray())))


def classify(span: Column, weights: tuple[float, dict[str, float]]) -> Column:
    """Whether the classifier takes a candidate."""
    inputs = features(span)
    return reduce(lambda total, name: total + inputs[name] * weights[1][name], inputs, F.lit(weights[0])) >= 0


def clear_of(spans: DataFrame, others: Column, own: Column) -> DataFrame:
    """``spans`` without those marked ``own`` that overlap, in their row, a span marked ``others``.

    In order of start, what reaches farthest of the earlier ones and begins first
    of the later ones tells, so each row is read once forward and once backward.
    """
    ordered = W.partitionBy("row_id").orderBy("start", "end", "kind")
    reach = F.max(F.when(others, F.col("end"))).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    near = F.min(F.when(others, F.col("start"))).over(ordered.rowsBetween(1, W.unboundedFollowing))
    hit = (reach > F.col("start")) | (near < F.col("end"))
    return spans.withColumn("hit", F.coalesce(hit, F.lit(False))).where(~(own & F.col("hit"))).drop("hit")


def clear_of_earlier(spans: DataFrame) -> DataFrame:
    """Base spans, and of the rest those that overlap no earlier one of the rest."""
    ordered = W.partitionBy("row_id").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(~F.col("base"), F.col("end"))).over(ordered)
    return spans.withColumn("reach", F.coalesce(reach, F.lit(0))).where(F.col("base") | (F.col("reach") <= F.col("start"))).drop("reach")


def find_pii(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc, base, added): spans of each text as arrays of (kind, start, end), in that order.

    ``base`` are the matches of the base rules. ``added`` are other candidates
    that the classifier takes and that overlap neither a base span nor another
    one that starts before them. ``doc`` is a struct of the columns ``keep``.
    Null and empty texts have no spans; repeated rows are read one by one and all
    count in training. An empty table gives no rows.

    Texts are read once; what matched is stored and worked on as rows, so a text
    with very many matches costs in proportion to them.
    """
    text = F.coalesce("text", F.lit(""))
    patterns = [(kind, base) for base, kinds in ((True, BASE), (False, LOOSE)) for kind in kinds]
    table = numbered(docs, keep, found=F.concat(*[matches(text, kind, base) for kind, base in patterns]))
    spans = stored(candidates(table.select("row_id", "found")), "candidates")
    weights = train(spans)
    base = F.col("base")
    taken = spans.where(base | classify(F.struct(*[F.col(c) for c in spans.columns]), weights))
    taken = clear_of_earlier(clear_of(taken, base, ~base))
    place = F.struct("kind", "start", "end")
    lists = taken.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.when(base, place))).alias("base"),
        F.array_sort(F.collect_list(F.when(~base, place))).alias("added"),
    )
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return (
        table.select("row_id", "doc")
        .join(lists, "row_id", "left")
        .select("doc", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(i: int) -> Callable[[Column], Column]:
    return lambda kind: kind == i


def op9_pii(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc.doc_id",
        *counts,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
