"""Quality by weak supervision: rules vote or abstain, and a latent class model weighs the votes.

Every rule looks at counts of one text and votes 1 (good), -1 (bad) or 0 (abstains). The rows are
grouped by their pattern of votes; there are at most 3 ** len(RULES) patterns, whatever the number
of rows, and expectation-maximisation over these counts gives, for each rule, how often it votes
what on good and on bad texts, and the share of good texts. The posterior probability of "good" is
then a sum of literals, one for each vote.

All work on texts is done with built-in functions, within the row: no shuffle but that of the
pattern counts.

Defined results: a null or empty text has no words, fails the base rules and is not kept; null ids
and repeated rows get a verdict each; an empty table gives an empty table; the verdict goes by row,
so other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE
from plumbline.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ITERATIONS, PRIOR_GOOD, PRIOR_WEIGHT = 30, 0.85, 50.0
#: Before any data, shares of votes as {vote: (on good texts, on bad texts)}: of a rule that knows
#: both sides, and of one that only finds a kind of bad text and abstains otherwise.
BOTH = {"+": (0.6, 0.1), "0": (0.3, 0.3), "-": (0.1, 0.6)}
ONE_SIDED = {"+": (0.001, 0.001), "0": (0.994, 0.699), "-": (0.005, 0.3)}

#: (name, condition for -1, condition for 1 or None) on the counts below; integers only, so that
#: every engine decides alike. The first condition that holds counts.
RULES = (
    ("symbols", "10 * n_symbols > n_words", None),
    ("symbol_share", "50 * n_symbols > word_chars", None),
    ("repeats", "100 * n_repeat_words > 30 * n_words", None),
    ("dup_lines", "2 * n_dup_lines > n_lines", None),
    ("capitals", "10 * n_capitals > 3 * word_chars", None),
    ("marks", "5 * n_marks > n_words", None),
    ("distinct_words", "10 * n_distinct_words < n_words", None),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars > 3 * n_words and word_chars < 9 * n_words"),
    ("stops", "n_stops = 0", None),
)
#: The counts that rules may use.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct_words", "n_stops",
)


def _covered(words: Column, ordered: Column) -> Column:
    """Words inside windows that are found twice or more, from (hash, position) pairs in order."""
    again = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def with_counts(docs: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Adds the COUNTS of a text under names that start with the prefix."""
    t, w, o, lines = (prefix + x for x in ("text", "words", "windows", "lines"))
    spaces = f"[{SPACE}]+"
    out = docs.withColumn(t, F.coalesce(text, F.lit("")))
    out = out.withColumns(
        {
            w: F.filter(F.split(F.col(t), spaces), lambda x: x != ""),
            lines: F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        }
    )
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn(o, F.sort_array(F.when(n >= 3, windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))))
    long = lambda c: c.cast("long")
    without = lambda chars: F.length(t) - F.length(F.translate(F.col(t), chars, ""))
    made = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(F.col(t), spaces, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(F.col(w), F.col(o)),
        "n_lines": F.size(lines),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": without("!?"),
        "n_distinct_words": F.size(F.array_distinct(w)),
        "n_stops": without(".,;:"),
    }
    return out.withColumns({prefix + k: long(v) for k, v in made.items()}).drop(t, w, o, lines)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > 50 * n)


def _votes(prefix: str) -> Column:
    """All votes as one string, a character for each rule: '-', '0' or '+'."""
    import re

    full = lambda c: F.expr(re.sub(r"\b(" + "|".join(COUNTS) + r")\b", rf"`{prefix}\1`", c))
    vote = lambda bad, good: F.when(full(bad), "-").when(full(good) if good else F.lit(False), "+").otherwise("0")
    return F.concat(*(vote(bad, good) for _, bad, good in RULES))


@dataclass(frozen=True)
class VoteModel:
    """Shares of votes, for each rule {vote: (on good texts, on bad texts)}, and the share of good texts."""

    good: float
    shares: tuple[dict[str, tuple[float, float]], ...]

    def log_odds(self, pattern: str) -> float:
        out = math.log(self.good) - math.log(1 - self.good)
        for v, table in zip(pattern, self.shares):
            out += math.log(table[v][0]) - math.log(table[v][1])
        return out

    def posterior(self, pattern: str) -> float:
        z = max(-500.0, min(500.0, self.log_odds(pattern)))
        return 1 / (1 + math.exp(-z))

    def accuracies(self) -> dict[str, float]:
        """Of the votes that a rule gives, the share that is right."""
        out = {}
        for (name, _, _), t in zip(RULES, self.shares):
            right = self.good * t["+"][0] + (1 - self.good) * t["-"][1]
            wrong = self.good * t["-"][0] + (1 - self.good) * t["+"][1]
            out[name] = right / (right + wrong)
        return out

    def column(self, votes: Column) -> Column:
        """The posterior as an expression over the vote string."""
        z = F.lit(math.log(self.good) - math.log(1 - self.good))
        for k, table in enumerate(self.shares):
            v = F.substring(votes, k + 1, 1)
            score = {x: math.log(a) - math.log(b) for x, (a, b) in table.items()}
            z = z + F.when(v == "+", score["+"]).when(v == "-", score["-"]).otherwise(score["0"])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def prior_model() -> VoteModel:
    return VoteModel(PRIOR_GOOD, tuple(BOTH if good else ONE_SIDED for _, _, good in RULES))


def fit(pattern_counts: dict[str, int], iterations: int = ITERATIONS) -> VoteModel:
    """Expectation-maximisation over pattern counts, with PRIOR_WEIGHT rows of belief for each class.

    The belief keeps "good" from changing places with "bad" and every share above zero.
    """
    model, rows = prior_model(), sorted(pattern_counts.items())
    belief = prior_model()
    for _ in range(iterations):
        mass = [(p, n * q, n * (1 - q)) for p, n in rows for q in (model.posterior(p),)]
        good, bad = sum(g for _, g, _ in mass), sum(b for _, _, b in mass)
        shares = []
        for k in range(len(RULES)):
            table = {}
            for v in "+0-":
                g = sum(x for p, x, _ in mass if p[k] == v) + PRIOR_WEIGHT * belief.shares[k][v][0]
                b = sum(y for p, _, y in mass if p[k] == v) + PRIOR_WEIGHT * belief.shares[k][v][1]
                table[v] = (g / (good + PRIOR_WEIGHT), b / (bad + PRIOR_WEIGHT))
            shares.append(table)
        share = (good + PRIOR_WEIGHT * PRIOR_GOOD) / (good + bad + PRIOR_WEIGHT)
        model = VoteModel(share, tuple(shares))
    return model


def judge(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, VoteModel]:
    """(row: the whole input row, COUNTS, votes, base_failed, posterior, kept), and the model.

    The counts are written once, to the shared folder: the fit reads the votes alone from there.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    counted = with_counts(rows, F.col(f"row.`{text_col}`"), "")
    counted = cut_lineage(counted.withColumn("votes", _votes("")))
    patterns = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit(patterns)
    out = counted.withColumn("base_failed", base_failed()).withColumn("posterior", model.column(F.col("votes")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)), model


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns."""
    return judge(docs, text_col)[0].filter("kept").select("row.*")


def vote_sql() -> str:
    return " || ".join(f"case when {bad} then '-' when {good or 'false'} then '+' else '0' end" for _, bad, good in RULES)


def fit_sql(patterns: str, iterations: int = ITERATIONS) -> str:
    """The same fit as chained SQL tables over `patterns` (votes, n): the last is `posteriors` (votes, p)."""
    belief = ", ".join(f"({k + 1}, '{v}', {a}, {b})" for k, table in enumerate(prior_model().shares) for v, (a, b) in table.items())
    parts = [
        f"belief(k, v, g, b) as (select * from (values {belief}))",
        f"each_vote as materialized (select votes, n, k, substr(votes, k, 1) as v from {patterns}, (select distinct k from belief))",
        f"share0 as (select {PRIOR_GOOD}::double as s)",
        "model0 as (select k, v, g::double as g, b::double as b from belief)",
    ]
    for i in range(iterations + 1):
        parts.append(
            f"""post{i} as materialized (select votes, n, 1 / (1 + exp(-(ln(any_value(s)) - ln(1 - any_value(s)) + sum(ln(g) - ln(b))))) as p
            from each_vote join model{i} using (k, v), share{i} group by votes, n)"""
        )
        if i == iterations:
            break
        parts.append(f"total{i} as materialized (select sum(n * p) as g, sum(n * (1 - p)) as b from post{i})")
        parts.append(f"share{i + 1} as materialized (select (g + {PRIOR_WEIGHT * PRIOR_GOOD}) / (g + b + {PRIOR_WEIGHT}) as s from total{i})")
        parts.append(
            f"""model{i + 1} as materialized (select k, v, (coalesce(x.g, 0) + {PRIOR_WEIGHT} * belief.g) / (t.g + {PRIOR_WEIGHT}) as g,
            (coalesce(x.b, 0) + {PRIOR_WEIGHT} * belief.b) / (t.b + {PRIOR_WEIGHT}) as b from belief left join
            (select k, v, sum(e.n * p) as g, sum(e.n * (1 - p)) as b from each_vote e join post{i} using (votes) group by k, v) x using (k, v), total{i} t)"""
        )
    return ",\n".join([*parts, f"posteriors as (select votes, p from post{iterations})"])
