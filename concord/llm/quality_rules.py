"""Quality rules by weak supervision, with built-in functions only.

Each rule looks at a few counts of a text and votes *good* (1), *bad* (0) or
abstains (null). No rule decides by itself: expectation-maximisation over all
documents estimates, without labels, how often each rule gives each of the three
answers to good and to bad texts, so that a rule that can only say *bad* tells
something by how much more often it does so of bad texts. A document is kept
when its posterior probability of being good reaches a threshold.

The only thing that leaves the executors is the table of vote patterns with
their counts: three outcomes per rule, so at most 3 ** rules rows whatever the
corpus holds. All passes of the estimation run on that table; the posterior
itself is a sum of log-likelihood ratios, evaluated as a column expression.

Defined cases: a null, empty or blank text has no words and fails the base
rules; repeated rows are judged alike, each by itself; extra columns pass
through :func:`judge` untouched unless they bear the name of an output column,
which is then replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, row_key, words_of

#: Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "on", "was", "are", "by", "this", "from",
    "der", "die", "das", "und", "ist", "mit", "den", "von", "zu", "auf", "ein", "eine", "nicht", "sich", "für",
    "le", "la", "les", "des", "et", "est", "un", "une", "dans", "que", "qui", "pour", "par", "sur", "pas",
    "el", "los", "las", "de", "y", "en", "una", "con", "se", "su", "al", "del", "es", "lo", "como",
)
SYMBOLS = "[#*$%&|<>]"


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every column of ``docs`` but the text, and the counts of its whole text.

    Repeated three-word windows are found inside the row: the windows are
    zipped, sorted as structs of strings, and neighbours compared, so the test
    is exact and nothing is shuffled.
    """
    counts = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_function_words", "n_ended"}
    kept = [c for c in docs.columns if c != text and c not in counts]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *kept,
        words_of(body).alias("_w"),
        F.expr(f"filter(split(coalesce(`{text}`, ''), '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"[.!?]['\")]*(?:[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ended"),
    )
    windows = F.expr("greatest(size(_w) - 2, 0)")
    sized = split.withColumn("_n", windows)
    sorted_windows = sized.withColumn(
        "_s",
        F.sort_array(F.arrays_zip(
            F.expr("slice(_w, 1, _n)").alias("a"), F.expr("slice(_w, 2, _n)").alias("b"),
            F.expr("slice(_w, 3, _n)").alias("c"), F.expr("slice(sequence(0, greatest(_n - 1, 0)), 1, _n)").alias("i"),
        )),
    )
    pairs = sorted_windows.withColumn(
        "_p", F.expr("arrays_zip(slice(_s, 1, greatest(_n - 1, 0)), slice(_s, 2, greatest(_n - 1, 0)))")
    )
    same = "p.`0`.a = p.`1`.a AND p.`0`.b = p.`1`.b AND p.`0`.c = p.`1`.c"
    covered = f"transform(filter(_p, p -> {same}), p -> array(p.`0`.i, p.`0`.i + 1, p.`0`.i + 2, p.`1`.i, p.`1`.i + 1, p.`1`.i + 2))"
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return pairs.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.expr(covered)))).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect("_w", stop)).cast("long").alias("n_function_words"),
        "n_ended",
    )


@dataclass(frozen=True)
class Rule:
    """A vote: ``good`` and ``bad`` are conditions over the counts; neither: abstain."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN 0 WHEN {self.good} THEN 1 END").alias(f"vote_{self.name}")


#: No two rules read the same defect, as the estimation takes them as independent given the class.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "n_symbols * 100 <= n_words", "n_symbols * 20 > n_words"),
    Rule("lines", "n_lines >= 3 AND n_dup_lines = 0", "n_dup_lines * 5 >= n_lines AND n_dup_lines > 0"),
    Rule("repeats", "n_words >= 3 AND n_repeat_words * 10 < n_words", "n_repeat_words * 10 > 3 * n_words"),
    Rule("word_length", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars NOT BETWEEN 2 * n_words AND 15 * n_words"),
    Rule("function_words", "n_function_words >= 4", "n_words >= 30 AND n_function_words <= 1"),
    Rule("sentences", "n_ended * 40 >= n_words", "n_words >= 60 AND n_ended * 100 < n_words"),
)
#: Outcomes in the order of the tables: bad, good, abstention.
OUTCOMES = (0, 1, None)


@dataclass
class LabelModel:
    """What EM has learnt: the share of good documents, and P(outcome | class) by rule."""

    prior: float
    #: rule -> (P of each outcome for bad texts, the same for good ones).
    tables: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = field(default_factory=dict)

    def weight(self, rule: str, vote: int | None) -> float:
        """The log-likelihood ratio of an outcome, never against what the vote says."""
        bad, good = self.tables[rule]
        k = OUTCOMES.index(vote)
        told = math.log(good[k] / bad[k])
        return max(told, 0.0) if vote == 1 else min(told, 0.0) if vote == 0 else told

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.tables:
            v = F.col(f"vote_{rule}")
            total = total + F.when(v == 1, F.lit(self.weight(rule, 1))).when(v == 0, F.lit(self.weight(rule, 0))).otherwise(F.lit(self.weight(rule, None)))
        return total

    def posterior(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def fit_label_model(patterns: list[tuple[tuple[int | None, ...], int]], rules: tuple[Rule, ...] = RULES, rounds: int = 200, start: float = 0.8, smooth: float = 1.0) -> LabelModel:
    """EM on vote patterns and counts; an abstention is an outcome like the votes.

    It starts from a majority of good documents and from rules that, of all the
    votes that they cast, give bad texts a bad one and good texts a good one
    with odds of ``start``. ``smooth`` pseudo-counts keep each estimate off 0,
    and no vote may ever speak against what it says, which fixes which of the
    two classes is called good.
    """
    total = sum(n for _, n in patterns)
    first = LabelModel(start)
    for r, rule in enumerate(rules):
        seen = [sum(n for votes, n in patterns if votes[r] == o) + smooth for o in OUTCOMES]
        lean = [(start, 1 - start, 0.5), (1 - start, start, 0.5)]
        mass = [[s * x for s, x in zip(seen, side, strict=True)] for side in lean]
        first.tables[rule.name] = tuple(tuple(x / sum(side) for x in side) for side in mass)
    model = first
    if not total:
        return model
    for _ in range(rounds):
        mass = {r.name: [[smooth * x for x in side] for side in first.tables[r.name]] for r in rules}
        good_mass = 0.0
        for votes, n in patterns:
            odds = math.log(model.prior / (1 - model.prior)) + sum(model.weight(r.name, v) for r, v in zip(rules, votes, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_mass += n * p
            for r, v in zip(rules, votes, strict=True):
                k = OUTCOMES.index(v)
                mass[r.name][1][k] += n * p
                mass[r.name][0][k] += n * (1 - p)
        before = model.prior
        model = LabelModel(min(max((good_mass + smooth * start) / (total + smooth), 0.01), 0.99), {name: tuple(tuple(x / sum(side) for x in side) for side in sides) for name, sides in mass.items()})
        if abs(model.prior - before) < 1e-9:
            break
    return model


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior, ``base_failed`` and ``kept`` for every document."""
    made = ["base_failed", "posterior", "kept", *[f"vote_{r.name}" for r in rules]]
    counts = text_counts(docs.drop(*made), text)
    voted = materialize(counts.select("*", *[r.vote() for r in rules]), "votes")
    votes = [f"vote_{r.name}" for r in rules]
    patterns = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(rules) rows
    found = sorted(((tuple(r[v] for v in votes), r["n"]) for r in patterns), key=lambda x: [-1 if v is None else v for v in x[0]])
    model = fit_label_model(found, rules)
    return (
        voted.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("posterior", model.posterior())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, in whole."""
    row = free_name(docs)
    named = docs.withColumn(row, row_key(key, text))
    verdicts = judge(named.select(row, text), text).filter("kept").select(row)
    return named.join(verdicts, row, "left_semi").select(*docs.columns)
