"""Quality rules as weak supervision, in DataFrame and SQL expressions only.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).
Vote patterns are counted over the whole table (at most 3 ** len(RULES) groups, however
many rows there are); expectation-maximisation on those counts estimates the class prior
and, for every rule and class, how often it votes each way. Texts that the two fixed
rules reject are decided already and don't enter these counts. The posterior probability of
"good" then decides, in place of requiring that all rules pass.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import FUNCTION_WORDS, materialize

#: name -> (SQL condition of a bad vote, SQL condition of a good vote); else the rule abstains.
RULES = {
    "symbols": ("n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    "repetition": ("n_repeat_words > 0.35 * n_words", "n_repeat_words < 0.15 * n_words"),
    "lines": ("n_dup_lines > 0.30 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    "function_words": ("n_function <= 1", "n_function >= 4"),
    "word_length": ("word_chars < 2.2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "capitals": ("n_capitals > 0.30 * word_chars", "n_capitals < 0.10 * word_chars"),
    "sentences": ("n_stops < 0.01 * n_words or n_stops > 0.6 * n_words", "n_stops between 0.02 * n_words and 0.35 * n_words"),
    "variety": ("n_distinct < 0.12 * n_words and n_words < 2000", "n_distinct > 0.30 * n_words"),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_WS = r"[\x20\x09-\x0D]"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read, as columns ``_q_*``; a null text has no words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.withColumn("_t", t)
    d = d.withColumn("_w", F.expr(rf"if(btrim(_t, ' \t\n\x0B\f\r') = '', array(), split(btrim(_t, ' \t\n\x0B\f\r'), r'{_WS}+'))".replace(r"\x0B\f", "\\u000B\\u000C")))
    d = d.withColumn("_n", F.size("_w"))
    # Windows that may repeat: 33 bits of a hash over 31 bits of place, sorted as plain longs.
    d = d.withColumn(
        "_s",
        F.expr(
            "if(_n < 4, array(), sort_array(transform(sequence(0, greatest(_n, 3) - 3), "
            "i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), 31) | i)))"
        ),
    )
    d = d.withColumn(
        "_c",
        F.expr("transform(filter(_s, (x, k) -> (x ^ get(_s, k + 1)) between 0 and 2147483647 or (x ^ get(_s, k - 1)) between 0 and 2147483647), x -> cast(x & 2147483647 as int))"),
    )
    # Those that do: the words themselves, compared among the few that are left.
    d = d.withColumn("_s", F.expr("sort_array(transform(_c, i -> named_struct('g', concat_ws(' ', slice(_w, i + 1, 3)), 'i', i)))"))
    d = d.withColumn("_p", F.expr("transform(filter(_s, (x, k) -> get(_s, k + 1).g <=> x.g or get(_s, k - 1).g <=> x.g), x -> x.i)"))
    d = d.withColumn("_l", F.expr(rf"filter(split(_t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"))
    words = ", ".join("'" + w + "'" for w in dict.fromkeys(FUNCTION_WORDS))
    counts = {
        "n_words": "cast(_n as bigint)",
        "word_chars": "cast(length(array_join(_w, '')) as bigint)",
        "n_symbols": "cast(length(_t) - length(regexp_replace(_t, r'[#*$%&|<>]', '')) as bigint)",
        "n_dup_lines": "cast(size(_l) - size(array_distinct(_l)) as bigint)",
        "n_repeat_words": "cast(size(array_union(_p, array_union(transform(_p, p -> p + 1), transform(_p, p -> p + 2)))) as bigint)",
        "n_lines": "cast(size(_l) as bigint)",
        "n_function": f"cast(size(array_intersect(_w, array({words}))) as bigint)",
        "n_capitals": "cast(length(_t) - length(regexp_replace(_t, r'[A-Z]', '')) as bigint)",
        "n_stops": rf"cast(regexp_count(_t, r'[.!?](?={_WS}|$)') as bigint)",
        "n_distinct": "cast(size(array_distinct(_w)) as bigint)",
    }
    # Flat columns, not a struct: the optimiser would copy a struct's fields into each use.
    for name, sql in counts.items():
        d = d.withColumn(f"_q_{name}", F.expr(sql))
    return d.drop("_t", "_w", "_n", "_s", "_c", "_p", "_l")


def base_failed() -> Column:
    """The two fixed rules that always reject: under 50 words, or over half the words repeated."""
    return F.expr("_q_n_words < 50 or 100 * _q_n_repeat_words > 50 * _q_n_words")


def votes() -> Column:
    """array<tinyint>: one vote per rule; every rule abstains on a text without words."""
    return F.array(
        *[
            F.expr(f"cast(case when _q_n_words = 0 then 0 when {_on(bad)} then -1 when {_on(good)} then 1 else 0 end as tinyint)")
            for bad, good in RULES.values()
        ]
    )


def _on(sql: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", r"_q_\1", sql)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, smooth: float = 1.0, false_alarm: float = 0.02, tolerance: float = 1e-9) -> dict:
    """EM for two classes in which the votes of different rules are independent.

    ``patterns`` holds (votes, documents). The start says that a rule seldom votes bad on a
    good text, which names the classes; ``false_alarm`` bounds that share throughout. Returns the prior and, per rule and vote,
    log P(vote | good) - log P(vote | bad). No documents: the start's weights.
    """
    m = len(RULES)
    prior = 0.8
    start_good, start_bad = {1: 0.8, 0: 0.18, -1: 0.02}, {1: 0.5, 0: 0.2, -1: 0.3}
    good = [dict(start_good) for _ in range(m)]
    bad = [dict(start_bad) for _ in range(m)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        on = [{v: smooth * x for v, x in start_good.items()} for _ in range(m)]
        off = [{v: smooth * x for v, x in start_bad.items()} for _ in range(m)]
        mass = 0.0
        for vote, n in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(vote))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            mass += n * p
            for j, v in enumerate(vote):
                on[j][v] += n * p
                off[j][v] += n * (1 - p)
        new = min(max(mass / total, 1e-3), 1 - 1e-3)
        shift = abs(new - prior)
        for old, got in ((good, on), (bad, off)):
            for j in range(m):
                s = sum(got[j].values())
                fresh = {v: max(x / s, 1e-6) for v, x in got[j].items()}
                if got is on and fresh[-1] > false_alarm:
                    fresh = {v: false_alarm if v == -1 else x * (1 - false_alarm) / (1 - fresh[-1]) for v, x in fresh.items()}
                shift = max(shift, max(abs(fresh[v] - old[j][v]) for v in fresh))
                old[j] = fresh
        prior = new
        if shift < tolerance:
            break
    return {"prior": prior, "weights": [{v: math.log(g[v] / b[v]) for v in (1, 0, -1)} for g, b in zip(good, bad, strict=True)]}


def posterior(model: dict, votes_column: str = "_votes") -> Column:
    """P(good | votes) as an expression, rounded to 9 places."""
    z = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for j, w in enumerate(model["weights"]):
        v = F.get(F.col(votes_column), F.lit(j))
        z = z + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(w[0])
    return F.round(1 / (1 + F.exp(-z)), 9)


def quality_rules(docs: DataFrame, text: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Score ``docs``: the ``carry`` columns (default: all), the counts, ``posterior``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows are scored
    alike, each giving one row. An empty table gives an empty table. Columns of ``docs``
    named like an output column are replaced.
    """
    made = [*FEATURES, "posterior", "base_failed", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    d = features(docs, text)
    d = d.select(*carry, *[F.col(f"_q_{c}").alias(c) for c in FEATURES], votes().alias("_votes"), base_failed().alias("base_failed"))
    d = materialize(d, "rules")
    counted = d.where(~F.col("base_failed")).groupBy("_votes").count().collect()  # at most 3 ** len(RULES) rows
    model = fit(sorted((tuple(r["_votes"]), r["count"]) for r in counted))
    d = d.withColumn("posterior", posterior(model))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("_votes")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with the columns of ``documents``."""
    return quality_rules(docs).where("kept").select(*docs.columns)
