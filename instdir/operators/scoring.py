"""Weighted score of a name against a url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_word_of, initials, name_words, url_root
from ..rules import ScoringRules, as_list
from .terms import MANY, TermSet

SIGNALS = ("known", "initials", "word", "url_keyword", "name_keyword")


def score_signals(df: DataFrame, rules: ScoringRules, name: str = "name", url: str = "url", many: int = MANY) -> DataFrame:
    """df with rejected and a boolean s_... for each signal. A rejected row has no other signal.

    Terms, domains and keywords may be tables of any size (see ``terms``; those of over ``many`` rows are joined);
    stopwords are part of each task's plan.
    """
    low_url, low_name = F.lower(url), F.lower(name)
    stop, keywords = as_list(rules.stopwords), TermSet(rules.keywords, many=many)
    looked_up = {
        "__known": (TermSet(rules.known_domains, many=many), url_root(F.col(url))),
        "__url_keyword": (keywords, low_url),
        "__name_keyword": (keywords, low_name),
        "__rejected": (TermSet(rules.reject_terms, many=many), low_url),
    }
    for column, (terms, text) in looked_up.items():
        df = terms.mark(df, text, column)
    first = initials(F.col(name))
    words = F.filter(name_words(F.col(name)), lambda w: (F.length(w) > 4) & ~(w.isin(stop) if stop else F.lit(False)))
    hits = {
        "known": F.col("__known"),
        "initials": (F.length(first) >= 2) & low_url.contains(first),
        "word": contains_word_of(low_url, words),
        "url_keyword": F.col("__url_keyword"),
        "name_keyword": F.col("__name_keyword"),
    }
    out = df.withColumn("rejected", F.col("__rejected"))
    return out.withColumns({f"s_{s}": ~F.col("rejected") & hits[s] for s in SIGNALS}).drop(*looked_up)


def score_candidates(df: DataFrame, rules: ScoringRules, name: str = "name", url: str = "url") -> DataFrame:
    """df with its signals, score, is_valid and reason."""
    out = score_signals(df, rules, name, url)
    score = sum((F.when(F.col(f"s_{s}"), getattr(rules.weights, s)).otherwise(0) for s in SIGNALS), F.lit(0))
    told = F.concat_ws(" | ", *[F.when(F.col(f"s_{s}"), rules.labels[s]) for s in SIGNALS])
    reason = F.when(F.col("rejected"), rules.rejected).when(told == "", rules.nothing).otherwise(told)
    return out.withColumns({"score": score, "reason": reason}).withColumn("is_valid", ~F.col("rejected") & (F.col("score") >= rules.weights.threshold))


def gate_error() -> Column:
    """What a failure record says of a row that the gate stops (fixed wording)."""
    return F.concat(F.lit("Bank validation failed ("), F.col("score").cast("string"), F.lit("/100): "), F.col("reason"))
