"""Title terms and capability rules by the thousand, found by an index of tokens.

A pattern per term would run every term on every row. Both texts are cut at
word boundaries instead: a term that stands in a text as whole words stands
there token by token. So each term is filed under one of its tokens, the one
that fewest terms have, rows meet the terms of their tokens in an equi-join,
and only those few are verified by the term's pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.checks import whole_word
from jobtide.functions.text import jtrim
from jobtide.operators.firsts import first_per_key


def _tokens(text: Column) -> Column:
    """Distinct tokens in lower case; the engine's own word boundary cuts them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\b"), lambda t: t != ""))


def index_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Terms with ``token``, the rarest of their own over all terms. Null, empty and blank terms have none and go."""
    spread = terms.withColumn("token", F.explode(_tokens(jtrim(term))))
    common = spread.groupBy("token").agg(F.count(F.lit(1)).alias("_terms"))
    return first_per_key(spread.join(common, "token"), [term], ["_terms", "token"]).drop("_terms")


def candidates(rows: DataFrame, text: str, indexed: DataFrame) -> DataFrame:
    """Rows with each indexed entry whose token they hold. A row repeats for each of them."""
    return rows.withColumn("token", F.explode(_tokens(F.col(text)))).join(indexed, "token").drop("token")


def matching_titles(postings: DataFrame, terms: DataFrame, title: str = "title", term: str = "term") -> DataFrame:
    """Postings whose title holds any of the terms as a whole word: ``matches_title`` for a table of terms.

    An empty title is dropped, an empty term never matches, and without any row in ``terms`` every posting stays.
    Titles are matched once each, however often they occur.
    """
    if terms.isEmpty():
        return postings
    asked = terms.select(term).filter(F.col(term) != "").distinct()
    titles = postings.select(F.col(title).alias("_title")).filter("_title <> ''").distinct()
    found = candidates(titles, "_title", index_terms(asked, term)).filter(F.rlike("_title", whole_word(term))).select("_title")
    if not asked.filter(jtrim(term) == "").isEmpty():
        # A term of white space is a pattern of word boundaries alone.
        found = found.union(titles.filter(F.rlike("_title", F.lit(r"\b"))))
    found = found.distinct()
    return postings.join(found, F.col(title) == F.col("_title"), "left_semi")


def label_by_rules(values: DataFrame, rules: DataFrame, value: str = "raw_value") -> DataFrame:
    """``values`` with ``rule_label``: that of the first rule that matches, by rank.

    ``rules``: rank, pattern, label and ``term``, a whole word or words that a text must hold for the pattern to be
    tried, in any case. Each distinct text is labelled once. Rules without a term can't be indexed; give those,
    which every text has to try, to ``functions.names.capability_rule``.
    """
    texts = values.select(F.col(value).alias("_text")).filter("_text IS NOT NULL").distinct()
    indexed = index_terms(rules.filter("term <> ''").select("term").distinct())
    tried = candidates(texts, "_text", indexed).filter(F.rlike("_text", whole_word("term")))
    hits = tried.join(rules, "term").filter(F.rlike(jtrim("_text"), F.concat(F.lit("(?i)"), "pattern")))
    labels = hits.groupBy("_text").agg(F.min_by("label", "rank").alias("rule_label"))
    return values.join(labels, values[value] == labels["_text"], "left").drop("_text")
