"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The weights of these cells are raked until the weighted tokens have
the target shares in each dimension. A document is expected as often as its cell's weight says: the whole part of that
number gives copies, the rest is the probability of one more. Rare categories are repeated, so no probability has to
be cut off at one and the drawn tokens have the target shares too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The category of everything that a target does not name, nulls included.
REST = "*"
ROUNDS = 20
#: Tokens that a draw holds in expectation, as a share of all tokens.
KEEP = 1.0
DIMENSIONS = ("source", "lang", "topic")

#: Production targets: what share of the tokens each category should have.
SOURCES = {**{f"src{i}": 1.0 for i in range(20)}, REST: 1.0}
LANGS = {"en": 0.5, "fr": 0.17, "de": 0.17, "es": 0.13, REST: 0.03}
TOPICS = {"licence": 0.1, "markup": 0.1, "contact": 0.1, REST: 0.7}
#: Topics by the first pattern that is found in a text.
TOPIC_PATTERNS = (("licence", "[Ll]icen[sc]e|[Cc]opyright"), ("markup", "[<>{}|]"), ("contact", "@|[0-9]{3}"))


def topic(text: str, patterns: Sequence[tuple[str, str]] = TOPIC_PATTERNS) -> Column:
    found = F.lit(REST)
    for name, pattern in reversed(patterns):
        found = F.when(F.col(text).rlike(pattern), name).otherwise(found)
    return found


def tokens(text: str) -> Column:
    """Runs of characters other than blanks, tabs and line ends."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t\r\n]+"))


def named(column: str, targets: Mapping[str, float]) -> Column:
    return F.when(F.col(column).isin(*targets), F.col(column)).otherwise(F.lit(REST))


def draw(doc_id: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def classified(docs: DataFrame, targets: Sequence[Mapping[str, float]], text: str = "text") -> DataFrame:
    """``docs`` with _tokens and the categories _source, _lang and _topic."""
    sources, langs, topics = targets
    return docs.withColumns(
        {"_tokens": tokens(text), "_source": named("source", sources), "_lang": named("lang", langs), "_topic": topic(text)}
    ).withColumn("_topic", named("_topic", topics))


def rake(cells: Mapping[tuple[str, ...], float], targets: Sequence[Mapping[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Weights of cells such that weighted tokens have the target shares in every dimension.

    Shares of categories without tokens are spread over the others in proportion. Cells without tokens have weight
    zero. Each round scales every dimension in turn, the last one exactly.
    """
    total = sum(cells.values())
    weights = {c: float(t > 0) for c, t in cells.items()}
    for _ in range(rounds):
        for k, shares in enumerate(targets):
            sums: dict[str, float] = {}
            for c, t in sorted(cells.items()):
                sums[c[k]] = sums.get(c[k], 0.0) + weights[c] * t
            present = sum(shares[name] for name, s in sums.items() if s > 0)
            for c in weights:
                if sums[c[k]] > 0 and present > 0:
                    weights[c] *= shares[c[k]] / present * total / sums[c[k]]
    return weights


def deviation(cells: Mapping[tuple[str, ...], float], weights: Mapping[tuple[str, ...], float], targets: Sequence[Mapping[str, float]]) -> float:
    """How far the weighted shares are from the targets at most; targets that tokens can't meet never come near zero."""
    total = sum(weights[c] * t for c, t in cells.items())
    worst = 0.0
    for k, shares in enumerate(targets):
        present = {c[k] for c, t in cells.items() if t > 0}
        whole = sum(shares[name] for name in present)
        for name in present if total and whole else ():
            reached = sum(weights[c] * t for c, t in cells.items() if c[k] == name) / total
            worst = max(worst, abs(reached - shares[name] / whole))
    return worst


def mix(
    docs: DataFrame, sources: Mapping[str, float] = SOURCES, langs: Mapping[str, float] = LANGS, topics: Mapping[str, float] = TOPICS,
    keep: float = KEEP, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with _tokens, _source, _lang, _topic, _weight, _expected, _copies and _sampled.

    Targets name categories of source, lang and topic; everything else, nulls too, counts as ``*``. They bound the
    cells, which are raked here. ``_expected`` is ``keep`` times the weight; a row is drawn ``_copies`` times, the
    whole part of that and once more if a number drawn from its id is below the rest, and sampled if that is not
    zero. Repeated rows and rows that share an id and a cell are drawn alike. Texts without tokens count nothing and
    are expected like their cell, never if no text of the cell has tokens. An empty table gives no rows. Columns called
    like the added ones are replaced.
    """
    targets = _with_rest(sources, langs, topics)
    rows = classified(docs, targets, text)
    cells = cell_tokens(rows)
    weights = rake(cells, targets, rounds)
    table = docs.sparkSession.createDataFrame(
        [(*c, weights[c], keep * weights[c]) for c in sorted(cells)], "_source string, _lang string, _topic string, _weight double, _expected double"
    )
    joined = rows.drop("_weight", "_expected").join(F.broadcast(table), CELL)
    whole = F.floor("_expected")
    copies = whole + F.when(draw(doc_id) < F.col("_expected") - whole, 1).otherwise(0)
    return joined.withColumn("_copies", copies.cast("int")).withColumn("_sampled", F.col("_copies") > 0)


CELL = ["_source", "_lang", "_topic"]


def _with_rest(*targets: Mapping[str, float]) -> list[Mapping[str, float]]:
    return [t if REST in t else {**t, REST: 0.0} for t in targets]


def cell_tokens(rows: DataFrame) -> dict[tuple[str, ...], float]:
    """Tokens of each cell: at most one row for each combination of named categories reaches the driver."""
    summed = rows.groupBy(*CELL).agg(F.sum("_tokens").alias("n")).collect()
    return {tuple(r[k] for k in CELL): float(r["n"]) for r in summed}


def reached(
    mixed: DataFrame, sources: Mapping[str, float] = SOURCES, langs: Mapping[str, float] = LANGS, topics: Mapping[str, float] = TOPICS
) -> DataFrame:
    """dimension, category, target, raked and drawn: the shares of tokens that weights and draw have reached.

    Targets of categories without tokens are spread over the others. Without any tokens there are no rows.
    """
    sums = [F.sum("_tokens").alias("n"), F.sum(F.col("_tokens") * F.col("_weight")).alias("w"), F.sum(F.col("_tokens") * F.col("_copies")).alias("d")]
    cells = [r.asDict() for r in mixed.groupBy(*CELL).agg(*sums).collect()]  # as many as there are cells
    out = []
    for name, shares in zip(CELL, _with_rest(sources, langs, topics)):
        by: dict[str, list[float]] = {}
        for r in cells:
            total = by.setdefault(r[name], [0.0, 0.0, 0.0])
            for i, k in enumerate("nwd"):
                total[i] += float(r[k])
        present = {c: t for c, t in by.items() if t[0] > 0}
        whole, raked, drawn = sum(shares[c] for c in present), sum(t[1] for t in present.values()), sum(t[2] for t in present.values())
        out += [(name[1:], c, shares[c] / whole if whole else 0.0, t[1] / raked if raked else 0.0, t[2] / drawn if drawn else 0.0) for c, t in sorted(present.items())]
    return mixed.sparkSession.createDataFrame(out, "dimension string, category string, target double, raked double, drawn double")


def _cte(shares: Mapping[str, float]) -> str:
    return ", ".join(f"('{name}', {share!r}::DOUBLE)" for name, share in shares.items())


def mixing_sql(documents: str = "documents", keep: float = KEEP, rounds: int = ROUNDS) -> str:
    """The same mixture of the production targets in plain SQL: one pair of subqueries for each scaling."""
    dims = {"s": SOURCES, "l": LANGS, "t": TOPICS}
    cases = "".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}' " for n, p in TOPIC_PATTERNS)
    names = lambda shares: ", ".join(f"'{n}'" for n in shares)
    parts = [
        f"""docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n,
        CASE WHEN source IN ({names(SOURCES)}) THEN source ELSE '*' END AS s, CASE WHEN lang IN ({names(LANGS)}) THEN lang ELSE '*' END AS l,
        CASE {cases}ELSE '*' END AS t FROM {documents})""",
        *(f"target_{d} AS (SELECT * FROM (VALUES {_cte(shares)}) v(name, share))" for d, shares in dims.items()),
        "w0 AS (SELECT s, l, t, sum(n)::DOUBLE AS n, CASE WHEN sum(n) > 0 THEN 1.0::DOUBLE ELSE 0 END AS w FROM docs GROUP BY s, l, t)",
        "total AS (SELECT sum(n) AS total FROM w0)",
    ]
    step = 0
    for _ in range(rounds):
        for d in dims:
            parts.append(f"m{step} AS MATERIALIZED (SELECT {d}, sum(w * n) AS x FROM w{step} GROUP BY {d})")
            parts.append(
                f"""w{step + 1} AS MATERIALIZED (SELECT s, l, t, n, CASE WHEN x > 0 THEN w * share / (SELECT sum(share) FROM m{step} JOIN target_{d} ON name = {d} WHERE x > 0) * total / x ELSE w END AS w
        FROM w{step} JOIN m{step} USING ({d}) JOIN target_{d} ON name = {d}, total)"""
            )
            step += 1
    parts.append(f"expected AS (SELECT s, l, t, w, {keep!r} * w AS e FROM w{step})")
    number = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0"
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, n AS n_tokens, s AS source_group, l AS lang_group, t AS topic, round(w, 6) AS weight, round(e, 6) AS expected, "
        f"(floor(e) + CASE WHEN {number} < e - floor(e) THEN 1 ELSE 0 END)::INTEGER AS copies FROM docs JOIN expected USING (s, l, t)"
    )
