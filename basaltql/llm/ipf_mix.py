"""Mixing sources to target weights by iterative proportional fitting, in DataFrame and SQL functions only.

Documents are counted in cells (source, language, topic) of tokens.  Raking scales the cells' weights to the source,
the language and the topic marginals in turn, until no marginal is off by more than TOLERANCE of its target or ROUNDS
are done; one number a round reaches the driver, the cells stay in Spark however many they are.  A document is then kept
with the probability of its cell, calibrated so that the expected tokens are `share` of all; the draw is a hash of
doc_id, the same in every run and for all copies of a row.  The sums of a marginal, and the cells when they are joined
to the documents, are broadcast only if they have been counted to at most BROADCAST rows.

Targets are the observed marginals tempered by an exponent unless given.  Null source, language or topic is a class of
its own ('<null>').  Null and empty texts have no tokens: their cells get probability 1 if nothing else is in them.  A
null doc_id draws as the empty string.  A table without documents gives none.  The topic is a column `topic`, or an
expression that the caller gives; without either it is read off the text's form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS, TOLERANCE, REFINE, SHARE, BROADCAST = 40, 1e-9, 4, 0.5, 100_000
MARGINALS = ("_source", "_lang", "_topic")
#: Exponents of the observed marginals.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def tokens(text: Column) -> Column:
    """White-space separated tokens, near enough: blanks and line ends plus one; none in an empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("bigint")


def topic(text: Column) -> Column:
    """The form of a text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("Licensed under")), "licensed")
        .when(F.contains(text, F.lit("!! ")), "shouted").when(F.length(text) < 400, "note").when(F.length(text) > 8000, "long").otherwise("prose")
    )


def classed(documents: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """The documents with _source, _lang, _topic and _tokens."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("<null>"))
    own = topic_of if topic_of is not None else F.col("topic") if "topic" in [c.lower() for c in documents.columns] else topic(F.coalesce("text", F.lit("")))
    return documents.withColumns({"_source": named(F.col("source")), "_lang": named(F.col("lang")), "_topic": named(own), "_tokens": tokens(F.col("text"))})


def cell_weights(docs: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """_source, _lang, _topic, n (tokens) and w (the raked share of all tokens) of each cell with tokens."""
    cells = cut(docs.groupBy(*MARGINALS).agg(F.sum("_tokens").cast("double").alias("n")).where("n > 0"))
    total, *sizes = cells.agg(F.sum("n"), *[F.countDistinct(at) for at in MARGINALS]).first()
    small = dict(zip(MARGINALS, (n <= BROADCAST for n in sizes), strict=True))

    def joined(x: DataFrame, sums: DataFrame, at: str) -> DataFrame:
        return x.join(F.broadcast(sums) if small[at] else sums, at)

    x = cells.withColumn("w", F.col("n") / (total or 1.0))
    for at in MARGINALS:
        want = cells.groupBy(at).agg(F.pow(F.sum("n"), F.lit(TEMPER[at[1:]])).alias(f"want{at}"))
        whole = want.agg(F.sum(f"want{at}")).first()[0] or 1.0
        x = joined(x, want.withColumn(f"want{at}", F.col(f"want{at}") / whole), at)
    for _ in range(rounds):
        for at in MARGINALS:
            x = joined(x, x.groupBy(at).agg(F.sum("w").alias("_sum")), at).withColumn("w", F.col("w") * F.col(f"want{at}") / F.col("_sum")).drop("_sum")
        x = cut(x.select(*MARGINALS, "n", "w", *[f"want{at}" for at in MARGINALS]))
        if marginal_error(x) <= tolerance:
            break
    return x.select(*MARGINALS, "n", "w")


def marginal_error(x: DataFrame) -> float:
    """The largest share by which a marginal of the raked cells is off its target."""
    off = [x.groupBy(at).agg(F.abs(F.sum("w") / F.first(f"want{at}") - 1).alias("off")).agg(F.max("off").alias("off")) for at in MARGINALS]
    return reduce(DataFrame.union, off).agg(F.max("off")).first()[0] or 0.0


def probabilities(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """The cells with p, min(1, scale * w / n), where the scale makes the expected tokens `share` of all."""
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    scale = share * total
    for _ in range(REFINE):
        full = F.col("w") * scale >= F.col("n")
        r = cells.agg(F.sum(F.when(full, F.col("n"))).alias("n"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if r.w:
            scale = (share * total - (r.n or 0.0)) / r.w
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("w") * scale / F.col("n")))


def mixed(documents: DataFrame, share: float = SHARE, topic_of: Column | None = None) -> DataFrame:
    """All documents with _source, _lang, _topic, _tokens, probability and sampled (columns of these names are replaced)."""
    docs = classed(documents, topic_of)
    cells = cut(probabilities(cell_weights(docs), share).select(*MARGINALS, F.col("p").alias("probability")))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST else cells
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    docs = docs.drop("probability", "sampled").join(cells, list(MARGINALS), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return docs.withColumn("sampled", draw < F.col("probability")).select(*[c for c in documents.columns if c.lower() not in OWN], *OWN)


OWN = ("_source", "_lang", "_topic", "_tokens", "probability", "sampled")


def oracle_sql(documents: str = "documents", rounds: int = ROUNDS, share: float = SHARE) -> str:
    """DuckDB SQL for the digest of mixed(): the raking spelled out."""
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, '<null>') AS s, coalesce(lang, '<null>') AS l,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'Licensed under') THEN 'licensed'
       WHEN contains(coalesce(text, ''), '!! ') THEN 'shouted' WHEN length(coalesce(text, '')) < 400 THEN 'note'
       WHEN length(text) > 8000 THEN 'long' ELSE 'prose' END AS t,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END AS k FROM {documents})""",
        "c AS (SELECT s, l, t, CAST(sum(k) AS DOUBLE) AS n FROM d GROUP BY s, l, t HAVING sum(k) > 0)",
    ]
    for x, key in (("s", "source"), ("l", "lang"), ("t", "topic")):
        ctes.append(f"m{x} AS (SELECT {x}, pow(sum(n), {TEMPER[key]}) / sum(pow(sum(n), {TEMPER[key]})) OVER () AS want FROM c GROUP BY {x})")
    ctes.append("r0 AS (SELECT c.*, ms.want AS ws, ml.want AS wl, mt.want AS wt, n AS w FROM c JOIN ms USING (s) JOIN ml USING (l) JOIN mt USING (t))")
    last = "r0"
    steps = [x for _ in range(rounds) for x in "slt"]
    for i, x in enumerate(steps, 1):
        ctes.append(f"r{i} AS (SELECT * REPLACE (w * w{x} / sum(w) OVER (PARTITION BY {x}) AS w) FROM {last})")
        last = f"r{i}"
    ctes.append(f"f0 AS (SELECT {share} * sum(n) AS b, {share} * sum(n) AS scale FROM {last})")
    for i in range(1, REFINE + 1):
        ctes.append(f"f{i} AS (SELECT any_value(f.b) AS b, coalesce((any_value(f.b) - coalesce(sum(n) FILTER (w * f.scale >= n), 0)) / sum(w) FILTER (w * f.scale < n), any_value(f.scale)) AS scale FROM {last} r, f{i - 1} f)")
    ctes.append(f"p AS (SELECT s, l, t, least(1.0, w * scale / n) AS p FROM {last}, f{REFINE})")
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, t AS topic, CAST(k AS BIGINT) AS n_tokens, round(coalesce(p, 1.0), 6) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < coalesce(p, 1.0) AS sampled
FROM d LEFT JOIN p USING (s, l, t)"""
