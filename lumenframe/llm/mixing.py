"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts of the cells (source, language, topic) are raked until each marginal has its target shares; each document
of a cell is then kept with the cell's probability, by a hash of its id. A probability is at most 1: so a target that
asks for more tokens of a value than there are is lowered to all of them, and the other values share what it leaves.
All of this is aggregates and joins of the cells, whatever their number.

Edge cases: a null source or language is the value "(none)"; a text without a known marker has topic "none"; a null or
empty text has no tokens and weight as its cell; a null doc_id hashes as the empty string; repeated rows share one
draw; target values that no document has are left out and the other targets scaled up; values without a target, "(none)"
too, keep their natural share where the targets leave no rest, and the targets share what remains; a cell whose documents have no
tokens keeps weight 1; an empty table gives an empty result; columns that
begin with mix_ are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumenframe.llm.common import remove, stored

NONE = "(none)"
#: Production settings: markers of each topic, target shares ("even", or shares by value), rounds of raking.
TOPICS = {"process": ("ing", "ung", "ando", "ant "), "abstract": ("tion", "ción", "heit", "keit"), "relation": (" of ", " de ", " von ", " in ")}
TARGETS = {"source": "even", "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, "topic": "even"}
ROUNDS, KEEP, PASSES, PART_CELLS = 12, 0.5, 6, 500_000


def topic_of(text: bytes, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> str:
    """The topic whose markers cover the most characters of the text; the first of equals, "none" without any."""
    covered = [sum(text.count(m.encode()) * len(m) for m in markers) for markers in topics.values()]
    most = max(covered, default=0)
    return list(topics)[covered.index(most)] if most else "none"


def marked(docs: DataFrame, topics: Mapping, carry: list[str], text: str = "text") -> DataFrame:
    """The columns carry of docs, mix_topic, and mix_tokens: the runs without ASCII white space in the text."""
    fields = [f for f in docs.schema.fields if f.name in carry]

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            own = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array([topic_of(x, topics) for x in texts], pa.string()), pa.array([len(x.split()) for x in texts], pa.int64())], [*(f.name for f in fields), "mix_topic", "mix_tokens"])

    schema = StructType([*fields, StructField("mix_topic", StringType()), StructField("mix_tokens", LongType())])
    return docs.select(*dict.fromkeys([*(f.name for f in fields), text])).mapInArrow(run, schema)


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the key's text and the seed."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def raw_shares(natural: DataFrame, dim: str, target, total: int) -> DataFrame:
    """dim and share of the values that occur (dim, n): named ones as asked, the others in their natural proportion within the rest.

    Where the named ones leave no rest, the others keep their natural share and the named ones are scaled to what remains.
    """
    if target == "even":
        return natural.select(dim, "n", F.lit(1.0 / max(1, natural.count())).alias("share"))
    named = F.create_map(*[F.lit(x) for v, s in target.items() for x in (v, float(s))])
    natural = natural.withColumn("named", named[F.col(dim)])
    free, got = natural.agg(F.sum(F.when(F.col("named").isNull(), F.col("n"))), F.sum("named")).first()
    free, got, rest, scale = free or 0, got or 0.0, 1 - sum(target.values()), 1.0
    if rest < 1e-9:
        rest = free / total
        scale = (1 - rest) / got if got else 1.0
    whole = got * scale + (rest if free else 0.0)
    return natural.select(dim, "n", ((F.coalesce(F.col("named") * scale, F.col("n") * (rest / free if free else 0.0))) / whole if whole else F.col("n") / total).alias("share"))


def feasible(shares: DataFrame, dim: str, total: int, keep: float, parts: int, passes: int = PASSES) -> DataFrame:
    """dim and share: no value gets more than all of its tokens (its natural share / keep); the others divide what it leaves."""
    out = shares.coalesce(parts).select(dim, "share", (F.col("n") / total / keep).alias("cap")).withColumn("full", F.lit(False))
    out = stored(out, "mix-shares")
    full = -1
    while True:
        capped, free, n = out.agg(F.sum(F.when(F.col("full"), F.col("cap"))), F.sum(F.when(~F.col("full"), F.col("share"))), F.sum(F.col("full").cast("int"))).first()
        scale = (1 - (capped or 0.0)) / free if free else 0.0
        own = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") * scale)
        if n == full or passes == 0:
            break
        full, passes = n, passes - 1
        new = stored(out.coalesce(parts).select(dim, "share", "cap", (F.col("full") | (own > F.col("cap"))).alias("full")), "mix-shares")
        remove(out)
        out = new
    done = stored(out.coalesce(parts).select(dim, own.alias("share")), "mix-shares")
    remove(out)
    return done


def rake(cells: DataFrame, targets: Mapping, keep: float, rounds: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """cells (the dimensions and tokens) with their weights w, stored; and the feasible target shares of each dimension.

    A weight is at most 1 / keep, so that keep x w is a probability. Nothing here is held in the driver but sums. The
    cells are dealt to a partition for each PART_CELLS of them; what is in one partition is summed and joined without a shuffle.
    """
    dims, most = list(targets), 1 / keep
    cells = stored(cells.withColumn("w", F.lit(1.0)), "mix-cells")
    total, count = cells.agg(F.sum("tokens"), F.count("*")).first()
    parts = max(1, math.ceil(count / PART_CELLS))
    if not total:
        return cells, {}
    shares = {}
    for dim, target in targets.items():
        natural = stored(cells.coalesce(parts).groupBy(dim).agg(F.sum("tokens").alias("n")).where("n > 0"), "mix-natural")
        shares[dim] = feasible(raw_shares(natural, dim, target, total), dim, total, keep, parts)
        remove(natural)
    for _ in range(rounds):
        new = cells.coalesce(parts)
        for dim in dims:
            mass = new.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("w")).alias("mass"))
            factor = mass.join(shares[dim].coalesce(parts), dim, "left").select(dim, F.when(F.col("mass") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("mass")).otherwise(1.0).alias("factor"))
            new = new.join(factor, dim).select(*dims, "tokens", F.least(F.lit(most), F.col("w") * F.col("factor")).alias("w"))
        new = stored(new, "mix-round")
        remove(cells)
        cells = new
    return cells, shares


def mix(docs: DataFrame, targets: Mapping = TARGETS, keep: float = KEEP, rounds: int = ROUNDS, seed: int = 8, topics: Mapping = TOPICS, doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns carry) with mix_topic, mix_tokens, mix_probability, mix_weight and mix_kept; no row is dropped.

    mix_probability is keep x raked weight; the tokens of the sampled documents have the target shares, as far as the
    corpus has the tokens for them. mix_weight is 1 for all that can be sampled, 0 for cells without a target. Texts are
    read and marked once, and the marks stored.
    """
    dims = list(targets)
    columns = [d for d in dims if d != "topic"]
    carry = [c for c in (carry or docs.columns) if not c.startswith("mix_")]
    cell = {d: F.coalesce(F.col(d), F.lit(NONE)) if d != "topic" else F.col("mix_topic") for d in dims}
    marks = stored(marked(docs, topics, list(dict.fromkeys([*carry, *columns, doc_id]))), "mix-marks")
    cells = marks.groupBy(*(c.alias(d) for d, c in cell.items())).agg(F.sum("mix_tokens").alias("tokens"))
    raked, shares = rake(cells, targets, keep, rounds)
    remove(*shares.values())
    raked = raked.select(*(F.col(d).alias(f"mix__{d}") for d in dims), F.col("w").alias("mix__w"))
    out = marks.join(raked, reduce(and_, [c == F.col(f"mix__{d}") for d, c in cell.items()]))
    p = F.least(F.lit(1.0), F.lit(keep) * F.col("mix__w"))
    out = out.withColumns({"mix_probability": p, "mix_weight": F.when(F.col("mix__w") > 0, F.lit(keep) * F.col("mix__w") / p).otherwise(0.0), "mix_kept": uniform(F.col(doc_id), seed) < p})
    return out.select(*carry, "mix_topic", "mix_tokens", "mix_probability", "mix_weight", "mix_kept")


def oracle(source: str = "documents", targets: Mapping = TARGETS, keep: float = KEEP, rounds: int = ROUNDS, seed: int = 8, topics: Mapping = TOPICS) -> str:
    """DuckDB SQL of the CTEs up to "mixed", which has the columns of source and mix()'s."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    covered = {name: " + ".join(f"length(t) - length(replace(t, {quote(m)}, ''))" for m in markers) for name, markers in topics.items()}
    cases = " ".join(f"WHEN c_{n} = greatest({', '.join(f'c_{k}' for k in covered)}) THEN {quote(n)}" for n in covered)
    out = [
        f"a AS MATERIALIZED (SELECT *, coalesce(text, '') AS t FROM {source})",
        f"b AS MATERIALIZED (SELECT * EXCLUDE (t), coalesce(source, '{NONE}') AS d_source, coalesce(lang, '{NONE}') AS d_lang, len(regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+')) AS mix_tokens, {', '.join(f'{e} AS c_{n}' for n, e in covered.items())} FROM a)",
        f"marked AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(f'c_{n}' for n in covered)}), CASE WHEN greatest({', '.join(f'c_{n}' for n in covered)}) = 0 THEN 'none' {cases} END AS d_topic FROM b)",
        "w0 AS MATERIALIZED (SELECT d_source, d_lang, d_topic, sum(mix_tokens)::DOUBLE AS n, 1.0::DOUBLE AS w FROM marked GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(n) AS total FROM w0)",
    ]
    for d, target in targets.items():
        if target == "even":
            out.append(f"r_{d} AS MATERIALIZED (SELECT d_{d}, sum(n) AS n, 1.0::DOUBLE / count(*) OVER () AS share FROM w0 GROUP BY d_{d} HAVING sum(n) > 0)")
        else:
            named = " ".join(f"WHEN {quote(v)} THEN {s!r}::DOUBLE" for v, s in target.items())
            rest = 1 - sum(target.values())
            out.append(f"n_{d} AS MATERIALIZED (SELECT d_{d}, sum(n) AS n, CASE d_{d} {named} END AS named FROM w0 GROUP BY d_{d} HAVING sum(n) > 0)")
            out.append(f"f_{d} AS MATERIALIZED (SELECT coalesce(sum(n) FILTER (named IS NULL), 0) AS free, coalesce(sum(named), 0) AS got, {'coalesce(sum(n) FILTER (named IS NULL), 0) / sum(n)' if rest < 1e-9 else f'{rest!r}::DOUBLE'} AS rest FROM n_{d})")
            scale = "(1 - rest) / got" if rest < 1e-9 else "1.0"
            out.append(f"r_{d} AS MATERIALIZED (SELECT d_{d}, n, coalesce(named * ({scale}), rest * n / nullif(free, 0)) / sum(coalesce(named * ({scale}), rest * n / nullif(free, 0))) OVER () AS share FROM n_{d}, f_{d})")
        out.append(f"c_{d}_0 AS MATERIALIZED (SELECT d_{d}, share, n / total / {keep!r} AS cap, FALSE AS full_ FROM r_{d}, total)")
        own = "CASE WHEN full_ THEN cap ELSE share * (1 - coalesce(sum(cap) FILTER (full_) OVER (), 0)) / sum(share) FILTER (NOT full_) OVER () END"
        for k in range(PASSES):
            out.append(f"c_{d}_{k + 1} AS MATERIALIZED (SELECT d_{d}, share, cap, full_ OR {own} > cap AS full_ FROM c_{d}_{k})")
        out.append(f"s_{d} AS MATERIALIZED (SELECT d_{d}, {own} AS share FROM c_{d}_{PASSES})")
    k = 0
    for _ in range(rounds):
        for d in targets:
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT d_source, d_lang, d_topic, n, least({1 / keep!r}, w * CASE WHEN m > 0 THEN coalesce(share, 0) * total / m ELSE 1 END) AS w FROM (SELECT *, sum(n * w) OVER (PARTITION BY d_{d}) AS m FROM w{k}) LEFT JOIN s_{d} USING (d_{d}) CROSS JOIN total)")
            k += 1
    u = f"(('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0"
    out.append(f"mixed AS (SELECT * EXCLUDE (d_source, d_lang, d_topic, n, w, p), d_topic AS mix_topic, p AS mix_probability, CASE WHEN w > 0 THEN {keep!r} * w / p ELSE 0 END AS mix_weight, {u} < p AS mix_kept FROM (SELECT *, least(1.0, {keep!r} * w) AS p FROM marked JOIN w{k} USING (d_source, d_lang, d_topic)))")
    return ", ".join(out)


ORACLE = f"WITH {oracle()} SELECT doc_id, source, lang, mix_topic AS topic, mix_tokens AS n_tokens, round(mix_probability, 6) AS probability, round(mix_weight, 6) AS weight FROM mixed WHERE mix_kept"
