"""Mixing sources to target weights by Pareto order sampling (operator 2), in DataFrame operations only.

Sizes are words. A source's target is its share of all words by weight, at most `max_copies` times its own words; what
exceeds that is shared anew by weight among the others until none exceeds it (water filling). Within a source,
documents get expected copies in proportion to size ** -damping, at most `max_copies`, scaled so that the expected
words are the target. Whole expected copies are certain. The fraction is an inclusion probability p: a document
draws u from a digest of the seed, its id, source and text, and is ranked by (u / (1 - u)) / (p / (1 - p)), random odds
divided by inclusion odds. The sample's size is fixed in words: documents are taken in that order while they fit into the source's
budget. One that would overrun it is passed over and the walk goes on behind it, until at most NEAR of the target is open or nothing fits.
One more document, the one whose size closes the remaining gap best, is added when that brings the total nearer.

Distribution: texts are read once into a narrow table (id, source, size, draw) in the shared folder, from which another one
is made with the ranks. Sizes are classed by their
power of two, told from their bits. Where a walk meets an overrunning document is found by counting words in about sqrt(n) rank buckets of
a source, each for the same expected number of documents, then ordering the one bucket where the budget ends, so that no
task sorts a source; each walk is a pass over the narrow table. All sums are pre-aggregated before the shuffle. Per-source
tables hold one row a source; they are joined by whatever Spark finds fit for their size.

Null or empty texts have size 0 and are never taken. A null source is a source of its own, the last. Rows that agree in
id, source and text share a draw and are taken or left together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, table

#: Part of a source's target that may be left open before the last document is chosen.
NEAR = 0.002
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(df: DataFrame, part: list[str], weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Adds the level L at which sum(least(cap, L * weight)) over a part's rows is its total; null if all are capped."""
    order = Window.partitionBy(*part).orderBy(F.col(cap) / F.col(weight), *[c for c in df.columns if c not in (cap, weight)][:2])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    rest = F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = rest / (F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    df = df.withColumn("_try", level)
    df = df.withColumn(out, F.max(F.when(F.col("_try") <= F.col(cap) / F.col(weight), F.col("_try"))).over(whole))
    return df.drop("_try")


def draw(seed: int, *parts: Column) -> Column:
    """A number in (0, 1), the same in every run: the first 48 bits of a digest of the seed and the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(x, F.lit("-")) for x in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def cycling_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by the sources' code point order, null last. One row a source is what is ordered."""
    n = F.row_number().over(Window.orderBy(F.col("_source").isNull(), F.col("_source")))
    return sources.withColumn("_weight", ((n - 1) % 3 + 1).cast("double"))


def _fill(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """One walk along each source's order, over documents of at most `_most` words that come after `_after`: up to the first one that
    overruns the gap. The walk goes on behind that one, over documents that fit, unless the gap is near enough or none is left."""
    live = ranked.join(state.where("not _done").select("_s", "_gap", "_most", "_after"), "_s").where("_q > _after and _n <= _most")
    counted = live.groupBy("_s", "_b").agg(F.sum("_n").alias("_w"), F.first("_gap").alias("_gap"))
    counted = counted.withColumn("_to", F.sum("_w").over(Window.partitionBy("_s").orderBy("_b")))
    over = F.col("_to") > F.col("_gap")
    edge = counted.groupBy("_s").agg(F.sum("_w").alias("_sum"), F.min(F.when(over, F.struct("_b", (F.col("_to") - F.col("_w")).alias("_before")))).alias("_e"))
    edge = edge.select("_s", "_sum", F.col("_e._b").alias("_edge"), F.col("_e._before").alias("_before"))
    within = live.join(edge, "_s").where("_b = _edge")
    within = within.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy("_s", "_b").orderBy("_q")))
    cut = within.groupBy("_s").agg(F.max(F.when(~over, F.col("_to"))).alias("_to"), F.min(F.when(over, F.col("_q"))).alias("_next"))
    new = state.join(edge, "_s", "left").join(cut, "_s", "left")
    # in the buckets before the edge all of these are taken: what is at or behind the overrunning one isn't
    filled = F.when(F.col("_edge").isNull(), F.coalesce("_sum", F.lit(0))).otherwise(F.coalesce("_to", "_before"))
    upto = F.when(F.col("_edge").isNull(), float("inf")).otherwise(F.col("_next"))
    step = F.struct(F.col("_after").alias("after"), upto.alias("upto"), F.col("_most").alias("most"))
    gap = F.col("_gap") - filled
    done = F.col("_done") | F.col("_edge").isNull() | (gap <= NEAR * F.col("_target"))
    return materialize(new.select(
        "_s", "_target", F.when(F.col("_done"), F.col("_gap")).otherwise(gap).alias("_gap"), F.when(F.col("_done"), F.col("_most")).otherwise(gap).cast("double").alias("_most"),
        F.when(F.col("_done"), F.col("_after")).otherwise(upto).alias("_after"), F.when(F.col("_done"), F.col("_steps")).otherwise(F.concat("_steps", F.array(step))).alias("_steps"), done.alias("_done"),
    ), "mix-state")


def mix(docs: DataFrame, weights=cycling_weights, seed: int = 7, max_copies: int = 3, damping: float = 0.125, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words), copies. weights: adds `_weight` > 0 to the
    table of sources (`_source`)."""
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    n = docs.select(F.col(id_col).alias("_id"), key.alias("_s"), word_count(F.col(text_col)).alias("_n"), F.md5(F.col(text_col).cast("binary")).alias("_h"))
    n = n.select("_id", "_s", "_n", draw(seed, F.col("_id").cast("string"), F.col("_s"), F.col("_h")).alias("_u"), (F.length(F.bin(F.col("_n") + 1)) - 1).alias("_k"))
    n = materialize(n, "mix-sizes")

    # targets of sources, then the expected copies of each class of sizes (at most 63 classes a source)
    classes = n.groupBy("_s", "_k").agg(F.sum("_n").alias("_words"), F.count("*").alias("_docs"))
    classes = materialize(classes, "mix-classes")
    sources = classes.groupBy("_s").agg(F.sum("_words").alias("_size"), F.sum("_docs").alias("_docs"))
    sources = weights(sources.withColumn("_source", F.when(F.col("_s") != "-", F.substring("_s", 2, 1 << 30))))
    sources = sources.withColumn("_cap", (F.col("_size") * max_copies).cast("double")).withColumn("_all", F.sum("_size").over(Window.partitionBy(F.lit(0))).cast("double"))
    sources = water_level(sources, [], "_weight", "_cap", "_all", "_level")
    target = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_weight")), F.col("_cap"))
    sources = sources.select("_s", "_size", target.alias("_target"))

    by_class = classes.select("_s", "_k", "_words", "_docs").join(sources, "_s")
    by_class = by_class.withColumn("_w", F.pow(F.lit(2.0), -damping * F.col("_k"))).withColumn("_cw", F.col("_words") * F.col("_w") + F.when(F.col("_words") == 0, 1.0).otherwise(0.0)).withColumn("_cc", (F.col("_words") * max_copies).cast("double"))
    by_class = water_level(by_class, ["_s"], "_cw", "_cc", "_target", "_level")
    copies = F.coalesce(F.least(F.lit(float(max_copies)), F.col("_level") * F.col("_w")), F.lit(float(max_copies)))
    copies = F.when(F.col("_words") == 0, 0.0).when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies)
    by_class = by_class.withColumn("_m", copies).withColumn("_p", F.col("_m") - F.floor("_m")).withColumn("_part", F.when(F.col("_p") > 0, F.col("_docs")))
    per_source = by_class.groupBy("_s").agg(
        F.first("_size").alias("_size"), F.first("_target").alias("_target"), F.sum("_part").cast("double").alias("_parts"),
        F.collect_list(F.when(F.col("_p") > 0, F.struct(F.col("_part").cast("double").alias("n"), ((1 - F.col("_p")) / F.col("_p")).alias("r")))).alias("_odds"),
        F.map_from_entries(F.collect_list(F.struct("_k", "_m"))).alias("_copies"),
        (F.first("_target") - F.sum(F.floor("_m") * F.col("_words"))).alias("_budget"),
    )
    per_source = materialize(per_source, "mix-sources")

    # rank of the fractions
    d = n.join(per_source, "_s").withColumn("_m", F.element_at("_copies", F.col("_k"))).withColumn("_sure", F.floor("_m"))
    d = d.withColumn("_p", F.col("_m") - F.col("_sure"))
    d = d.withColumn("_q", F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (1 - F.col("_u")) * (1 - F.col("_p")) / F.col("_p")))
    # how many documents of the source are expected up to a rank, in buckets of its square root; each step of the sum grows with the rank
    ahead = F.aggregate("_odds", F.lit(0.0), lambda n, x: n + x["n"] / (1 + x["r"] / F.col("_q")))
    d = d.withColumn("_b", F.when(F.col("_q").isNotNull(), F.floor(ahead / F.sqrt("_parts"))).cast("int")).select("_id", "_s", "_n", "_sure", "_q", "_b")
    d = materialize(d, "mix-ranks")
    ranked = d.where("_q is not null").select("_s", "_n", "_q", "_b")
    state = per_source.select("_s", "_target", F.col("_budget").alias("_gap"), F.lit(float("inf")).alias("_most"), F.lit(-1.0).alias("_after"), F.array().cast("array<struct<after:double,upto:double,most:double>>").alias("_steps"), F.lit(False).alias("_done"))
    state = _fill(ranked, state)
    while not state.where("not _done").isEmpty():
        release(docs.sparkSession)
        state = _fill(ranked, state)

    # the document that closes the gap best
    taken = F.exists("_steps", lambda x: (F.col("_q") > x["after"]) & (F.col("_q") < x["upto"]) & (F.col("_n") <= x["most"]))
    gap = F.col("_gap")
    left = ranked.join(state, "_s").where(~taken)
    best = left.groupBy("_s").agg(F.min(F.struct(F.abs(F.col("_n") - gap).alias("_off"), F.col("_q"))).alias("_c")).select("_s", F.col("_c._q").alias("_last"))
    alike = left.join(best, "_s").where("_q = _last").groupBy("_s", "_last").agg(F.sum("_n").alias("_w"), F.first(gap).alias("_gap"))
    alike = alike.where(F.abs(F.col("_w") - F.col("_gap")) < F.abs("_gap")).select("_s", "_last")
    state = state.select("_s", "_target", "_steps").join(per_source.select("_s", "_size"), "_s").join(alike, "_s", "left")
    state = materialize(state, "mix-last")

    chosen = F.col("_q").isNotNull() & (taken | F.coalesce(F.col("_q") == F.col("_last"), F.lit(False)))
    out = d.join(state, "_s").withColumn("_c", F.col("_sure") + F.when(chosen, 1).otherwise(0))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_c") * F.col("_n")).alias("taken"), F.col("_c").cast("int").alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, s, n, CAST(floor(log2(n + 1)) AS INT) AS k,
         (CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || s || '|' || coalesce(md5(text), '-')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM (SELECT doc_id, text, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents) x
), classes AS (SELECT s, k, CAST(sum(n) AS BIGINT) AS words FROM n GROUP BY 1, 2
), src AS (
  SELECT s, size, size * 3.0::DOUBLE AS cap, CAST((row_number() OVER (ORDER BY s = '-', s) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(sum(size) OVER () AS DOUBLE) AS total
  FROM (SELECT s, CAST(sum(words) AS BIGINT) AS size FROM classes GROUP BY 1) x
), src_try AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS t FROM src
  WINDOW b AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tgt AS (SELECT s, size, coalesce(least(cap, w * max(CASE WHEN t <= cap / w THEN t END) OVER ()), cap) AS target FROM src_try
), cls AS (
  SELECT s, k, words, size, target, pow(2.0, -0.125 * k) AS w, words * 3.0::DOUBLE AS cc, words * pow(2.0, -0.125 * k) + CASE WHEN words = 0 THEN 1 ELSE 0 END AS cw FROM classes JOIN tgt USING (s)
), cls_try AS (
  SELECT *, (target - coalesce(sum(cc) OVER b, 0)) / (sum(cw) OVER (PARTITION BY s) - coalesce(sum(cw) OVER b, 0)) AS t FROM cls
  WINDOW b AS (PARTITION BY s ORDER BY cc / cw, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), raw AS (
  SELECT s, k, words, size, target, CASE WHEN words = 0 THEN 0 ELSE coalesce(least(3, w * max(CASE WHEN t <= cc / cw THEN t END) OVER (PARTITION BY s)), 3) END AS m FROM cls_try
), m AS (SELECT s, k, words, size, target, CASE WHEN abs(m - round(m)) < 1e-9 THEN round(m) ELSE m END AS m FROM raw
), budget AS (SELECT s, max(target) - sum(floor(m) * words) AS budget FROM m GROUP BY 1
), d AS (
  SELECT n.doc_id, n.s, n.n, n.u, m.size, m.target, budget, floor(m) AS sure, m - floor(m) AS p FROM n JOIN m ON n.s = m.s AND n.k = m.k JOIN budget ON n.s = budget.s
), r AS (SELECT *, CASE WHEN p > 0 AND n > 0 THEN u / (1 - u) * (1 - p) / p END AS q FROM d
), g AS (SELECT s, q, max(n) AS n, sum(n) AS w, max(budget) AS budget, max(target) AS target, row_number() OVER (PARTITION BY s ORDER BY q) AS i FROM r WHERE q IS NOT NULL GROUP BY s, q
), walk(s, i, gap, most, stop, took) AS (
  SELECT s, CAST(0 AS BIGINT), CAST(max(budget) AS DOUBLE), CAST('inf' AS DOUBLE), false, false FROM d GROUP BY s
  UNION ALL
  SELECT g.s, g.i, CASE WHEN NOT stop AND n <= most AND w <= gap THEN gap - w ELSE gap END,
         CASE WHEN NOT stop AND n <= most AND w > gap THEN gap ELSE most END, stop OR (n <= most AND w > gap AND gap <= 0.002::DOUBLE * target), NOT stop AND n <= most AND w <= gap
  FROM walk JOIN g ON g.s = walk.s AND g.i = walk.i + 1
), o AS (SELECT r.*, coalesce(walk.took, false) AS took FROM r LEFT JOIN g ON g.s = r.s AND g.q = r.q LEFT JOIN walk ON walk.s = g.s AND walk.i = g.i
), f AS (SELECT s, min(gap) AS gap FROM walk GROUP BY 1
), near AS (SELECT s, q, gap, CAST(sum(n) AS DOUBLE) AS w, row_number() OVER (PARTITION BY s ORDER BY abs(max(n) - gap), q) AS k FROM o JOIN f USING (s) WHERE q IS NOT NULL AND NOT took GROUP BY s, q, gap
), last AS (SELECT s, q FROM near WHERE k = 1 AND abs(w - gap) < abs(gap)
), c AS (SELECT o.*, CAST(sure AS INT) + CASE WHEN o.q IS NOT NULL AND (took OR o.q = last.q) THEN 1 ELSE 0 END AS copies FROM o LEFT JOIN last ON o.s = last.s AND o.q = last.q)
SELECT doc_id, n AS size, size AS source_size, target, CAST(copies * n AS BIGINT) AS taken, copies FROM c
"""
