"""Mixing sources to target weights by Poisson replication.

A source with n documents and target weight w gets the mean repetition rate total * w / (n * sum
of w). Each document's count is the inverse of that Poisson distribution at a number hashed from
its doc_id and the seed, so it doesn't depend on other rows or on partitioning. Documents are
exploded by their counts, and all copies are dealt to partitions by ranges of a hashed key and
ordered by it there: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, staged

SALTS = 256
STEP = 16.0  # a larger mean is drawn as a sum of means up to this


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, key: Column, seed: int) -> Column:
    """The count for a key: the least n whose distribution function is above the hashed number."""
    draws = F.greatest(F.lit(1), F.ceil(mean / STEP).cast("int"))
    part = mean / draws

    def draw(j: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, j.cast("string"))
        start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("below"), F.lit(0).alias("n"))

        def more(s: Column, k: Column) -> Column:
            p = s["p"] * part / k
            return F.when(s["below"] <= u, F.struct(p.alias("p"), (s["below"] + p).alias("below"), (s["n"] + 1).alias("n"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, more, lambda s: s["n"])

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda a, j: a + draw(j))).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None, power: float, total: float | None) -> DataFrame:
    """source and mean repetition rate; without weights, a source's weight is its count to `power`."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "__source string, w double")
        counts = counts.join(given, "__source", "left")
        weight = F.coalesce("w", F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    out_total = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    # one row of sums meets one row for each source
    return counts.join(F.broadcast(sums)).select("__source", F.when(F.col("all_w") > 0, out_total * F.col("weight") / (F.col("n") * F.col("all_w"))).otherwise(0.0).alias("__mean"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """Copies of docs in shuffled order, with copy_no (from 0), n_copies and shuffle_key.

    weights: by source, others get none; `total` documents come out on average, as many as came in
    by default. Null and empty sources are one source; a null doc_id is hashed as empty; repeated
    rows get the same count each; an empty table stays empty; texts of any length are copied whole.
    Extra columns are kept, but for those named n_copies, copy_no, shuffle_key, __source, __mean and
    __salt, which are replaced or dropped. A source of any size is neither grouped nor sorted as one: only its
    count is shuffled.
    """
    docs = docs.drop("n_copies", "copy_no", "shuffle_key", "__source", "__mean", "__salt")
    rate = staged(rates(docs, weights, power, total), "rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    with_rate = docs.withColumn("__source", F.coalesce("source", F.lit("")))
    if rate.count() <= 1_000_000:  # one narrow row for each source
        with_rate = with_rate.join(F.broadcast(rate), "__source")
    else:  # a hot source is dealt over SALTS tasks
        salted = rate.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        with_rate = with_rate.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"]).drop("__salt")
    counted = with_rate.withColumn("n_copies", poisson(F.col("__mean"), key, seed).cast("long")).where("n_copies > 0").drop("__source", "__mean")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long"))
    n = partitions(docs.sparkSession)
    # keys are uniform by their making, so equal ranges need no sampling pass over the texts
    part = (F.shiftright("shuffle_key", 32) * n / F.lit(1 << 28)).cast("int")  # the key's first 28 bits
    return keyed.repartitionById(n, part).sortWithinPartitions("shuffle_key")


ORACLE = """
with c as (select coalesce(source, '') as s, count(*) as n, sqrt(count(*)::double) as w from documents group by 1),
r as (select s, (select sum(n) from c)::double * w / (n * (select sum(w) from c)) as m from c),
d as (select d.*, m, greatest(1, ceil(m / 16.0))::int as draws from documents d join r on coalesce(d.source, '') = r.s),
j as (select doc_id, m / draws as part, unnest(generate_series(1, draws)) as j from d),
u as (select doc_id, part, ('0x' || substr(md5('17:' || doc_id || ':' || j), 1, 13))::bigint::double / 4503599627370496.0 as u from j),
k as (select doc_id, sum(len(list_filter(list_transform(generate_series(0, 60), lambda k: list_sum(list_transform(generate_series(0, k), lambda i: exp(-part) * pow(part, i) / gamma(i + 1)))), lambda f: f <= u)))::bigint as n_copies from u group by doc_id),
x as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, k.n_copies, unnest(generate_series(0, k.n_copies - 1)) as copy_no from d join k using (doc_id) where k.n_copies > 0)
select doc_id, text, lang, source, n_chars, n_copies, copy_no, ('0x' || substr(md5('17-order:' || doc_id || ':' || copy_no), 1, 15))::bigint as shuffle_key from x
"""
