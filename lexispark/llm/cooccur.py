"""Items that appear together: pair counts with blocking of large baskets, and association scores.

Plan. Each basket's distinct items are sorted. Baskets of at most `block` items give their pairs at once; a larger one is cut into chunks of `block`
items; chunks are shuffled first and meet in pairs behind that, so that the products of one huge basket are made in many tasks. All
pairs are then counted with map-side aggregation, so a hot item or pair is added up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .termcount import CODES_SQL, record_codes


def _inside(items: Column) -> Column:
    """All pairs a < b of a sorted array."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def _between(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("a"), y.alias("b")))))


def pair_rows(baskets: DataFrame, items: str, block: int = 64) -> DataFrame:
    """a, b, n: each pair of distinct items (a < b by codepoint) of each basket, n times over; a pair has many rows.

    A huge basket leaves its task as chunks, each once; equal baskets are one from there on, n times. Behind that shuffle every chunk goes to the products it takes part in, so that
    neither the chunks' pairs nor the items' pairs of a basket are made in one task. Baskets are told apart by two hashes of their items: a task that is made again makes the same.
    """
    own = baskets.select(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("items"))
    small = own.where(F.size("items").between(2, block)).select(F.explode(_inside(F.col("items"))).alias("p"), F.lit(1).cast("bigint").alias("n"))
    last = F.ceil(F.size("items") / F.lit(block)).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("items", i * block + 1, F.lit(block)))
    basket = F.struct(F.xxhash64("items").alias("x"), F.hash("items").alias("y"))
    chunks = own.where(F.size("items") > block).select(basket.alias("basket"), last.alias("last"), F.posexplode(cut).alias("i", "chunk"))
    chunks = chunks.groupBy("basket", "last", "i").agg(F.first("chunk").alias("chunk"), F.count("*").alias("n"))
    met = chunks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    met = met.groupBy("basket", "lo", "hi").agg(F.max(F.when(F.col("i") == F.col("lo"), F.col("chunk"))).alias("left"), F.max(F.when(F.col("i") == F.col("hi"), F.col("chunk"))).alias("right"), F.max("n").alias("n"))
    product = F.when(F.col("lo") == F.col("hi"), _inside(F.col("left"))).otherwise(_between(F.col("left"), F.col("right")))
    return small.unionByName(met.select(F.explode(product).alias("p"), "n")).select("p.a", "p.b", "n")


def associations(baskets: DataFrame, items: str, block: int = 64, least: int = 1) -> DataFrame:
    """a, b, n_ab, n_a, n_b, total, lift, pmi of each pair in at least `least` baskets.

    baskets: a row for each basket; null and empty arrays and null items take no part, an item counts once a basket. total: baskets with at least one item.
    """
    pairs = pair_rows(baskets, items, block).groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    single = baskets.select(F.explode(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    total = baskets.where(F.size(F.filter(items, lambda x: x.isNotNull())) > 0).agg(F.count("*").alias("total"))  # one row
    a = single.select(F.col("item").alias("a"), F.col("n").alias("n_a"))
    b = single.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
    scored = pairs.join(a, "a").join(b, "b").join(F.broadcast(total))
    lift = F.col("n_ab") * F.col("total").cast("double") / (F.col("n_a") * F.col("n_b").cast("double"))
    return scored.select("a", "b", "n_ab", "n_a", "n_b", "total", lift.alias("lift"), F.log2(lift).alias("pmi"))


def code_pairs(records: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """code_a, code_b that at least `least` records hold together and `times` as many as by chance, in whole numbers."""
    s = associations(record_codes(records), "codes", least=least)
    d = lambda c: F.col(c).cast("decimal(19,0)")
    return s.where(d("n_ab") * d("total") >= (d("n_a") * d("n_b")).cast("decimal(37,0)") * times).select(F.col("a").alias("code_a"), F.col("b").alias("code_b"))


FOUND_SQL = (
    CODES_SQL
    + """, d as (select distinct record_id, code from codes), n as (select count(distinct record_id) as n from d),
f as (select code, count(*) as k from d group by code),
p as (select a.code as code_a, b.code as code_b, count(*) as k from d a join d b on a.record_id = b.record_id and a.code < b.code group by all having count(*) >= 5)
select code_a, code_b from p join f fa on fa.code = code_a join f fb on fb.code = code_b, n where p.k::hugeint * n.n >= 3 * fa.k::hugeint * fb.k"""
)
SCORES_SQL = (
    CODES_SQL
    + """, d as (select distinct record_id, code from codes), n as (select count(distinct record_id) as n from d),
f as (select code, count(*) as k from d group by code),
p as (select a.code as code_a, b.code as code_b, count(*) as k from d a join d b on a.record_id = b.record_id and a.code < b.code group by all)
select code_a, code_b, p.k as n_ab, fa.k as n_a, fb.k as n_b, round(p.k * n.n::double / (fa.k * fb.k::double), 6) as lift from p join f fa on fa.code = code_a join f fb on fb.code = code_b, n"""
)
