"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source is hashed into blocks of documents. Targets are shares of all words by weight, held at `most` times a
source's size, the excess reshared among the others (water-filling, in closed form over sources sorted by the share at
which each is full). A source takes whole passes over its blocks and, for the rest, permuted blocks up to its target;
the block that the target cuts gives a share of its sub-blocks, so the error is about one document, and one more block is
taken where that comes nearer.

That makes an exact quota of blocks for each source. A binary tree splits the quotas among the output shards: at each
node a random half of the node's tickets goes left, which draws the sources' counts from the multivariate
hypergeometric distribution and keeps every quota exact. The leaves' counts then draw disjoint runs of each source's
permuted blocks. Rows are shuffled within their shard by a hash.

Only per-block sums are shuffled (partial sums first); windows run over blocks, whose number is bounded by the number
of sources, never over documents, so a hot source is many blocks; of many sources' tickets, a node's are ranked in slots of their
random draws. Sources alone, one row each, are ordered in one task. All choices hash ids and a seed: reruns agree. Sizes
are written once to the shared checkpoint folder because the texts would otherwise be counted for each pass.

Defined results: null text has size 0; a null source is a source of its own, last in order; a source of size 0 takes
nothing; equal ids are taken alike; an empty table gives no rows; further columns are ignored or, in mixed_rows, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks per source, sub-blocks per block, levels of the tree (2 to this power shards).
BLOCKS, SUBBLOCKS, LEVELS = 256, 4096, 3
#: A plan of at most so many rows is broadcast in mixed_rows; a larger one is joined by shuffling.
BROADCAST_ROWS = 20_000
#: Tickets that are ranked in one window; more are ranked in slots of their draws, with the same result.
TICKETS_TOGETHER, SLOT_BITS = 200_000, 10
SLOTS = 1 << SLOT_BITS


def number(*parts: Column) -> Column:
    """An integer below 2^32 from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(by_block: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """k, source_size, target, passes, rest: one row per source."""
    sources = by_block.groupBy("k").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("k") == "n", "k")
    weight = F.array(*map(F.lit, weights))[(F.row_number().over(order) - 1) % len(weights)]
    sources = sources.withColumn("weight", weight.cast("long")).withColumn("full", most * F.col("source_size"))
    rank = Window.orderBy(F.col("full") / F.col("weight"), "k")
    before, everything = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.select("*", F.row_number().over(rank).alias("rank"), (left.cast("double") / weights_left.cast("double")).alias("level"))
    fits = F.when(F.col("weight") * F.col("level") <= F.col("full"), F.struct("rank", "level"))
    level = F.coalesce(F.min(fits).over(everything)["level"], F.lit(0.0))
    sources = sources.withColumn("target", F.least(F.col("full").cast("double"), F.col("weight") * level))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")).cast("int"))).otherwise(0)
    return sources.withColumn("passes", passes).select("k", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))


def sized(df: DataFrame, seed: int, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """doc_id, size, k, block, sub."""
    at = number(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    size = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD)).cast("long")
    named = df.select(F.col(id_column).alias("doc_id"), size.alias("size"), key(F.col(source_column)).alias("k"), at.alias("at"))
    return named.select("doc_id", "size", "k", (F.col("at") % BLOCKS).cast("int").alias("block"), (F.floor(F.col("at") / BLOCKS) % SUBBLOCKS).cast("int").alias("sub"))


def in_slots(tickets: DataFrame) -> DataFrame:
    """Tickets (node, draw) with the slot of their draw, the number of tickets of the node in earlier slots and in all, so that
    they can be ranked slot by slot. Counts have at most SLOTS rows for each node and are broadcast."""
    slot = F.shiftright("draw", 32 - SLOT_BITS).cast("int").alias("slot")
    counts = tickets.groupBy(F.col("node").alias("_node"), slot.alias("_slot")).agg(F.count("*").alias("n"))
    node = Window.partitionBy("_node")
    before = F.coalesce(F.sum("n").over(node.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_node", "_slot", before.alias("before"), F.sum("n").over(node).alias("tickets"))
    tickets = tickets.select("*", slot)
    return tickets.join(F.broadcast(counts), (F.col("node") == F.col("_node")) & (F.col("slot") == F.col("_slot"))).drop("_node", "_slot")


def plan(documents: DataFrame, seed: int, weights: tuple[int, ...], most: int, levels: int) -> DataFrame:
    """For each source's block: passes over all of it, sub-blocks below `below` get one more, and each copy's shard."""
    by_block = cut(documents.groupBy("k", "block").agg(F.sum("size").alias("words")), documents.count())
    n = by_block.count()
    sources = targets(by_block, weights, most)
    permuted = Window.partitionBy("k").orderBy(number(F.lit(seed), F.lit("rest"), F.col("k"), F.col("block")), "block")
    blocks = by_block.join(sources, "k").withColumn("upto", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = cut(blocks.withColumn("left", F.col("rest") - (F.col("upto") - F.col("words"))), n)
    split = blocks.where("rest > 0 and left > 0 and upto > rest").select("k", "block", "left")
    subs = documents.join(split, ["k", "block"]).groupBy("k", "block", "left", "sub").agg(F.sum("size").alias("words"))
    reached = F.sum("words").over(Window.partitionBy("k").orderBy("sub"))
    inside = F.col("reached") <= F.col("left")
    subs = subs.withColumn("reached", reached).groupBy("k", "block").agg(F.max(F.when(inside, F.col("sub") + 1)).alias("upto_sub"), F.sum(F.when(inside, F.col("words"))).alias("some"))
    whole = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    below = F.when(whole, F.lit(SUBBLOCKS)).otherwise(F.coalesce("upto_sub", F.lit(0)))
    more = F.when(whole, F.col("words")).otherwise(F.coalesce("some", F.lit(0)))
    blocks = blocks.join(subs, ["k", "block"], "left").withColumn("below", below).withColumn("more", more)
    # where a few long documents make up a source, another block may come nearer to what is still missing
    source = Window.partitionBy("k")
    blocks = blocks.withColumn("missing", F.col("rest") - F.sum("more").over(source))
    spare = (F.col("below") == 0) & (F.col("words") > 0) & (F.col("rest") > 0)
    blocks = blocks.withColumn("miss", F.when(spare, F.abs(F.col("missing") - F.col("words"))).otherwise(F.lit(float("inf"))))
    fills = (F.min(F.struct("miss", "block")).over(source)["block"] == F.col("block")) & (F.col("miss") < F.abs("missing"))
    blocks = blocks.select("k", "block", "source_size", "target", "passes", F.when(fills, F.lit(SUBBLOCKS)).otherwise(F.col("below")).alias("below"))
    blocks = cut(blocks.withColumn("copies", F.col("passes") + (F.col("below") > 0).cast("int")), n)
    units = blocks.where("copies > 0").select("k", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"))
    run = Window.partitionBy("k").orderBy("pass", number(F.lit(seed), F.col("pass"), F.col("k"), F.col("block")), "block")
    units = units.withColumn("unit", F.row_number().over(run))
    tickets = units.select("k", "unit", F.lit(0).alias("node"))
    many = (blocks.agg(F.sum("copies")).first()[0] or 0) > TICKETS_TOGETHER
    for level in range(levels):
        tickets = tickets.withColumn("draw", number(F.lit(seed), F.lit(f"level{level}"), F.col("k"), F.col("unit")))
        tickets = in_slots(tickets) if many else tickets.select("*", F.lit(0).alias("slot"), F.lit(0).alias("before"), F.count("*").over(Window.partitionBy("node")).alias("tickets"))
        right = (F.col("before") + F.row_number().over(Window.partitionBy("node", "slot").orderBy("draw", "k", "unit"))) * 2 > F.col("tickets")
        tickets = tickets.select("k", "unit", (F.col("node") * 2 + right.cast("int")).alias("node"))
    drawn = tickets.select("k", F.row_number().over(Window.partitionBy("k").orderBy("node", "unit")).alias("unit"), F.col("node").alias("shard"))
    shards = units.join(drawn, ["k", "unit"]).groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    return cut(blocks.join(shards, ["k", "block"], "left").select("k", "block", "source_size", "target", "passes", "below", F.transform("shards", lambda x: x["shard"]).alias("shards")), n)


def _copies() -> tuple[Column, Column]:
    n = F.col("passes") + (F.col("sub") < F.col("below")).cast("int")
    return n, F.when(n > 0, F.slice("shards", 1, n)).otherwise(F.array().cast("array<int>"))


def mix(df: DataFrame, *, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, levels: int = LEVELS, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, shards (those of its copies, comma-joined)."""
    documents = cut(sized(df, seed, id_column, text_column, source_column))
    chosen = plan(documents, seed, weights, most, levels)
    n, shards = _copies()
    return documents.join(chosen, ["k", "block"]).select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), F.concat_ws(",", shards.cast("array<string>")).alias("shards"))


def mixed_rows(df: DataFrame, *, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, levels: int = LEVELS, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of df, each as often as it is taken, dealt to their shards and shuffled there; columns as in df."""
    documents = cut(sized(df, seed, id_column, text_column, source_column))
    chosen = plan(documents, seed, weights, most, levels).drop("source_size", "target")
    at = number(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    rows = df.select(whole, key(F.col(source_column)).alias("k"), at.alias("at"))
    rows = rows.select("whole", "k", "at", (F.col("at") % BLOCKS).cast("int").alias("block"), (F.floor(F.col("at") / BLOCKS) % SUBBLOCKS).cast("int").alias("sub"))
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    n, shards = _copies()
    copies = rows.join(chosen, ["k", "block"]).select("whole", "at", F.posexplode(shards).alias("pass", "shard"))
    # a shard has more rows than one task should hold: each task shuffles its share of every shard
    dealt = copies.repartition("shard", "at").sortWithinPartitions("shard", F.xxhash64("at", "pass", F.lit(seed)))
    return dealt.select(*[F.col("whole").getField(c).alias(c) for c in df.columns])


def oracle(seed: int = 7, most: int = 3, levels: int = LEVELS) -> str:
    """The same rows in DuckDB's SQL."""
    n = lambda *parts: "cast('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8) as bigint)"
    tree = "".join(
        f""", node{i + 1} as (select k, unit, node * 2 + cast(row_number() over (partition by node order by draw, k, unit) * 2 > count(*) over (partition by node) as int) as node
  from (select *, {n(str(seed), f"'level{i}'", "k", "unit")} as draw from node{i}))"""
        for i in range(levels)
    )
    return f"""with sized as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
  coalesce('s' || source, 'n') as k, {n(str(seed), "coalesce(cast(doc_id as varchar), 'null')")} as drawn_at from documents),
documents2 as (select doc_id, size, k, drawn_at % {BLOCKS} as block, (drawn_at // {BLOCKS}) % {SUBBLOCKS} as sub from sized),
by_block as (select k, block, cast(sum(size) as bigint) as words from documents2 group by all),
s1 as (select k, cast(sum(words) as bigint) as source_size from by_block group by all),
s2 as (select *, (row_number() over (order by k = 'n', k) - 1) % 3 + 1 as weight, {most} * source_size as "full" from s1),
s3 as (select *, row_number() over (order by "full" / weight, k) as rank,
  cast(sum(source_size) over () - coalesce(sum("full") over (order by "full" / weight, k rows between unbounded preceding and 1 preceding), 0) as double)
  / cast(sum(weight) over () - coalesce(sum(weight) over (order by "full" / weight, k rows between unbounded preceding and 1 preceding), 0) as double) as level from s2),
s4 as (select *, least(cast("full" as double), weight * coalesce((select arg_min(level, rank) from s3 where weight * level <= "full"), 0.0)) as target from s3),
s5 as (select *, case when source_size > 0 then least({most}, cast(floor(target / source_size) as int)) else 0 end as passes from s4),
sources as (select k, source_size, target, passes, target - passes * source_size as rest from s5),
b1 as (select *, sum(words) over (partition by k order by {n(str(seed), "'rest'", "k", "block")}, block rows unbounded preceding) as upto from by_block join sources using (k)),
b2 as (select *, rest - (upto - words) as "left" from b1),
subs as (select k, block, "left", sub, sum(size) as words from documents2 join (select k, block, "left" from b2 where rest > 0 and "left" > 0 and upto > rest) using (k, block) group by all),
mids as (select *, sum(words) over (partition by k order by sub) as reached from subs),
cuts as (select k, block, max(case when reached <= "left" then sub + 1 end) as upto_sub, sum(case when reached <= "left" then words end) as some_words from mids group by all),
b3 as (select *, case when rest > 0 and upto <= rest then {SUBBLOCKS} else coalesce(upto_sub, 0) end as below,
  case when rest > 0 and upto <= rest then words else coalesce(some_words, 0) end as more from b2 left join cuts using (k, block)),
b4 as (select *, rest - cast(sum(more) over (partition by k) as bigint) as missing from b3),
b5 as (select *, case when below = 0 and words > 0 and rest > 0 then abs(missing - words) else 'infinity'::double end as miss from b4),
b6 as (select * exclude (below), case when miss < abs(missing) and row_number() over (partition by k order by miss, block) = 1 then {SUBBLOCKS} else below end as below from b5),
blocks as (select k, block, source_size, target, passes, below, passes + cast(below > 0 as int) as copies from b6),
units as (select *, row_number() over (partition by k order by pass, {n(str(seed), "pass", "k", "block")}, block) as unit from (select k, block, unnest(range(copies)) as pass from blocks where copies > 0)),
node0 as (select k, unit, 0 as node from units){tree},
drawn as (select k, row_number() over (partition by k order by node, unit) as unit, node as shard from node{levels}),
shards as (select k, block, list(shard order by pass) as shards from units join drawn using (k, unit) group by all)
select doc_id, size, source_size, target, cast(size * (passes + cast(sub < below as int)) as bigint) as taken,
  coalesce(array_to_string(shards[1:passes + cast(sub < below as int)], ','), '') as shards
from documents2 join blocks using (k, block) left join shards using (k, block)"""
