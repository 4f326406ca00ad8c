"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame operations only.

Targets: the sources, in code-point order with null last, have weights; together they get SHARE of all words. A target
stops at CAP times its source's words, and the excess is shared out again by weight until none is above. That fixed
point is min(CAP * size, level * weight) for one level, found from running sums over one row a source.

Blocks: each source's rows fall by a hash of the row into blocks of about ROWS rows; only a block's total is kept. The
blocks of a source stand in a random order; a mix takes whole passes over them and then as many words as the quota has
left, so each source's words taken meet its target to one word.

Splitting tree: the draws are the blocks that the passes use. The root holds each source's count of draws; a node gives
its left child a given number of draws, spread over the sources as a multivariate hypergeometric sample (source by
source, each a hypergeometric draw given those before it; first over groups of SOURCES sources, then in each group), and
the right child the rest, until each leaf, an output shard of about SHARD words, holds an exact count of draws from each
source. A source's draws in their random order then go to the shards by those counts, so the shards' blocks are disjoint,
and each shard orders its rows by a hash of its own.

Defined cases: null text counts no words and is taken 0 times; null source is a source of its own; a source without
words has target 0; repeated rows and repeated ids are rows of their own, each taken as one; an empty table gives no
rows; the outcome follows from the rows and the seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import placed, settle

SHARE = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
ROWS = 64
SOURCES = 4096
SHARD = 1 << 23
LEVELS = 1  # at least
RANGE = 4096
SEED = 20


def words(text: Column) -> Column:
    """Number of runs of anything but white space (space and U+0009 to U+000D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _chance(*parts: object) -> Column:
    """A uniform number in (0, 1) that depends on the parts alone."""
    cut = F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11)
    return (cut.cast("double") + 0.5) / float(1 << 53)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, blocks, target) for rows (source, size): one row a source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    named = placed(sums, [F.col("source").asc_nulls_last()], {})
    turn = F.pmod("place", F.lit(len(weights))).cast("int")
    named = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).drop("place")
    full = named.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    total = full.agg((share * F.sum("source_size")).alias("goal"), F.sum("weight").alias("all"))
    spread = placed(full, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"filled": cap * F.col("source_size"), "gone": F.col("weight")})
    spread = spread.crossJoin(F.broadcast(total))  # one row
    # the level if all sources before this one are at their cap and none from here on is
    spread = settle(spread.withColumn("level", (F.col("goal") - F.col("filled")) / (F.col("all") - F.col("gone"))))
    # levels fall short of the answer before it and of their own ratio after it: the first that its own source can hold
    found = spread.where("level <= ratio").agg(F.min_by("level", "place").alias("found"))
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce("found", F.lit(float("inf"))) * F.col("weight"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / ROWS)).cast("long")
    return spread.crossJoin(F.broadcast(found)).select("source", "source_size", "docs", blocks.alias("blocks"), target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, mark) of each row of docs, written, so that a row keeps its number; mark: a hash of the text."""
    counted = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    return settle(counted.withColumn("row", F.monotonically_increasing_id()))


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.col("blocks"))


def plan(sized: DataFrame, seed: int = SEED, **how: object) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and (source, block, words, rank, begin, quota, source_size, used) for each block with words, in its source's random order."""
    per = settle(targets(sized, **how))
    dealt = sized.join(per.select(F.col("source").alias("s"), "blocks"), _same(F.col("source"), F.col("s")))
    sums = dealt.groupBy("source", _block(seed).alias("block")).agg(F.sum("size").alias("words")).where("words > 0")
    ranked = placed(sums, [F.col("source").asc_nulls_last(), F.xxhash64("source", "block", F.lit(seed + 1)), F.col("block")], {"before": F.col("words")})
    firsts = ranked.groupBy("source").agg(F.min("place").alias("p0"), F.min("before").alias("w0"), F.count("*").alias("used"))
    about = per.join(firsts.withColumnRenamed("source", "t"), _same(F.col("source"), F.col("t")))
    about = about.select(F.col("source").alias("s"), F.round("target").cast("long").alias("quota"), "source_size", "p0", "w0", "used")
    ranked = ranked.join(about, _same(F.col("source"), F.col("s")))
    return per, settle(ranked.select("source", "block", "words", (F.col("place") - F.col("p0")).alias("rank"), (F.col("before") - F.col("w0")).alias("begin"), "quota", "source_size", "used"))


def _passes() -> tuple[Column, Column]:
    """Whole passes over a source, and the words that the last, partial pass takes."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return whole, F.col("quota") - whole * F.col("source_size")


def _hypergeometric(chance: Column, good: Column, rest: Column, draws: Column) -> Column:
    """How many of the draws, from good + rest, are good: inversion of the distribution by its ratio of neighbours.

    Sums run up from the smallest possible count; the terms are kept relative to the most likely one, whose logarithm
    comes from the recurrence, so that no term is lost for large counts.
    """
    low, high = F.greatest(F.lit(0).cast("long"), draws - rest), F.least(good, draws)
    steps = F.sequence(low, high)
    ratio = lambda k: F.log(((good - k) * (draws - k)).cast("double")) - F.log(((k + 1) * (rest - draws + k + 1)).cast("double"))
    # one pass: the greatest logarithm so far, and the terms' sum relative to it
    scan = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum")),
        lambda s, k: F.struct(
            F.when(k >= high, s["at"]).otherwise(s["at"] + ratio(k)).alias("at"),
            F.greatest(s["top"], s["at"]).alias("top"),
            (s["sum"] * F.exp(s["top"] - F.greatest(s["top"], s["at"])) + F.exp(s["at"] - F.greatest(s["top"], s["at"]))).alias("sum"),
        ),
    )

    def count(both: Column) -> Column:
        # a second pass counts the terms before the chance is used up
        return F.aggregate(
            steps,
            F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
            lambda s, k: F.struct(
                F.when(k >= high, s["at"]).otherwise(s["at"] + ratio(k)).alias("at"),
                (s["sum"] + F.exp(s["at"] - both["top"])).alias("sum"),
                (s["n"] + F.when(s["sum"] + F.exp(s["at"] - both["top"]) < chance * both["sum"], 1).otherwise(0)).cast("long").alias("n"),
            ),
            lambda s: s["n"],
        )

    return F.least(high, low + F.transform(F.array(scan), count)[0])


def levels_for(words_: int) -> int:
    """Levels of the tree, so that a shard has about SHARD words."""
    levels = LEVELS
    while SHARD << levels < words_:
        levels += 1
    return levels


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def _spread(held: Column, draws: Column, *chance: object) -> Column:
    """How the draws fall on the parts (key, n) of an array: part by part, each a hypergeometric draw given those before it."""

    def draw(s: Column, x: Column) -> Column:
        good = _hypergeometric(_chance(*chance, x["key"]), x["n"], s["all"] - x["n"], s["draws"])
        return F.struct((s["all"] - x["n"]).alias("all"), (s["draws"] - good).alias("draws"), F.concat(s["out"], F.array(F.struct(x["key"].alias("key"), good.alias("n")))).alias("out"))

    begin = F.struct(_total(held).alias("all"), draws.alias("draws"), F.filter(held, lambda x: F.lit(False)).alias("out"))
    return F.aggregate(held, begin, draw, lambda s: s["out"])


def shards(blocks: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(source, shard, first, draws): the draws first .. first + draws - 1 of the source's random order go to the shard.

    blocks is what plan() returns. A node of the tree is one row for each group of at most SOURCES sources that it has
    draws of; a row holds those sources' counts, and the groups' counts of one node come together in one row of their own.
    """
    whole, part = _passes()
    uses = blocks.withColumn("uses", whole + F.when(F.col("begin") < part, 1).otherwise(0))
    counts = placed(uses.groupBy("source").agg(F.sum("uses").alias("n")).where("n > 0"), [F.col("source").asc_nulls_last()], {})
    node = counts.groupBy(F.floor(F.col("place") / SOURCES).cast("int").alias("group"))
    node = settle(node.agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("key"), "n"))).alias("held")).select(F.lit(0).alias("shard"), "group", "held"))
    for level in range(levels):
        groups = node.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("group").alias("key"), _total(F.col("held")).alias("n")))).alias("groups"))
        given = groups.select(F.col("shard").alias("s"), F.inline(_spread(F.col("groups"), F.floor(_total(F.col("groups")) / 2), F.col("shard"), seed + level, "group"))).withColumnRenamed("n", "draws")
        pair = node.join(given, (F.col("shard") == F.col("s")) & (F.col("group") == F.col("key")))
        pair = pair.select("shard", "group", "held", _spread(F.col("held"), F.col("draws"), F.col("shard"), seed + level).alias("left"))
        right = F.zip_with("held", "left", lambda h, x: F.struct(h["key"].alias("key"), (h["n"] - x["n"]).alias("n")))
        some = lambda xs: F.filter(xs, lambda x: x["n"] > 0)
        both = F.array(F.struct((F.col("shard") * 2).alias("shard"), "group", some(F.col("left")).alias("held")), F.struct((F.col("shard") * 2 + 1).alias("shard"), "group", some(right).alias("held")))
        node = settle(pair.select(F.explode(both).alias("x")).select("x.*").where(F.size("held") > 0))
    flat = node.select("shard", F.inline("held")).withColumnRenamed("key", "source")
    before = placed(flat, [F.col("source").asc_nulls_last(), F.col("shard")], {"before": F.col("n")})
    firsts = before.groupBy(F.col("source").alias("s")).agg(F.min("before").alias("b0"))
    return before.join(firsts, _same(F.col("source"), F.col("s"))).select("source", "shard", (F.col("before") - F.col("b0")).alias("first"), F.col("n").alias("draws"))


def _draws(sized: DataFrame, seed: int, levels: int | None, **how: object) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and (row, shard, place, pass, words) for each row each time a shard takes it."""
    per, blocks = plan(sized, seed, **how)
    if levels is None:
        levels = levels_for(int(per.agg(F.sum("target")).first()[0] or 0))
    cuts = shards(blocks, levels, seed)
    whole, part = _passes()
    used = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), whole))).where((F.col("pass") < whole) | (F.col("begin") < part))
    used = used.withColumn("draw", F.col("pass") * F.col("used") + F.col("rank"))
    # the last pass uses the blocks that begin before its words end: the first ones, so draws are numbered without a gap
    used = used.withColumn("some", F.when(F.col("pass") < whole, F.col("words")).otherwise(F.least("words", part - F.col("begin"))))
    used = used.withColumn("range", F.floor(F.col("draw") / RANGE))
    # a shard's stretch of draws meets the draws by the ranges that it reaches into
    reach = F.sequence(F.floor(F.col("first") / RANGE), F.floor((F.col("first") + F.col("draws") - 1) / RANGE))
    cuts = cuts.select(F.col("source").alias("s"), "shard", "first", "draws", F.explode(reach).alias("r"))
    inside = (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("draws"))
    dealt = used.join(cuts, _same(F.col("source"), F.col("s")) & (F.col("range") == F.col("r")) & inside)
    dealt = settle(dealt.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "shard", "some"))
    about = per.select(F.col("source").alias("t"), "blocks")
    rows = sized.join(about, _same(F.col("source"), F.col("t"))).withColumn("block", _block(seed))
    rows = rows.join(dealt, _same(F.col("source"), F.col("s")) & (F.col("block") == F.col("b")))
    within = Window.partitionBy("source", "block", "pass").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed + 2)), "doc_id", "row")
    end = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("some") - (end - F.col("size")))))
    place = F.xxhash64("doc_id", "mark", "pass", "shard", F.lit(seed + 3))
    return per, rows.where("words > 0").select("row", "doc_id", "source", "shard", place.alias("place"), "pass", "words")


def mix(docs: DataFrame, seed: int = SEED, levels: int | None = None) -> DataFrame:
    """The mix itself: (shard, place, doc_id, source, pass, words) for each row of docs each time a shard takes it.

    place orders a shard's rows (a hash: sort by it within the shard); words is how many of the row's words that take
    counts. A block that two passes use is two draws.
    """
    return _draws(sizes(docs), seed, levels)[1].select("shard", "place", "doc_id", "source", "pass", "words")


def taken(sized: DataFrame, seed: int = SEED, levels: int | None = None, **how: object) -> DataFrame:
    """(row, doc_id, size, mark, source, source_size, target, taken, draws) for each row of sizes(): the draws that shards take it by, added up."""
    per, draws = _draws(sized, seed, levels, **how)
    sums = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "place", "words"))).alias("draws"))  # one a pass
    about = per.select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.join(sums, "row", "left").join(about, _same(F.col("source"), F.col("s")))
    return rows.select("row", "doc_id", "size", "mark", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "draws")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, draws) for each row of docs; draws: where in which shards it stands, as JSON, null if nowhere."""
    return taken(sizes(docs), seed).select("doc_id", "size", "source_size", "target", "taken", F.to_json("draws").alias("draws"))


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all columns, as often as the mix takes them; a pass that takes half a row or more takes it whole.

    Rows that share id, source and text share what the mix takes of them.
    """
    each = taken(sizes(docs), seed).groupBy("doc_id", "source", "size", "mark").agg((F.sum("taken") / F.count("*")).alias("taken")).where("size > 0")
    times = each.select(F.struct("doc_id", "source", "mark").alias("key"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("mark")).alias("key"))
    return rows.join(times, "key").select("kept", F.explode(F.sequence(F.lit(1), "times"))).select("kept.*")
