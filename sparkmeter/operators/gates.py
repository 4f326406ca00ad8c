"""Checks on generated text, and plans for a local model: numbers, quotes, names, index packing, time estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digit_runs

# Tokens a second of prefill and decode by a part of the processor's name; the first that fits, else SLOW.
CHIPS: tuple[tuple[str, float, float], ...] = (
    ("M1 Max", 250.0, 40.0),
    ("M1 Pro", 170.0, 20.0),
    ("M2 Max", 250.0, 35.0),
    ("M2 Pro", 170.0, 20.0),
    ("M3 Max", 300.0, 38.0),
    ("M3 Pro", 190.0, 22.0),
    ("M4 Max", 420.0, 35.0),
    ("M4 Pro", 210.0, 25.0),
    ("M5", 350.0, 45.0),
    ("M4", 105.0, 15.0),
    ("M3", 100.0, 14.0),
    ("M2", 85.0, 12.0),
    ("M1", 110.0, 12.0),
)
SLOW = (85.0, 12.0)
SMALL = 10


def number_violations(output: Column, source: Column) -> Column:
    """Runs of digits in the output that are not in the source and are neither up to ten nor a hundred."""
    plain = lambda x: F.length(F.regexp_replace(x, "^0+(?=[0-9])", "")) <= 2
    allowed = lambda x: plain(x) & (F.regexp_replace(x, "^0+(?=[0-9])", "").cast("int") <= SMALL) | (x == "100")
    return F.filter(F.array_except(digit_runs(output), digit_runs(source)), lambda x: ~F.coalesce(allowed(x), F.lit(False)))


def grounded(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings (server, tool, quote) whose server and tool are in the index and whose quote stands in that tool's text."""
    known = index.select(F.col("server").alias("_s"), F.col("name").alias("_t"), F.col("description").alias("_d"))
    hit = (F.col("server") == F.col("_s")) & (F.col("tool") == F.col("_t")) & (F.instr("_d", F.col("quote")) > 0)
    return findings.join(known, hit, "left_semi")


def index_lines(tools: DataFrame, words: int = 25) -> DataFrame:
    """Per server one text of lines 'server :: tool :: first words', tools by name; and its size at four bytes a token."""
    short = F.array_join(F.slice(F.split(F.trim("description"), r"\s+"), 1, words), " ")
    lines = tools.select("server", "name", F.concat_ws(" :: ", "server", "name", short).alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("server").agg(text.alias("block")).withColumn("tokens", F.floor(F.octet_length("block") / 4))


def packed_index(blocks: DataFrame, budget: int) -> DataFrame:
    """Servers, by name, whose block still fits what is left; the first always goes in, a later smaller one still may.

    What is left depends on the order, so it is folded over one array of names and sizes: one row a server.
    """
    order = F.sort_array(F.collect_list(F.struct("server", "tokens")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names"))
    fold = lambda s, x: F.when((F.size(s["names"]) == 0) | (s["used"] + x["tokens"] <= budget), F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["names"], F.array(x["server"])).alias("names"))).otherwise(s)
    chosen = blocks.agg(F.aggregate(order, zero, fold).alias("p")).select(F.explode("p.names").alias("server"))
    return blocks.join(chosen, "server", "left_semi")


def eta_seconds(chip: Column, prompt: Column, answer: Column) -> Column:
    """Whole seconds to read a prompt and write an answer on a chip."""
    rate = lambda k: F.coalesce(*[F.when(F.instr(chip, row[0]) > 0, F.lit(row[k])) for row in CHIPS], F.lit(SLOW[k - 1]))
    return F.ceil(prompt / rate(1) + answer / rate(2))


def model_for(ram_gb: Column) -> Column:
    """Size of a local model for so much memory."""
    return F.when(ram_gb >= 48, "32b").when(ram_gb >= 32, "14b").when(ram_gb >= 16, "8b").when(ram_gb >= 8, "4b").otherwise("none")


def skills_plan(files: DataFrame, most: int) -> DataFrame:
    """Distinct paths that end in SKILL.md, in order, up to so many; with the number left out."""
    rows = files.where(F.col("path").endswith("SKILL.md")).select("path").distinct()
    count = rows.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("path"))
    return rows.orderBy("path").limit(most).withColumn("place", place).join(F.broadcast(count)).select("place", "path", F.greatest(F.lit(0), F.col("n") - most).alias("capped"))


def answers_match(given: Column, accepted: Column) -> Column:
    """Whether an answer is or contains one of the accepted, case and white space aside."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.exists(accepted, lambda a: (norm(given) == norm(a)) | (F.instr(norm(given), norm(a)) > 0))
