"""Registry, prompts, monitoring and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import stripped


def filter_values(documents: DataFrame, by: str, levels: list[str]) -> DataFrame:
    """The distinct values of each filter level that aren't empty, sorted, in one pass."""
    each = F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("value")) for x in levels])
    pairs = documents.select(by, F.explode(each).alias("pair")).select(by, "pair.*").filter(F.coalesce("value", F.lit("")) != "").distinct()
    return pairs.groupBy(by, "level").agg(F.array_sort(F.collect_list("value")).alias("values"))


def filter_combinations(documents: DataFrame, levels: list[str]) -> DataFrame:
    return documents.select(*levels).distinct()


def version_parts(version: Column) -> Column:
    """A version as numbers, so that 10.0.0 comes after 9.0.0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def latest(rows: DataFrame, by: list[str], version: Column, *ties: Column) -> DataFrame:
    """The row with the highest version of each group."""
    best = Window.partitionBy(*by).orderBy(version.desc(), *ties)
    return rows.withColumn("at", F.row_number().over(best)).filter("at = 1").drop("at")


def monitor_runs(log: DataFrame, most: int | None = None) -> DataFrame:
    """One row per run: start, total duration, the query; newest first. log: run_uuid, stage_start_time, duration_ms, custom_metadata (JSON)."""
    runs = log.groupBy("run_uuid").agg(F.min("stage_start_time").alias("started"), F.sum("duration_ms").alias("duration_ms"), F.max(F.get_json_object("custom_metadata", "$.user_query")).alias("user_query"), F.count("*").alias("stages"))
    runs = runs.orderBy(F.desc("started"), "run_uuid")
    return runs if most is None else runs.limit(most)


def run_detail(log: DataFrame, run: object) -> DataFrame:
    return log.filter(F.col("run_uuid") == F.lit(run))


def stage_totals(log: DataFrame) -> DataFrame:
    """Calls, duration and the share of errors by stage."""
    return log.groupBy("stage_name").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("longest_ms"))


def preview(rows: DataFrame, key: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a table in the order of its key; limit is held within 1 and 200."""
    return rows.orderBy(*key).offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def history(messages: DataFrame, most: int, by: str = "conv_id") -> DataFrame:
    """The last messages of users and assistants with a text, most of them per conversation; dropped says how many were left out, had_system whether a system message was."""
    real = messages.withColumn("usable", F.col("role").isin("user", "assistant") & (stripped(F.coalesce("text", F.lit(""))) != ""))
    counts = real.groupBy(by).agg(F.count_if(F.col("usable")).alias("usable_count"), F.count("*").alias("all_count"), F.coalesce(F.bool_or(F.col("role") == "system"), F.lit(False)).alias("had_system"))
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("turn")))
    kept = real.filter("usable").withColumn("last", last).filter(F.col("last") <= most)
    joined = kept.join(counts, by)
    return joined.select(by, "turn", "role", "text", (F.col("all_count") - F.least(F.col("usable_count"), F.lit(most))).alias("dropped"), "had_system")


def conversation_text(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Each conversation as `[ROLE]: text` paragraphs in the order of turns."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy(by).agg(F.array_join(ordered["line"], "\n\n").alias("conversation"))


def table_pages(tables: dict[str, DataFrame], keys: dict[str, list[str]], limit: int, offset: int = 0) -> DataFrame:
    """table_name, row_count, columns and rows: for each table its size, its column names, and a page of its rows as JSON in the order of its key."""
    made = []
    for name, rows in tables.items():
        page = preview(rows, keys[name], limit, offset).select(F.struct(*keys[name]).alias("key"), F.to_json(F.struct("*")).alias("row"))
        page = page.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "row"))), lambda x: x["row"]).alias("rows"))
        counts = rows.agg(F.count("*").alias("row_count"))
        made.append(counts.crossJoin(page).select(F.lit(name).alias("table_name"), "row_count", F.lit(",".join(rows.columns)).alias("columns"), "rows"))  # one row each
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    return found


def usage_totals(calls: DataFrame, by: list[str], input_price: float, output_price: float) -> DataFrame:
    """Tokens and their cost, at prices for a thousand, by group. calls: by..., input_tokens, output_tokens."""
    cost = F.col("input_tokens") / 1000 * input_price + F.col("output_tokens") / 1000 * output_price
    return calls.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost"))


def custom_metadata(details: Column, reserved: list[str]) -> Column:
    """A stage's details (a map) without the reserved keys, as JSON."""
    return F.to_json(F.map_filter(details, lambda k, v: ~k.isin(*reserved)))


def flag(text: Column) -> Column:
    """Whether a text says true, 1 or yes."""
    return F.coalesce(F.lower(stripped(text)).isin("true", "1", "yes"), F.lit(False))

