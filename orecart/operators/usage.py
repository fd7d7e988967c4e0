"""Token usage of sessions: totals, early and late averages, waste, spike and sparkline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orecart.functions.text import format_tokens, short_id

GLYPHS = "▁▂▃▄▅▆▇█"
# Colours of a terminal, and the ratios from which a turn or a session has one.
RED, YELLOW, PLAIN = "\x1b[31m", "\x1b[33m", "\x1b[0m"
RED_FROM, YELLOW_FROM, ALARM_FROM = 5.0, 2.5, 10.0
FIELDS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
SCHEMA = "type string, message struct<usage: struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">>"


def turns(lines: DataFrame) -> DataFrame:
    """(session_id, turn_no, tokens) from JSON lines (session_id, line_no, line); unreadable lines and empty turns go."""
    j = F.from_json("line", SCHEMA)
    usage = F.col("j.message.usage")
    total = sum((F.coalesce(usage[f], F.lit(0)) for f in FIELDS), F.lit(0))
    kept = lines.withColumn("j", j).filter((F.col("j.type") == "assistant") & usage.isNotNull()).select("session_id", "line_no", total.cast("long").alias("tokens")).filter("tokens > 0")
    return kept.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")).cast("long").alias("turn_no"), "tokens")


def sessions(t: DataFrame) -> DataFrame:
    """One row a session: turns, total, baseline (first 5), latest (last 3), waste = latest / baseline and its label."""
    last = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    g = t.withColumn("back", last - F.col("turn_no")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum("tokens").alias("total"),
        F.avg(F.when(F.col("turn_no") <= 5, F.col("tokens"))).alias("baseline"),
        F.avg(F.when(F.col("back") < 3, F.col("tokens"))).alias("latest"),
    )
    g = g.withColumn("waste", F.when(F.col("baseline") > 0, F.col("latest") / F.col("baseline")).otherwise(1.0))
    whole, tenths = F.format_string("%.0fx", F.bround("waste", 0)), F.format_string("%.1fx", F.bround("waste", 1))
    label = F.when(F.col("waste") >= ALARM_FROM, F.concat(whole, F.lit(" !!!"))).when(F.col("waste") >= RED_FROM, F.concat(whole, F.lit(" !"))).otherwise(tenths)
    colour = F.when(F.col("waste") >= RED_FROM, RED).when(F.col("waste") >= YELLOW_FROM, YELLOW)
    return g.withColumns({"label": label, "colour": colour, "total_text": format_tokens(F.col("total"))})


def spikes(t: DataFrame) -> DataFrame:
    """The largest turn after the fifth of each session; the last wins ties."""
    return t.filter("turn_no > 5").groupBy("session_id").agg(F.max(F.struct("tokens", "turn_no")).alias("m")).select("session_id", F.col("m.turn_no").alias("turn_no"), F.col("m.tokens").alias("tokens"))


def sparklines(t: DataFrame, colour: bool = False) -> DataFrame:
    """A bar of eight heights a turn, scaled to the session's largest; in colour, turns after the fifth stand out that are many times the
    mean of the first five."""
    whole = Window.partitionBy("session_id")
    glyph = F.element_at(F.array(*map(F.lit, GLYPHS)), (F.floor(F.col("tokens") / F.max("tokens").over(whole) * 7 + 0.5) + 1).cast("int"))
    if colour:
        ratio = F.col("tokens") / F.avg(F.when(F.col("turn_no") <= 5, F.col("tokens"))).over(whole)
        mark = F.when(F.col("turn_no") <= 5, F.lit(None)).when(ratio >= RED_FROM, RED).when(ratio >= YELLOW_FROM, YELLOW)
        glyph = F.when(mark.isNull(), glyph).otherwise(F.concat(mark, glyph, F.lit(PLAIN)))
    g = t.withColumn("g", glyph).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "g"))).alias("x"))
    return g.select("session_id", F.array_join(F.transform("x", lambda s: s["g"]), "").alias("bar"))


def latest(files: DataFrame, n: int = 5) -> DataFrame:
    """The n sessions (session_id, modified) that changed last; ties by id. Sessions without turns are among them and drop out later."""
    return files.groupBy("session_id").agg(F.max("modified").alias("modified")).orderBy(F.desc("modified"), "session_id").limit(n)


def padded(text, width: int):
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def report(t: DataFrame, recent: DataFrame) -> DataFrame:
    """(session_id, modified, row): a line of the usage table for each recent session that has turns."""
    g = sessions(t.join(F.broadcast(recent), "session_id", "left_semi")).join(sparklines(t, colour=True), "session_id").join(F.broadcast(recent), "session_id")
    waste = F.when(F.col("colour").isNull(), padded(F.col("label"), 10)).otherwise(padded(F.concat("colour", "label", F.lit(PLAIN)), 27))
    columns = [
        padded(short_id(F.col("session_id").cast("string"), 14), 14),
        padded(F.col("n_turns").cast("string"), 8),
        padded(format_tokens(F.floor("baseline")), 12),
        padded(format_tokens(F.floor("latest")), 12),
        waste,
        padded(F.col("total_text"), 10),
        F.col("bar"),
    ]
    return g.select("session_id", "modified", F.concat_ws(" ", *columns).alias("row"))


HEADER = "SESSION        TURNS    BASELINE     LATEST       WASTE      TOTAL      GROWTH"


def biggest_spike(t: DataFrame, recent: DataFrame) -> DataFrame:
    """(session_id, turn_no, tokens, line) of the most recent session that has turns; none if it has no more than five."""
    seen = t.select("session_id").distinct().join(F.broadcast(recent), "session_id").orderBy(F.desc("modified"), "session_id").limit(1).select("session_id")
    own = t.join(F.broadcast(seen), "session_id")
    base = own.groupBy("session_id").agg(F.avg(F.when(F.col("turn_no") <= 5, F.col("tokens"))).alias("baseline"))
    ratio = F.bround(F.col("tokens") / F.col("baseline"), 1)
    line = F.format_string("Biggest spike (most recent session): turn %d — %s (%.1fx baseline)", "turn_no", format_tokens(F.col("tokens")), ratio)
    return spikes(own).join(base, "session_id").select("session_id", "turn_no", "tokens", line.alias("line"))
