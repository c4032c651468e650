"""Quotation linking: quoted passages lead to the messages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, let, salted_join, stored, table

_MARK = r"^(?:[ \t]*>)+"
#: A line that only announces the quote below it, by how it begins and what it says. (Fixed values.)
_ANNOUNCE = r"(?i)^\s*(?:(?:On|Am|Le|El|Em|Il|Op)\b.*|.*\b)(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe|escreveu|ha scritto|schreef).*:\s*$"
#: A passage that is quoted whole counts so much more than a line of it.
_WHOLE = 1000


def _lines(text: Column) -> Column:
    """Array of (level, body) of a message's lines; level 0 is the sender's own text."""

    def line(x: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 0), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(x, _MARK + " ?", "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), line)


def _own_text(lines: Column) -> Column:
    """The lines of level 0 without those that announce a quote, trimmed."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(_ANNOUNCE) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _runs(lines: Column) -> Column:
    """Array of (level, text) of runs of lines of one level."""

    def piece(x: Column, i: Column) -> Column:
        before = F.get(lines, F.greatest(i - 1, F.lit(0)))["level"]
        head = F.when((i == 0) | (before != x["level"]), F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))).otherwise(F.lit(""))
        return F.concat(head, F.translate(x["body"], "\x01\x02", ""), F.lit("\n"))

    runs = F.filter(F.split(F.array_join(F.transform(lines, piece), ""), "\x01"), lambda x: x != "")
    return F.transform(runs, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("body")))


def _passages(lines: Column, quoted: bool) -> Column:
    """Array of (level, hash, weight): runs and single lines, and the whole own text."""
    wanted = (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0)

    def hashed(weight: int):
        return lambda x: F.struct(x["level"].cast("int").alias("level"), F.md5(_normal(x["body"])).alias("hash"), F.lit(weight).alias("weight"))

    some = lambda a: F.filter(F.filter(a, wanted), lambda x: _normal(x["body"]) != "")
    parts = [F.transform(some(_runs(lines)), hashed(_WHOLE)), F.transform(some(lines), hashed(1))]
    if not quoted:
        parts.append(F.transform(some(F.array(F.struct(F.lit(0).alias("level"), _own_text(lines).alias("body")))), hashed(_WHOLE)))
    return F.concat(*parts)


def links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row (conv, turn, reply_to) for each message that quotes an earlier one of its conversation.

    A passage belongs to the first message of the conversation that has it as
    own text. The lowest quote level that leads anywhere decides; then the
    message of which most is quoted, whole passages first; then the latest.
    """
    m = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{text_col}`").alias("text")).where("conv is not null and turn is not null and text is not null")
    of = lambda df, quoted: df.select("conv", "turn", F.explode(let(_lines(F.col("text")), lambda x: _passages(x, quoted))).alias("p")).select("conv", "turn", "p.*")
    quoting = m.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    # Only conversations with a quote have their own texts hashed.
    first = of(m.join(quoting.select("conv").distinct(), "conv", "left_semi"), False).groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    quotes = of(quoting, True).groupBy("conv", "turn", "level", "hash").agg(F.max("weight").alias("weight"))
    found = quotes.join(first, ["conv", "hash"]).where("origin < turn").groupBy("conv", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    return found.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "weight", "origin")).alias("reply_to"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``n``, their place in the order of ``keys`` (a unique one), from 0.

    Rows are dealt out by ranges of the order, which split a key of any
    size, and counted by range: no key's rows have to meet in one task.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = stored(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordered")
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    first, bases = 0, []
    for part, n in sizes:
        bases.append((part, first))
        first += n
    if not bases:
        return held.select(*rows.columns, F.lit(0).cast("long").alias("n"))
    before = F.element_at(F.create_map(*(F.lit(x) for pair in bases for x in pair)), F.col("_part")).cast("long")
    return held.select(*rows.columns, (before + F.col("_at")).alias("n"))


def _threads(edges: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth, after) of each message in a chain of replies.

    thread is the turn at the start of the chain, depth the replies between
    the two, and ``after`` the messages of the thread from this one on, in the order
    in which each message is followed by its replies, earlier ones first. A
    walk around the tree of replies enters and leaves each message once; its
    steps find their ends by doubling (in rounds that grow with the
    logarithm of the thread), which sums up what lies between.
    """
    edges = stored(edges, "replies")
    children = _numbered(edges.select("conv", "reply_to", "turn"), ["conv", "reply_to", "turn"])
    eldest = children.groupBy("conv", "reply_to").agg(F.min("turn").alias("child"))
    younger = children.select("conv", "reply_to", F.col("turn").alias("next"), (F.col("n") - 1).alias("n"))
    siblings = children.join(younger, ["conv", "reply_to", "n"], "left").select("conv", "turn", "reply_to", "next")
    nodes = edges.select("conv", "turn").union(edges.select("conv", F.col("reply_to").alias("turn"))).distinct()
    at = lambda turn, enters: F.when(turn.isNotNull(), F.struct(turn.alias("turn"), enters.alias("enters")))
    true, false = F.lit(True), F.lit(False)
    enter = nodes.join(eldest.withColumnRenamed("reply_to", "turn"), ["conv", "turn"], "left").select("conv", at(F.col("turn"), true).alias("step"), F.coalesce(at(F.col("child"), true), at(F.col("turn"), false)).alias("to"))
    leave = nodes.join(siblings, ["conv", "turn"], "left").select("conv", at(F.col("turn"), false).alias("step"), F.coalesce(at(F.col("next"), true), at(F.col("reply_to"), false)).alias("to"))
    rounds = Rounds(edges.sparkSession, "walk")
    walk = rounds.put(enter.union(leave).select("conv", "step", "to", F.col("step.turn").alias("thread"), F.col("step.enters").cast("long").alias("after"), F.when(F.col("step.enters"), -1).otherwise(1).cast("long").alias("depth")))
    while not walk.where("to is not null").isEmpty():
        on = walk.select("conv", F.col("step").alias("to"), F.col("to").alias("then"), F.col("thread").alias("end"), F.col("after").alias("more"), F.col("depth").alias("down"))
        none = F.lit(0).cast("long")
        walk = rounds.put(walk.join(on, ["conv", "to"], "left").select("conv", "step", F.col("then").alias("to"), F.coalesce("end", "thread").alias("thread"), (F.col("after") + F.coalesce("more", none)).alias("after"), (F.col("depth") + F.coalesce("down", none)).alias("depth")))
    return walk.where("step.enters").select("conv", F.col("step.turn").alias("turn"), "thread", "depth", "after")


def unquoted(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The messages without quotes and with their place in the conversation.

    One row an input row: conv_id, turn, role, text (own lines only),
    quote_levels (deepest level), reply_to (turn of the message quoted, else
    null), thread (turn of the message at the start of the chain of replies,
    its own if it replies to none), depth (replies between the two) and
    position (from 0 in its conversation: threads by their first message, in
    each a message, then its replies with all of theirs, earlier ones
    first). A null text is empty; very long texts and quotes are read whole;
    rows with a null conversation or turn link to nothing, and their position
    is null; repeated rows stay, get the same links and stand next to each
    other. Of messages with one turn the first passage found counts. Other
    columns of ``messages`` are left out. An empty table gives no rows.
    """
    base = messages.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    lines = _lines(F.col("text"))
    clean = base.select("conv_id", "turn", "role", let(lines, _own_text).alias("text"), let(lines, lambda x: F.array_max(F.transform(x, lambda y: y["level"]))).cast("int").alias("quote_levels"))
    replies = stored(links(messages, conv_col, turn_col, text_col), "links")
    if replies.isEmpty():
        placed = clean.withColumns({"reply_to": F.lit(None).cast(clean.schema["turn"].dataType), "thread": F.col("turn"), "depth": F.lit(0).cast("long"), "after": F.lit(None).cast("long")})
    else:
        trees = _threads(replies).join(replies, ["conv", "turn"], "left").withColumnRenamed("conv", "conv_id")
        placed = clean.join(trees, ["conv_id", "turn"], "left").select(*clean.columns, "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "after")
    order = [F.col("conv_id"), F.col("thread"), F.col("_back"), F.col("turn"), F.col("role"), F.col("text")]
    rows = _numbered(placed.withColumn("_back", -F.col("after")), order)
    first = rows.groupBy("conv_id").agg(F.min(F.when(F.col("turn").isNotNull(), F.col("n"))).alias("_first"))
    return salted_join(rows, first, "conv_id", how="left").select(*clean.columns, "reply_to", "thread", "depth", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("n") - F.col("_first")).alias("position"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unquoted(table(spark, sf_dir, "conversations"))


QUERIES = {"op5_chat_formatting": op5_chat_formatting}
SQL: dict[str, str] = {}
