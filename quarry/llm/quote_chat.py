"""Chat formatting with quotation linking. DataFrame functions only.

A line that begins with one or more ``>`` (spaces between them do not matter) is quoted, at the level of
their number. Neighbouring quoted lines of one level are a passage. Passages and the messages' own
(unquoted) parts are normalised, lower case with single spaces, and hashed. A passage is joined to the
original that has it as its whole own text, as a paragraph or as a line: the earliest such message of the
same conversation before the quoting one, else the earliest of all conversations before it (by conversation
id and turn). A passage without such an original is one of a part: its units, which are its lines, or the
sentences of its paragraphs, have to follow each other in an own text, and of the messages that hold them in
a row the earliest counts as above. A message replies to the original of its first linked passage of the lowest level; without
one it replies to none and keeps its place in its conversation. Threads are what reply links connect,
found by pointer doubling; messages are ordered by thread, depth of reply, conversation and turn.

Hashes are SHA-256, with the length beside them. Holders of a passage become one row a hash and conversation in each
task before they are joined, so a passage that everyone quotes or holds never meets all its holders. ``conversations``
has a row a message, in range-partitioned order; ``transcripts`` puts each conversation together, a long one in parts.

Cases: a null text is empty; an empty own text cannot be an original. Null roles are formatted as
``unknown``. Messages whose conversation or turn is null neither link nor are linked. Several messages
with the same conversation and turn stay rows of their own and share their links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import settled

_MARKS = r"^[ \t]*(>[ \t]*)+"


def _normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role and: own (text without quotes), passages array<struct<level, text>> in order.

    A run of quoted lines is cut out as one; its lines are split by level by marking each change.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    lines = F.split(F.col("__text"), "\n", -1)
    mark = lambda line: F.regexp_extract(line, _MARKS, 0)
    level = lambda line: F.length(F.regexp_replace(mark(line), r"[^>]", ""))
    leveled = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text")))
    base = messages.select("conv_id", "turn", "role", text.alias("__text"))
    quoted = F.col("__text").rlike(r"(?m)^[ \t]*>")
    rows = base.select("conv_id", "turn", "role", "__text", F.when(quoted, leveled).alias("lines"))
    own = F.when(F.col("lines").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n"))
    # where the level changes a passage begins: lines are joined with a mark of the level in front of each first line
    changes = F.transform(
        "lines", lambda x, i: F.concat(F.when((i == 0) | (F.get("lines", i - 1)["level"] != x["level"]), F.concat(F.lit("\u001e"), x["level"].cast("string"), F.lit("\u001f"))).otherwise(F.lit("\n")), F.regexp_replace(x["text"], "[\u001e\u001f]", " "))
    )
    runs = F.split(F.substring(F.array_join(changes, ""), 2, 2147483647), "\u001e", -1)
    passages = F.filter(F.transform(runs, lambda r: F.struct(F.substring_index(r, "\u001f", 1).cast("int").alias("level"), F.substring_index(r, "\u001f", -1).alias("text"))), lambda p: (p["level"] > 0) & (_normal(p["text"]) != ""))
    empty = F.expr("cast(array() as array<struct<level: int, text: string>>)")
    return rows.select("conv_id", "turn", "role", F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("own"), F.when(F.col("lines").isNull(), empty).otherwise(passages).alias("passages"))


def _units(text: Column) -> list[Column]:
    """The lines of a text, and the sentences of its paragraphs, normalised and without empty ones."""
    lines = F.transform(F.split(text, "\n"), _normal)
    sentences = F.flatten(F.transform(F.split(text, r"\n[ \t]*\n"), lambda x: F.split(_normal(x), r"(?<=[.!?\u2026]) |(?<=[\u3002\uff01\uff1f]) ?")))
    return [F.filter(x, lambda unit: unit != "") for x in (lines, sentences)]


def _run(units: Column) -> tuple[Column, Column]:
    whole = F.array_join(units, "\n")
    return F.sha2(whole, 256).alias("h"), F.length(whole).alias("n")


def _earliest(quotes: DataFrame, held: DataFrame) -> DataFrame:
    """(conv_id, turn, place, level, far, to) of quotes (.., h, n) whose (h, n) is in held (conv_id, turn, h, n) before them."""
    near = held.groupBy("h", "n", "conv_id").agg(F.min("turn").alias("near_turn"))
    far = held.groupBy("h", "n").agg(F.min(F.struct("conv_id", "turn")).alias("far"))
    both = quotes.join(near, ["h", "n", "conv_id"], "left").join(far, ["h", "n"], "left")
    here = F.col("near_turn") < F.col("turn")
    there = F.col("far") < F.struct("conv_id", "turn")
    to = F.when(here, F.struct("conv_id", F.col("near_turn").alias("turn"))).when(there, F.col("far"))
    return both.withColumn("to", to).filter("to is not null").select("conv_id", "turn", "place", "level", (~F.coalesce(here, F.lit(False))).alias("far"), "to")


def _in_part(rest: DataFrame, owners: DataFrame) -> DataFrame:
    """As _earliest, of passages (.., text) whose units follow each other in an own text of owners (conv_id, turn, own).

    Runs are built where the first unit of a wanted one stands, in the lengths wanted there; then one row a run is kept.
    """
    runs = rest.select("conv_id", "turn", "place", "level", F.explode(F.array(*_units(F.col("text")))).alias("units")).filter(F.size("units") > 0)
    runs = settled(runs.select("conv_id", "turn", "place", "level", F.xxhash64(F.get("units", F.lit(0))).alias("first"), F.size("units").alias("k"), *_run(F.col("units"))).distinct())
    firsts = runs.groupBy("first").agg(F.collect_set("k").alias("lengths"))
    whole = F.xxhash64("own").alias("whole")  # rows of one conversation and turn may differ
    each = owners.select("conv_id", "turn", whole, F.posexplode(F.array(*_units(F.col("own")))).alias("kind", "units"))
    each = each.select("conv_id", "turn", "whole", "kind", F.posexplode("units").alias("at", "unit")).select("conv_id", "turn", "whole", "kind", "at", F.xxhash64("unit").alias("first"))
    starts = each.join(firsts, "first").groupBy("conv_id", "turn", "whole", "kind").agg(F.collect_set(F.struct("at", "lengths")).alias("starts"))
    texts = owners.select("conv_id", "turn", whole, "own").distinct()
    units = F.get(F.array(*_units(F.col("own"))), F.col("kind"))
    there = starts.join(texts, ["conv_id", "turn", "whole"]).select("conv_id", "turn", units.alias("units"), "starts")
    fits = lambda s: F.filter(s["lengths"], lambda k: s["at"] + k <= F.size("units"))
    built = F.flatten(F.transform("starts", lambda s: F.transform(fits(s), lambda k: F.struct(*_run(F.slice("units", s["at"] + 1, k))))))
    parts = there.select("conv_id", "turn", F.explode(F.array_distinct(built)).alias("r")).select("conv_id", "turn", "r.h", "r.n")
    return _earliest(runs, parts.join(runs.select("h", "n").distinct(), ["h", "n"], "left_semi"))


def linked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, level, to_conv, to_turn) of every linked passage of parsed messages."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quotes = rows.filter(known & (F.size("passages") > 0)).select("conv_id", "turn", F.posexplode("passages").alias("place", "p"))
    quotes = settled(quotes.select("conv_id", "turn", "place", "p.level", "p.text", F.sha2(_normal(F.col("p.text")), 256).alias("h"), F.length(_normal(F.col("p.text"))).alias("n")))
    owners = rows.filter(known & (F.col("own") != "")).select("conv_id", "turn", "own")
    units = F.array_distinct(F.transform(F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")), _normal))
    parts = owners.select("conv_id", "turn", F.explode(units).alias("unit")).filter("unit <> ''")
    parts = parts.select("conv_id", "turn", F.sha2("unit", 256).alias("h"), F.length("unit").alias("n"))
    wanted = quotes.select("h", "n").distinct()
    names = ["conv_id", "turn", "place", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn")]
    found = _earliest(quotes.drop("text"), parts.groupBy("conv_id", "h", "n").agg(F.min("turn").alias("turn")).join(wanted, ["h", "n"], "left_semi"))
    links = settled(found.select(*names).distinct())
    rest = settled(quotes.join(links, ["conv_id", "turn", "place", "level"], "left_anti"))
    if not rest.limit(1).count():
        return links
    more = _in_part(rest, owners).groupBy("conv_id", "turn", "place", "level").agg(F.min(F.struct("far", "to")).alias("best"))
    return settled(links.union(more.select("conv_id", "turn", "place", "level", "best.to.conv_id", "best.to.turn")))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of replies (conv_id, turn, to_conv, to_turn); links point back, so there is no cycle."""
    up = settled(replies.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        far = up.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("d"))
        up = settled(
            up.join(far, ["root_conv", "root_turn"], "left").select(
                "conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("d").isNotNull().alias("moved")
            )
        )
        if not up.filter("moved").limit(1).count():
            return up.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, in order of thread and reply, without quotes.

    conv_id, turn, role, text, formatted, n_quotes, max_level, n_linked, reply_conv, reply_turn (null: none),
    thread_conv, thread_turn (the message at the thread's root: the message itself if it replies to none) and depth
    (replies from the root).
    """
    rows = parsed(messages)
    links = linked(rows)
    first = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "place", "to_conv", "to_turn")).alias("f"))
    replies = first.select("conv_id", "turn", F.col("f.to_conv").alias("to_conv"), F.col("f.to_turn").alias("to_turn"))
    tops = threads(replies).join(first.select("conv_id", "turn", "n_linked", F.col("f.to_conv").alias("reply_conv"), F.col("f.to_turn").alias("reply_turn")), ["conv_id", "turn"])
    out = rows.join(tops, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("unknown"))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("formatted"),
        F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max("passages.level"), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_conv",
        "reply_turn",
        F.coalesce("root_conv", "conv_id").alias("thread_conv"),
        F.coalesce("root_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    ).orderBy(*ORDER)


ORDER = ("thread_conv", "thread_turn", "depth", "conv_id", "turn")


def transcripts(messages: DataFrame) -> DataFrame:
    """(thread_conv, part, n_messages, text): the formatted messages of each conversation and of those that reply into it,
    thread by thread, replies after what they answer, without quotes.

    A part is what one range of the order holds of a conversation, so one of very many messages is never put together
    in one task; parts are numbered from 0 in order.
    """
    rows = conversations(messages).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    placed = settled(rows.select("thread_conv", "formatted", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")))
    parts = placed.groupBy("thread_conv", "range").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "formatted"))), lambda x: x["formatted"]), "").alias("text"))
    number = F.row_number().over(Window.partitionBy("thread_conv").orderBy("range")) - 1
    return parts.select("thread_conv", number.cast("long").alias("part"), "n_messages", "text")
