"""Chat formatting by quotation linking. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.skew import row_numbers
from spanloom.llm.common import read_table, stored

#: Fixed patterns. Quoted lines begin with one or more >, blanks between them. Quantifiers are possessive, so long
#: passages are matched without deep recursion.
_MARK_BLANKS = r"(?m)(?:^|(?<=>))[ \t]++(?=>)"
_PASSAGE = r"(?m)^(>++)[^\n]*+(?:\n\1(?!>)[^\n]*+)*+"
_QUOTED_LINES = r"(?m)^[ \t]*+>[^\n]*+(?:\n|\z)"
_ATTRIBUTION = r"(?m)^[^\n]*wrote:[ \t]*+\n(?=[ \t]*+>)"
_PARAGRAPHS = r"\n[ \t]*+(?:\n[ \t]*+)*+"
#: Turns numbered together when a conversation is put in order.
TURNS = 64


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s++", " "))


def _parts(text: Column) -> Column:
    """The whole text, its paragraphs and its lines, normalised, each once, without empty ones."""
    pieces = F.concat(F.array(text), F.split(text, _PARAGRAPHS + "(?=\\S)"), F.split(text, "\n"))
    return F.array_distinct(F.filter(F.transform(pieces, normalised), lambda x: x != ""))


def parse_messages(conversations: DataFrame) -> DataFrame:
    """One row per distinct message: (id, place, conv_id, turn, role, copies, own, passages).

    ``own`` is the text without quoted lines and the line announcing them; ``passages`` are runs of lines of one quote
    level, with their markers. Place orders messages: by conversation, turn, then a digest of role and text.
    """
    columns = ["conv_id", "turn", "role", "text"]
    distinct = conversations.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    digest = F.md5(F.to_json(F.struct("role", "text")))
    own = F.btrim(F.regexp_replace(F.regexp_replace(text, _ATTRIBUTION, ""), _QUOTED_LINES, ""), F.lit(" \t\n"))
    marked = F.regexp_replace(text, _MARK_BLANKS, "")
    passages = F.when(F.contains(text, F.lit(">")), F.regexp_extract_all(marked, F.lit(_PASSAGE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    place = F.struct("conv_id", "turn", digest.alias("digest"))
    return distinct.select(F.md5(F.to_json(place)).alias("id"), place.alias("place"), "conv_id", "turn", "role", "copies", own.alias("own"), passages.alias("passages"))


def quotes_of(messages: DataFrame) -> DataFrame:
    """(id, place, conv_id, level, weight, hash) of each quoted passage and of its paragraphs and lines."""
    quoted = messages.where(F.size("passages") > 0).select("id", "place", "conv_id", F.explode("passages").alias("passage"))
    level = F.length(F.regexp_extract("passage", "^(>++)", 1))
    quoted = quoted.select("id", "place", "conv_id", level.alias("level"), F.explode(_parts(F.regexp_replace("passage", r"(?m)^>++[ \t]*+", ""))).alias("part"))
    return quoted.select("id", "place", "conv_id", "level", F.length("part").alias("weight"), F.md5("part").alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """(id, parent, parent_place) of messages that quote an earlier one.

    A passage is looked for among the own words of messages, as a whole, by paragraph and by line: first in its own
    conversation, else anywhere. Of several messages with the same words the first one wrote them. The parent is the
    message behind the outermost quotes, by their length.
    """
    quotes = stored(quotes_of(messages), "quotes")
    wanted = quotes.select("hash").distinct()
    original = messages.select("id", "place", "conv_id", F.explode(_parts(F.col("own"))).alias("part"))
    original = original.select("id", "place", "conv_id", F.md5("part").alias("hash")).join(wanted, "hash", "left_semi")
    near = original.groupBy("hash", "conv_id").agg(F.min(F.struct("place", "id")).alias("near"))
    near = stored(near, "originals")
    far = near.groupBy("hash").agg(F.min("near").alias("far"))
    found = quotes.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    earlier = [F.when(F.col(c)["place"] < F.col("place"), F.col(c)) for c in ("near", "far")]
    found = found.withColumn("source", F.coalesce(*earlier)).where("source is not null")
    votes = found.groupBy("id", "level", "source").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy("id").agg(F.min_by("source", F.struct("level", -F.col("weight"), "source")).alias("source"))
    return best.select("id", F.col("source")["id"].alias("parent"), F.col("source")["place"].alias("parent_place"))


def threads(found: DataFrame) -> DataFrame:
    """(id, root, root_place, depth) by pointer doubling; parents stand earlier, so there are no cycles."""
    state = stored(found.select("id", F.col("parent").alias("root"), F.col("parent_place").alias("root_place"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("__root"), F.col("root_place").alias("__place"), F.col("depth").alias("__depth"))
        after = state.join(up, "root", "left")
        after = stored(after.select("id", F.coalesce("__root", "root").alias("root"), F.when(F.col("__root").isNotNull(), F.col("__place")).otherwise(F.col("root_place")).alias("root_place"),
                                    (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.col("__root").isNotNull().alias("moved")), "threads")
        state = after.drop("moved")
        if not after.where("moved").take(1):
            return state


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Messages without their quotes, in reply order within the conversation of the message their thread begins with.

    One row per distinct message with its number of ``copies``. position counts from 1: threads by their first turn,
    then by depth, so that an answer follows what it answers. A message that quotes nothing known begins a thread of
    its own. NULL texts are empty; NULL conversations form one; NULL turns sort first. Equal turns are told apart by a
    digest of role and text. Other columns are ignored; an empty table gives an empty result.
    """
    messages = stored(parse_messages(conversations.select("conv_id", "turn", "role", "text")), "messages")
    found = stored(links(messages), "links")
    roots = threads(found).drop("root")
    rows = messages.join(found, "id", "left").join(roots, "id", "left")
    begin = F.when(F.col("depth").isNull(), F.col("place")).otherwise(F.col("root_place"))
    rows = rows.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "copies", F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: F.length(F.regexp_extract(p, "^(>++)", 1)))), F.lit(0)).cast("long").alias("max_level"),
        F.col("parent_place")["conv_id"].alias("parent_conv"), F.col("parent_place")["turn"].alias("parent_turn"),
        begin["conv_id"].alias("thread_conv"), begin["turn"].alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce(begin["conv_id"].cast("string"), F.lit("")).alias("__key"), F.coalesce(begin["turn"], F.lit(-(1 << 40))).cast("long").alias("__turn"), "place", begin["digest"].alias("__digest"))
    rows = row_numbers(rows, ["__key"], ["__turn", "__digest", "depth", "place"], "position", chunk=F.floor(F.col("__turn") / TURNS))
    return rows.select("thread_conv", "position", "thread_turn", "depth", "conv_id", "turn", "role", "text", "copies", "n_quotes", "max_level", "parent_conv", "parent_turn")


def op9_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(read_table(spark, sf_dir, "conversations"))
