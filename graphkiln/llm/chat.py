"""Chat formatting by quotation linking.

Each message's lines are parsed into nested quote levels (leading ``>`` marks). Quoted passages (runs of one level), their
paragraphs, lines and sentences are normalised (lower case, letters and digits only) and hashed, and joined to the earliest
message of the conversation that has one of them as its text, paragraph, line or sentence. A message replies to the message
it quotes most directly (lowest level, then latest); without a known quote, to the message before it. Quotes and the lines
that introduce them are taken out. The conversation is then ordered by replies: a message, the messages that go on from it, then
branches that come back to earlier messages, those from later messages first; and it is built in that order.

Everything is DataFrame operations on rows of a bounded size. Conversations of any length stay spread: neighbours and running
numbers come from range sorts, a branch is its number and its parent's, and the branches' places come from their tour (down,
across, up) whose distances to its end are summed by pointer doubling. A built conversation is one row; only one of more than
``PART`` messages goes on in further rows.

Defined results: null text is empty text; a message with a null conversation or turn replies to none and is a conversation of
its own row; rows of one conversation that share a turn are one message for linking and stay rows of their own; quotes without
letters and digits, without an earlier original, or of a part of a sentence only, link to nothing but are still taken out;
the markers of the format are escaped in texts (a backslash more in ``<|``) and left out of roles; very long texts take time in
proportion to their length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.llm.common import attach, bounded_broadcast, discard, following, let, materialize, running, tidy, written

#: Messages in a row of a built conversation.
PART = 1000
MARK = r"^(?:[ \t]*>)+"
#: Between two sentences.
STOP = r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+\s*"
#: How mail programs introduce a quote in four languages.
INTRODUCTION = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(text: Column) -> Column:
    """array<struct<level, text>>: the lines of a message without their quote marks."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK + " ?", "").alias("text"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), line)


def own_text(lines: Column) -> Column:
    """What the message itself says."""

    def kept(parsed: Column) -> Column:
        quoted_next = lambda i: F.coalesce(F.get(parsed, i + 1)["level"] > 0, F.lit(False))
        own = F.filter(parsed, lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(INTRODUCTION) & quoted_next(i)))
        return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")

    return let(lines, kept)


def _runs(lines: Column) -> Column:
    """array<struct<level, text>>: the runs of quoted lines of one level."""

    def found(parsed: Column) -> Column:
        changes = lambda i: (i == 0) | (F.get(parsed, i)["level"] != F.get(parsed, i - 1)["level"])
        starts = F.filter(F.sequence(F.lit(0), F.size(parsed) - 1), changes)

        def run(at: Column, end: Column) -> Column:
            text = F.array_join(F.transform(F.slice(parsed, at + 1, end - at), lambda x: x["text"]), "\n")
            return F.struct(F.get(parsed, at)["level"].alias("level"), text.alias("text"))

        runs = let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(parsed))), run))
        return F.filter(runs, lambda x: x["level"] > 0)

    return let(lines, found)


def _distinct(found: Column) -> Column:
    """An array<struct<level, text>> without repeats: as strings, which are compared by hash."""
    plain = F.array_distinct(F.transform(found, lambda x: F.concat_ws(":", x["level"].cast("string"), x["text"])))
    return F.transform(plain, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("level"), F.substr(x, F.instr(x, ":") + 1).alias("text")))


def quotes(lines: Column) -> Column:
    """array<struct<level, text>>: the quoted lines and the runs of lines of one level, normalised."""
    every = F.concat(_runs(lines), F.filter(lines, lambda x: x["level"] > 0))
    return _distinct(F.transform(every, lambda x: F.struct(x["level"].alias("level"), _normal(x["text"]).alias("text"))))


def pieces(text: Column) -> Column:
    """array<string>: a text, its paragraphs, lines and sentences (of lines and, if set in several lines, of paragraphs), normalised."""
    paragraphs = F.split(text, r"\n\s*\n")
    lines = F.split(text, r"\n")
    sentences = F.flatten(F.transform(F.array_distinct(F.concat(paragraphs, lines)), lambda x: F.split(x, STOP)))
    every = F.array_distinct(F.concat(F.array(text), paragraphs, lines, sentences))
    return F.array_remove(F.array_distinct(F.transform(every, _normal)), "")


def asked_for(lines: Column) -> Column:
    """array<struct<level, text>>: the pieces of the runs of quoted lines of one level."""
    piece = lambda x: F.transform(pieces(x["text"]), lambda text: F.struct(x["level"].alias("level"), text.alias("text")))
    return _distinct(F.flatten(F.transform(_runs(lines), piece)))


def _places(branches: DataFrame) -> DataFrame:
    """(conv, branch, place): the number of messages before a branch in the reply order. branches: conv, branch, size, up, parent, start."""
    family = branches.filter("up IS NOT NULL").withColumn("near", -F.col("parent"))
    family = following(family, ["conv", "up"], ["near", "start"], "branch", "sibling", "chat-siblings")
    family = materialize(family.select("conv", "branch", "up", "near", "start", "sibling"), "chat-family")
    child = family.groupBy(F.col("conv"), F.col("up").alias("branch")).agg(F.min_by("branch", F.struct("near", "start")).alias("child"))
    tree = branches.select("conv", "branch", "size").join(family.select("conv", "branch", "up", "sibling"), ["conv", "branch"], "left").join(child, ["conv", "branch"], "left")
    tree = tree.join(family.select("conv").distinct(), "conv", "left_semi")
    # The tour's steps: into a branch (twice its number) and out of it (one more).
    into = F.struct((2 * F.col("branch")).alias("x"), F.coalesce(2 * F.col("child"), 2 * F.col("branch") + 1).alias("next"), F.col("size").alias("sum"))
    out = F.struct((2 * F.col("branch") + 1).alias("x"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("next"), F.lit(0).cast("long").alias("sum"))
    tour = materialize(tree.select("conv", F.explode(F.array(into, out)).alias("s")).select("conv", "s.*"), "chat-tour")
    while tour.filter("next IS NOT NULL").limit(1).count():
        over = tour.select("conv", F.col("x").alias("next"), F.col("next").alias("after"), F.col("sum").alias("more"))
        done, open_ = tour.filter("next IS NULL"), tour.filter("next IS NOT NULL").join(over, ["conv", "next"])
        old, tour = tour, materialize(done.unionByName(open_.select("conv", "x", F.col("after").alias("next"), (F.col("sum") + F.col("more")).alias("sum"))), "chat-tour")
        discard(old)
    whole = tour.filter("x = 2").select("conv", F.col("sum").alias("all"))  # a conversation's first branch has the number 1
    places = tour.filter("x % 2 = 0").select("conv", (F.col("x") / 2).cast("long").alias("branch"), "sum")
    sizes = materialize(whole.join(places.groupBy("conv").agg(F.count("*").alias("m")), "conv"), "chat-sizes")
    return attach(places, sizes, "conv", "m", "chat-places").select("conv", "branch", (F.col("all") - F.col("sum")).alias("place"))


def _order(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(row, parent, quoted, position) of every row. rows: conv, turn, row; parents: conv, turn, parent by a quote."""
    rows = materialize(running(rows, ["conv", "turn", "row"], {"seq": F.lit(1).cast("long")}, "chat-rows", ["conv"]), "chat-numbered")
    nodes = rows.groupBy("conv", "turn").agg(F.min("seq").alias("seq"), F.count("*").alias("m"))
    nodes = following(nodes, ["conv"], ["turn"], "turn", "before", "chat-before", back=True)
    nodes = nodes.join(parents, ["conv", "turn"], "left").withColumn("quoted", F.col("parent").isNotNull()).withColumn("parent", F.coalesce("parent", "before"))
    starts = F.when(F.col("before").isNull() | (F.col("parent") != F.col("before")), 1).otherwise(0).cast("long")
    nodes = materialize(running(nodes, ["conv", "turn"], {"branch": starts}, "chat-starts", ["conv"]), "chat-nodes")

    branches = nodes.groupBy("conv", "branch").agg(F.sum("m").alias("size"), F.count("*").alias("n"), F.min("turn").alias("start"), F.min("seq").alias("first"), F.min_by("parent", "turn").alias("parent"))
    branches = branches.withColumn("at", F.when(F.col("parent").isNotNull(), F.struct("conv", F.col("parent").alias("turn"))))
    branches = materialize(branches, "chat-branches")
    met = branches.filter("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("many"))
    above = met.select("at", "many", "at.conv", "at.turn").join(nodes.select("conv", "turn", F.col("branch").alias("up")), ["conv", "turn"]).select("at", "many", "up")
    later = attach(branches.filter("at IS NOT NULL"), materialize(above, "chat-above"), "at", "many", "chat-up").drop("many")
    branches = materialize(branches.filter("at IS NULL").withColumn("up", F.lit(None).cast("long")).unionByName(later), "chat-branches")
    placed = branches.join(_places(branches), ["conv", "branch"], "left")
    shifts = placed.select(F.struct("conv", "branch").alias("in"), "n", (F.coalesce("place", F.lit(0)) - F.col("first")).alias("shift"))
    shifts = materialize(shifts, "chat-shifts")
    nodes = attach(nodes.withColumn("in", F.struct("conv", "branch")), shifts, "in", "n", "chat-in")
    nodes = materialize(nodes.select(F.struct("conv", "turn").alias("at"), "m", "parent", "quoted", "shift"), "chat-nodes")
    rows = attach(rows.withColumn("at", F.struct("conv", "turn")), nodes, "at", "m", "chat-at")
    return rows.select("row", "parent", "quoted", (F.col("seq") + F.col("shift")).alias("position"))


def _parents(known: DataFrame) -> DataFrame:
    """(conv, turn, parent) of the messages with a known quote. known: conv, turn, own, asked."""
    asked = materialize(known.select("conv", "turn", F.explode("asked").alias("q")).select(F.struct("conv", F.xxhash64("q.text").alias("passage")).alias("at"), "turn", "q.level").distinct(), "chat-asked")
    convs = materialize(asked.select("at.conv").distinct(), "chat-quoting")
    said = known.join(bounded_broadcast(convs), "conv", "left_semi").select("conv", "turn", F.explode(pieces(F.col("own"))).alias("line"))
    first = said.select(F.struct("conv", F.xxhash64("line").alias("passage")).alias("at"), "turn").groupBy("at").agg(F.min("turn").alias("said"))
    first = materialize(asked.groupBy("at").agg(F.count("*").alias("m")).join(first, "at"), "chat-said")
    found = attach(asked, first, "at", "m", "chat-found").filter(F.col("said") < F.col("turn"))
    return found.groupBy("at.conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "said"))["said"].alias("parent"))


def formatted(role: Column, text: Column) -> Column:
    """A message between its markers."""
    tag = F.coalesce(F.regexp_replace(role, r"[^\p{L}\p{N}_\-]", "_"), F.lit("user"))
    return F.concat(F.lit("<|"), tag, F.lit("|>\n"), F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|"), F.lit("\n<|end|>\n"))


def unescaped(text: Column) -> Column:
    """A text as it was before ``formatted`` escaped it."""
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message: conv, turn, role, text without quotes, parent_turn, quoted, n_quotes, position in the reply order (from 0)."""
    mark = written()
    col = lambda c: F.col(f"`{c}`")
    parsed = messages.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), col(role).alias("role"), parse(col(text)).alias("lines"))
    has = F.exists("lines", lambda x: x["level"] > 0)
    where = lambda found, name: F.when(has, found(F.col("lines"))).otherwise(F.array().cast("array<struct<level:int,text:string>>")).alias(name)
    parsed = parsed.select("conv", "turn", "role", own_text(F.col("lines")).alias("own"), F.size(where(quotes, "q")).alias("n_quotes"), where(asked_for, "asked"), F.monotonically_increasing_id().alias("row"))
    parsed = materialize(parsed, "chat-parsed")
    whole = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    known = parsed.filter(whole)
    ordered = materialize(_order(known.select("conv", "turn", "row"), materialize(_parents(known), "chat-parents")), "chat-ordered")
    tidy(mark, parsed, ordered)
    alone = parsed.filter(~whole).select("*", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("position"))
    out = known.join(ordered, "row").unionByName(alone)
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own").alias(text), F.col("parent").alias("parent_turn"), "quoted", "n_quotes", "position", F.col("row").alias("_row"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The built conversations: conv, part (0, and on for more than ``PART`` messages), n_messages, text (the formatted messages
    in reply order), messages (in the same order: turn, role, text, parent_turn, quoted, n_quotes)."""
    linked = link(messages, conv, turn, role, text)
    col = lambda c: F.col(f"`{c}`")
    alone = F.when(col(conv).isNull() | col(turn).isNull(), F.col("_row"))
    message = F.struct("position", col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"), "parent_turn", "quoted", "n_quotes")
    built = linked.groupBy(col(conv).alias("_conv"), alone.alias("_alone"), F.floor(F.col("position") / PART).alias("part")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    whole = F.array_join(F.transform("messages", lambda m: formatted(m["role"], m["text"])), "")
    plain = F.transform("messages", lambda m: m.dropFields("position"))
    return built.select(F.col("_conv").alias(conv), "part", F.size("messages").alias("n_messages"), whole.alias("text"), plain.alias("messages"))
