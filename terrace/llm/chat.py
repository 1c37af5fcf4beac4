r"""Chat formatting with a grammar round trip, with DataFrame operations only.

    conversation := turn*
    turn         := "<s>[INST]" role "\n" body "\n[/INST]</s>"

A role of letters, digits, "_", "." and "-" stands as it is, any other as "=" and its URL encoding. A body must hold no bare
control string; "\" before a control string (and before any "\" in front of it) takes it out of the grammar, and the parser
removes one "\" again. A role that begins with "~" says that the body is URL encoded, which nothing can conflict with.

Texts are first rendered as they are; a turn that the parser doesn't give back is escaped by "\"; one that still doesn't
read back is URL encoded. After each step whole conversations are parsed again and compared with their source, so the last
step makes all identical. Loss counts on the bodies of assistant turns, as the parser finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
OPEN, BREAK, CLOSE = "<s>[INST]", "\n", "\n[/INST]</s>"
CONTROL = r"(?:</?s>|\[/?INST\])"

TURN_AT = r"\n\[/INST\]</s>"
PLAIN_ROLE = r"\A[A-Za-z0-9_.-]*\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, rf"\\(\\*{CONTROL})", "$1")


def reads_back(body: Column, text: Column) -> Column:
    """Whether the parser takes body as one body and gives back text."""
    return ~body.rlike(rf"(?<!\\){CONTROL}") & (unescape(body) == text)


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation: an array of (role, text, head, body), the last two as they are rendered."""
    def turn(part: Column) -> Column:
        name = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), BREAK, 1)
        head, body = F.char_length(name) + len(OPEN) + len(BREAK), F.substr(part, F.char_length(name) + len(OPEN) + len(BREAK) + 1)
        coded = F.startswith(name, F.lit("~"))
        role = F.when(coded, F.substr(name, F.lit(2))).otherwise(name)
        role = F.when(F.startswith(role, F.lit("=")), F.url_decode(F.substr(role, F.lit(2)))).otherwise(role)
        text = F.when(coded, F.url_decode(body)).otherwise(unescape(body))
        return F.struct(role.alias("role"), text.alias("text"), F.substr(part, F.lit(1), head).alias("head"), body.alias("body"))

    parts = F.split(rendered, TURN_AT, -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def _identical(turns: Column, source: Column) -> Column:
    pair = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    return F.transform(turns, pair) == F.transform(source, pair)


def format_chat(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A row for each conversation: its id, n_turns, text (rendered), chunks (text and loss, which joined give text), turns (parsed: role, text, loss).

    chunks and turns are what the parser finds in text. Turns are in the order of turn, then role, then text; null turns come
    first; null roles and texts are empty; repeated rows are turns of their own; rows without a conversation id make up one
    conversation without an id; an empty table gives no rows; other columns are not read, whatever their names.
    One conversation must fit in a task's memory.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("turn"), who.alias("role"), what.alias("text"))
    rows = rows.withColumn("body", F.when(reads_back(F.col("text"), F.col("text")), F.col("text")).otherwise(escape(F.col("text"))))
    head = F.concat(F.lit(OPEN), F.when(F.col("role").rlike(PLAIN_ROLE), F.col("role")).otherwise(F.concat(F.lit("="), F.url_encode("role"))), F.lit(BREAK))
    whole = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body", head.alias("head")))).alias("source"))
    join = lambda: F.array_join(F.transform("source", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    whole = whole.withColumn("text", join()).withColumn("turns", parse(F.col("text")))
    # What doesn't read back is escaped further: the turns whose bodies conflict first, all of them if that isn't enough.
    for every in (False, True):
        coded = lambda x: F.struct(
            x["role"].alias("role"), x["text"].alias("text"), F.url_encode(x["text"]).alias("body"), F.concat(F.lit(OPEN + "~"), F.substr(x["head"], F.lit(len(OPEN) + 1))).alias("head"))
        plain = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["body"].alias("body"), x["head"].alias("head"))
        conflict = lambda x: F.lit(every) | ~reads_back(x["body"], x["text"])
        same = _identical(F.col("turns"), F.col("source"))
        fixed = F.transform("source", lambda x: F.when(same | ~conflict(x) | F.startswith(x["head"], F.lit(OPEN + "~")), plain(x)).otherwise(coded(x)))
        whole = whole.withColumn("source", fixed).withColumn("_same", same)
        whole = whole.withColumn("text", F.when(F.col("_same"), F.col("text")).otherwise(join()))
        whole = whole.withColumn("turns", F.when(F.col("_same"), F.col("turns")).otherwise(parse(F.col("text")))).drop("_same")
    lit = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    chunks = F.flatten(F.transform("turns", lambda x: F.array(lit(x["head"], F.lit(False)), lit(x["body"], x["role"] == learn), lit(F.lit(CLOSE), F.lit(False)))))
    read = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), (x["role"] == learn).alias("loss")))
    return whole.select(
        F.col("_conv").alias(conv), F.size("turns").cast("long").alias("n_turns"), "text", chunks.alias("chunks"),
        F.when(_identical(F.col("turns"), F.col("source")), read).otherwise(F.raise_error(F.lit("a rendered conversation does not read back to its source"))).alias("turns"),
    )


def loss_spans(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, start, length: the code points of each rendered text on which loss counts, for trainers that take offsets."""
    line = Window.partitionBy("_row").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    each = formatted.select(F.col(conv), F.xxhash64(F.col(conv), F.col("text")).alias("_row"), F.posexplode("chunks").alias("_pos", "_chunk"))
    each = each.withColumn("length", F.char_length("_chunk.text")).withColumn("start", F.coalesce(F.sum("length").over(line), F.lit(0)))
    return each.where("_chunk.loss").select(conv, "start", "length")
