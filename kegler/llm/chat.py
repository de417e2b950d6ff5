r"""Chat formatting with typed content parts.

A visitor walks the parts of a message in order. Text is escaped; an image, audio or document part
leaves a placeholder with its number in the conversation, and an attachment record with its
reference, the tokens it expands to and the placeholder. A turn is

    ### <role>: <content></turn>\n

and a conversation its turns in order. In roles and texts a backslash is doubled and every control
string is broken by one (``###`` becomes ``\###``, ``</turn>`` ``<\/turn>``, ``<|`` ``<\|``, a colon
of a role ``\:``), so that no text can end a turn, open one or forge a placeholder, and taking one
backslash from each pair gives the text back. Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that attachments expand to: a square of an image, a second of audio, a page of a document.
IMAGE_SQUARE, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 600


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control, broken in (("###", "\\###"), ("</turn>", "<\\/turn>"), ("<|", "<\\|")):
        out = F.replace(out, F.lit(control), F.lit(broken))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def part_tokens(part: Column) -> Column:
    """Tokens that a part other than text expands to; a missing size counts as one square, second or page."""
    squares = F.ceil(F.coalesce(part["width"], F.lit(1)) / F.lit(IMAGE_SQUARE)) * F.ceil(F.coalesce(part["height"], F.lit(1)) / F.lit(IMAGE_SQUARE))
    return (
        F.when(part["kind"] == "image", squares)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * DOCUMENT_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_file(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv, formatted, loss (spans of assistant contents), attachments, n_tokens_expanded.

    turns: one row per turn with ``parts``, an array of PART. Turns are ordered by (turn, role,
    parts), nulls first, so ties have a defined order and repeated rows are turns of their own. A
    null role or text is empty, a null or empty array a turn without content, a part of an unknown
    kind its text. A null id is a conversation like any other. Spans and offsets count code points
    of ``formatted``. A conversation is one value and so is put together in one task; rows are
    grouped by nothing coarser.
    """
    own = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), own.alias("parts"))
    # Running sums over the turns before give each turn the number of its first file and its place, in one pass.
    before = W.partitionBy("conv").orderBy("turn", "role", "parts").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    rows = rows.withColumn("files", F.filter("parts", _is_file)).withColumn("first_file", upto(F.size("files")))

    def visit(p: Column, i: Column) -> Column:
        number = F.col("first_file") + F.size(F.filter(F.slice("parts", 1, i), _is_file))
        return F.when(_is_file(p), placeholder(p["kind"], number)).otherwise(escape(p["text"]))

    content = F.array_join(F.when(F.size("files") > 0, F.transform("parts", visit)).otherwise(F.transform("parts", lambda p: escape(p["text"]))), "")
    rows = rows.withColumns({"head": F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(COLON)), "content": content})
    rows = rows.withColumn("at", upto(F.length("head") + F.length("content") + len(END)))
    start = F.col("at") + F.length("head")
    files = F.transform("files", lambda p, k: F.struct((F.col("first_file") + k).cast("int").alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens"), placeholder(p["kind"], F.col("first_file") + k).alias("placeholder")))
    # Places ascend, so they tell the order.
    turn_value = F.struct("at", start.alias("start"), (start + F.length("content")).alias("end"), (F.col("role") == "assistant").alias("learned"), F.concat("head", "content", F.lit(END)).alias("text"), files.alias("files"))
    groups = rows.select("conv", turn_value.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    out = groups.select("conv", F.array_join("turns.text", "").alias("formatted"), loss.alias("loss"), F.flatten("turns.files").alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    return out.withColumn("n_tokens_expanded", total).withColumnRenamed("conv", conv)


def placeholder(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))


def parse_conversations(formatted: DataFrame, conv: str = "conv_id", text: str = "formatted", others: tuple[str, ...] = ()) -> DataFrame:
    """Read formatted conversations back: conv, turns (array of role, text), in order, and ``others`` as they are.

    Placeholders stay in the text. Only what escaped text can't contain ends a turn or a role.
    """
    pieces = F.filter(F.split(F.col(text), r"</turn>\n"), lambda x: x != "")
    head = r"(?s)^### ((?:[^:\\]|\\.)*+): "
    turns = F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_replace(x, head, "")).alias("text")))
    return formatted.select(F.col(conv), F.col(text).alias("formatted"), turns.alias("turns"), *others)


#: Code points of the blocks from which spans are cut.
CUT_BLOCK = 1024


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text that is cut into blocks: work in proportion to the span."""
    first = F.floor(start / CUT_BLOCK)
    last = F.floor((end - 1) / CUT_BLOCK)
    own = F.array_join(F.slice(blocks, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
    return F.substring(own, (start - first * CUT_BLOCK + 1).cast("int"), (end - start).cast("int"))


def conversation_digest(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format conversations of plain texts, read them back and digest what was read: conv, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are those that are parsed; what is
    learned is the text under the loss spans."""
    rows = turns.select(F.col(conv), F.col(turn), F.col(role), text_part(F.col(text)).alias("parts"))
    formatted = format_conversations(rows, conv, turn, role)
    back = parse_conversations(formatted, conv, others=("loss",))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = F.struct("formatted", "loss", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CUT_BLOCK}}}"), F.lit(0)).alias("blocks"), F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"))
    # A generator keeps the optimizer from moving the blocks into the lambda, where each span would make them anew.
    back = back.select(F.col(conv), F.inline(F.array(found)))
    learned = F.array_join(F.transform("loss", lambda s: unescape(_cut(F.col("blocks"), s["start"], s["end"]))), "")
    out = back.select(F.col(conv), "formatted", "n_turns", "whole", learned.alias("learned"))
    return out.select(F.col(conv), "n_turns", F.sha2("whole", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
