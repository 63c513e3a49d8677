"""Chat formatting: typed parts are flattened by a visitor of column expressions, then laid out by a reversible template. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "struct<type:string,text:string,ref:string,tokens:long>"
#: Tokens that a placeholder stands for when its part doesn't say. Parameters of the model to train.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
TURN_START, TURN_END = "### ", "</turn>\n"
#: What a control character becomes inside a text or role. The escape sign comes first here, and last on the way back.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    """No control string of the template can occur in the result; ``unescape`` gives the text back."""
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


class PartVisitor:
    """One method for each part type gives what the part adds to the line, the expanded tokens and the attachment."""

    def text(self, part: Column, _: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def attachment(self, part: Column, at: Column) -> Column:
        """A placeholder such as ``<|image:0|>``; a text can't hold one, because its ``<`` is escaped."""
        return F.concat(F.lit("<|"), part["type"], F.lit(":"), at.cast("string"), F.lit("|>"))

    def line(self, part: Column, at: Column) -> Column:
        return F.when(self.is_attachment(part), self.attachment(part, at)).otherwise(self.text(part, at))

    def is_attachment(self, part: Column) -> Column:
        return F.coalesce(part["type"].isin(*DEFAULT_TOKENS), F.lit(False))

    def tokens(self, part: Column) -> Column:
        default = F.lit(0)
        for kind, n in DEFAULT_TOKENS.items():
            default = F.when(part["type"] == kind, n).otherwise(default)
        return F.when(self.is_attachment(part), F.coalesce(part["tokens"], default)).otherwise(0).cast("long")


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def mixed_parts(text: Column) -> Column:
    """A turn with attachments that its text's length n chooses: an image before the text where 3 divides n, after it an audio part of n tokens where 5 does, a document where 7 does."""
    n = F.char_length(F.coalesce(text, F.lit("")))

    def part(kind: str, every: int, tokens: Column) -> Column:
        ref = F.concat(F.lit(f"{kind}/"), n.cast("string"))
        return F.when(n % every == 0, F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), tokens.cast("long").alias("tokens")))

    none = F.lit(None)
    return F.concat(F.array(part("image", 3, none)), text_part(text), F.array(part("audio", 5, n), part("document", 7, none)))


def flatten_parts(messages: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """Adds ``flat`` (text and placeholders in order), ``attachments`` (position, type, ref, tokens) and ``expanded_tokens``.

    ``parts`` is an array of PART; placeholders carry the part's position. A null list, part or
    text adds nothing; an unknown type counts as text. Row by row, no shuffle. Columns with these three names are replaced; others pass through.
    """
    visitor = visitor or PartVisitor()
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["type"].alias("type"), p["ref"].alias("ref"), visitor.tokens(p).alias("tokens"), visitor.is_attachment(p).alias("_is")))
    attached = F.transform(F.filter(numbered, lambda p: p["_is"]), lambda p: F.struct(p["at"], p["type"], p["ref"], p["tokens"]))
    return (
        messages.withColumn("flat", F.array_join(F.transform(parts, visitor.line), ""))
        .withColumn("attachments", attached)
        .withColumn("expanded_tokens", F.aggregate(F.transform(parts, visitor.tokens), F.lit(0).cast("long"), lambda s, x: s + x))
    )


def format_conversations(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted``, the loss mask as spans of it, attachments and expanded tokens.

    ``messages`` has conv_id, turn, role and parts. Turns go by turn, then role, then text (nulls
    first), so ties and repeated rows have a fixed order. A null role reads as empty; a null
    conv_id is one conversation. A conversation is one string, so its rows meet in one task; what
    is shuffled is each turn's own line.
    """
    lined = flatten_parts(messages).withColumn("_role", F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(TURN_START), escape(F.col("_role")), F.lit(": "))
    turn = F.struct("turn", F.col("role").alias("role"), F.col("flat").alias("flat"), head.alias("head"), F.col("_role").isin(*trained_roles).alias("trained"), "attachments", "expanded_tokens")
    lined = lined.select("conv_id", turn.alias("_turn"), (F.char_length(head) + F.char_length("flat") + len(TURN_END)).cast("long").alias("_length"))
    order = Window.partitionBy("conv_id").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = lined.withColumn("_from", F.coalesce(F.sum("_length").over(order), F.lit(0)))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_from", "_turn"))).alias("_turns"))
    span = lambda t: F.struct((t["_from"] + F.char_length(t["_turn"]["head"])).alias("start"), F.char_length(t["_turn"]["flat"]).cast("long").alias("length"))
    noted = lambda t, i: F.transform(t["_turn"]["attachments"], lambda a: F.struct(i.alias("turn"), a["at"].alias("at"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: F.concat(t["_turn"]["head"], t["_turn"]["flat"], F.lit(TURN_END))), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["_turn"]["trained"]), span).alias("loss_spans"),
        F.flatten(F.transform("_turns", noted)).alias("attachments"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda s, t: s + t["_turn"]["expanded_tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Recovers the turns and the trained text from ``formatted`` and ``loss_spans`` alone."""
    lines = F.filter(F.split("formatted", TURN_END), lambda x: x != "")
    cut = lambda x: F.instr(x, ": ")
    turns = F.transform(lines, lambda x: F.struct(unescape(F.substring(x, F.lit(len(TURN_START) + 1), cut(x) - len(TURN_START) - 1)).alias("role"), unescape(F.substring(x, cut(x) + 2, F.char_length(x))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Formats ``conversations`` (conv_id, turn, role, text) and digests what is read back.

    Each is formatted twice in one pass: as it is, which gives the digests of turns and loss, and with
    the attachments of ``mixed_parts``, which gives mixed_chars, n_attachments, expanded_tokens and the
    digest of the attachment records in order. Null texts and roles read as empty; a null conv_id is
    one conversation; repeated rows are turns of their own; a very long text is one line of its
    conversation; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    both = F.array(F.struct(F.lit(False).alias("mixed"), text_part(F.col("text")).alias("parts")), F.struct(F.lit(True).alias("mixed"), mixed_parts(F.col("text")).alias("parts")))
    turns = conversations.select("conv_id", "turn", "role", F.explode(both).alias("b"))
    back = read_back(format_conversations(turns.select(F.struct("conv_id", "b.mixed").alias("conv_id"), "turn", "role", "b.parts")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    noted = F.array_join(F.transform("attachments", lambda a: F.concat(F.concat_ws(":", a["turn"].cast("string"), a["at"].cast("string"), a["type"], a["ref"], a["tokens"].cast("string")), F.lit("\n"))), "")
    plain = F.struct(
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    mixed = F.struct(
        F.char_length("formatted").cast("long").alias("mixed_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
        F.sha2(noted, 256).alias("attachments_sha256"),
    )
    digests = back.select("conv_id.conv_id", F.when(~F.col("conv_id.mixed"), plain).alias("plain"), F.when(F.col("conv_id.mixed"), mixed).alias("mixed"))
    return digests.groupBy("conv_id").agg(F.max("plain").alias("plain"), F.max("mixed").alias("mixed")).select("conv_id", "plain.*", "mixed.*")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) AS l, length(role) + length(text) + len(regexp_extract_all(role || text, '[\\#<:]')) + 14 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS t FROM c),
a AS (SELECT conv_id, t, 0 AS spot, 'image' AS type, 'image/' || l AS ref, 576 AS tokens FROM e WHERE l % 3 = 0
  UNION ALL SELECT conv_id, t, 1 + (l % 3 = 0)::INTEGER, 'audio', 'audio/' || l, l FROM e WHERE l % 5 = 0
  UNION ALL SELECT conv_id, t, 1 + (l % 3 = 0)::INTEGER + (l % 5 = 0)::INTEGER, 'document', 'document/' || l, 1024 FROM e WHERE l % 7 = 0),
s AS (SELECT conv_id, count(*) AS n, sum(tokens) AS tokens, sum(length(type) + 6) AS chars, string_agg(t || ':' || spot || ':' || type || ':' || ref || ':' || tokens || chr(10), '' ORDER BY t, spot) AS said FROM a GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT g.*, formatted_chars + CAST(coalesce(chars, 0) AS BIGINT) AS mixed_chars, coalesce(s.n, 0) AS n_attachments, CAST(coalesce(tokens, 0) AS BIGINT) AS expanded_tokens, sha256(coalesce(said, '')) AS attachments_sha256
FROM g LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM g.conv_id
"""
