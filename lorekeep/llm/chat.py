"""Chat templates on DataFrame functions: typed content parts, reversible escapes and loss masks.

Every turn is OPEN role BODY content CLOSE. Inside roles and texts a backslash is doubled and each
control string, of this template or of other common ones, gets a backslash after its first
character, so no text can hold a control string and unescaping gives back exactly what came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table

# Control strings of the template. All begin with "<|".
OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>"
#: "<|", "<s>", "</s>", "[INST]" and "[/INST]" by their first character.
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def flatten_parts(parts: Column, tokens_per: dict[str, int] | None = None) -> tuple[Column, Column]:
    """Content and attachments of array<struct<type,text,ref,tokens>>: each type has its own rule.

    text gives its escaped text; image, audio and document give the placeholder `<|type:i|>`, i being
    the place of the part, and an attachment (place, type, ref, tokens), tokens being the part's own or
    the type's default; other types and null parts give nothing. Null text is empty.
    """
    default = {"image": 576, "audio": 750, "document": 1024} | (tokens_per or {})
    media = list(default)

    def visit(p: Column, i: Column) -> Column:
        place = F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))
        return F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).when(p["type"].isin(media), place).otherwise(F.lit(""))

    def attachment(p: Column, i: Column) -> Column:
        usual = F.coalesce(*[F.when(p["type"] == t, F.lit(n)) for t, n in default.items()])
        return F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"].cast("int"), usual).alias("tokens"))

    given = F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,tokens:int>>"))
    content = F.concat_ws("", F.transform(given, visit))
    return content, F.filter(F.transform(given, attachment), lambda a: a["type"].isin(media))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask, attachments) from turns (conv_id, turn, role, parts).

    loss_mask lists the spans (start, length in code points of formatted) of the contents of turns
    whose role is `learn`. Turns are in order of turn, then role and content; a null role is empty,
    rows of a null conv_id are one conversation, repeated rows repeat their turn, an empty table gives
    none. A conversation is one output row and so one task's, whatever its length.
    """
    content, attachments = flatten_parts(F.col("parts"))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), content.alias("content"), attachments.alias("found"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))).withColumn("segment", F.concat("head", "content", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    placed = rows.withColumns(
        {
            "at": F.row_number().over(order),
            "start": F.sum(F.char_length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("segment") + F.char_length("head"),
            "size": F.char_length("content").cast("long"),
        }
    )
    turn = F.struct("at", "segment", "start", "size", (F.col("role") == learn).alias("learnt"), "found")
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    mask = F.transform(F.filter("t", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length")))
    found = F.flatten(F.transform("t", lambda t: F.transform(t["found"], lambda a: F.struct(t["at"].alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return chats.select("conv_id", F.concat_ws("", F.transform("t", lambda t: t["segment"])).alias("formatted"), mask.alias("loss_mask"), found.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, out of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda s: F.startswith(s, F.lit(OPEN)))
    body = lambda s: F.split(F.substr(s, F.lit(len(OPEN) + 1)), r"<\|body\|>")
    return F.transform(F.transform(parts, body), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -1, and reads everything back from the formatted text and its mask."""
    odd = "</s>[INST] ok [/INST]"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema))
    made = format_chats(turns.select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts")))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learnt = F.concat_ws("", F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int")))))
    return made.withColumns({"turns": read_turns(F.col("formatted")), "learnt": learnt}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS escaped,
    replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS named
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, escaped) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, escaped), '') AS learnt,
    sum(length(named) + length(escaped) + 23) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
