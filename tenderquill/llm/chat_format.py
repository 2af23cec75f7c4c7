"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged into one block by array aggregation, and blocks are
concatenated. Layout of a block (a new block starts where the role changes)::

    <|im_start|>role<|im_sep|>text<|im_next|>text ... <|im_end|>

Inside roles and texts every control string gets one U+2060 after its first
character; one that holds some already gets one more, so removing one restores
the text exactly and no text can forge a marker.

Defined cases: null role or text counts as empty; a null conv_id is one
conversation; turns sort by (turn, role, text), null turns first, repeated rows
stay; an empty table gives no rows; extra columns are ignored. A conversation is
one formatted string, whatever its length, so it must fit into memory several
times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
JOINER = "⁠"
#: Control strings without their first character.
TAILS = [r"\|im_start\|>", r"\|im_sep\|>", r"\|im_next\|>", r"\|im_end\|>", r"\|endoftext\|>", "s>", "/s>", "<SYS>>", "</SYS>>", r"INST\]", r"/INST\]"]
ESCAPE = r"([<\[])(" + JOINER + "*)(" + "|".join(TAILS) + ")"
UNESCAPE = r"([<\[])" + JOINER + "(" + JOINER + "*)(" + "|".join(TAILS) + ")"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, "$1" + JOINER + "$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def _quoted(marker: str) -> str:
    return "\\Q" + marker + "\\E"


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length in code points of formatted)."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    per = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # positions at which a block begins
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    per = per.select("conv_id", "turns", starts.alias("starts"))
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    per = per.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
    # every block as pieces (marker or text, text's under the loss mask), in output order
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(head(b).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)).alias("s"), F.lit(False).alias("loss")),
                            F.struct(t.alias("s"), (b["role"] == loss_role).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    per = per.select("conv_id", pieces.alias("pieces"))
    span = "array<struct<start:int,length:int>>"
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["s"]).alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return per.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_conversations(formatted: Column) -> Column:
    """array<struct<role,text>> read back from the formatted string."""
    blocks = F.slice(F.split(formatted, _quoted(END), -1), 1, F.size(F.split(formatted, _quoted(END), -1)) - 1)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, SEP, -1), _quoted(NEXT), -1),
                lambda t: F.struct(
                    unescape(F.substring(F.substring_index(b, SEP, 1), len(START) + 1, 2**31 - 1)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = format_conversations(rows.unionByName(probe))
    out = out.select("conv_id", "formatted", parse_conversations(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPE = ESCAPE.replace(JOINER, "\\x{2060}")
OP2_SQL = f"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') AS "role", coalesce(text, '') AS txt FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), n AS (
  SELECT *, row_number() OVER w AS k, lag("role") OVER w AS prev FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, "role", txt)
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg("role" || chr(10) || txt || chr(10), '' ORDER BY k) AS whole,
    coalesce(string_agg(txt, '' ORDER BY k) FILTER ("role" = 'assistant'), '') AS loss,
    sum(length(regexp_replace(txt, '{_SQL_ESCAPE}', '\\1' || chr(8288) || '\\2\\3', 'g'))
        + CASE WHEN prev IS NULL OR prev <> "role" THEN {len(START) + len(SEP) + len(END)} + length("role") ELSE {len(NEXT)} END) AS chars
  FROM n GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM s
"""
