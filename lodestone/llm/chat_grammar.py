r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    conversation := turn*
    turn         := "<s>[INST] " role " [/INST] " text "</s>"      plain
                  | "<s>[INST*] " role " [/INST] " text "</s>"     escaped

Role and text hold no control string: the parser rejects a turn that does. Each turn is rendered
plain and parsed again; where that doesn't give back the source, its role and text are escaped
(& < [ become &amp; &lt; &lsqb;) and it is parsed again. The two forms differ in the opening mark,
so the reader knows which to undo, and no escaped text can hold a control string.

A conversation is one output text, hence one group; its turns are gathered as rows of a group,
never across conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PLAIN, ESCAPED, MID, END = "<s>[INST] ", "<s>[INST*] ", " [/INST] ", "</s>"
#: What no role or text may hold unescaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[INST*]", "[/INST]")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
#: The conversation each run adds: both turns say what looks like control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def render(role: Column, text: Column, escaped: bool) -> Column:
    return F.concat(F.lit(ESCAPED), escape(role), F.lit(MID), escape(text), F.lit(END)) if escaped else F.concat(F.lit(PLAIN), role, F.lit(MID), text, F.lit(END))


def parse_turn(turn: Column) -> Column:
    """Struct (role, text, escaped) of one rendered turn without its end mark; null where the grammar rejects it."""
    escaped = turn.startswith(ESCAPED)
    body = F.when(escaped, F.substring(turn, len(ESCAPED) + 1, 2**31 - 1)).when(turn.startswith(PLAIN), F.substring(turn, len(PLAIN) + 1, 2**31 - 1))
    at = F.locate(MID, body)
    role, text = F.left(body, at - F.lit(1)), F.substring(body, at + F.lit(len(MID)), F.lit(2**31 - 1))
    clean = F.lit(True)
    for mark in CONTROLS:
        clean = clean & ~role.contains(mark) & ~text.contains(mark)
    undo = lambda c: F.when(escaped, unescape(c)).otherwise(c)
    return F.when((at > 0) & clean, F.struct(undo(role).alias("role"), undo(text).alias("text"), escaped.alias("escaped")))


def parse(formatted: Column) -> Column:
    """Array of (role, text, escaped) of a formatted conversation."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_escaped, formatted, loss_spans, round_trip) from rows (conv_id, turn, role, text).

    Null texts and roles count as empty; equal turn numbers are ordered by role, then text, and
    repeated rows stay; a null turn comes first; a null conv_id is a conversation of its own.
    loss_spans: (start, length, escaped) of each assistant text in ``formatted``, code points from 0.
    round_trip: the parsed turns equal the source."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    plain = render(F.col("role"), F.col("text"), False)
    back = parse(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    rows = rows.withColumn("conflict", ~F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("shown", F.when(F.col("conflict"), render(F.col("role"), F.col("text"), True)).otherwise(plain))
    lead = F.when(F.col("conflict"), F.char_length(escape(F.col("role"))) + len(ESCAPED) + len(MID)).otherwise(F.char_length("role") + len(PLAIN) + len(MID))
    rows = rows.withColumn("lead", lead)
    group = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown", "lead", "conflict"))).alias("t"))
    start = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,escaped:boolean>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["shown"])).alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(s["spans"], F.array(F.struct((s["at"] + x["lead"]).alias("start"), (F.char_length(x["shown"]) - x["lead"] - len(END)).alias("length"), x["conflict"].alias("escaped")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    shown = group.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["conflict"])).cast("long").alias("n_escaped"),
        F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("formatted"),
        start["spans"].alias("loss_spans"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    found = F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return shown.select("conv_id", "n_turns", "n_escaped", "formatted", "loss_spans", (found == F.col("source")).alias("round_trip"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes read back from formatted conversations: turns by the parser, loss text by the mask."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + F.lit(1), s["length"]))
    plain = F.zip_with(masked, "loss_spans", lambda t, s: F.when(s["escaped"], unescape(t)).otherwise(t))
    loss = F.array_join(plain, "")
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.union(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))))


def _sql_escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"


_HOLDS = " OR ".join(f"contains(role, '{m}') OR contains(text, '{m}')" for m in (*CONTROLS, MID.strip()))
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, CASE WHEN {_HOLDS}
    THEN {len(ESCAPED + MID + END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})
    ELSE {len(PLAIN + MID + END)} + length(role) + length(text) END AS chars FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
