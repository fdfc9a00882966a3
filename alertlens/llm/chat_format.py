r"""Chat formatting with a grammar round trip, in DataFrame operations only.

Template (a turn): ``[INST]`` role ``[/INST]`` text ``</s>``. The parser is
deterministic: cut at ``</s>``, then each piece must be ``[INST]``, a role, the first
``[/INST]``, and a text free of control strings. Every turn is first rendered as it
stands and parsed again; a turn that does not come back identical is escaped: one
backslash goes behind the first character of each control string in it, also of one
that has backslashes there already (``[INST]`` -> ``[\INST]`` -> ``[\\INST]``), so that
removing one backslash restores any text exactly. Other texts stay untouched.

Defined results: null role or text counts as empty; turns are ordered by (turn, role,
rendered text), nulls first, so ties and repeated rows have a fixed order; a null
conv_id is one conversation; no rows give no rows; other columns are ignored.

A conversation is one output text, so its turns meet in one row: that is the result,
not a helper group. Turns are rendered and checked before the shuffle, and copies of a
conversation under other ids spread over tasks by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Control strings of the template (fixed values).
OPEN, SEP, CLOSE = "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"

_CONFLICT = r"(\[(?=\\*/?INST\])|<(?=\\*/s>))"
_ESCAPED = r"(\[(?=\\+/?INST\])|<(?=\\+/s>))\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONFLICT, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(CLOSE))


def _parse_piece(piece: Column) -> Column:
    """struct(role, text, raw_role, raw) of a piece between ``</s>``; null if the grammar rejects it."""
    at = F.instr(piece, SEP)
    role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
    body = F.substring(piece, at + len(SEP), F.length(piece))
    good = (piece.startswith(OPEN) & (at > 0) & ~role.contains(OPEN)
            & ~body.contains(OPEN) & ~body.contains(SEP))
    return F.when(good, F.struct(unescape(role).alias("role"), unescape(body).alias("text"),
                                  role.alias("raw_role"), body.alias("raw")))


def parse(formatted: Column) -> Column:
    """array of struct(role, text, raw_role, raw), or null if the text is not in the grammar."""
    pieces = F.split(formatted, CLOSE, -1)  # no regex characters in CLOSE
    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), _parse_piece)
    whole = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def render_checked(role: Column, text: Column) -> Column:
    """The turn as it stands if its own parse gives it back, else the escaped turn."""
    plain = render(role, text)
    back = parse(plain)
    same = F.coalesce((F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))
    return F.when(same, plain).otherwise(render(escape(role), escape(text)))


def loss_spans(turns: Column) -> Column:
    """array of struct(start, length): places (from 1) of the assistant texts in the
    formatted text, whose parsed turns are given."""
    start = F.struct(F.lit(1).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["raw_role"]) + len(OPEN) + len(SEP)
        size = F.length(t["raw"])
        span = F.struct((acc["at"] + head).alias("start"), size.cast("long").alias("length"))
        spans = F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + size + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (recovered from formatted), spans (loss mask)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.select("conv_id", "turn", role.alias("role"), render_checked(role, text).alias("part"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "part"))).alias("parts"))
    conv = conv.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"))
    conv = conv.withColumn("turns", parse(F.col("formatted")))
    return conv.withColumn("spans", loss_spans(F.col("turns")))


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows plus conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, '{ASSISTANT}', '{said}') "
                      "AS p(conv_id, turn, role, text)")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def digests(conv: DataFrame) -> DataFrame:
    """The query's columns, all read back from ``formatted`` and its loss mask."""
    under = F.transform("spans", lambda s: F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))
    conv = conv.withColumn("loss", F.array_join(F.transform(under, unescape), ""))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB SQL for the digests. The turn order matches on (turn, role, text); escaping adds
#: one character per control string with its backslashes.
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 17 + length(role) + length(text)
             + CASE WHEN contains(role || text, '</s>') OR contains(role || text, '[INST]') OR contains(role || text, '[/INST]')
                         OR regexp_matches(role || ' ' || text, '\[\\+/?INST\]|<\\+/s>')
                    THEN len(regexp_extract_all(role || ' ' || text, '\[\\*/?INST\]|<\\*/s>')) ELSE 0 END AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
