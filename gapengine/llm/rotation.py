"""Chat formatting by perspective rotation: each participant in turn is the assistant.

A conversation of n turns with p participants becomes p dialogues of n
segments.  In a participant's dialogue their own turns are the assistant's and
carry the loss mask; everybody else's are a user's, with the speaker's name.
Segments stay rows, with their place in the rendered dialogue, so that a
conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapengine.llm.common import C, running_sum, stored

# The common chat mark-up.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NOBODY = "unknown"


def unmarked(text: Column) -> Column:
    """Mark-up inside a text broken up with a zero-width space."""
    return F.replace(text, F.lit("<|"), F.lit("<\u200b|"))


def in_head(speaker: Column) -> Column:
    """A speaker as it stands in a turn's first line: no mark-up, and no line end that would close that line."""
    return F.translate(unmarked(speaker), "\r\n\u0085\u2028\u2029", "     ")


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    never: tuple[str, ...] = ("system",),
) -> DataFrame:
    """One row for each turn of each perspective of each conversation.

    Returns conv_id, perspective (the participant who is the assistant), turn,
    speaker, role (assistant, user, or a speaker of ``never`` under its own
    name, who gets no perspective), name (null for the assistant), segment (the
    rendered turn), start and end (code points of the segment in the rendered
    dialogue, which is all segments in order), mask_start and mask_end (code
    points to train on: an assistant's text with its closing mark; both null
    for others).

    Mark-up inside a text or a speaker is broken up with a zero-width space, and
    line ends of a speaker become spaces, so neither can end its turn or open
    another; ``speaker``, ``perspective`` and ``name`` keep them as they are.  A
    null text is empty, a null speaker is one with the speaker ``unknown``; rows
    with null conv_id form one conversation.  Turns are ordered by turn, null first, then speaker and text; repeated rows stay,
    each a segment.  A conversation without participants (only ``never``) gives
    no rows, as does an empty table.  Other columns are not read.
    """
    speaker = F.coalesce(C(speaker_col).cast("string"), F.lit(NOBODY))
    text = F.coalesce(C(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        C(conv_col).alias("conv_id"), F.coalesce(F.concat(F.lit("c"), C(conv_col).cast("string")), F.lit("")).alias("conv"),
        C(turn_col).alias("turn"), speaker.alias("speaker"), unmarked(text).alias("text"),
    )
    people = rows.filter(~C("speaker").isin(*never)).select("conv", C("speaker").alias("perspective")).distinct()
    # Spark splits a conversation that holds a large share of the turns, as both sides are plain shuffles.
    rotated = rows.join(stored(people), "conv")
    role = (
        F.when(C("speaker") == C("perspective"), "assistant").when(C("speaker").isin(*never), C("speaker")).otherwise("user")
    )
    rotated = rotated.withColumn("role", role).withColumn("name", F.when(C("role") == "user", C("speaker")))
    head = F.concat(F.lit(OPEN), in_head(C("role")), F.coalesce(F.concat(F.lit(" name="), in_head(C("name"))), F.lit("")), F.lit("\n"))
    rotated = rotated.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(CLOSE + "\n"))).withColumn("length", F.length("segment"))
    placed = running_sum(rotated, ["conv", "perspective"], ["turn", "speaker", "text"], "length", "start")
    trained = C("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name", "segment", "start", (C("start") + C("length")).alias("end"),
        F.when(trained, C("start") + C("head")).alias("mask_start"), F.when(trained, C("start") + C("length") - 1).alias("mask_end"),
    )


def _in_head(speaker: str) -> str:
    return f"translate(replace({speaker}, '<|', '<' || chr(8203) || '|'), chr(13) || chr(10) || chr(133) || chr(8232) || chr(8233), '     ')"


ORACLE = f"""
WITH r AS (
  SELECT conv_id, coalesce('c' || conv_id, '') AS conv, turn, coalesce(role, '{NOBODY}') AS speaker,
         replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text FROM conversations),
p AS (SELECT DISTINCT conv, speaker AS perspective FROM r WHERE speaker <> 'system'),
x AS (
  SELECT r.*, perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM r JOIN p USING (conv)),
h AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '{OPEN}' || {_in_head('role')} || CASE WHEN role = 'user' THEN ' name=' || {_in_head('speaker')} ELSE '' END || chr(10) AS head FROM x),
s AS (SELECT *, head || text || '{CLOSE}' || chr(10) AS segment FROM h),
q AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv, perspective ORDER BY turn NULLS FIRST, speaker, text
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM s)
SELECT conv_id, perspective, turn, speaker, role, name, segment, "start", CAST("start" + length(segment) AS BIGINT) AS "end",
       CASE WHEN role = 'assistant' THEN CAST("start" + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role = 'assistant' THEN CAST("start" + length(segment) - 1 AS BIGINT) END AS mask_end
FROM q
"""
