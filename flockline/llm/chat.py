"""Chat formatting by rotating perspectives (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM, UNNAMED = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame) -> DataFrame:
    """Every dialogue once per participant: ``conv_id, perspective, turn, role, name, rendered, mask``.

    ``turns (conv_id, turn, role, text)``; a participant is a role other than ``system``,
    a null role is ``unknown``. In a participant's perspective its own turns are the
    assistant's, those of all others are of users named after them, system turns stay.
    ``rendered`` is the turn's piece of the dialogue, which is the pieces by turn; ``mask``
    is true where a model learns: the assistant's turns. A marker inside a text is
    broken up, so no text can end its turn; a null text is empty. Dialogues with system
    turns only have no perspective. Repeated rows stay repeated; rows without a conv_id
    belong to no dialogue and are left out. Other columns are ignored.

    Rows are never gathered per dialogue: participants are distinct rows, found with
    map-side aggregation, and a long dialogue's turns are joined with its few participants.
    """
    speaker = F.coalesce("role", F.lit(UNNAMED)).alias("speaker")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", speaker, text.alias("text"))
    people = rows.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    rendered = F.concat(head, "text", F.lit(f"{CLOSE}\n"))
    return rows.join(people, "conv_id").select(
        "conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), rendered.alias("rendered"), own.alias("mask")
    )


def rotate_sql() -> str:
    """The same rule on ``conversations``."""
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS speaker,
  replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}'),
seen AS (SELECT conv_id, perspective, turn, text, speaker, speaker = perspective AS mask,
  CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said JOIN people USING (conv_id))
SELECT conv_id, perspective, turn, role, CASE WHEN role = 'user' THEN speaker END AS name,
  '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) || text || '{CLOSE}' || chr(10) AS rendered,
  mask FROM seen"""
