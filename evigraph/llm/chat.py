"""Chat formatting by prefix-target expansion: each assistant turn becomes an example of its own, with all turns before it
as context and only its own text under the loss mask.

A turn is written `### role: text </turn>` and a line feed. In roles and texts a backslash is put before every backslash,
`#` and `<` (in roles also before `:`), so that no text can hold a marker, and escaping can be undone exactly.

A conversation's turns are sorted by turn, role and text and read one after the other; memory holds one conversation's
text. Its output is as long as its prefixes together, which grows with the square of its turns; that is what the method
asks for. Turns after the last assistant turn, or a conversation without one, give one last example without a target, so
that nothing is lost.

Rows: a null text or role is an empty one; a null conversation id is a conversation of its own; repeated rows are turns
like any other; turns of one number come by role, then text; texts are taken whole, whatever their length; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import arrow_stage

TURN = re.compile(r"### ((?:\\.|[^\\#<:])*): ((?:\\.|[^\\#<])*) </turn>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"[\\#<:]" if role else r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns; ValueError if anything else is in the way."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def expand(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per example: id, example (from 0), text, and the loss mask's loss_start and loss_end (null without a target)."""
    source = df.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    ordered = source.repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def rows(batches):
        at, parts, length, example, fresh = object(), [], 0, 0, False
        for b in batches:
            for c, role, text in zip(b["c"], b["r"], b["t"], strict=True):
                if c != at:
                    if fresh:
                        yield at, example, "".join(parts), None, None
                    at, parts, length, example = c, [], 0, 0
                head, body = f"### {escape(role, True)}: ", escape(text)
                parts.append(f"{head}{body} </turn>\n")
                start = length + len(head)
                length += len(parts[-1])
                fresh = role != target_role
                if not fresh:
                    parts = ["".join(parts)]
                    yield at, example, parts[0], start, start + len(body)
                    example += 1
        if fresh:
            yield at, example, "".join(parts), None, None

    return arrow_stage(ordered.select("c", "r", "t"), f"`{id_col}` long, example long, text string, loss_start long, loss_end long", rows)


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from its examples alone: turns of the longest one, and the texts under the loss masks in order."""

    def rows(batches):
        for b in batches:
            for c, n, text, start, end in zip(b[id_col], b["example"], b["text"], b["loss_start"], b["loss_end"], strict=True):
                turns = read_turns(text)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                yield c, n, len(turns), digest, "" if start is None else unescape(text[start:end]), len(text)

    got = arrow_stage(examples, f"`{id_col}` long, example long, turns long, digest string, loss string, chars long", rows)
    out = got.groupBy(id_col).agg(
        F.max_by("turns", "example").alias("n_turns"),
        F.max_by("digest", "example").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("_loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return out.select(id_col, "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def query(spark, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return read_back(expand(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)))


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, 15 + 2 * length(r) - length(regexp_replace(r, '[\\#<:]', '', 'g')) + 2 * length(t) - length(regexp_replace(t, '[\\#<]', '', 'g')) as chars from c),
p as (select *, sum(chars) over w as upto, row_number() over w as k, count(*) over (partition by conv_id) as turns from n window w as (partition by conv_id order by turn, r, t rows unbounded preceding)),
e as (select *, r = 'assistant' as target, r = 'assistant' or k = turns as example from p),
g as (
  select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by k)) as turns_sha256, coalesce(string_agg(t, '' order by k) filter (where target), '') as loss,
         (sum(upto) filter (where example))::bigint as formatted_chars, count(*) filter (where example) as n_examples from e group by conv_id)
select conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars, n_examples from g
"""
