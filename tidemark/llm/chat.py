r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are its context, and only its reply is trainable.
A conversation's formatted text is kept once, a segment to a turn, and an example is a slice of it: characters
``[0, context_chars)`` are its context and ``[loss_start, loss_end)`` its reply. So the output grows with the turns and not
with their square, and a conversation of any length is a stream of rows. ``materialise_examples`` writes the slices out; ``read_back`` reads every
example's prompt as a digest that goes on from turn to turn, so that each context is checked without being written out.

A segment is ``### role: text</turn>\n``. Inside role and text, ``\``, ``#`` and ``<`` get a backslash (in a role ``:`` too), so no
text can hold a control string, and removing the backslashes gives the text back.

Null roles and texts count as empty. Rows of equal conv_id and turn are ordered by role, then text; null keys come
first, and rows of a null conv_id are one conversation. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .texts import table

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _escaped(c: Column, controls: str) -> Column:
    return F.regexp_replace(c, controls, r"\\$0")


def prefix_examples(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """A row for each turn of ``turns`` (conv_id, turn, role, text).

    conv_id, seq (from 0), segment, context_chars (characters of the segments before it), example (from 0; null for a turn
    that is only context), loss_start and loss_end (positions in the conversation's formatted text; null likewise).
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN), _escaped(F.col("role"), r"[\\#<:]"), F.lit(MIDDLE))
    target = F.col("role") == trained
    rows = rows.select("*", head.alias("head"), _escaped(F.col("text"), r"[\\#<]").alias("body"))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat("head", "body", F.lit(CLOSE)).alias("segment"), F.length("head").cast("long").alias("h"), F.length("body").cast("long").alias("b"))
    rows = rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "segment",
        F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("long").alias("context_chars"),
        F.when(target, F.coalesce(F.count_if(target).over(before), F.lit(0))).alias("example"),
        "h",
        "b",
    )
    start = F.when(F.col("example").isNotNull(), F.col("context_chars") + F.col("h"))
    return rows.select("conv_id", "seq", "segment", "context_chars", "example", start.alias("loss_start"), (start + F.col("b")).alias("loss_end"))


def materialise_examples(examples: DataFrame) -> DataFrame:
    """conv_id, example, prompt, completion, with the whole context in each prompt: its size is quadratic in a conversation's turns."""
    target = examples.where("example is not null").select("conv_id", "example", "seq", "segment", F.col("context_chars"), F.col("loss_start"), F.col("loss_end"))
    past = examples.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), F.col("segment").alias("text"))
    pairs = target.join(past, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("s") < F.col("seq")), "left")
    grouped = pairs.groupBy("conv_id", "example").agg(
        F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "text")))).alias("past"),
        F.first("segment").alias("segment"),
        F.first(F.col("loss_start") - F.col("context_chars")).alias("at"),
        F.first(F.col("loss_end") - F.col("loss_start")).alias("n"),
    )
    context = F.concat_ws("", F.transform("past", lambda p: p["text"]))
    return grouped.select("conv_id", "example", F.concat(context, F.expr("substring(segment, 1, cast(at as int))")).alias("prompt"), F.expr("substring(segment, cast(at + 1 as int), cast(n as int))").alias("completion"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError(f"not a turn: {segment[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def read_back(examples: DataFrame) -> DataFrame:
    """What a trainer reads from ``examples``: a row for each conversation, hashed as its turns pass by, so that no conversation is held."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, context_chars long, prompts_sha256 string"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def closed() -> tuple:
            turns, loss, n, chars, size, examples, context, _, prompts = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size, examples, context, prompts.hexdigest()

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(x), type=t) for x, t in zip(zip(*rows), types)], names=names)
        for b in batches:
            done = []
            for conv, segment, context, example, start, end in zip(*(b.column(i).to_pylist() for i in range(6))):
                if state is None or conv != key:
                    if state is not None:
                        done.append(closed())
                    key, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                role, text = read_segment(segment)
                state[0].update(f"{role}\n{text}\n".encode())
                state[2] += 1
                state[4] += len(segment)
                if example is not None:
                    reply = unescape(segment[start - context : end - context])
                    state[1].update(reply.encode())
                    state[3] += len(reply)
                    state[5] += 1
                    state[6] += context
                    prompt = state[7].copy()  # of all segments so far
                    prompt.update(segment[: start - context].encode())
                    state[8].update(f"{prompt.hexdigest()},".encode())
                state[7].update(segment.encode())
            if done:
                yield pack(done)
        if state is not None:
            yield pack([closed()])

    columns = ["conv_id", "segment", "context_chars", "example", "loss_start", "loss_end"]
    return examples.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select(*columns).mapInArrow(run, out)


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(prefix_examples(turns.unionByName(probe)))


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, '### ' || regexp_replace(role, '[\\#<:]', '\\\0', 'g') || ': ' as head, head || regexp_replace(text, '[\\#<]', '\\\0', 'g') || '</turn>' || chr(10) as segment from t),
s as (
  select *, sha256(coalesce(string_agg(segment, '') over (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), '') || head) as prompt,
    coalesce(sum(length(segment)) over (partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as before from e)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(segment)) as bigint) as formatted_chars,
  count(*) filter (where role = 'assistant') as n_examples,
  cast(coalesce(sum(before) filter (where role = 'assistant'), 0) as bigint) as context_chars,
  sha256(coalesce(string_agg(prompt || ',', '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as prompts_sha256
from s group by conv_id
"""
