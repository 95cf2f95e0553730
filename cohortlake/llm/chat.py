"""Chat formatting with Spark expressions only.

Template: a message is ``<|im_start|>role\\ntext<|im_end|>\\n``. Adjacent turns of one role are
merged into one message, their texts kept apart by ``<|im_sep|>``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can occur there; in roles
a line feed becomes ``<\\_``. Both steps can be undone: after them, a single backslash occurs only
after ``<``, where an original one is always doubled.

The loss mask covers assistant texts. It is a run-length list over the turns in output order:
(start, chars, loss) in code points of the formatted string.

Turns are first gathered in blocks of consecutive turn numbers and merged there; a conversation
then meets as one row per block. Its formatted string is one value by definition, so that much
has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Turn numbers per block.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\_"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\_"), F.lit("\n")))


def _merge(runs: str) -> Column:
    """Join neighbours of one role in an array of (role, texts), in time linear in its length."""
    firsts = f"filter(transform({runs}, (x, i) -> if(i = 0 or x.role <> {runs}[i - 1].role, i, -1)), i -> i >= 0)"
    one = f"transform(sequence(0, size(f) - 1), k -> named_struct('role', {runs}[f[k]].role, 'texts', flatten(transform(slice({runs}, f[k] + 1, coalesce(get(f, k + 1), size({runs})) - f[k]), x -> x.texts))))"
    return F.expr(f"transform(array({firsts}), f -> {one})[0]")


def messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, messages): each conversation's turns in order, neighbours of one role merged.

    messages is an array of (role, texts), escaped. Turns are ordered by turn number, then role
    and text; turns without a number come last. Null roles and texts count as empty.
    """
    turn = F.col(turn_col).cast("long")
    block = F.coalesce(turn - F.pmod(turn, F.lit(BLOCK)), F.lit(2**63 - 1))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        block.alias("block"),
        F.struct(turn.alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).alias("row"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    runs = blocks.select("conv_id", "block", F.transform("rows", lambda x: F.struct(escape_role(x.r).alias("role"), F.array(escape(x.t)).alias("texts"))).alias("runs"))
    part = runs.select("conv_id", F.struct("block", _merge("runs").alias("runs")).alias("part"))
    joined = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = joined.select("conv_id", F.expr("flatten(transform(parts, p -> p.runs))").alias("runs"))
    return whole.select("conv_id", _merge("runs").alias("messages"))


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, mask, n_messages): one row per conversation.

    mask has one (skip, chars, loss) per turn in output order: after ``skip`` code points of
    template, ``chars`` code points of escaped text, under the loss if spoken by the assistant.
    Rows with a null conversation id form one conversation; repeated rows are turns of their own.
    An empty table gives an empty result. Other columns are not read.
    """
    made = messages(turns, conv_col, turn_col, role_col, text_col)
    formatted = F.expr(f"array_join(transform(messages, m -> concat('{START}', m.role, '\\n', array_join(m.texts, '{SEP}'), '{END}\\n')), '')")
    skip = f"if(j > 0, {len(SEP)}, if(i > 0, {len(END) + 1}, 0) + {len(START) + 1} + length(m.role))"
    mask = F.expr(f"flatten(transform(messages, (m, i) -> transform(m.texts, (t, j) -> named_struct('skip', {skip}, 'chars', length(t), 'loss', m.role = '{ASSISTANT}'))))")
    return made.select("conv_id", formatted.alias("formatted"), mask.alias("mask"), F.size("messages").cast("long").alias("n_messages"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): parse ``formatted`` strings with their masks.

    turns is an array of (role, text), unescaped; loss_text is what lies in ``formatted`` at the
    places that the mask puts under the loss, unescaped. Where every skip and length of the mask is
    that of the parsed turns, the places are the same, and the parsed texts stand for the slices.
    """
    pieces = F.expr(rf"slice(split(formatted, '\\Q{START}\\E', -1), 2, size(split(formatted, '\\Q{START}\\E', -1)))")
    parsed = formatted.withColumn("pieces", pieces)
    role = "substring_index(p, '\\n', 1)"
    body = f"substring(p, length({role}) + 2, length(p) - length({role}) - {len(END) + 2})"
    lead = f"length(substring_index(formatted, '{START}', 1))"
    skip = f"if(j > 0, {len(SEP)}, if(i > 0, {len(END) + 1}, {lead}) + {len(START) + 1} + length({role}))"
    spoken = F.expr(rf"flatten(transform(pieces, (p, i) -> transform(split({body}, '\\Q{SEP}\\E', -1), (t, j) -> named_struct('role', {role}, 'text', t, 'skip', {skip}))))")
    parsed = parsed.withColumn("spoken", spoken)
    turns = F.transform("spoken", lambda x: F.struct(unescape_role(x.role).alias("role"), unescape(x.text).alias("text")))
    aligned = F.expr("size(spoken) = size(mask) and forall(zip_with(spoken, mask, (x, m) -> m.skip = x.skip and m.chars = length(x.text)), b -> b)")
    parsed_texts = F.expr("transform(filter(zip_with(spoken, mask, (x, m) -> named_struct('loss', m.loss, 'text', x.text)), x -> x.loss), x -> x.text)")
    start = "1 + m.skip + aggregate(slice(mask, 1, i), 0, (a, y) -> a + y.skip + y.chars)"
    slices = F.expr(f"transform(filter(transform(mask, (m, i) -> named_struct('loss', m.loss, 'text', substring(formatted, {start}, m.chars))), x -> x.loss), x -> x.text)")
    masked = F.when(aligned, parsed_texts).otherwise(slices)
    return parsed.select("*", turns.alias("turns"), F.array_join(F.transform(masked, unescape), "").alias("loss_text"))
