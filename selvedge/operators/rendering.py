"""Records into chat conversations, training texts and token labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.functions.text import or_empty, record_key

IGNORED = -100


def messages(*turns: tuple[str, Column | str]) -> Column:
    """A message list; a string is a literal content."""
    return F.array(*[F.struct(F.lit(role).alias("role"), (F.lit(c) if isinstance(c, str) else c).alias("content")) for role, c in turns])


def canonical_records(anchors: DataFrame, prefix: str, constants: dict[str, str], operations: list[str]) -> DataFrame:
    """anchors (source, source_record_id, source_locator, language, question, answer) to nested canonical records.

    constants become top-level fields; provenance and the list of operations are kept in structs.
    """
    return anchors.select(
        record_key(prefix, F.col("source"), F.col("source_record_id")).alias("record_id"),
        "language",
        F.col("question").alias("instruction"),
        F.col("answer").alias("response"),
        F.struct(F.col("source").alias("source_dataset"), "source_record_id", "source_locator").alias("source"),
        F.struct(F.array(*map(F.lit, operations)).alias("operations"), F.lit(False).alias("content_truncated")).alias("transformation"),
        *[F.lit(v).alias(k) for k, v in constants.items()],
    )


def render_qa(records: DataFrame, task: str, system: str, held_out: bool = False) -> DataFrame:
    """(record_id, split, messages) of the task's records: all but the test split, or with held_out the test split alone."""
    of = (F.col("task_type") == task) & ((F.col("split") == "test") if held_out else (F.col("split") != "test"))
    return records.where(of).select("record_id", "split", messages(("system", system), ("user", or_empty("instruction")), ("assistant", or_empty("response"))).alias("messages"))


def render_json_turns(records: DataFrame, system: str, context: list[str], target: list[str]) -> DataFrame:
    """(record_id, messages): the context fields as JSON in the user turn, the target fields in the assistant turn, both in name order with nulls."""
    as_json = lambda fields: F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    return records.select("record_id", messages(("system", system), ("user", as_json(context)), ("assistant", as_json(target))).alias("messages"))


def chat_text(turns: Column, open_think: bool = True) -> Column:
    """Chat markup of a message list; assistant turns open with an empty thinking block."""
    think = F.lit("<think>\n\n</think>\n\n") if open_think else F.lit("")
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.when(m["role"] == "assistant", think).otherwise(F.lit("")), or_empty(m["content"]), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, turn), "")


def with_end_token(text: Column, eos: str) -> Column:
    """The text with its last end-of-turn mark replaced by an end token; null when it has no such mark or holds the token already."""
    mark = "<|im_end|>\n"
    ok = F.endswith(text, F.lit(mark)) & ~F.contains(text, F.lit(eos))
    return F.when(ok, F.concat(F.left(text, F.length(text) - len(mark)), F.lit(eos)))


def prompt_and_completion(text: Column, prompt: Column) -> tuple[Column, Column]:
    """(prompt, completion) of a text; completion is null where the text does not start with the prompt or ends there."""
    rest = F.substring(text, F.length(prompt) + 1, F.length(text))
    return prompt, F.when(F.startswith(text, prompt) & (F.length(text) > F.length(prompt)), rest)


def completion_labels(ids: Column, prompt_length: Column) -> Column:
    """Token ids with those of the prompt ignored."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(IGNORED)).otherwise(x))


def labels_are_valid(ids: Column, labels: Column, prompt_length: Column) -> Column:
    """Whether labels ignore exactly the prompt and repeat at least one completion token."""
    return (F.size(ids) > prompt_length) & (labels == completion_labels(ids, prompt_length))
