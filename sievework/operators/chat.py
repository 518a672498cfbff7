"""Conversations: validation, hashes, rendering, and masked examples fitted to a context, on arrays of messages in the JVM.

Without merges a message costs its bytes, its role id, its end mark and two line breaks, so fitting needs sizes only.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework import schema
from sievework.functions import text as t
from sievework.operators.ordering import running
from sievework.operators.tokens import LUT

BREAK_ID = int(LUT[10])


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows of (conv_id, turn, role, text)."""
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return packed.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def message_violation(messages: Column) -> Column:
    """The first broken rule, or null: roles, content, a leading system message at most, then user and assistant in turn."""
    roles = F.transform(messages, lambda m: m["role"])
    body = F.when(F.element_at(roles, 1) == "system", F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    turn = lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")
    kept = F.size(F.filter(body, turn))
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "empty")
        .when(F.exists(messages, lambda m: m["role"].isNull() | ~m["role"].isin(*schema.ROLES)), "role")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["content"], F.lit("")).rlike(t.NOT_SPACE)), "blank")
        .when(F.size(body) == 0, "no_user")
        .when(kept != F.size(body), "alternation")
    )


def record_violation(messages: Column, provenance: list[Column] | None = None, content_hash: Column | None = None) -> Column:
    """As message_violation, then: the last message is the assistant's, provenance is there, the hash is right."""
    out = F.coalesce(message_violation(messages), F.when(F.element_at(messages, -1)["role"] != "assistant", "no_answer"))
    for c in provenance or []:
        out = F.coalesce(out, F.when(~F.coalesce(c, F.lit("")).rlike(t.NOT_SPACE), "provenance"))
    return out if content_hash is None else F.coalesce(out, F.when(~content_hash.eqNullSafe(conversation_hash(messages)), "content_hash"))


def conversation_hash(messages: Column) -> Column:
    """SHA-256 of the messages as compact JSON, control characters escaped in lower case."""
    json = F.to_json(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        # A backslash before it would be part of an escaped backslash.
        json = F.regexp_replace(json, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u{code:04X}", f"$1\\\\u{code:04x}")
    return F.sha2(json, 256)


def render(messages: Column, generation_prompt: bool = False) -> Column:
    """The conversation as text with its marks."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(schema.SPECIAL[schema.EOS] + "\n")))
    out = F.concat(F.lit(schema.SPECIAL[schema.BOS]), F.array_join(each, ""))
    return F.concat(out, F.lit("<|assistant|>\n")) if generation_prompt else out


def message_size(message: Column) -> Column:
    """Ids of a message: role, break, content, end mark, break."""
    return F.octet_length(message["content"]) + 4


def dropped_pairs(messages: Column, budget: int, extra: int, least: int) -> Column:
    """How many of the oldest user and assistant pairs go so that the rest fits `budget`; null where it can't.

    `extra` ids come on top of the messages. A pair may go while `least` messages or more besides the system's are left.
    """
    system = F.when(F.element_at(messages, 1)["role"] == "system", 1).otherwise(0)
    body = F.size(messages) - system
    most = F.when(body >= least, F.floor((body - least) / 2) + 1).otherwise(0).cast("int")
    sizes = F.transform(messages, message_size)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) + extra
    gone = lambda k: F.aggregate(F.slice(sizes, system + 1, k * 2), F.lit(0), lambda a, x: a + x)
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: total - gone(k) <= budget)
    return F.when(F.size(fits) > 0, F.element_at(fits, 1))


def without_pairs(messages: Column, pairs: Column) -> Column:
    system = F.when(F.element_at(messages, 1)["role"] == "system", 1).otherwise(0)
    return F.concat(F.slice(messages, F.lit(1), system), F.slice(messages, system + 1 + pairs * 2, F.size(messages)))


def fit_prompt(messages: Column, budget: int) -> Column:
    """Pairs to drop so that a prompt with its generation mark fits: BOS, the messages, and role and break for the answer."""
    return dropped_pairs(messages, budget, 3, 3)


def fit_example(messages: Column, budget: int) -> Column:
    return dropped_pairs(messages, budget, 1, 4)


def _bytes_of(content: Column) -> Column:
    table = F.array(*(F.lit(int(i)) for i in LUT))
    return F.transform(F.regexp_extract_all(F.hex(F.encode(content, "utf-8")), F.lit("[0-9A-F]{2}"), 0), lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1))


def encode_example(messages: Column) -> Column:
    """array<struct<id, mask>>: the mask is true on the assistant's content (with the break before it) and its end mark only."""
    token = lambda i, m: F.struct(i.cast("int").alias("id"), m.alias("mask"))
    roles = F.create_map(*(x for r in schema.ROLES for x in (F.lit(r), F.lit(schema.SPECIAL_ID[f"<|{r}|>"]))))

    def one(m: Column) -> Column:
        mine = m["role"] == "assistant"
        return F.concat(
            F.array(token(roles[m["role"]], F.lit(False)), token(F.lit(BREAK_ID), mine)),
            F.transform(_bytes_of(m["content"]), lambda i: token(i, mine)),
            F.array(token(F.lit(schema.EOS), mine), token(F.lit(BREAK_ID), F.lit(False))),
        )

    return F.concat(F.array(token(F.lit(schema.BOS), F.lit(False))), F.flatten(F.transform(messages, one)))


def pack_examples(examples: DataFrame, length: int, order: str, drop_remainder: bool = False) -> DataFrame:
    """(seq_id, token_ids, loss_mask) of examples (order, tokens): ids and masks are cut at the same places; the rest is filled with padding, unmasked."""
    starts = running(examples.select(order, F.size("tokens").alias("n")), [order], F.col("n"), "start").select(order, "start")
    placed = examples.join(starts, order).select("start", F.posexplode("tokens").alias("at", "x")).select(((F.col("start") + F.col("at"))).alias("p"), "x")
    rows = placed.groupBy(F.floor(F.col("p") / length).alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("t"))
    missing = F.lit(length) - F.size("t")
    out = rows.select("seq_id", F.size("t").alias("n"), F.concat(F.transform("t", lambda y: y["x"]["id"]), F.array_repeat(F.lit(schema.PAD), missing)).alias("token_ids"), F.concat(F.transform("t", lambda y: y["x"]["mask"]), F.array_repeat(F.lit(False), missing)).alias("loss_mask"))
    return (out.where(F.col("n") == length) if drop_remainder else out).drop("n")


def system_prompt(path: str) -> str:
    """A prompt file that isn't blank."""
    text = Path(path).read_text(encoding="utf-8").strip()
    if not text:
        raise ValueError(f"{path} is blank")
    return text


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")
