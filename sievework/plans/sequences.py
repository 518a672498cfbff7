"""Queries of tokens, packing, shards, batch orders and conversations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schema
from sievework.operators import batches, chat, dedup, packs, splits, tokens
from sievework.sources import sinks, storage
from sievework.plans.shared import FIRST, LIMIT, byte_values_sql, documents, table

PER_SHARD, BATCH, CONTEXT = 64, 8, 700


def _joined(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", tokens.byte_tokens("text", eos=True).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("n"), _joined(F.col("ids")).alias("ids_hash"))


def byte_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("ids", tokens.byte_tokens("text"))
    return rows.select("doc_id", (tokens.byte_text("ids") == F.col("text")).alias("same"))


def _ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ribbons of the sound first copies; texts stay where they are."""
    kept = dedup.first_keys(documents(spark, sf_dir), n=(tokens.byte_count(F.col("text")) + 1).cast("long"))
    return packs.placed(splits.split_documents(kept, 0.1).select("split", "ord", "n"))


def _packed(spark: SparkSession, sf_dir: str, drop_remainder: bool, together: int = 1) -> DataFrame:
    return packs.pack(documents(spark, sf_dir), LIMIT, drop_remainder=drop_remainder, ribbons=_ribbons(spark, sf_dir), together=together)


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, True).select("split", "seq_id", "non_padding_tokens", _joined(F.col("token_ids")).alias("ids_hash"))


def pack_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, False).select("split", "seq_id", "non_padding_tokens", _joined(F.col("token_ids")).alias("ids_hash"))


def pack_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.sequence_spans(_ribbons(spark, sf_dir), LIMIT).withColumnRenamed("ord", "doc_id")


def _shards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packed sequences written as shards and read back, checked against their manifest; and the manifest."""
    path = f"{storage.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    manifest = sinks.write_shards(_packed(spark, sf_dir, False, PER_SHARD), path, PER_SHARD, grouped=True)
    return sinks.read_shards(spark, path, LIMIT), manifest


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, seq_id, non_padding_tokens) of what was packed."""
    return _shards(spark, sf_dir)[0].select("split", F.col("seq_id").cast("long").alias("seq_id"), F.col("non_padding_tokens").cast("int").alias("non_padding_tokens"))


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir)[1].drop("sha256")


def shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence's index, counted from the end, to shard and row."""
    rows, manifest = _shards(spark, sf_dir)
    return packs.locate(rows.select("split", (-1 - F.col("seq_id")).alias("index")), manifest)


def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.epoch_order(documents(spark, sf_dir).select("doc_id"), "doc_id", 71, 1)


def batch_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _sequences(spark, sf_dir).where("split = 'train'").withColumnRenamed("seq_id", "position")
    mask = F.array_join(F.transform(packs.loss_mask(LIMIT, F.col("non_padding_tokens")), lambda m: m.cast("int").cast("string")), "")
    return batches.batched(ordered, BATCH).select("batch", "slot", "position", F.sha2(mask, 256).alias("mask_hash"))


def batch_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _sequences(spark, sf_dir).where("split = 'train'").withColumnRenamed("seq_id", "position")
    return batches.batched(ordered, BATCH, drop_last=True).select("batch", "slot", "position")


def worker_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What worker 1 of 3 reads."""
    return batches.of_worker(_sequences(spark, sf_dir), 1, 3).select("split", "seq_id")


def cursor_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an epoch after 40 sequences."""
    return batches.resume(epoch_shuffle(spark, sf_dir), 40)


def shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir).where("split = 'train'").select(F.floor(F.col("seq_id") / PER_SHARD).alias("shard"), "seq_id")
    return batches.shuffled_rows(rows, 91, 0)


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def conversation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", F.size("messages").alias("messages"), F.array_join(F.col("messages.role"), ",").alias("roles"))


def conversation_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", chat.conversation_hash(F.col("messages")).alias("content_hash"))


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", chat.render(F.col("messages"), True).alias("rendered"))


def sft_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", chat.record_violation(F.col("messages")).alias("violation"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).where(chat.record_violation(F.col("messages")).isNull())


def sft_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select("conv_id", chat.fit_example(F.col("messages"), CONTEXT).alias("dropped"))


def chat_fit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts are conversations without their last answer."""
    m = F.col("messages")
    prompt = F.when(F.element_at(m, -1)["role"] == "assistant", F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m)
    prompts = _valid(spark, sf_dir).withColumn("messages", prompt)
    return prompts.select("conv_id", chat.fit_prompt(F.col("messages"), CONTEXT).alias("dropped"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _valid(spark, sf_dir).withColumn("k", chat.fit_example(F.col("messages"), CONTEXT)).where("k is not null")
    return fitted.select("conv_id", chat.encode_example(chat.without_pairs(F.col("messages"), F.col("k"))).alias("tokens"))


def sft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("tokens")
    graded = F.filter(x, lambda y: y["mask"])
    return _examples(spark, sf_dir).select("conv_id", F.size("tokens").alias("n"), F.size(graded).alias("graded"), _joined(F.transform(x, lambda y: y["id"])).alias("ids_hash"), _joined(F.transform(graded, lambda y: y["id"])).alias("graded_hash"))


def sft_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.pack_examples(_examples(spark, sf_dir), LIMIT, "conv_id")
    return rows.select("seq_id", _joined(F.col("token_ids")).alias("ids_hash"), F.size(F.filter("loss_mask", lambda m: m)).alias("graded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        byte_tokens, byte_round_trip, pack_sequences, pack_remainder, pack_spans, shard_manifest, shard_index, epoch_shuffle, batch_assembly, batch_grouping, worker_shard, cursor_resume, shard_shuffle,
        conversation_scan, conversation_hash, chat_render, sft_valid, sft_truncate, chat_fit_context, sft_mask, sft_pack,
    )
}

_ID = byte_values_sql("('0x' || b)::INT")
_BYTES = "regexp_extract_all(hex(encode(text)), '..')"
_IDS = f"""ids AS (
    SELECT split, start + i - 1 AS p, {_ID} AS id FROM (SELECT split, start, unnest({_BYTES}) AS b, generate_subscripts({_BYTES}, 1) AS i FROM ribbon)
    UNION ALL SELECT split, start + n - 1, {schema.EOS} FROM ribbon),
  packed AS (SELECT split, p // {LIMIT} AS seq_id, count(*)::INT AS non_padding_tokens, string_agg(id::VARCHAR, ',' ORDER BY p) AS ids FROM ids GROUP BY 1, 2)"""
_SEQUENCES = f"""seqs AS (SELECT split, seq_id, least({LIMIT}, t - seq_id * {LIMIT})::INT AS non_padding_tokens FROM (
    SELECT split, t, unnest(range((t - 1) // {LIMIT} + 1)) AS seq_id FROM (SELECT split, sum(n)::BIGINT AS t FROM ribbon GROUP BY split)))"""
_SHARDS = f"""shards AS (SELECT split, seq_id // {PER_SHARD} AS shard, count(*) AS sequences, sum(non_padding_tokens)::BIGINT AS non_padding_tokens FROM seqs GROUP BY 1, 2),
  ends AS (SELECT *, (sum(sequences) OVER (PARTITION BY split ORDER BY shard))::BIGINT AS end_index FROM shards)"""
_EPOCH = "SELECT doc_id, row_number() OVER (ORDER BY sha256('71:1:' || doc_id), doc_id) - 1 AS position FROM documents"
_TALK = """talk AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
  body AS (SELECT conv_id, m, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS r, CASE WHEN m[1].role = 'system' THEN 1 ELSE 0 END AS s FROM talk),
  checked AS (SELECT *, CASE WHEN len(list_filter(m, lambda x: x.role NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'role'
      WHEN len(list_filter(m, lambda x: trim(coalesce(x.text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '')) > 0 THEN 'blank' WHEN len(r) = 0 THEN 'no_user'
      WHEN list_transform(r, lambda x: x.role) <> list_transform(range(len(r)), lambda i: CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) THEN 'alternation'
      WHEN m[-1].role <> 'assistant' THEN 'no_answer' END AS violation FROM body)"""


def _fit_sql(source: str, extra: int, least: int) -> str:
    """For each conversation the least number of pairs to drop, or null."""
    return f"""SELECT conv_id, min(k) FILTER (fits)::INT AS dropped FROM (
        SELECT conv_id, k, {extra} + coalesce(list_sum(list_transform(m[:s], lambda x: strlen(x.text) + 4)), 0) + coalesce(list_sum(list_transform(r[2 * k + 1:], lambda x: strlen(x.text) + 4)), 0) <= {CONTEXT} AS fits
        FROM (SELECT *, unnest(range(CASE WHEN len(r) >= {least} THEN (len(r) - {least}) // 2 + 2 ELSE 1 END)) AS k FROM {source})) GROUP BY conv_id"""


_ROLE_ID = " ".join(f"WHEN '{r}' THEN {schema.SPECIAL_ID[f'<|{r}|>']}" for r in schema.ROLES)
_BREAK = chat.BREAK_ID
_EXAMPLES = f"""{_TALK}, good AS (SELECT * FROM checked WHERE violation IS NULL), fit AS ({_fit_sql('good', 1, 4)}),
  msgs AS (SELECT conv_id, unnest(mm) AS x, generate_subscripts(mm, 1) AS i FROM (SELECT conv_id, m[:s] || r[2 * dropped + 1:] AS mm FROM good JOIN fit USING (conv_id) WHERE dropped IS NOT NULL)),
  toks AS (
    SELECT conv_id, 0 AS i, 0 AS j, {schema.BOS} AS id, false AS mask FROM (SELECT DISTINCT conv_id FROM msgs)
    UNION ALL SELECT conv_id, i, 0, CASE x.role {_ROLE_ID} END, false FROM msgs
    UNION ALL SELECT conv_id, i, 1, {_BREAK}, x.role = 'assistant' FROM msgs
    UNION ALL SELECT conv_id, i, 1 + j, {_ID}, mask FROM (SELECT conv_id, i, x.role = 'assistant' AS mask, unnest(regexp_extract_all(hex(encode(x.text)), '..')) AS b, generate_subscripts(regexp_extract_all(hex(encode(x.text)), '..'), 1) AS j FROM msgs)
    UNION ALL SELECT conv_id, i, 2 + strlen(x.text), {schema.EOS}, x.role = 'assistant' FROM msgs
    UNION ALL SELECT conv_id, i, 3 + strlen(x.text), {_BREAK}, false FROM msgs)"""
_RENDER = "string_agg('<|' || role || '|>' || chr(10) || text || '<|eos|>' || chr(10), '' ORDER BY turn)"

SQL: dict[str, str] = {
    "byte_tokens": f"""SELECT doc_id, count(*)::INT AS n, sha256(string_agg(id::VARCHAR, ',' ORDER BY i)) AS ids_hash FROM (
        SELECT doc_id, i, {_ID} AS id FROM (SELECT doc_id, unnest({_BYTES}) AS b, generate_subscripts({_BYTES}, 1) AS i FROM documents) UNION ALL SELECT doc_id, 1000000000000, {schema.EOS} FROM documents) GROUP BY doc_id""",
    "byte_round_trip": "SELECT doc_id, true AS same FROM documents",
    "pack_sequences": f"WITH {FIRST}, {_IDS} SELECT split, seq_id, non_padding_tokens, sha256(ids) AS ids_hash FROM packed WHERE non_padding_tokens = {LIMIT}",
    "pack_remainder": f"WITH {FIRST}, {_IDS} SELECT split, seq_id, non_padding_tokens, sha256(ids || repeat(',0', {LIMIT} - non_padding_tokens)) AS ids_hash FROM packed",
    "pack_spans": f'WITH {FIRST} SELECT split, doc_id, start // {LIMIT} AS first_seq, (start + n - 1) // {LIMIT} AS last_seq, start % {LIMIT} AS "offset" FROM ribbon',
    "shard_manifest": f"WITH {FIRST}, {_SEQUENCES}, {_SHARDS} SELECT split, shard, sequences, non_padding_tokens, end_index, end_index - sequences AS first_index FROM ends",
    "shard_index": f"""WITH {FIRST}, {_SEQUENCES}, z AS (SELECT split, count(*) AS size FROM seqs GROUP BY split)
        SELECT split, -1 - seq_id AS "index", (size - 1 - seq_id) // {PER_SHARD} AS shard, (size - 1 - seq_id) % {PER_SHARD} AS row FROM seqs JOIN z USING (split)""",
    "epoch_shuffle": _EPOCH,
    "batch_assembly": f"""WITH {FIRST}, {_SEQUENCES} SELECT seq_id // {BATCH} AS batch, seq_id % {BATCH} AS slot, seq_id AS position,
        sha256(repeat('1', non_padding_tokens) || repeat('0', {LIMIT} - non_padding_tokens)) AS mask_hash FROM seqs WHERE split = 'train'""",
    "batch_grouping": f"""WITH {FIRST}, {_SEQUENCES} SELECT seq_id // {BATCH} AS batch, seq_id % {BATCH} AS slot, seq_id AS position FROM seqs
        WHERE split = 'train' AND seq_id // {BATCH} < (SELECT count(*) FROM seqs WHERE split = 'train') // {BATCH}""",
    "worker_shard": f"WITH {FIRST}, {_SEQUENCES} SELECT split, seq_id FROM seqs WHERE seq_id % 3 = 1",
    "cursor_resume": f"SELECT * FROM ({_EPOCH}) WHERE position >= 40",
    "conversation_scan": "SELECT conv_id, count(*)::INT AS messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    "conversation_hash": """SELECT conv_id, sha256('[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']') AS content_hash FROM conversations GROUP BY conv_id""",
    "chat_render": f"SELECT conv_id, '<|bos|>' || {_RENDER} || '<|assistant|>' || chr(10) AS rendered FROM conversations GROUP BY conv_id",
    "sft_valid": f"WITH {_TALK} SELECT conv_id, violation FROM checked",
    "sft_truncate": f"WITH {_TALK}, good AS (SELECT * FROM checked WHERE violation IS NULL) {_fit_sql('good', 1, 4)}",
    "chat_fit_context": f"WITH {_TALK}, good AS (SELECT conv_id, m, r[:-2] AS r, s FROM checked WHERE violation IS NULL) {_fit_sql('good', 3, 3)}",
    "sft_mask": f"""WITH {_EXAMPLES} SELECT conv_id, count(*)::INT AS n, count(*) FILTER (mask)::INT AS graded, sha256(string_agg(id::VARCHAR, ',' ORDER BY i, j)) AS ids_hash,
        sha256(coalesce(string_agg(id::VARCHAR, ',' ORDER BY i, j) FILTER (mask), '')) AS graded_hash FROM toks GROUP BY conv_id""",
    "sft_pack": f"""WITH {_EXAMPLES}, o AS (SELECT *, row_number() OVER (ORDER BY conv_id, i, j) - 1 AS p FROM toks)
        SELECT p // {LIMIT} AS seq_id, sha256(string_agg(id::VARCHAR, ',' ORDER BY p) || repeat(',0', {LIMIT} - count(*)::INT)) AS ids_hash, count(*) FILTER (mask)::INT AS graded FROM o GROUP BY 1""",
}
