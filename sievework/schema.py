"""Record schemas, versions and fixed vocabularies of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

PACK_VERSION = "sievework-pack-1"
NEAR_VERSION = "sievework-simhash-1"
CODE_VERSION = "sievework-code-1"
FIM_VERSION = "psm-1"

REQUIRED = ("source", "revision", "license", "language", "record_id")
OPTIONAL = ("path", "split", "parent_content_hash", "transform")
LICENCES = tuple(sorted(("MIT", "Unlicense", "CC0-1.0", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause")))
SPLITS = ("train", "validation", "test")
ROLES = ("system", "user", "assistant")

DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("text", *REQUIRED, "content_hash", "source_type")] + [T.StructField(c, T.StringType()) for c in OPTIONAL]
)
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CONVERSATION = T.StructType(
    [T.StructField("messages", T.ArrayType(MESSAGE))] + [T.StructField(c, T.StringType()) for c in ("source", "revision", "license", "record_id", "content_hash")]
)
FIXTURE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "license", "provenance", "prompt", "reference", "suffix", "tests")])

#: The tokens with fixed ids, from 0 on.
SPECIAL = tuple(f"<|{name}|>" for name in ("pad bos eos system user assistant fim_prefix fim_suffix fim_middle tool_call tool_result".split()))
SPECIAL_ID = {name: i for i, name in enumerate(SPECIAL)}
PAD, BOS, EOS = 0, 1, 2
#: Vocabulary without merges: the special tokens and one id for each byte.
BYTE_VOCABULARY = len(SPECIAL) + 256


def byte_ids() -> list[int]:
    """The id of each byte: printable bytes first, then the others, in order, after the special tokens."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    order = shown + [b for b in range(256) if b not in shown]
    ids = [0] * 256
    for place, b in enumerate(order):
        ids[b] = len(SPECIAL) + place
    return ids
