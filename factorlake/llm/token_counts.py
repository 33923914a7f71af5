"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.pieces import balanced, divisible, encoder, split_safely, strings
from factorlake.llm.scratch import bounded_batches

#: Characters of a part that a long text is split into.
PART = 1 << 18


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit) of every row.

    Tokens are those of the tokenizers library for the byte-level BPE file at `tokenizer_path`
    (on every machine), without added special tokens; special strings inside texts are treated
    as by its default. Null and empty texts have 0 bytes and tokens; null ids and repeated rows
    pass through row by row; an empty table gives an empty table; other columns are not carried.

    Arrow batches are bounded in bytes, are encoded in groups of about a million bytes,
    texts longer than PART in parts cut at safe boundaries, and only lengths go back.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, parted = encoder(tokenizer_path, "count"), divisible(tokenizer_path)
        for b in batches:
            texts = strings(b.column(1))
            parts, owner = [], []
            for i, t in enumerate(texts):
                for p in split_safely(t, PART) if parted else [t]:
                    parts.append(p)
                    owner.append(i)
            totals, at = [0] * len(texts), 0
            for group in balanced(parts):
                for lengths in count(group):
                    totals[owner[at]] += sum(lengths)
                    at += 1
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(totals, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    counted = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
