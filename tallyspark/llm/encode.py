"""Problem 6: the whole corpus as ids of a public tokenizer, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe


def encode_corpus(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "ids") -> DataFrame:
    """(id, ids ARRAY<INT>) for each row of `docs`, without special tokens; null and empty texts give an empty list.

    Map-only: one pass, no shuffle, Arrow batches. Other columns of `docs` aren't read. Ids come once for each row, so a
    repeated row is encoded again.
    """
    path = path or bpe.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flat: list[int] = []
            offsets = np.zeros(len(texts) + 1, np.int32)
            for i, text in enumerate(texts):
                flat += coder.encode(text)
                offsets[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, out])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")


def decode_corpus(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", out: str = "text") -> DataFrame:
    """(id, text) of encoded rows by the incremental state machine; a null list gives a null text."""
    path = path or bpe.default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                machine = coder.decoder()
                texts.append("".join(map(machine.feed, ids)) + machine.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, out])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` string")
