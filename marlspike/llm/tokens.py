"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

#: Vocabulary file read on every executor; a parameter of each operator that counts.
VOCABULARY = os.environ.get("MARLSPIKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def with_tokens(docs: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of ``text``; null and empty texts have 0.

    Whole texts are counted. Special tokens' strings count as ordinary text. The
    tokenizer is loaded once per Python worker and fed Arrow batches, a few
    texts at a time so that long ones don't pile up.
    """
    schema = docs.select(*keep).schema

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = batch.column(text).to_pylist()
            sizes = [0] * len(texts)
            pending, held = [], 0

            def flush(pending=pending, sizes=sizes, texts=texts):
                for i, e in zip(pending, tokenizer.encode_batch_fast([texts[i] for i in pending], add_special_tokens=False)):
                    sizes[i] = len(e)
                pending.clear()

            for i, t in enumerate(texts):
                if t:
                    pending.append(i)
                    held += len(t)
                    if held > 200_000:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(sizes, pa.int64())], names=[*keep, out]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(count, f"{fields}, `{out}` bigint")
