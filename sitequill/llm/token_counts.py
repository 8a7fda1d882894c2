"""Token counts by rank-synchronous merging of ragged pre-token arrays.

A chunk's distinct pre-tokens are held as one ragged array of byte symbols;
every round each sequence merges its own lowest-rank pair, all sequences at
once (``bpe.merge_ranks``). What survives is counted: a document's count is
the sum of its pre-tokens' surviving symbols. One narrow pass over the scan,
no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, map_texts


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null text: empty, so 0 bytes and 0 tokens. Repeated rows and null ids are
    counted like any other row; an empty table gives an empty result; other
    columns are not read. Special strings inside a text count as one token.
    """

    def count(texts: list[str]) -> dict:
        from .bpe import encoder

        n = encoder(vocabulary_path).token_counts(texts)
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        return {"n_bytes": sizes, "n_tokens": n, "over_limit": n > limit}

    return map_texts(id_text(docs, id_col, text_col), count, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")])
