"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidemill.llm import embedding_dedup, exact_dedup, minhash_dedup, suffix_dedup
from tidemill.llm.bpe_codec import op2_bpe_roundtrip
from tidemill.llm.embedding_dedup import op7_embedding_dedup
from tidemill.llm.exact_dedup import op3_exact_dedup
from tidemill.llm.language_crf import op6_language_crf
from tidemill.llm.minhash_dedup import op5_minhash_dedup
from tidemill.llm.packing import op10_pack_binary
from tidemill.llm.quality import op4_quality
from tidemill.llm.suffix_dedup import op9_suffix_dedup
from tidemill.llm.token_count import op1_token_counts
from tidemill.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_language_crf": op6_language_crf,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pack_binary": op10_pack_binary,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
}
