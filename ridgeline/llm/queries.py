"""Every query of the subpackage; importing the modules registers them."""

from ridgeline.llm import (  # noqa: F401
    decontamination,
    divergence,
    language,
    licenses,
    mixing,
    ngram_join,
    quality,
    sharding,
    suffix_dedup,
    token_counts,
    topk,
    warc,
    whitening,
)
from ridgeline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
