"""All registered queries of the subpackage."""

import corpus_pipeline
from jointwork.llm import (  # noqa: F401
    best_fit,
    centroids,
    decontamination,
    fingerprints,
    jaccard_join,
    license_scan,
    norm_search,
    personal_data,
    resampling,
    suffix_dedup,
    token_store,
    toxicity,
    warc,
)
from jointwork.llm.registry import ORACLES, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
