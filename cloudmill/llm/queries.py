"""The registered queries of this subpackage and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudmill.llm import line_dedup, source_divergence
from cloudmill.llm.embedding_dedup import op2_embedding_near_dedup
from cloudmill.llm.fingerprint import op7_document_fingerprints
from cloudmill.llm.jaccard_join import op4_ngram_jaccard_join
from cloudmill.llm.language_model import op3_lm_scoring
from cloudmill.llm.license_scan import op6_license_scan
from cloudmill.llm.packing import op1_best_fit_packing
from cloudmill.llm.pieces import op10_sentencepiece
from cloudmill.llm.quality import op9_quality_classifier
from cloudmill.llm.resampling import op12_importance_resampling
from cloudmill.llm.secret_scan import op8_secret_scan
from cloudmill.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op11_source_divergence": source_divergence.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
