"""Queries of the corpus operators and the SQL that some of them are held against."""

from colloq.llm.decontaminate import op7_template_decontamination
from colloq.llm.fingerprints import op12_syncmer_fingerprints
from colloq.llm.language import op2_viterbi_language
from colloq.llm.lm_score import op8_deleted_interpolation
from colloq.llm.media import op5_media_columns
from colloq.llm.near_dup import op9_minhash_near_dedup
from colloq.llm.packing import op6_best_fit_packing
from colloq.llm.pii import op3_weak_supervision_pii
from colloq.llm.quality import op1_knn_quality
from colloq.llm.ranks import OP11_SQL, op11_grouped_ranking
from colloq.llm.resample import OP13_SQL, op13_importance_resampling
from colloq.llm.substrings import op4_suffix_dedup
from colloq.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_knn_quality": op1_knn_quality,
    "op2_viterbi_language": op2_viterbi_language,
    "op3_weak_supervision_pii": op3_weak_supervision_pii,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_deleted_interpolation": op8_deleted_interpolation,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_grouped_ranking": op11_grouped_ranking,
    "op12_syncmer_fingerprints": op12_syncmer_fingerprints,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {
    "op10_url_filter": OP10_SQL,
    "op11_grouped_ranking": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
