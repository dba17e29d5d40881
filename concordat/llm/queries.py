"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from . import decontam, fingerprint, hardneg, htmltree, katz, langid, linededup, neardup, packing, pointintime, quality, warc, wavelet

QUERIES = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op2_weak_label_quality": quality.op2_weak_label_quality,
    "op3_one_permutation_minhash": fingerprint.op3_one_permutation_minhash,
    "op4_segmentation_unigrams": langid.op4_segmentation_unigrams,
    "op5_concatenate_and_cut": packing.op5_concatenate_and_cut,
    "op6_wavelet_matrix": wavelet.op6_wavelet_matrix,
    "op7_segment_edit_join": linededup.op7_segment_edit_join,
    "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
    "op9_winnowing": decontam.op9_winnowing,
    "op10_site_style_tree": htmltree.op10_site_style_tree,
    "op11_point_in_time": pointintime.op11_point_in_time,
    "op12_katz_backoff": katz.op12_katz_backoff,
    "op13_norm_bucketed_negatives": hardneg.op13_norm_bucketed_negatives,
}

ORACLE_SQL = {
    "op1_warc_revisits": warc.ORACLE_SQL,
    "op8_minhash_near_dedup": neardup.ORACLE_SQL,
    "op9_winnowing": decontam.ORACLE_SQL,
    "op11_point_in_time": pointintime.ORACLE_SQL,
    "op13_norm_bucketed_negatives": hardneg.ORACLE_SQL,
}
