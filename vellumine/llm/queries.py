"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from vellumine.llm.decontam_qgram import op7_decontam_qgram
from vellumine.llm.histogram_sharding import op4_histogram_sharding
from vellumine.llm.mixing_ipf import op6_mixing_ipf
from vellumine.llm.pii_surrogates import op1_pii_surrogates
from vellumine.llm.quality_rules import ORACLE_OP9, op9_quality_rules
from vellumine.llm.reply_trees import ORACLE_OP8, op8_reply_trees
from vellumine.llm.secret_tests import op5_secret_tests
from vellumine.llm.simhash_golay import op10_simhash_golay
from vellumine.llm.toxicity_segments import op2_toxicity_segments
from vellumine.llm.warc_chunks import ORACLE_OP3, op3_warc_chunks

QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_toxicity_segments": op2_toxicity_segments,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_histogram_sharding": op4_histogram_sharding,
    "op5_secret_tests": op5_secret_tests,
    "op6_mixing_ipf": op6_mixing_ipf,
    "op7_decontam_qgram": op7_decontam_qgram,
    "op8_reply_trees": op8_reply_trees,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_golay": op10_simhash_golay,
}

ORACLE_SQL = {
    "op3_warc_chunks": ORACLE_OP3,
    "op8_reply_trees": ORACLE_OP8,
    "op9_quality_rules": ORACLE_OP9,
}
