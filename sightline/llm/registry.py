"""The queries of this package, by name, and their SQL."""

from sightline.llm.bpe import op11_bpe_roundtrip
from sightline.llm.chat import OP9_SQL, op9_chat_formatting
from sightline.llm.decontaminate import op7_decontamination
from sightline.llm.html_text import op4_html_extraction
from sightline.llm.merkle import OP12_SQL, op12_merkle_manifest
from sightline.llm.mixing import op2_mix_sources
from sightline.llm.pii import op5_pii_weak_supervision
from sightline.llm.quality import OP6_SQL, op6_quality_rules
from sightline.llm.simhash import op8_simhash_components
from sightline.llm.suffix_dedup import op3_suffix_array_dedup
from sightline.llm.tokens import op10_training_order
from sightline.llm.trie import OP13_SQL, op13_prefix_trie
from sightline.llm.warc import OP1_SQL, op1_warc_archive

QUERIES = {
    "op1_warc_archive": op1_warc_archive,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii_weak_supervision": op5_pii_weak_supervision,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_simhash_components": op8_simhash_components,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_training_order": op10_training_order,
    "op11_bpe_roundtrip": op11_bpe_roundtrip,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_warc_archive": OP1_SQL,
    "op6_quality_rules": OP6_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
