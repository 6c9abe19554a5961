"""Queries and SQL of the operators, by the names that the driver uses."""

from __future__ import annotations

from . import bpe_automaton, bwt_dedup, directly_addressable, edit_embedding, html_extract, jaccard_join, merkle_manifest, mixing, progressive_jpeg, secrets, suffix_tree, toxicity

QUERIES = {
    "op2_suffix_tree": suffix_tree.query,
    "op1_progressive_jpeg": progressive_jpeg.query,
    "op3_mix_sources": mixing.query,
    "op4_bpe_automaton": bpe_automaton.query,
    "op5_secret_scan": secrets.query,
    "op6_toxicity": toxicity.query,
    "op7_edit_embedding": edit_embedding.query,
    "op8_bwt_dedup": bwt_dedup.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_directly_addressable": directly_addressable.query,
    "dac_lookup": directly_addressable.lookup_query,
    "op11_html_extract": html_extract.query,
    "op12_merkle_manifest": merkle_manifest.query,
}

ORACLES = {
    "op8_bwt_dedup": bwt_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
}
