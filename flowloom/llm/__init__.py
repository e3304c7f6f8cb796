"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import bpe, hard_negatives, html_text, lattice_lm, line_frequency, nn_descent, packing, pii, simhash, suffix_dedup, toxicity, turn_repair, warc

#: Query name -> module with ``query(spark, sf_dir)`` and, where SQL can say it, ``ORACLE``.
MODULES = {
    "op1_weak_pii": pii,
    "op2_text_density": html_text,
    "op3_simhash_blocks": simhash,
    "op4_line_frequency": line_frequency,
    "op5_nb_char_ngrams": toxicity,
    "op6_differencing_packing": packing,
    "op7_warc_source": warc,
    "op8_lattice_lm": lattice_lm,
    "op9_forced_bpe": bpe,
    "op10_nn_descent": nn_descent,
    "op11_pca_negatives": hard_negatives,
    "op12_prefix_doubling": suffix_dedup,
    "op13_cost_layers": turn_repair,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if hasattr(module, "ORACLE")}
