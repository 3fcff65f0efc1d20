"""Column mappings between table layouts, for ``readers.rename``: each is {column there: column here}, in the order of the resulting table."""

from __future__ import annotations

# The layouts' column names, in their order. In the legacy layout gamma takes alpha's place, and delta beta's.
MAPPINGS: dict[str, dict[str, str]] = {
    "raw_to_cells": {
        "id": "id", "epitope": "epitope", "subject": "subject",
        "cdr3a": "cdr3_a_aa", "cdr3b": "cdr3_b_aa",
        "ja_gene": "j_a_gene", "va_gene": "v_a_gene", "jb_gene": "j_b_gene", "vb_gene": "v_b_gene",
    },
    "vdjdb_alpha": {
        "complex.id": "complex_id", "Gene": "gene", "CDR3": "cdr3_a_aa", "V": "v_a_gene", "J": "j_a_gene", "Species": "organism",
        "MHC A": "mhc_a_a", "MHC B": "mhc_a_b", "MHC class": "mhc_a_class",
        "Epitope": "epitope", "Epitope gene": "epitope_gene", "Epitope species": "epitope_species",
        "Reference": "reference", "Method": "method", "Meta": "meta", "CDR3fix": "cdr3fix", "Score": "score",
    },
    "vdjdb_beta": {
        "complex.id": "complex_id", "Gene": "gene", "CDR3": "cdr3_b_aa", "V": "v_b_gene", "J": "j_b_gene", "Species": "organism",
        "MHC A": "mhc_b_a", "MHC B": "mhc_b_b", "MHC class": "mhc_b_class",
        "Epitope": "epitope", "Epitope gene": "epitope_gene", "Epitope species": "epitope_species",
        "Reference": "reference", "Method": "method", "Meta": "meta", "CDR3fix": "cdr3fix", "Score": "score",
    },
    "legacy_to_clones": {
        "clone_id": "clone_id", "subject": "subject", "cdr3a": "cdr3_a_aa", "cdr3b": "cdr3_b_aa", "clone_size": "count", "epitope": "epitope",
        "ja_rep": "j_a_gene", "jb_rep": "j_b_gene", "va_rep": "v_a_gene", "vb_rep": "v_b_gene",
        "cdr3a_nucseq": "cdr3_a_nucseq", "cdr3b_nucseq": "cdr3_b_nucseq",
        "va_countreps": "va_countreps", "ja_countreps": "ja_countreps", "vb_countreps": "vb_countreps", "jb_countreps": "jb_countreps",
        "va_gene": "va_gene", "ja_gene": "ja_gene", "vb_gene": "vb_gene", "jb_gene": "jb_gene",
    },
    "clones_to_legacy": {
        "clone_id": "clone_id", "subject": "subject", "cdr3_a_aa": "cdr3a", "cdr3_b_aa": "cdr3b", "count": "clone_size", "epitope": "epitope",
        "j_a_gene": "ja_rep", "j_b_gene": "jb_rep", "v_a_gene": "va_rep", "v_b_gene": "vb_rep",
        "cdr3_a_nucseq": "cdr3a_nucseq", "cdr3_b_nucseq": "cdr3b_nucseq",
        "va_countreps": "va_countreps", "ja_countreps": "ja_countreps", "vb_countreps": "vb_countreps", "jb_countreps": "jb_countreps",
        "va_gene": "va_gene", "ja_gene": "ja_gene", "vb_gene": "vb_gene", "jb_gene": "jb_gene",
    },
    "clones_to_legacy_alpha": {  # with beta's nucleotides
        "clone_id": "clone_id", "subject": "subject", "cdr3_a_aa": "cdr3a", "count": "clone_size", "epitope": "epitope",
        "j_a_gene": "ja_rep", "v_a_gene": "va_rep", "cdr3_a_nucseq": "cdr3a_nucseq", "cdr3_b_nucseq": "cdr3b_nucseq",
        "va_countreps": "va_countreps", "ja_countreps": "ja_countreps", "va_gene": "va_gene", "ja_gene": "ja_gene",
    },
    "clones_to_legacy_beta": {
        "clone_id": "clone_id", "subject": "subject", "cdr3_b_aa": "cdr3b", "count": "clone_size", "epitope": "epitope",
        "j_b_gene": "jb_rep", "v_b_gene": "vb_rep", "cdr3_b_nucseq": "cdr3b_nucseq",
        "vb_countreps": "vb_countreps", "jb_countreps": "jb_countreps", "vb_gene": "vb_gene", "jb_gene": "jb_gene",
    },
    "clones_to_legacy_gamma": {
        "clone_id": "clone_id", "subject": "subject", "cdr3_g_aa": "cdr3a", "count": "clone_size", "epitope": "epitope",
        "j_g_gene": "ja_rep", "v_g_gene": "va_rep", "cdr3_g_nucseq": "cdr3a_nucseq",
        "va_countreps": "va_countreps", "ja_countreps": "ja_countreps", "va_gene": "va_gene", "ja_gene": "ja_gene",
    },
    "clones_to_legacy_delta": {
        "clone_id": "clone_id", "subject": "subject", "cdr3_d_aa": "cdr3b", "count": "clone_size", "epitope": "epitope",
        "j_d_gene": "jb_rep", "v_d_gene": "vb_rep", "cdr3_d_nucseq": "cdr3b_nucseq",
        "vb_countreps": "vb_countreps", "jb_countreps": "jb_countreps", "vb_gene": "vb_gene", "jb_gene": "jb_gene",
    },
    "clones_to_legacy_gamma_delta": {
        "clone_id": "clone_id", "subject": "subject", "cdr3_g_aa": "cdr3a", "cdr3_d_aa": "cdr3b", "count": "clone_size", "epitope": "epitope",
        "j_g_gene": "ja_rep", "j_d_gene": "jb_rep", "v_g_gene": "va_rep", "v_d_gene": "vb_rep",
        "cdr3_g_nucseq": "cdr3a_nucseq", "cdr3_d_nucseq": "cdr3b_nucseq",
        "va_countreps": "va_countreps", "ja_countreps": "ja_countreps", "vb_countreps": "vb_countreps", "jb_countreps": "jb_countreps",
        "va_gene": "va_gene", "ja_gene": "ja_gene", "vb_gene": "vb_gene", "jb_gene": "jb_gene",
    },
    "clones_to_legacy_gamma_delta_own_letters": {
        "clone_id": "clone_id", "subject": "subject", "cdr3_g_aa": "cdr3a", "cdr3_d_aa": "cdr3b", "count": "clone_size", "epitope": "epitope",
        "j_g_gene": "ja_rep", "j_d_gene": "jb_rep", "v_g_gene": "va_rep", "v_d_gene": "vb_rep",
        "cdr3_g_nucseq": "cdr3a_nucseq", "cdr3_d_nucseq": "cdr3b_nucseq",
        "vg_countreps": "va_countreps", "jg_countreps": "ja_countreps", "vd_countreps": "vb_countreps", "jd_countreps": "jb_countreps",
        "vg_gene": "va_gene", "jg_gene": "ja_gene", "vd_gene": "vb_gene", "jd_gene": "jb_gene",
        "va_countreps": "va_countreps", "ja_countreps": "ja_countreps", "vb_countreps": "vb_countreps", "jb_countreps": "jb_countreps",
        "va_gene": "va_gene", "ja_gene": "ja_gene", "vb_gene": "vb_gene", "jb_gene": "jb_gene",
    },
    "clones_to_motif": {
        "subject": "subject", "epitope": "epitope", "v_a_gene": "va_rep", "j_a_gene": "ja_rep", "v_b_gene": "vb_rep", "j_b_gene": "jb_rep",
        "cdr3_a_aa": "cdr3a", "cdr3_b_aa": "cdr3b",
    },
    "subset_to_motif": {
        "subject": "subject", "epitope": "epitope", "v_a_gene": "va_rep", "j_a_gene": "ja_rep", "v_b_gene": "vb_rep", "j_b_gene": "jb_rep",
        "cdr3_a_aa": "cdr3a", "cdr3_b_aa": "cdr3b",
    },
    "subset_to_motif_all_chains": {
        "subject": "subject", "epitope": "epitope",
        "v_a_gene": "va_rep", "v_g_gene": "va_rep", "j_a_gene": "ja_rep", "j_g_gene": "ja_rep",
        "v_b_gene": "vb_rep", "v_d_gene": "vb_rep", "j_b_gene": "jb_rep", "j_d_gene": "jb_rep",
        "cdr3_a_aa": "cdr3a", "cdr3_g_aa": "cdr3a", "cdr3_b_aa": "cdr3b", "cdr3_d_aa": "cdr3b",
    },
}
