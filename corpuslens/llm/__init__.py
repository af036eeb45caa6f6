"""Operators for preparing training text; nothing else in the library imports this package."""

from __future__ import annotations

from corpuslens.llm import exact_dedup, neighbours, packing, pieces, runs, secrets, simhash, suffix_dedup, token_counts, token_files, toxicity, warc, whitening


def queries() -> dict:
    """Queries over the given tables, one for each operator."""
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_sampled_pieces": pieces.op2_sampled_pieces,
        "op3_secret_ledger": secrets.op3_secret_ledger,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_block_neighbours": neighbours.op5_block_neighbours,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_simhash": simhash.op7_simhash,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_warc": warc.op9_warc,
        "op10_token_files": token_files.op10_token_files,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of those that SQL can express."""
    return {"op3_secret_ledger": secrets.OP3_SQL, "op5_block_neighbours": neighbours.OP5_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op9_warc": warc.OP9_SQL}
