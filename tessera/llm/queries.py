"""Registry of the training-data queries: QUERIES and, where SQL can state one, ORACLES."""

from __future__ import annotations

from . import chat_format, cotraining, filter_audit, mixing, packing, phrases, radix_dedup, repetition, secret_ledger, token_groups, token_transducer, toxicity, warc_index

QUERIES = {
    "op1_repetition": repetition.op1_repetition,
    "op2_secret_ledger": secret_ledger.op2_secret_ledger,
    "op3_exact_dedup": radix_dedup.op3_exact_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_jaccard": token_groups.op6_ngram_jaccard,
    "op7_cotraining": cotraining.op7_cotraining,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc_index": warc_index.op10_warc_index,
    "op11_token_transducer": token_transducer.op11_token_transducer,
    "op12_collocations": phrases.op12_collocations,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_repetition": repetition.OP1_SQL,
    "op2_secret_ledger": secret_ledger.OP2_SQL,
    "op3_exact_dedup": radix_dedup.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op6_ngram_jaccard": token_groups.OP6_SQL,
    "op10_warc_index": warc_index.OP10_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
