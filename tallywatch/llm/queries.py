"""The queries of this folder and their SQL."""

from __future__ import annotations

from tallywatch.llm import fertility, fim, hashtree, katz, kernelquality, langid, linededup, merkle, mixing, packing, repeats, simhash, topk

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_fertility": fertility.op2_fertility,
    "op3_topk": topk.op3_topk,
    "op4_hash_tree": hashtree.op4_hash_tree,
    "op5_simhash": simhash.op5_simhash,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_packing": packing.op7_packing,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_kneser_ney": langid.op9_kneser_ney,
    "op10_katz": katz.op10_katz,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_merkle": merkle.op12_merkle,
    "op13_kernel_quality": kernelquality.op13_kernel_quality,
}

ORACLE = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_topk": topk.OP3_SQL,
    "op4_hash_tree": hashtree.OP4_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
