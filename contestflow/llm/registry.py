"""Queries of this subpackage and their SQL."""

from . import audit, bpe, chat, fim, minhash, mixing, packing, quality, shards, suffixes, urls, vectors, warc

QUERIES = {
    "op1_embedding_dedup": vectors.op1_embedding_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_token_shards": shards.op4_token_shards,
    "op5_warc": warc.op5_warc,
    "op6_minhash_dedup": minhash.op6_minhash_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_url_filter": urls.op8_url_filter,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_bpe": bpe.op11_bpe,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLES = {
    "op1_embedding_dedup": vectors.OP1_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
