"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, embeddings, lines, mixing, quality, simhash, suffixes, tokens, warc

QUERIES = {f.__name__: f for f in (quality.op1_repetition_quality, tokens.op2_token_range_coder, bpe.op3_bpe_segment_tree, chat.op4_chat_trees, suffixes.op5_suffix_merge, mixing.op6_mix_sources, simhash.op7_simhash_pivots, warc.op8_warc_zip, lines.op9_line_dedup, embeddings.op10_embedding_itq)}
SQL = {"op1_repetition_quality": quality.SQL, "op4_chat_trees": chat.SQL, "op6_mix_sources": mixing.SQL, "op8_warc_zip": warc.SQL, "op9_line_dedup": lines.SQL}
