"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from larkspur.llm import chat, decontaminate, exactdedup, gridjoin, hpyp, linededup, middle, mixing, pii, prefixtrie, quality, simhash, tokens
from larkspur.session import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op2_perspectives": lambda spark, d: chat.perspectives(table(spark, d, "conversations")),
    "op6_fuzzy_lines": lambda spark, d: linededup.fuzzy_lines(table(spark, d, "documents")),
    "op8_epsilon_grid": lambda spark, d: gridjoin.near_duplicates(table(spark, d, "embeddings")),
    "op3_spaced_seeds": lambda spark, d: decontaminate.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_skip_chain": lambda spark, d: pii.personal_data(table(spark, d, "documents")),
    "op4_random_indexing": lambda spark, d: quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op1_pitman_yor": lambda spark, d: hpyp.scores(table(spark, d, "documents")),
    "op7_rans_tokens": lambda spark, d: tokens.token_digests(table(spark, d, "documents"), tokenizer_path()),
    "op9_entropy_balancing": lambda spark, d: mixing.mix(table(spark, d, "documents")).drop("row_key", "rate", "copies"),
    "op10_simhash_trie": lambda spark, d: simhash.simhash_components(table(spark, d, "documents")),
    "op11_two_pass_bloom": lambda spark, d: exactdedup.exact_duplicates(table(spark, d, "documents")),
    "op12_fill_in_middle": lambda spark, d: middle.digests(table(spark, d, "documents")),
    "op13_prefix_trie": lambda spark, d: prefixtrie.prefix_trie(table(spark, d, "conversations")).drop("preorder", "subtree_end"),
}

ORACLE_SQL: dict[str, str] = {"op2_perspectives": chat.ORACLE, "op11_two_pass_bloom": exactdedup.ORACLE, "op12_fill_in_middle": middle.ORACLE, "op13_prefix_trie": prefixtrie.ORACLE}
