"""The operators' queries over whole tables, and their SQL twins where SQL can express them."""

from functools import wraps

from airloom.llm import alignment, bpe, classifier, exact, language_model, lines, mixing, packing, rules, sharding, simhash, toxicity, whitening
from airloom.session import configure


def _configured(run):
    @wraps(run)
    def query(spark, sf_dir):
        return run(configure(spark), sf_dir)

    return query


QUERIES = {name: _configured(module.query) for name, module in {
    "op1_mix_to_weights": mixing,
    "op2_exact_dedup": exact,
    "op3_line_dedup": lines,
    "op4_toxicity": toxicity,
    "op5_harmonic_packing": packing,
    "op6_kneser_ney": language_model,
    "op7_feistel_shards": sharding,
    "op8_importance_resampling": classifier,
    "op9_simhash_near_dedup": simhash,
    "op10_divergence_rules": rules,
    "op11_token_alignment": alignment,
    "op12_trie_bpe": bpe,
    "op13_embedding_whitening": whitening,
}.items()}

ORACLE_SQL = {
    "op1_mix_to_weights": mixing.SQL,
    "op2_exact_dedup": exact.SQL,
    "op3_line_dedup": lines.SQL,
}
