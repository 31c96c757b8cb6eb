"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

import corpus_pipeline
from corpusloom.llm import ann, divergence, minhash, resampling, warc
from corpusloom.llm.ann import op8_nearest_neighbours
from corpusloom.llm.bytebpe import op6_byte_bpe
from corpusloom.llm.divergence import op13_source_divergence
from corpusloom.llm.langid import op10_language_id
from corpusloom.llm.minhash import op11_minhash_near_dedup
from corpusloom.llm.packing import op7_best_fit_packing
from corpusloom.llm.pii import op4_pii
from corpusloom.llm.resampling import op12_importance_resampling
from corpusloom.llm.sharding import op3_sharding
from corpusloom.llm.simhash import op9_simhash_near_dedup
from corpusloom.llm.spotsigs import op5_spotsigs
from corpusloom.llm.tokencount import op1_token_counts
from corpusloom.llm.warc import op2_warc

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_sharding, op4_pii, op5_spotsigs, op6_byte_bpe, op7_best_fit_packing, op8_nearest_neighbours, op9_simhash_near_dedup, op10_language_id, op11_minhash_near_dedup, op12_importance_resampling, op13_source_divergence)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op2_warc": warc.ORACLE, "op8_nearest_neighbours": ann.ORACLE, "op11_minhash_near_dedup": minhash.ORACLE, "op12_importance_resampling": resampling.ORACLE, "op13_source_divergence": divergence.ORACLE}
