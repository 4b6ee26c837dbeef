"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import oracles
from .bpe import op10_bpe
from .decontaminate import op4_decontaminate
from .divergence import op13_divergence
from .media import op2_media
from .merkle import op11_merkle
from .minhash import op12_minhash
from .quality import op6_quality
from .sharding import op3_sharding
from .simhash import op7_simhash
from .suffix_array import op9_suffix_array
from .suffix_trees import op1_substring_dedup
from .toxicity import op8_toxicity
from .urls import op5_urls

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_media, op3_sharding, op4_decontaminate, op5_urls, op6_quality, op7_simhash, op8_toxicity, op9_suffix_array, op10_bpe, op11_merkle, op12_minhash, op13_divergence)}
ORACLE_SQL = {"op1_substring_dedup": oracles.OP1, "op5_urls": oracles.OP5, "op11_merkle": oracles.OP11, "op12_minhash": oracles.OP12, "op13_divergence": oracles.OP13}
