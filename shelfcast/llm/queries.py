"""One query per operator, over its whole table, and oracle SQL where SQL can say the same."""

from __future__ import annotations

from shelfcast.llm.bpe import op10_bpe
from shelfcast.llm.divergence import OP11_SQL, op11_divergence
from shelfcast.llm.embedding_dedup import op9_embedding_dedup
from shelfcast.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from shelfcast.llm.mixing import OP6_SQL, op6_mixing
from shelfcast.llm.near_dedup import op2_near_dedup
from shelfcast.llm.records import op3_records
from shelfcast.llm.sharding import op1_sharding
from shelfcast.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from shelfcast.llm.toxicity import op8_toxicity
from shelfcast.llm.turn_repair import op12_turn_repair
from shelfcast.llm.url_filter import OP13_SQL, op13_url_filter
from shelfcast.llm.warc import op5_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_near_dedup": op2_near_dedup,
    "op3_records": op3_records,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_turn_repair": op12_turn_repair,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op11_divergence": OP11_SQL, "op13_url_filter": OP13_SQL}
