"""The corpus operators as registered queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from .alignment import alignment_digest
from .common import table
from .decontaminate import DECONTAMINATE_SQL, decontaminate_digest
from .language_model import score as lm_score
from .licenses import licenses_digest, licenses_sql
from .mixing import MIX_SQL, mix_digest
from .ngram_join import ngram_join_digest
from .prefix_trie import TRIE_SQL, trie
from .quality_rules import quality_digest
from .repeats import REPEATS_SQL, repeats_digest
from .sharding import shard_digest
from .topk import TOPK_SQL, topk_digest
from .toxicity import toxicity_digest
from .warc import WARC_SQL, warc_digest

QUERIES = {
    "op1_license_scan": lambda s, d: licenses_digest(table(s, d, "documents")),
    "op2_ngram_jaccard": lambda s, d: ngram_join_digest(table(s, d, "documents")),
    "op3_mix_sources": lambda s, d: mix_digest(table(s, d, "documents")),
    "op4_repeated_passages": lambda s, d: repeats_digest(table(s, d, "documents")),
    "op5_decontaminate": lambda s, d: decontaminate_digest(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_lm_score": lambda s, d: lm_score(table(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity_digest(table(s, d, "documents"), table(s, d, "labels")),
    "op8_exact_topk": lambda s, d: topk_digest(table(s, d, "embeddings")),
    "op9_warc_revisits": lambda s, d: warc_digest(table(s, d, "pages")),
    "op10_shard": lambda s, d: shard_digest(table(s, d, "documents")),
    "op11_align_tokens": lambda s, d: alignment_digest(table(s, d, "documents")),
    "op12_prefix_trie": lambda s, d: trie(table(s, d, "conversations")),
    "op13_quality_rules": lambda s, d: quality_digest(table(s, d, "documents"), table(s, d, "labels")),
}

SQL = {
    "op1_license_scan": licenses_sql(),
    "op3_mix_sources": MIX_SQL,
    "op4_repeated_passages": REPEATS_SQL,
    "op5_decontaminate": DECONTAMINATE_SQL,
    "op8_exact_topk": TOPK_SQL,
    "op9_warc_revisits": WARC_SQL,
    "op12_prefix_trie": TRIE_SQL,
}
