"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .archives import ORACLE_SQL as WARC_SQL
from .archives import op6_warc
from .audio import op10_audio
from .bpe_reuse import op5_bpe
from .decontaminate import ORACLE_SQL as DECONTAMINATE_SQL
from .decontaminate import op8_decontaminate
from .negatives import ORACLE_SQL as NEGATIVES_SQL
from .negatives import op13_negatives
from .passages import op2_passages
from .permutations import op12_permutations
from .pii import op9_pii
from .quality import op3_quality
from .ranked import ORACLE_SQL as RANKED_SQL
from .ranked import op11_ranked
from .simhash import op4_simhash
from .simple8b import op1_simple8b
from .suffixes import op7_suffixes


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_simple8b, op2_passages, op3_quality, op4_simhash, op5_bpe, op6_warc, op7_suffixes, op8_decontaminate, op9_pii, op10_audio, op11_ranked, op12_permutations, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": WARC_SQL, "op8_decontaminate": DECONTAMINATE_SQL, "op11_ranked": RANKED_SQL, "op13_negatives": NEGATIVES_SQL}
