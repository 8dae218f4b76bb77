"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat import OP8_SQL, op8_chat
from .collocations import OP12_SQL, op12_collocations
from .decontam import op5_decontamination
from .fm_dedup import op10_fm_dedup
from .langid import op2_langid
from .licenses import op9_licenses
from .merkle import OP11_SQL, op11_merkle
from .minhash import op3_minhash
from .sharding import op1_sharding
from .spotsigs import op6_spotsigs
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op13_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_langid": op2_langid,
    "op3_minhash": op3_minhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_spotsigs": op6_spotsigs,
    "op7_bpe": op7_bpe,
    "op8_chat": op8_chat,
    "op9_licenses": op9_licenses,
    "op10_fm_dedup": op10_fm_dedup,
    "op11_merkle": op11_merkle,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {"op8_chat": OP8_SQL, "op11_merkle": OP11_SQL, "op12_collocations": OP12_SQL}
