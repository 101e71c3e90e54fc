"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from . import audit, chat, vectors, warc
from .audit import op12_filter_audit
from .chat import op3_chat
from .decontaminate import op4_decontamination
from .language import op13_language
from .licenses import op1_licenses
from .linededup import op8_line_dedup
from .packing import op7_packing
from .quality import op10_quality
from .sharding import op6_sharding
from .simhash import op9_simhash
from .toxicity import op2_toxicity
from .vectors import op11_vectors
from .warc import op5_warc

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_chat": op3_chat,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_vectors": op11_vectors,
    "op12_filter_audit": op12_filter_audit,
    "op13_language": op13_language,
}

SQL: dict[str, str] = {**chat.SQL, **warc.SQL, **vectors.SQL, **audit.SQL}
