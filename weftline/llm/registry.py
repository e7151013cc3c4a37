"""Queries of this subpackage and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat
from .decontaminate import op8_decontaminate
from .hmm import UNIGRAM_SQL, op10_hmm, unigram_scores
from .language import op2_language
from .licenses import PLACES_SQL, licence_places, op7_licenses
from .media import PAYLOADS_SQL, media_payloads, op1_media
from .near import OP3_SQL, op3_near
from .packing import op9_packing
from .sharding import OP4_SQL, op4_sharding
from .substrings import OP6_SQL, op6_substrings

QUERIES = {
    "op1_media": op1_media,
    "op2_language": op2_language,
    "op3_near": op3_near,
    "op4_sharding": op4_sharding,
    "op5_chat": op5_chat,
    "op6_substrings": op6_substrings,
    "op7_licenses": op7_licenses,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_hmm": op10_hmm,
    # of three results, the columns that SQL can express
    "media_payloads": media_payloads,
    "licence_places": licence_places,
    "unigram_scores": unigram_scores,
}

ORACLE_SQL = {
    "op3_near": OP3_SQL,
    "op4_sharding": OP4_SQL,
    "op5_chat": OP5_SQL,
    "op6_substrings": OP6_SQL,
    "media_payloads": PAYLOADS_SQL,
    "licence_places": PLACES_SQL,
    "unigram_scores": UNIGRAM_SQL,
}
