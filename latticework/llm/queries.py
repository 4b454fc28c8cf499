"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontaminate
from .infill import OP11_SQL, op11_infill
from .language import op1_language
from .licenses import op10_licenses
from .mixing import OP8_SQL, op8_mixing
from .pii import op2_pii
from .quality import op9_quality
from .secrets import op5_secrets
from .simhash import op4_simhash
from .source_terms import OP12_SQL, op12_source_terms
from .substrings import OP7_SQL, op7_substrings
from .token_counts import op6_token_counts
from .token_files import op13_token_files

QUERIES = {
    "op1_language": op1_language,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_token_counts": op6_token_counts,
    "op7_substrings": op7_substrings,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_infill": op11_infill,
    "op12_source_terms": op12_source_terms,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op7_substrings": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op11_infill": OP11_SQL,
    "op12_source_terms": OP12_SQL,
}
