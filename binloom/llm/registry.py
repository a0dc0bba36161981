"""Queries of the subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from .jaccard import op8_jaccard_join
from .langid import op4_byte_cnn
from .lattice import op2_lattice_likelihood
from .mixing import op3_mixing
from .packing import op7_packing
from .quantised import op6_product_quantisation
from .quality import op5_site_quality
from .revisits import OP9_SQL, op9_revisits
from .secrets import op10_secret_scan
from .winnowing import op1_winnowing


def queries() -> dict:
    return {"op1_winnowing": op1_winnowing, "op2_lattice_likelihood": op2_lattice_likelihood, "op3_mixing": op3_mixing, "op8_jaccard_join": op8_jaccard_join, "op4_byte_cnn": op4_byte_cnn, "op5_site_quality": op5_site_quality, "op6_product_quantisation": op6_product_quantisation, "op7_packing": op7_packing, "op9_revisits": op9_revisits, "op10_secret_scan": op10_secret_scan}


def oracle_sql() -> dict[str, str]:
    return {"op9_revisits": OP9_SQL}
