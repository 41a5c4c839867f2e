"""The subpackage's queries for the driver, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import itq, url_equiv
from .bpe import op2_bpe
from .itq import op3_itq
from .langid import op6_language_id
from .minhash_oph import op8_fingerprints
from .packing import op9_packing
from .pii import op4_pii
from .quality_crf import op1_quality_crf
from .simhash_bk import op7_simhash
from .toxicity import op10_toxicity
from .url_equiv import op5_url_filter

_ALL = (op1_quality_crf, op2_bpe, op3_itq, op4_pii, op5_url_filter, op6_language_id, op7_simhash, op8_fingerprints, op9_packing, op10_toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: The others train models, walk trees or pack greedily; tests hold them against brute force.
ORACLE: dict[str, str] = {"op3_itq": itq.ORACLE_SQL, "op5_url_filter": url_equiv.ORACLE_SQL}
