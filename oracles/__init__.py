"""Check SQL for the registered queries, written independently of the operators.

Only the derivation of the inputs is shared (``plumbline.plans.inputs``).
"""

from oracles.comparison import ORACLES as _comparison
from oracles.readiness import ORACLES as _readiness
from oracles.tables import ORACLES as _tables
from oracles.words import ORACLES as _words

ORACLES = {**_tables, **_comparison, **_readiness, **_words}
