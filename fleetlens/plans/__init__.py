"""Report operators (R01-R82): each is a function from telemetry DataFrames
to a result DataFrame, a lazy plan Catalyst optimises as a whole.

Modules by family: ``statements`` (R24-R34, R42-R43), ``plancache`` (R15,
R35-R41), ``waits`` (R49, R50, R78), ``deltas`` (R75, R79-R82), ``indexes``
(R01-R14, R17-R19, R76, R77), ``maintenance`` (R16, R20-R23), ``inventory``
(R44-R57, R60-R64), ``sessions`` (R58, R59, R65-R71), ``deadlocks``
(R72-R74); fixed values of the source live in ``constants``.
"""

from . import (constants, deadlocks, deltas, indexes, inventory, maintenance, plancache, sessions, statements,
               waits)

__all__ = ["constants", "deadlocks", "deltas", "indexes", "inventory", "maintenance", "plancache", "sessions",
           "statements", "waits"]
