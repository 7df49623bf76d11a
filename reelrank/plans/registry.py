"""All registered queries and SQL oracles (batch, recommenders, streams)."""

from reelrank.plans import catalog

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES

for _mod in ("reelrank.plans.learn", "reelrank.plans.streams"):
    try:
        __import__(_mod)
    except ModuleNotFoundError as _e:  # module not written yet
        if _mod.rsplit(".", 1)[1] not in str(_e):
            raise
