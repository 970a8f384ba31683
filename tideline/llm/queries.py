"""Every query of this package, for the driver's entry."""
from . import (bpe, decontamination, fingerprints, licenses, mixing, neardup, passages, periods, quality, registry, repair, secretscan, suffixes,  # noqa: F401
               urlfilter)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
