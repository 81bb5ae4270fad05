"""All oracle SQL texts, keyed like the registered queries."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from churnforge.plans import oracle_business
    out: dict[str, str] = {}
    out.update(oracle_business.ORACLE)
    for mod in ("oracle_clean", "oracle_profile", "oracle_features", "oracle_models", "oracle_segment"):
        try:
            m = __import__(f"churnforge.plans.{mod}", fromlist=["ORACLE"])
        except ImportError:
            continue
        out.update(getattr(m, "ORACLE", {}))
    return out
