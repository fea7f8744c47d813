"""Tables and analytic views under names, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nearpass.plans import metrics, profiles, watch
from nearpass.schemas import APPROACH, FETCH_STATUS, FIREBALL, ORBIT, PASSAGE, RISK, RISK_LIST, Entity

# --- fixed values: names in SQL ------------------------------------------------------
TABLES: dict[str, Entity] = {
    "close_approaches": APPROACH,
    "agency_sbdb": ORBIT,
    "agency_sentry": RISK,
    "agency_esa": RISK_LIST,
    "agency_cad": PASSAGE,
    "fireball_events": FIREBALL,
    "agency_fetch_status": FETCH_STATUS,
}
# --- end of fixed values ---------------------------------------------------------------


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The analytic views over the tables of `TABLES`."""
    approaches, orbits, risks = tables["close_approaches"], tables["agency_sbdb"], tables["agency_sentry"]
    risk_list, passages = tables["agency_esa"], tables["agency_cad"]
    return {
        "daily_metrics": metrics.daily_metrics(approaches),
        "asteroid_profile": profiles.object_profiles(approaches, orbits, risks, risk_list),
        "sentry_watchlist": watch.watchlist(risks),
        "cad_upcoming": profiles.enriched_passages(passages, orbits, risks, risk_list),
        "orbit_class_dist": metrics.orbit_class_distribution(orbits),
        "fireball_annual": metrics.fireball_summary(tables["fireball_events"]),
    }


def register(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Make tables and views known to SQL, under a common prefix if wanted.

    Nothing runs until a query does."""
    names = []
    for name, df in {**tables, **views(tables)}.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
