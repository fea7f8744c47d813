"""Identity resolution over four catalogues in one plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.functions.text import designation_candidates, non_empty, normalise_designation, strip, without_blanks
from nearpass.operators.lookup import (
    ORBIT_FORMS,
    PASSAGE_FORMS,
    RISK_FORMS,
    RISK_LIST_FORMS,
    key_index,
    lookup_first,
    orbit_index,
)
from nearpass.schemas import SOURCE_ORBIT, SOURCE_PASSAGE, SOURCE_RISK, SOURCE_RISK_LIST

HOLD_FLAGS = {
    "hold_sbdb": SOURCE_ORBIT,
    "hold_sentry": SOURCE_RISK,
    "hold_cad": SOURCE_PASSAGE,
    "hold_esa": SOURCE_RISK_LIST,
}


def object_names(approaches: DataFrame) -> DataFrame:
    """One name per object: that of its latest approach."""
    newest = F.struct(F.col("close_approach_date"), F.col("name"))
    return approaches.groupBy("asteroid_id").agg(F.max_by("name", newest).alias("name"))


def with_candidates(objects: DataFrame) -> DataFrame:
    return objects.withColumn("candidates", designation_candidates(F.col("asteroid_id"), F.col("name")))


def active_holds(statuses: DataFrame, as_of: datetime | Column) -> DataFrame:
    """(object, source) pairs that must not be asked again yet."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return statuses.filter((F.col("status_code") == 404) & (F.col("not_found_until") > now)).select(
        "asteroid_id", "source", "not_found_until"
    )


def with_hold_flags(objects: DataFrame, holds: DataFrame | None) -> DataFrame:
    """A flag per source: true where the object is on hold."""
    if holds is None:
        return objects.withColumns({flag: F.lit(False) for flag in HOLD_FLAGS})
    flags = holds.groupBy("asteroid_id").agg(
        *[F.bool_or(F.col("source") == source).alias(flag) for flag, source in HOLD_FLAGS.items()]
    )
    joined = objects.join(flags, "asteroid_id", "left")
    return joined.withColumns({flag: F.coalesce(F.col(flag), F.lit(False)) for flag in HOLD_FLAGS})


def without_held(work: DataFrame, holds: DataFrame) -> DataFrame:
    """(object, source) work rows that are not on hold."""
    return work.join(holds.select("asteroid_id", "source"), ["asteroid_id", "source"], "left_anti")


# --- indexes --------------------------------------------------------------------

def orbit_refs(orbits: DataFrame, order: str, record_id: str) -> DataFrame:
    ref = F.struct(F.col(record_id).alias("id"), F.col("designation"), F.col("spkid"))
    return orbit_index(orbits, order, ref)



def risk_refs(active: DataFrame, removed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Active and removed entries under their normalised designation; for the
    same key the active one is preferred."""
    def ref(status: str, removed_date: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"), F.col("key").alias("id"), removed_date.cast("string").alias("removed_date")
        )

    keyed = active.withColumn("key", normalise_designation(F.coalesce(F.col("designation"), F.lit(""))))
    first = key_index(keyed, F.col("key"), ref("active", F.lit(None)), order, "sentry", rank=0)
    second = key_index(removed, F.col("key"), ref("removed", F.col("removed_date")), ("removed_date",), "sentry", rank=1)
    return first.unionByName(second)


def passage_refs(passages: DataFrame) -> DataFrame:
    """Every designation that has at least one approach record."""
    return key_index(
        passages.select("designation").distinct(), F.col("designation"), F.struct(F.col("designation").alias("id")),
        ("designation",), "cad",
    )


def risk_list_refs(risk_list: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Risk-list keys as they are and, for spellings without blanks, bare; of
    keys with one bare spelling the first in the list counts."""
    ref = F.struct(F.col("key").alias("id"))
    exact = key_index(risk_list, F.col("key"), ref, order, "esa")
    bare = key_index(risk_list, without_blanks(F.col("key")), ref, order, "esa_bare", last=False)
    return exact.unionByName(bare)


# --- lookups --------------------------------------------------------------------

def resolve_orbits(objects: DataFrame, index: DataFrame, enabled: Column | None = None) -> DataFrame:
    """`objects` (with candidates) plus `sbdb`: the matching orbit reference or NULL."""
    return lookup_first(
        objects, index, {"sbdb": ORBIT_FORMS}, enabled={"sbdb": enabled} if enabled is not None else None
    )


def extended_candidates(candidates: Column, orbit: Column) -> Column:
    """Candidates after an orbit hit: its designation first, its spk id last."""
    designation, spkid = non_empty(orbit["ref"]["designation"]), non_empty(strip(orbit["ref"]["spkid"]))
    front = F.when(
        designation.isNotNull(), F.concat(F.array(designation), F.array_remove(candidates, designation))
    ).otherwise(candidates)
    return F.when(
        spkid.isNotNull() & ~F.array_contains(front, spkid), F.array_append(front, spkid)
    ).otherwise(front)


def coverage(resolved: DataFrame) -> DataFrame:
    """How many objects the orbit catalogue covers and how many need a fetch of their own."""
    hit = F.col("sbdb").isNotNull()
    return resolved.agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.count_if(hit).alias("bulk_hits"),
        F.count_if(~hit).alias("gap_fill"),
    )


def gap_fill(resolved: DataFrame) -> DataFrame:
    """Objects without an orbit hit: one row per identifier to try, in order."""
    held = F.col("hold_sbdb") if "hold_sbdb" in resolved.columns else F.lit(False)
    return resolved.filter(F.col("sbdb").isNull() & ~held).select(
        "asteroid_id", F.posexplode("candidates").alias("try_no", "lookup_value")
    )


def resolve_profiles(
    objects: DataFrame,
    orbits: DataFrame,
    active: DataFrame,
    removed: DataFrame,
    passages: DataFrame,
    risk_list: DataFrame,
    holds: DataFrame | None = None,
    orbit_order: str = "row_no",
    orbit_id: str = "asteroid_id",
    risk_order: tuple[str, ...] = ("row_no",),
    risk_list_order: tuple[str, ...] = ("key",),
) -> DataFrame:
    """Which record of each catalogue describes each object (id, name).

    An orbit hit decides the identifiers that the other lookups use; those
    three share one join.  A source on hold is left out (NULL), which differs
    from "not found" and from "not on the list".
    """
    base = with_hold_flags(with_candidates(objects), holds)
    placed = resolve_orbits(base, orbit_refs(orbits, orbit_order, orbit_id), ~F.col("hold_sbdb"))
    extended = placed.withColumn("candidates", extended_candidates(F.col("candidates"), F.col("sbdb")))
    return _resolve_others(
        extended, F.col("sbdb.ref.id"), active, removed, passages, risk_list, risk_order, risk_list_order
    )


def _resolve_others(
    extended: DataFrame,
    orbit_id: Column,
    active: DataFrame,
    removed: DataFrame,
    passages: DataFrame,
    risk_list: DataFrame,
    risk_order: tuple[str, ...],
    risk_list_order: tuple[str, ...],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The catalogues behind the orbits, for objects whose candidates are final (with hold flags)."""
    # A bare risk-list key is tried after the exact one of the same candidate.
    others = (
        risk_refs(active, removed, risk_order)
        .unionByName(_with_ref(passage_refs(passages)))
        .unionByName(_with_ref(risk_list_refs(risk_list, risk_list_order)))
    )
    forms = {
        "sentry": RISK_FORMS,
        "cad": PASSAGE_FORMS,
        "esa": RISK_LIST_FORMS[:1],
        "esa_bare": RISK_LIST_FORMS[1:],
    }
    enabled = {
        "sentry": ~F.col("hold_sentry"),
        "cad": ~F.col("hold_cad"),
        "esa": ~F.col("hold_esa"),
        "esa_bare": ~F.col("hold_esa"),
    }
    found = lookup_first(extended, others, forms, enabled=enabled)
    exact, bare = F.col("esa"), F.col("esa_bare")
    best_listed = (
        F.when(exact.isNull(), bare).when(bare.isNull(), exact).when(bare["pos"] < exact["pos"], bare).otherwise(exact)
    )
    first_try = F.get("candidates", F.lit(0))
    return found.select(
        "asteroid_id",
        "name",
        "candidates",
        orbit_id.alias("sbdb_id"),
        F.when(~F.col("hold_sentry"), F.coalesce(F.col("sentry.ref.status"), F.lit("not_found"))).alias("sentry_status"),
        F.when(~F.col("hold_sentry"), F.coalesce(F.col("sentry.cand"), first_try)).alias("sentry_designation"),
        F.when(F.col("sentry.ref.status") == "active", F.col("sentry.ref.id")).alias("sentry_key"),
        F.col("sentry.ref.removed_date").alias("removed_date"),
        F.col("cad.ref.id").alias("cad_designation"),
        F.when(~F.col("hold_esa"), best_listed.isNotNull()).alias("on_risk_list"),
        best_listed["ref"]["id"].alias("esa_key"),
        *keep,
    )


# --- second pass ------------------------------------------------------------------

def open_tries(profiles: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """What a first pass leaves to be fetched: the identifiers, in order, of the
    profiles without an orbit whose orbit source is not on hold."""
    missing = with_hold_flags(profiles.filter(F.col("sbdb_id").isNull()), holds)
    return gap_fill(missing.withColumn("sbdb", F.lit(None)))


def answered_tries(tries: DataFrame, landed: DataFrame, order: tuple[str, ...] = ("checked_at",)) -> DataFrame:
    """The tries that were made, with what came back.

    `landed` has responses per `lookup_value` (http_status, body, and whether it
    holds a document: designation, spkid, NULL where it holds none); of several
    the last by `order` counts.  Identifiers are tried in order up to the first
    answer, so later ones are no tries.  `is_answer` marks that one: it came with
    status 200 and a document.
    """
    newest = landed.groupBy("lookup_value").agg(
        F.max_by(F.struct(*[c for c in landed.columns if c != "lookup_value"]), F.struct(*order)).alias("r")
    )
    # As in `lookup_first`: not broadcast by the size of the files behind it.
    met = tries.join(newest.hint("merge"), "lookup_value")
    good = (F.col("r.http_status") == 200) & F.col("r.has_document")
    # An object has a handful of identifiers at most.
    listed = met.groupBy("asteroid_id").agg(
        F.min(F.when(good, F.col("try_no"))).alias("first_answer"),
        F.collect_list(F.struct("try_no", "lookup_value", "r")).alias("tried"),
    )
    made = listed.select("asteroid_id", "first_answer", F.explode("tried").alias("t")).filter(
        F.col("first_answer").isNull() | (F.col("t.try_no") <= F.col("first_answer"))
    )
    return made.select(
        "asteroid_id", "t.try_no", "t.lookup_value", "t.r.*",
        F.coalesce(F.col("t.try_no") == F.col("first_answer"), F.lit(False)).alias("is_answer"),
    )


def resolve_again(
    profiles: DataFrame,
    answers: DataFrame,
    active: DataFrame,
    removed: DataFrame,
    passages: DataFrame,
    risk_list: DataFrame,
    holds: DataFrame | None = None,
    risk_order: tuple[str, ...] = ("row_no",),
    risk_list_order: tuple[str, ...] = ("key",),
) -> DataFrame:
    """Profiles of a first pass after its misses were fetched.

    The document that answers an object rewrites its candidates as an orbit hit
    does, and only those objects are looked up in the other catalogues again;
    all other profiles stay as they are.  Adds `answered_by`, the identifier
    under which the document was found.
    """
    found = answers.filter("is_answer").select("asteroid_id", "lookup_value", "designation", "spkid")
    orbit = F.struct(F.struct("designation", "spkid").alias("ref"))
    again = profiles.select("asteroid_id", "name", "candidates").join(found, "asteroid_id")
    again = again.withColumn("candidates", extended_candidates(F.col("candidates"), orbit))
    again = with_hold_flags(again.withColumnRenamed("lookup_value", "answered_by"), holds)
    looked_up = _resolve_others(
        again.drop("designation", "spkid"), F.lit(None).cast("string"), active, removed, passages, risk_list, risk_order,
        risk_list_order, keep=("answered_by",),
    )
    same = profiles.join(found.select("asteroid_id"), "asteroid_id", "left_anti")
    return same.withColumn("answered_by", F.lit(None).cast("string")).unionByName(looked_up)


def _with_ref(index: DataFrame) -> DataFrame:
    """References without a status, in the shape of the risk references."""
    none = F.lit(None).cast("string")
    ref = F.struct(none.alias("status"), F.col("ref.id").alias("id"), none.alias("removed_date"))
    return index.withColumn("ref", ref)
