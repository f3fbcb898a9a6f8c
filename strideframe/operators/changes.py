"""Batches of patches, deletes and mixed change lists against the log table
(D-3, D-4, D-7).

The result equals applying the requests one by one in ``seq`` order, but it
is computed with equi-joins and per-id aggregates (partial aggregation, no
per-id window); requests meet what is unique per id in joins that Spark can
split, so one log with millions of changes is not one task:

* the owner of a log never changes (it is not patchable), so a request
  *hits* a log when the owner matches and the log exists at ``seq``;
* a log exists from its birth (stored rows: always; created rows: the
  winning create's ``seq``) until its first hitting delete ``dead``;
* the final value of a field is the value of the last accepted patch that
  sent it (``max_by(value, seq)``), else the stored value;
* ``updated_at`` moves when any accepted patch changed a field.  Along one
  field's chain of values some step changes the value exactly when some
  value differs from the starting one, so a per-id ``max`` of
  ``value <> base`` answers it without ordering the chain.

Check order per request follows the reference: identity, then body
validation (``invalid``), then ownership (``not_found``), then the table's
constraints (``rejected_not_null``, ``rejected_too_long``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R
from ..session import checkpoint
from . import entity as EN
from .records import ChangeResult, principal_outcome
from .sizing import maybe_broadcast, split_join

NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
INT_TEXT = r"^[+-]?[0-9]+$"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INT_MAX = 2147483647


def _kind(t: Column) -> Column:
    """JSON kind of a field by the type of its variant: absent (null), null, string, number, boolean, other."""
    return (F.when(t.isNull(), F.lit(None).cast("string"))
            .when(t == "VOID", F.lit("null"))
            .when(t == "STRING", F.lit("string"))
            .when(t.isin(*NUMBER_TYPES) | t.startswith("DECIMAL"), F.lit("number"))
            .when(t == "BOOLEAN", F.lit("boolean"))
            .otherwise(F.lit("other")))


def _read_fields(df: DataFrame, v: Column, fields: list[EN.Field]) -> DataFrame:
    """Adds what the fields of variant ``v`` hold: ``k_<f>`` (kind), ``d_<f>`` (as a number), ``s_<f>`` (as text).

    As columns of a projection of its own each is read once, however often it is asked for.  The kinds come from one
    ``transform``: Spark makes no whole-stage code for it, whose single method would be too long for the JVM to compile.
    """
    types = F.array(*[F.schema_of_variant(F.try_variant_get(v, f"$.{f.name}", "variant")) for f in fields])
    got = {"_kinds": F.transform(types, _kind)}
    for f in fields:
        got[f"s_{f.name}"] = F.try_variant_get(v, f"$.{f.name}", "string")
        if f.kind in (EN.WHOLE, EN.NUMBER):
            got[f"d_{f.name}"] = F.try_variant_get(v, f"$.{f.name}", "double")
    return df.withColumns(got).withColumns({f"k_{f.name}": F.col("_kinds")[i] for i, f in enumerate(fields)}).drop("_kinds")


def _whole(kind: Column, number: Column, text: Column) -> Column:
    """Whether a value is a whole number, or its text."""
    return F.coalesce((((kind == "number") & (number == F.floor(number))) | ((kind == "string") & text.rlike(INT_TEXT)))
                      & (F.abs(number) <= INT_MAX), F.lit(False))


def _number(kind: Column, text: Column) -> Column:
    """Whether a value is a number, or its text."""
    return F.coalesce((kind == "number") | ((kind == "string") & text.rlike(NUMBER_TEXT)), F.lit(False))


def _typed(field: EN.Field) -> tuple[Column, Column]:
    """(whether the field has a value of its kind, that value or null), from the columns of ``_read_fields``."""
    kind, text = F.col(f"k_{field.name}"), F.col(f"s_{field.name}")
    if field.kind == EN.WHOLE:
        ok = _whole(kind, F.col(f"d_{field.name}"), text)
        return ok, F.when(ok, F.col(f"d_{field.name}").cast("int"))
    if field.kind == EN.NUMBER:
        ok = _number(kind, text)
        return ok, F.when(ok, F.col(f"d_{field.name}"))
    ok = F.coalesce(kind == "string", F.lit(False))
    return ok, F.when(ok, text)


def _read_columns(fields: list[EN.Field]) -> list[str]:
    return [f"{c}_{f.name}" for f in fields for c in "kds"]


def parse_patch(df: DataFrame, body: str = "body", variant: str | None = None, entity: EN.Entity = EN.LOG) -> DataFrame:
    """Parse a patch body into presence, kind and typed value per field.

    Columns added: ``body_ok`` (a JSON object), and per patchable field
    ``p_<f>`` (key sent), ``n_<f>`` (sent as null), ``v_<f>`` (typed value),
    ``t_<f>`` (type acceptable for the field).  ``equipment_used`` is checked
    for type and never stored.
    """
    v = F.col(variant) if variant else F.try_parse_json(F.col(body))
    out = df.withColumn("_v", v)
    out = out.withColumn("body_ok", F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"),
                                              F.lit(False)))
    fields = [*entity.patchable, *[EN.Field(c, EN.TEXT) for c in entity.checked]]
    out = _read_fields(out, F.col("_v"), fields)
    more = {}
    for f in fields:
        k = F.col(f"k_{f.name}")
        ok, value = _typed(f)
        more[f"p_{f.name}"] = k.isNotNull()
        more[f"n_{f.name}"] = F.coalesce(k == "null", F.lit(False))
        more[f"t_{f.name}"] = F.coalesce(k.isNull() | (k == "null") | ok, F.lit(False))
        more[f"v_{f.name}"] = value
    out = out.withColumns(more)
    return out.drop("_v", *_read_columns(fields))


def _patch_invalid(entity: EN.Entity) -> Column:
    """Body validation (the reference's 422): shape, types, numbers above 0."""
    fine = F.col("body_ok")
    for f in [*[f.name for f in entity.patchable], *entity.checked]:
        fine = fine & F.col(f"t_{f}")
    for f in entity.patchable:
        if f.positive:
            fine = fine & F.coalesce(~F.col(f"p_{f.name}") | F.col(f"n_{f.name}") | (F.col(f"v_{f.name}") > 0), F.lit(False))
    return ~fine


def _patch_constraint(entity: EN.Entity) -> Column:
    """Table constraints (the reference's failed flush): NOT NULL, length."""
    any_null, too_long = F.lit(False), F.lit(False)
    for f in entity.patchable:
        if f.required:
            any_null = any_null | F.col(f"n_{f.name}")
        if f.max_len is not None:
            too_long = too_long | F.coalesce(F.length(f"v_{f.name}") > f.max_len, F.lit(False))
    return (F.when(any_null, F.lit(S.REJECTED_NOT_NULL))
            .when(too_long, F.lit(S.REJECTED_TOO_LONG)))


def parse_create(df: DataFrame, body: str = "body", variant: str | None = None, entity: EN.Entity = EN.LOG) -> DataFrame:
    """Typed fields of a create request's JSON body, and ``create_ok``.

    ``create_ok`` is false if the body is no object or a field has a kind its
    column does not take: text for dates and texts; a whole number (or its
    text), or a number (or its text); null or nothing only where the field is
    not required.
    """
    v = F.col(variant) if variant else F.try_parse_json(F.col(body))
    out = _read_fields(df.withColumn("_c", v), F.col("_c"), entity.fields)
    ok = F.coalesce(F.schema_of_variant(F.col("_c")).startswith("OBJECT"), F.lit(False))
    values = {}
    for f in entity.fields:
        kind = F.col(f"k_{f.name}")
        good, values[f.name] = _typed(f)
        ok = ok & (good if f.required else F.coalesce(kind.isNull() | (kind == "null") | good, F.lit(False)))
    return out.withColumns({"create_ok": ok, **values}).drop("_c", *_read_columns(entity.fields))


def _parsed(requests: DataFrame, entity: EN.Entity) -> DataFrame:
    """Requests with the fields of creates and of patches: what each body says, read as its request's kind only.

    Besides the fields of a create and ``create_ok``: ``_invalid`` (a patch's body validation), ``_constraint`` (the table
    constraint that it breaks), ``p_<f>`` and ``v_<f>``.
    """
    op, body = F.col("op"), F.try_parse_json(F.col("body"))
    both = requests.withColumns({"_made": F.when(op == "create", body), "_sent": F.when(op == "patch", body)}).drop("body")
    got = parse_patch(parse_create(both, variant="_made", entity=entity), variant="_sent", entity=entity)
    return got.select(
        "seq", "op", "id", "user_id", "create_ok", *[f.name for f in entity.fields],
        ((op == "patch") & _patch_invalid(entity)).alias("_invalid"), _patch_constraint(entity).alias("_constraint"),
        *[f"{c}_{f.name}" for f in entity.patchable for c in "pv"])


def apply_changes(changes: DataFrame, logs: DataFrame, now: Column,
                  users: DataFrame | None = None, materialize: bool = False, entity: EN.Entity = EN.LOG) -> ChangeResult:
    """D-7: apply an ordered list of creates, patches and deletes in one pass.

    ``entity`` says which table ``logs`` is; everything below follows from it.

    ``changes``: ``seq, op, id, user_id, body``.  A create carries its own id;
    an id already stored, or taken by an earlier accepted create, is a
    ``conflict`` (ids are never reused).  Every request has an outcome: an
    unknown or null ``op`` is ``invalid``.  With ``users`` given, the owner of
    every request must be an existing, active user first.  ``materialize``
    checkpoints the per-request decisions, for callers that write both the
    outcomes and the table (each would otherwise recompute them).

    Plan: the parsed requests are checkpointed and counted.  When their ids
    fit the broadcast budget, the log table is only *filtered* - a broadcast
    semi-join picks the touched logs, a broadcast anti-join keeps the rest -
    and all per-log work runs on the touched slice, so the table is never
    shuffled.  Beyond the budget the same joins run as shuffle joins on ``id``.
    """
    if changes.isStreaming:
        raise ValueError("apply_changes takes a batch DataFrame; for a stream use "
                         "strideframe.streaming.jobs.stream_changes (one call per micro-batch)")
    # Each body is parsed once (as VARIANT); creates read create fields,
    # patches read patch fields.  The parsed requests are
    # checkpointed: every branch below reads them, and the count is exact.
    src = changes.select("seq", "op", "id", "user_id", "body")
    par = src.sparkSession.sparkContext.defaultParallelism
    if not src.isStreaming and src.rdd.getNumPartitions() < par:
        # a batch read from few files: spread the parsing over the cluster
        # (round robin: no key, so one hot id cannot skew it)
        src = src.repartition(par)
    requests = checkpoint(_parsed(src, entity))
    n = requests.count()
    # the ids the batch touches come straight from the requests
    ids_side = maybe_broadcast(requests.select("id").distinct(), n)
    if users is not None:
        ch = principal_outcome(requests, users, request_rows=n)
    else:
        ch = requests.withColumn("auth", F.lit(None).cast("string"))

    patchable = [f.name for f in entity.patchable]
    stored = logs.select(*entity.columns)
    hit_stored = stored.join(ids_side, "id", "left_semi")
    untouched = stored.join(ids_side, "id", "left_anti")

    # ---- creates ------------------------------------------------------
    # A create names its log: a missing id is a broken rule like any other.
    cr = R.validate(ch.filter(F.col("op") == "create"),
                    entity.rules() + [("id_present", F.col("id").isNotNull()), ("body_types", F.col("create_ok"))])
    cr_ok = cr.filter(F.col("auth").isNull() & (F.size("errors") == 0))
    # the first create of an id, before anything is joined by it: one row per id
    winners = cr_ok.groupBy("id").agg(
        F.min("seq").alias("born"),
        F.min_by(F.struct(
            F.col("user_id").alias("owner"),
            *[F.try_to_date(F.col(f.name), "yyyy-MM-dd").alias(f.name) if f.kind == EN.DATE else F.col(f.name)
              for f in entity.fields]), F.col("seq")).alias("w"),
    ).join(hit_stored.select("id"), "id", "left_anti")
    born = winners.select(
        "id", F.col("w.owner").alias("user_id"), *[f"w.{f.name}" for f in entity.fields],
        now.alias("created_at"), now.alias("updated_at"), "born")
    rows = hit_stored.withColumn("born", F.lit(None).cast("long")).unionByName(born)

    create_out = split_join(cr, winners.select("id", "born"), ["id"], "left").select(
        "seq", "op", "id", "user_id",
        F.when(F.col("auth").isNotNull(), F.col("auth"))
        .when(F.size("errors") > 0, F.lit(S.INVALID))
        .when(F.col("seq") == F.col("born"), F.lit(S.CREATED))
        .otherwise(F.lit(S.CONFLICT)).alias("outcome"))

    # ---- patches and deletes against the touched logs ---------------------
    pd_ = ch.filter(F.col("op").isin("patch", "delete")).drop("create_ok", *[f.name for f in entity.fields])
    base = rows.select(
        "id", F.col("user_id").alias("owner"), "born",
        *[F.col(f).alias(f"b_{f}") for f in patchable])
    j = split_join(pd_, base, ["id"], "left")
    is_patch = F.col("op") == "patch"
    hit = (F.col("auth").isNull() & ~F.coalesce(F.col("_invalid"), F.lit(False))
           & (F.col("owner") == F.col("user_id"))
           & (F.col("born").isNull() | (F.col("seq") > F.col("born"))))
    j = j.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    dead = (j.filter((F.col("op") == "delete") & F.col("_hit"))
            .groupBy("id").agg(F.min("seq").alias("dead")))
    j = split_join(j, dead, ["id"], "left")
    alive = F.col("_hit") & (F.col("dead").isNull() | (F.col("seq") <= F.col("dead")))
    constraint = F.col("_constraint")
    outcome = (F.when(F.col("auth").isNotNull(), F.col("auth"))
               .when(F.col("_invalid"), F.lit(S.INVALID))
               .when(~alive, F.lit(S.NOT_FOUND))
               .when(F.col("op") == "delete", F.lit(S.DELETED))
               .when(constraint.isNotNull(), constraint)
               .otherwise(F.lit(S.OK)))
    j = j.withColumn("outcome", outcome)
    if materialize:
        j = checkpoint(j)
        dead = j.filter(F.col("dead").isNotNull()).select("id", "dead").distinct()
    pd_out = j.select("seq", "op", "id", "user_id", "outcome")

    # ---- fold accepted patches per log ---------------------------------
    accepted = j.filter(is_patch & (F.col("outcome") == S.OK))
    folds = []
    changed = []
    for f in patchable:
        sent = F.col(f"p_{f}")
        # in a struct: a null that was sent is a value
        folds.append(F.max_by(F.when(sent, F.struct(F.col(f"v_{f}").alias("v"))), F.when(sent, F.col("seq"))).alias(f"n_{f}"))
        changed.append(F.max(sent & ~F.col(f"v_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"c_{f}"))
    fold = accepted.groupBy("id").agg(*folds, *changed)
    touched = dead.join(fold, "id", "full")

    any_changed = F.lit(False)
    for f in patchable:
        any_changed = any_changed | F.coalesce(F.col(f"c_{f}"), F.lit(False))
    state = rows.join(touched, "id", "left").select(
        *[F.when(F.col(f"n_{c}").isNotNull(), F.col(f"n_{c}.v")).otherwise(F.col(c)).alias(c) if c in patchable else F.col(c)
          for c in entity.columns if c != "updated_at"],
        F.when(any_changed, now).otherwise(F.col("updated_at")).alias("updated_at"), F.col("dead").isNotNull().alias("deleted"))
    rewritten = state.filter(~F.col("deleted")).drop("deleted")
    # rewritten and gone rows in one pass: as a union, a task would hold the sorted sides of both
    changed = state.select("id", *[F.when(~F.col("deleted"), F.col(c)).alias(c) for c in entity.columns if c != "id"], "deleted")

    # a request that asks for nothing known is answered too
    known = F.coalesce(F.col("op").isin("create", "patch", "delete"), F.lit(False))
    other_out = ch.filter(~known).select(
        "seq", "op", "id", "user_id", F.coalesce(F.col("auth"), F.lit(S.INVALID)).alias("outcome"))

    table = untouched.unionByName(rewritten)
    outcomes = create_out.unionByName(pd_out).unionByName(other_out)
    gone = dead.join(rows.select("id"), "id", "left_semi").select("id")
    return ChangeResult(table, outcomes, rewritten, gone, changed)


def patch_logs(patches: DataFrame, logs: DataFrame, now: Column,
               users: DataFrame | None = None) -> ChangeResult:
    """D-3: partial updates.  ``patches``: ``seq, id, user_id, body``."""
    ch = patches.select("seq", F.lit("patch").alias("op"), "id", "user_id", "body")
    return apply_changes(ch, logs, now, users)


def delete_logs(deletes: DataFrame, logs: DataFrame,
                users: DataFrame | None = None) -> ChangeResult:
    """D-4: deletes; a second delete of the same log is ``not_found``."""
    ch = deletes.select("seq", F.lit("delete").alias("op"), "id", "user_id",
                        F.lit(None).cast("string").alias("body"))
    # ``now`` is unused by deletes: no surviving row changes.
    return apply_changes(ch, logs, F.lit(None).cast("timestamp_ntz"), users)
