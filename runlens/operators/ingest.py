"""From deliveries (one JSON envelope a shard) to runs, shards and observations: validation, building rows, merging.

All functions are pure over DataFrames; the streaming sink calls the same ones for each micro-batch. Validation
works on VARIANT values, so that a wrong type is told from a missing field, and collects every error in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import presence, stripped, truncated
from ..functions.json import with_json
from ..plans.primitives import keep_newest, latest_per_key
from ..sources.bodies import NOT_JSON

#: Allowed statuses and layers, least lengths, and limits of a recorded rejection.
STATUSES = ["annotated", "unannotated"]
LAYERS = ["unit", "integration", "request", "system"]
INTENT_LEAST = {"entity": 2, "behavior": 15}
INTENT_REQUIRED = ["entity", "action", "behavior", "layer"]
INTENT_OPTIONAL = ["preconditions"]
REASONS, REASON_CHARS, AGENT_CHARS, REJECTIONS_KEPT = 20, 300, 300, 50


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


#: The kinds of a JSON number.
_NUMBER = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def intent_errors(intent: Column) -> Column:
    """Every violation of the annotation's contract."""
    absent = F.array(*(F.when(F.try_variant_get(intent, f"$.{k}", "variant").isNull(), F.lit(k)) for k in INTENT_REQUIRED))
    absent = F.array_compact(absent)
    checks = [F.when(F.size(absent) > 0, F.concat(F.lit("object at root is missing required properties: "), F.array_join(absent, ", ")))]
    for key in INTENT_REQUIRED[:3]:
        v = _get(intent, key)
        checks.append(F.when(v.isNotNull() & (_kind(v) != "STRING"), F.lit(f"value at `/{key}` is not a string")))
        if key in INTENT_LEAST:
            checks.append(F.when((_kind(v) == "STRING") & (F.length(_text(v)) < INTENT_LEAST[key]), F.lit(f"string length at `/{key}` is less than: {INTENT_LEAST[key]}")))
    layer = _get(intent, "layer")
    checks.append(F.when(layer.isNotNull() & ~F.coalesce(_text(layer).isin(LAYERS), F.lit(False)), F.lit("value at `/layer` is not one of the layers")))
    more = _get(intent, "preconditions")
    checks.append(F.when(more.isNotNull() & ~_kind(more).startswith("ARRAY"), F.lit("value at `/preconditions` is not an array")))
    known = F.array(*map(F.lit, INTENT_REQUIRED + INTENT_OPTIONAL))
    extra = F.array_except(F.coalesce(F.json_object_keys(F.to_json(intent)), F.array().cast("array<string>")), known)
    extras = F.transform(extra, lambda k: F.concat(F.lit("object property at `/"), k, F.lit("` is a disallowed additional property")))
    return F.when(~_object(intent), F.array(F.lit("must be a JSON object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), extras))


SPEC_FIELDS = ("file_path", "line_number", "status", "intent", "name", "duration")
#: Of a field's value, besides its kind: which plain forms are asked for.
_TEXTS, _NUMBERS = ("file_path", "line_number", "status", "name"), ("line_number", "duration")


def _facts(fields: Column) -> Column:
    """A spec's fields with the kind of each, and its text or number where that is asked for: each value is looked into once."""
    out = [fields["is_object"].alias("is_object"), fields["intent"].alias("intent")]
    for k in SPEC_FIELDS:
        v = fields[k]
        out.append(_kind(v).alias(f"{k}_kind"))
        if k in _TEXTS:
            out.append(F.coalesce(_text(v), F.when(v.isNotNull(), F.to_json(v)) if k in ("file_path", "line_number") else F.lit(None)).alias(f"{k}_text"))
        if k in _NUMBERS:
            out.append(F.try_variant_get(v, "$", "double").alias(f"{k}_number"))
    return F.struct(*out)


def _spec_errors(fact: Column, index: Column) -> Column:
    kind, text = lambda k: fact[f"{k}_kind"], lambda k: fact[f"{k}_text"]
    nil = lambda k: kind(k) == "VOID"
    filled = lambda k: (kind(k) == "STRING") & F.coalesce(stripped(text(k)) != "", F.lit(False))
    intent = fact["intent"]
    place = F.concat_ws(":", F.when(~nil("file_path"), text("file_path")), F.when(~nil("line_number"), text("line_number")))
    label = F.concat(F.lit("specs["), index.cast("string"), F.lit("]"), F.when(fact["is_object"] & (place != ""), F.concat(F.lit(" "), place)).otherwise(""))
    integer = (kind("line_number") == "BIGINT") & F.coalesce(fact["line_number_number"] > 0, F.lit(False))
    state = F.when(kind("status") == "STRING", text("status"))
    known = F.coalesce(state.isin(STATUSES), F.lit(False))
    timed = kind("duration").rlike(_NUMBER) & F.coalesce(fact["duration_number"] >= 0, F.lit(False))
    wrong_name = F.when(nil("name"), F.when(nil("intent"), "name is required when the spec carries no intent")).when(~filled("name"), "name must be a non-empty string when present")
    first = F.array(
        F.when(~filled("file_path"), "file_path is required and must be a non-empty string"),
        F.when(~integer, "line_number is required and must be a positive integer"),
        F.when(~known, "status must be one of annotated, unannotated"),
        F.when((state == "annotated") & nil("intent"), 'intent is required when status is "annotated"').when((state == "unannotated") & ~nil("intent"), 'intent must be null when status is "unannotated"'),
    )
    about = F.when((state == "annotated") & ~nil("intent"), F.transform(intent_errors(intent), lambda m: F.concat(F.lit("intent is invalid — "), m))).otherwise(F.array().cast("array<string>"))
    last = F.array(wrong_name, F.when(~nil("duration") & ~timed, "duration must be a non-negative number when present"))
    found = F.when(~fact["is_object"], F.array(F.lit("must be a JSON object"))).otherwise(F.concat(F.array_compact(first), about, F.array_compact(last)))
    return F.transform(found, lambda m: F.concat(label, F.lit(": "), m))


#: A delivery read in one pass. What is told by its kind stays a VARIANT; as binary only a JSON string is read.
SPECS = "array<struct<id:string,spec_file_path:string,file_path:binary,line_number:variant,status:string,name:variant,intent:variant,duration:variant,outcome:string>>"
WHOLE = f"struct<commit_sha:binary,branch:variant,ci_run_id:variant,shard_id:variant,duration_seconds:variant,_json:variant,specs:{SPECS}>"
INTENT = "struct<entity:binary,action:binary,behavior:binary,layer:string,preconditions:variant>"


def _filled(text: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(text.cast("string").rlike(r"\S"), F.lit(False))


def _nil(v: Column) -> Column:
    return v.isNull() | (_kind(v) == "VOID")


def _of(value: Column, check) -> Column:
    """``check`` of a value that is made once, however often the check names it."""
    return F.exists(F.array(value), check)


def _seconds(v: Column) -> Column:
    """Whether a value is no number below zero, if there is one."""
    number = lambda kind: (kind == "VOID") | (~kind.isin("STRING", "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "double") >= 0, F.lit(False)))
    return v.isNull() | _of(_kind(v), number)


def _plain_intent(intent: Column) -> Column:
    """Whether ``intent_errors`` finds nothing, without making any text of it."""

    def fine(v: Column) -> Column:
        known = F.when(v["preconditions"].isNull(), len(INTENT_REQUIRED)).when(_kind(v["preconditions"]).startswith("ARRAY"), len(INTENT_REQUIRED) + 1)
        long = [F.length(v[k].cast("string")) >= n for k, n in (INTENT_LEAST | {"action": 0}).items()]
        return F.coalesce(long[0] & long[1] & long[2] & v["layer"].isin(LAYERS) & (F.size(F.try_variant_get(intent, "$", "map<string,variant>")) == known), F.lit(False))

    return _of(F.try_variant_get(intent, "$", INTENT), fine)


def _plain_spec(s: Column) -> Column:
    """Whether ``_spec_errors`` finds nothing in a spec of SPECS."""
    line, name, nil = s["line_number"], s["name"], _nil(s["intent"])
    named = (_kind(name) == "STRING") & _filled(_text(name))
    integer = (_kind(line) == "BIGINT") & F.coalesce(F.try_variant_get(line, "$", "double") > 0, F.lit(False))
    stated = F.when(s["status"] == "unannotated", nil & named).when(s["status"] == "annotated", ~nil & (_nil(name) | named) & _plain_intent(s["intent"])).otherwise(False)
    return _filled(s["file_path"]) & integer & stated & _seconds(s["duration"])


def _plain(whole: Column) -> Column:
    """Whether a delivery read as WHOLE has no error at all."""
    texts = [F.coalesce(_kind(whole[k]).isin("VOID", "STRING"), F.lit(True)) for k in ("branch", "ci_run_id", "shard_id")]
    top = whole.isNotNull() & whole["_json"].isNull() & _filled(whole["commit_sha"]) & texts[0] & texts[1] & texts[2] & _seconds(whole["duration_seconds"])
    return F.coalesce(top & whole["specs"].isNotNull() & F.forall(whole["specs"], _plain_spec), F.lit(False))


def _settled(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with some columns made once a row: what a generator gives is not made again by filters further on, as they stay above it."""
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(F.array(F.struct(*columns))))


def validate(deliveries: DataFrame, column: str = "value") -> DataFrame:
    """Deliveries with ``body`` (VARIANT, NULL where the text is not one JSON value and nothing else), ``specs`` (SPECS) and ``errors``, all of them, in order.

    Most deliveries have no errors, which is told from one reading of their values; the others are looked into field by field.
    """
    rows = with_json(deliveries, "body", F.col(column))
    body = F.col("body")
    rows = rows.withColumn("_whole", F.try_variant_get(body, "$", WHOLE))
    rows = rows.withColumn("_plain", _plain(F.col("_whole")))
    top = ("commit_sha", "branch", "ci_run_id", "shard_id", "duration_seconds", "specs")
    # two projections: first each field's value, then its kind, so that the errors look at plain columns
    fields = F.struct(*(_get(body, k).alias(k) for k in top), _get(body, "_json").alias("_json"), _kind(body).alias("kind"))
    rows = rows.withColumn("_fields", F.when(~F.col("_plain"), fields))
    v = F.col("_fields")
    facts = [_kind(v[k]).alias(k) for k in top]
    facts = F.struct(*facts, _text(v["commit_sha"]).alias("sha"), F.try_variant_get(v["duration_seconds"], "$", "double").alias("seconds"))
    rows = rows.withColumn("_facts", F.when(~F.col("_plain"), facts))
    kind = F.col("_facts")
    text_or_nil = lambda k: F.when(~kind[k].isin("VOID", "STRING"), F.lit(f"{k} must be a string when present"))
    timed = kind["duration_seconds"].rlike(_NUMBER) & F.coalesce(kind["seconds"] >= 0, F.lit(False))
    found = F.array(
        F.when(~((kind["commit_sha"] == "STRING") & F.coalesce(stripped(kind["sha"]) != "", F.lit(False))), "commit_sha is required and must be a non-empty string"),
        text_or_nil("branch"),
        text_or_nil("ci_run_id"),
        text_or_nil("shard_id"),
        F.when((kind["duration_seconds"] != "VOID") & ~timed, "duration_seconds must be a non-negative number when present"),
        F.when(~kind["specs"].startswith("ARRAY"), "specs is required and must be an array"),
    )
    specs = F.coalesce(F.try_variant_get(v["specs"], "$", "array<variant>"), F.array().cast("array<variant>"))
    fields = F.transform(specs, lambda s: F.struct(_object(s).alias("is_object"), *(_get(s, k).alias(k) for k in SPEC_FIELDS)))
    each = F.flatten(F.transform(F.transform(fields, _facts), _spec_errors))
    is_object = v["kind"].startswith("OBJECT") & v["_json"].isNull()
    errors = F.when(F.col("_plain"), F.array().cast("array<string>")).when(body.isNull(), F.array(F.lit(NOT_JSON))).when(~is_object, F.array(F.lit("the request body must be a JSON object")))
    rows = rows.withColumn("errors", errors.otherwise(F.concat(F.array_compact(found), each))).withColumn("specs", F.col("_whole.specs"))
    return _settled(rows.drop("_whole", "_plain", "_fields", "_facts"), "body", "specs", "errors")


def rejections(validated: DataFrame) -> DataFrame:
    """Refused deliveries as rejection rows: at most 20 reasons of 300 characters, and how many there were."""
    reasons = F.transform(F.slice("errors", 1, REASONS), lambda r: truncated(r, REASON_CHARS))
    rows = validated.filter(F.size("errors") > 0)
    return rows.select("repository_id", "occurred_at", reasons.alias("details"), F.size("errors").alias("total_reasons_count"), truncated(F.col("user_agent"), AGENT_CHARS).alias("user_agent"))


def keep_rejections(rows: DataFrame, n: int = REJECTIONS_KEPT) -> DataFrame:
    """The newest n rejections of each repository."""
    return keep_newest(rows, ["repository_id"], [F.desc("occurred_at"), F.desc("id")], n)


def accepted(validated: DataFrame) -> DataFrame:
    """Accepted deliveries with their run and shard keys: a delivery without either key is a run or shard of its own.

    Expects ``delivery_seq``, which orders deliveries and names those without keys.
    """
    body = F.col("body")
    rows = validated.filter(F.size("errors") == 0)
    if "specs" not in rows.columns:
        rows = rows.withColumn("specs", F.try_variant_get(body, "$.specs", SPECS))
    get = lambda k, t="string": F.try_variant_get(body, f"$.{k}", t)
    own = F.concat(F.lit("#"), F.col("delivery_seq").cast("string"))
    rows = rows.withColumns(
        {
            "ci_run_id": presence(get("ci_run_id")),
            "shard_id": presence(get("shard_id")),
            "commit_sha": stripped(get("commit_sha")),
            "branch": presence(get("branch")),
            "duration_seconds": get("duration_seconds", "double"),
            "total_specs_count": F.size("specs"),
            "annotated_specs_count": F.size(F.filter("specs", lambda s: s["status"] == "annotated")),
        }
    )
    run_key = F.when(F.col("ci_run_id").isNotNull(), F.concat(F.lit("="), F.col("ci_run_id"))).otherwise(own)
    shard_key = F.when(F.col("shard_id").isNotNull(), F.concat(F.lit("="), F.col("shard_id"))).otherwise(own)
    return rows.withColumns({"run_key": run_key, "shard_key": shard_key})


def _example(s: Column) -> list[Column]:
    """The columns of an example that a spec of SPECS gives."""
    intent = F.try_variant_get(s["intent"], "$", "struct<entity:string,action:string,behavior:string>")
    return [
        presence(s["id"]).alias("example_id"),
        F.coalesce(presence(s["spec_file_path"]), s["file_path"].cast("string")).alias("spec_file_path"),
        s["file_path"].cast("string").alias("file_path"),
        F.try_variant_get(s["line_number"], "$", "int").alias("line_number"),
        presence(_text(s["name"])).alias("name"),
        *(intent[k].alias(f"intent_{k}") for k in ("entity", "action", "behavior")),
        F.try_variant_get(s["duration"], "$", "double").alias("duration_seconds"),
        presence(s["outcome"]).alias("outcome"),
        s["status"].alias("status"),
    ]


RUN_KEYS = ["repository_id", "run_key"]
SHARD_KEYS = [*RUN_KEYS, "shard_key"]


def shard_rows(deliveries: DataFrame) -> DataFrame:
    """One row a shard: the last delivery of it wins."""
    rows = deliveries.select(*SHARD_KEYS, "shard_id", "duration_seconds", "total_specs_count", "annotated_specs_count", "received_at", "delivery_seq")
    return latest_per_key(rows, SHARD_KEYS, ["delivery_seq"])


def run_rows(deliveries: DataFrame) -> DataFrame:
    """One row a run: what its first delivery said, and when."""
    rows = deliveries.select(*RUN_KEYS, "ci_run_id", "commit_sha", "branch", "received_at", "delivery_seq")
    return latest_per_key(rows, RUN_KEYS, ["delivery_seq"], newest=False)


def derived_totals(shards: DataFrame, keys: tuple[str, ...] = ("test_run_id",)) -> DataFrame:
    """Run totals from its shards: sums of examples, and the slowest shard's seconds (NULL where none is timed)."""
    return shards.groupBy(*keys).agg(
        F.coalesce(F.sum("total_specs_count"), F.lit(0)).cast("int").alias("total_specs_count"),
        F.coalesce(F.sum("annotated_specs_count"), F.lit(0)).cast("int").alias("annotated_specs_count"),
        F.max("duration_seconds").alias("duration_seconds"),
    )


def observation_rows(deliveries: DataFrame) -> DataFrame:
    """One row an example of each delivery; of equal ids in one payload the first stays, rows without an id all stay."""
    rows = deliveries.select(*SHARD_KEYS, "delivery_seq", "received_at", F.posexplode_outer("specs").alias("position", "spec")).filter("position is not null")
    rows = rows.select(*SHARD_KEYS, "delivery_seq", "position", *_example(F.col("spec")), F.col("received_at").alias("created_at"))
    return dedup_payload(rows)


def dedup_payload(rows: DataFrame, keys: tuple[str, ...] = (*SHARD_KEYS, "delivery_seq")) -> DataFrame:
    """First of each example_id within a delivery; NULL ids never collide."""
    w = Window.partitionBy(*keys, F.coalesce("example_id", F.concat(F.lit("\u0000"), F.col("position").cast("string")))).orderBy("position")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


KEPT = ["created_at", "spec_identity_id", "embed_failed_at", "embed_failure_count"]


def with_state(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns that resolution keeps, empty where they are missing."""
    for c, kind in (("spec_identity_id", "long"), ("embed_failed_at", "timestamp"), ("embed_failure_count", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0 if kind == "int" else None).cast(kind))
    return rows


def newest_deliveries(deliveries: DataFrame) -> DataFrame:
    """The last delivery of each shard."""
    return deliveries.groupBy(*SHARD_KEYS).agg(F.max("delivery_seq").alias("delivery_seq"))


def newest_of_shards(deliveries: DataFrame) -> DataFrame:
    """The deliveries that count, whole: of each shard the last. So the examples of all others need not be made."""
    return deliveries.join(newest_deliveries(deliveries), [*SHARD_KEYS, "delivery_seq"], "left_semi").select(*deliveries.columns)


def arriving(existing: DataFrame, delivered: DataFrame, redelivered: DataFrame | None = None) -> DataFrame:
    """The rows of ``delivered`` that stay, as they are written.

    Of several deliveries of a shard the last counts, and of an example that several shards deliver the last. One that another
    shard of the run, not itself redelivered, still has takes that row's place and keeps its created_at, identity and failure
    stamps. ``redelivered`` has a row (its keys and delivery_seq) a delivery, those without an example included; by
    default the deliveries are read off ``delivered``.
    """
    existing, delivered = with_state(existing), with_state(delivered)
    newest = newest_deliveries(delivered if redelivered is None else redelivered)
    delivered = delivered.join(newest, [*SHARD_KEYS, "delivery_seq"], "left_semi").select(*delivered.columns)
    named = latest_per_key(delivered.filter("example_id is not null"), [*RUN_KEYS, "example_id"], ["delivery_seq"])
    delivered = named.unionByName(delivered.filter("example_id is null"))
    conflict = [*RUN_KEYS, "example_id"]
    rest = existing.filter("example_id is not null").join(newest, SHARD_KEYS, "left_anti")
    old = rest.select(*conflict, *(F.col(c).alias(f"_old_{c}") for c in KEPT), F.lit(True).alias("_had"))
    merged = delivered.join(old, conflict, "left")
    return merged.select(*(F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in KEPT else F.col(c) for c in delivered.columns))


def merge_observations(existing: DataFrame, delivered: DataFrame, redelivered: DataFrame | None = None) -> DataFrame:
    """All rows after a delivery: rows of redelivered shards go, then those whose example arrives from elsewhere, then ``arriving`` ones come."""
    existing, new = with_state(existing), arriving(existing, delivered, redelivered)
    rest = existing.join(newest_deliveries(delivered if redelivered is None else redelivered), SHARD_KEYS, "left_anti")
    kept = rest.join(new.filter("example_id is not null").select(*RUN_KEYS, "example_id"), [*RUN_KEYS, "example_id"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_shards(existing: DataFrame, delivered: DataFrame) -> DataFrame:
    """Last write wins by shard key."""
    return latest_per_key(existing.unionByName(delivered), SHARD_KEYS, ["delivery_seq"])


def merge_runs(existing: DataFrame, delivered: DataFrame) -> DataFrame:
    """Find or create by run key: what was first recorded stays."""
    return latest_per_key(existing.unionByName(delivered), RUN_KEYS, ["delivery_seq"], newest=False)
