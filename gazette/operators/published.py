"""Rules that a record must keep before it is published, read from its raw JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import lookup, names_of

CONFIRMATIONS = ["obligation_applies_confirmed", "artifact_capable_of_violation_confirmed", "omission_materiality_confirmed"]
_KEYS = vocab.PUBLISHED_KEYS


def _kind(value: Column) -> Column:
    """What a JSON value is: STRING, VOID for null, BOOLEAN, OBJECT<...> and so on; null where there is no value."""
    return F.schema_of_variant(value)


def _fields(value: Column) -> Column:
    """Fields of an object by name; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    """Items of a list; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _is(value: Column, *kinds: str) -> Column:
    """True for a value of one of the kinds, false for others and for a field that is not there."""
    return F.coalesce(_kind(value).isin(*kinds), F.lit(False))


def _text(value: Column) -> Column:
    """The value of a JSON text; null for a value that is no text, which is never read as one."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _empty(value: Column) -> Column:
    return ~F.coalesce(_text(value).rlike(r"(?U)\S"), F.lit(False))


def _other(value: Column, fixed: str) -> Column:
    return F.coalesce(_text(value) != fixed, F.lit(True))


def _no_texts(value: Column) -> Column:
    """True unless the value is a list of texts, an empty one included."""
    return ~F.coalesce(F.forall(_items(value), lambda item: _is(item, "STRING")), F.lit(False))


def _key_errors(where: Column, fields: Column, keys: list[str]) -> Column:
    """Keys that are not listed and listed ones that are missing, each in their order."""
    listed, given = F.array(*[F.lit(k) for k in sorted(keys)]), F.map_keys(fields)
    named = lambda what, found: F.transform(found, lambda k: F.concat(where, F.lit(f": {what} key "), k))
    return F.when(fields.isNull(), F.array(F.concat(where, F.lit(": not an object")))).otherwise(
        F.concat(named("unlisted", F.array_sort(F.array_except(given, listed))), named("missing", F.array_except(listed, given))))


def _fits(fields: Column, keys: list[str]) -> Column:
    """True for an object with exactly these keys. Objects keep their keys in order, so one comparison mostly does."""
    listed, given = F.array(*[F.lit(k) for k in sorted(keys)]), F.map_keys(fields)
    return F.coalesce((given == listed) | ((F.size(fields) == len(keys)) & (F.size(F.array_except(listed, given)) == 0)), F.lit(False))


def _failure_errors(failure: Column, position: Column) -> Column:
    """Broken rules of one recorded failure; a failure with other keys or an unknown mode is not read further."""
    where = F.concat(F.lit("baseline_failures["), position.cast("string"), F.lit("]"))
    fields = failure["fields"]
    mode = _text(fields["mode"])
    stage = lookup(mode, vocab.FAILURE_STAGES)
    rules = {
        "stage: wrong": F.coalesce(_text(fields["stage"]) != stage, F.lit(True)),
        "baseline_response_excerpt: not a text": ~_is(fields["baseline_response_excerpt"], "STRING"),
        "judge_rationale: wrong": ~F.when(mode == "missed_obligation", _is(fields["judge_rationale"], "STRING"))
        .otherwise(_is(fields["judge_rationale"], "VOID")),
    }
    named = F.transform(names_of(rules), lambda rule: F.concat(where, F.lit("."), rule))
    return (F.when(~_fits(fields, _KEYS["baseline_failures"]), _key_errors(where, fields, _KEYS["baseline_failures"]))
            .when(stage.isNull(), F.array(F.concat(where, F.lit(".mode: unknown")))).otherwise(named))


def _truth(value: Column) -> Column:
    """True for true, false, null and for the numbers 0 and 1, which count as truth values."""
    number = F.when(_kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, "$", "double"))
    return _is(value, "BOOLEAN", "VOID") | F.coalesce(number.isin(0.0, 1.0), F.lit(False))


def errors(rows: DataFrame, column: str, snapshot: str, model: str, cutoff: str) -> DataFrame:
    """The rows with `errors`, the names of all broken rules of the record whose JSON text is in `column`.

    Every rule is tried whatever else is broken, but for the fields of an object whose keys are not the listed ones.
    Text that is no JSON, null, an object that repeats a key, and JSON that is no object have the one error "record: not an object".
    A record without errors has an empty list. Nothing but the row itself is read, so there is no shuffle.
    """
    objects = ["jurisdiction", "citation", "impacted_business", "source", "human_review"]
    read = rows.withColumn("_json", F.try_parse_json(column)).withColumn("_record", _fields(F.col("_json")))
    top = lambda key: F.col("_record")[key]
    read = read.withColumns({f"_{key}": _fields(top(key)) for key in objects}).withColumn(
        "_failures", F.transform(_items(top("baseline_failures")), lambda f: F.struct(_fields(f).alias("fields"))))
    has = lambda key: F.map_contains_key("_record", key)
    inside = lambda key: (lambda name: F.col(f"_{key}")[name])
    exact = {key: _fits(F.col(f"_{key}"), _KEYS[key]) for key in objects}
    place, cited, business, origin, review = (inside(key) for key in objects)

    failures = F.col("_failures")
    missed = F.exists(failures, lambda f: F.coalesce(_text(f["fields"]["mode"]) == "missed_obligation", F.lit(False)))
    url = cited("url")
    rules = {
        **{f"{k}: empty": has(k) & _empty(top(k)) for k in (
            "id", "title", "regulator_name", "update_type", "objective", "what_changed", "why_it_matters", "probed_at")},
        "impact_label: not high": has("impact_label") & _other(top("impact_label"), "high"),
        "model_id: wrong": has("model_id") & _other(top("model_id"), model),
        "model_cutoff: wrong": has("model_cutoff") & _other(top("model_cutoff"), cutoff),
        "scenario: not A or B": has("scenario") & _other(top("scenario"), "A") & _other(top("scenario"), "B"),
        "key_requirements: not a list of texts": has("key_requirements") & _no_texts(top("key_requirements")),
        "key_requirements: empty": F.size(_items(top("key_requirements"))) == 0,
        "impacted_functions: not a list of texts": has("impacted_functions") & _no_texts(top("impacted_functions")),
        "compliance_date: not a text": has("compliance_date") & ~_is(top("compliance_date"), "STRING", "VOID"),
        "jurisdiction.scope: not a text": exact["jurisdiction"] & ~_is(place("scope"), "STRING"),
        **{f"jurisdiction.{k}: not a text": exact["jurisdiction"] & ~_is(place(k), "STRING", "VOID") for k in ("country", "bloc", "region_name")},
        **{f"citation.{k}: empty": exact["citation"] & _empty(cited(k)) for k in ("name", "url")},
        "citation.url: not http": exact["citation"] & ~_empty(url) & ~F.coalesce(_text(url).rlike("^https?://"), F.lit(False)),
        **{f"impacted_business.{k}: not a list of texts": exact["impacted_business"] & _no_texts(business(k)) for k in sorted(_KEYS["impacted_business"])},
        **{f"source.{k}: empty": exact["source"] & _empty(origin(k)) for k in ("artifact_id", "topic_id", "source_id")},
        "source.snapshot_date: wrong": exact["source"] & _other(origin("snapshot_date"), snapshot),
        "baseline_failures: not a list": has("baseline_failures") & failures.isNull(),
        "baseline_failures: empty": F.size(failures) == 0,
        **{f"human_review.{k}: empty": exact["human_review"] & _empty(review(k)) for k in ("reviewer", "reviewed_at")},
        "human_review.attestation: not approved": exact["human_review"] & _other(review("attestation"), "approved"),
        **{f"human_review.{k}: not a truth value": exact["human_review"] & ~_truth(review(k)) for k in CONFIRMATIONS},
        **{f"human_review.{k}: not confirmed": exact["human_review"] & missed
           & ~F.coalesce(F.try_variant_get(F.when(_is(review(k), "BOOLEAN"), review(k)), "$", "boolean"), F.lit(False)) for k in CONFIRMATIONS},
        **{f"human_review.{k}: confirmed unasked": exact["human_review"] & ~missed & ~_is(review(k), "VOID") for k in CONFIRMATIONS},
    }
    none = F.array().cast("array<string>")
    # Keys are listed for objects without exactly the right ones only.
    keys = [F.when(~_fits(F.col("_record"), _KEYS["record"]), _key_errors(F.lit("record"), F.col("_record"), _KEYS["record"])).otherwise(none)]
    keys += [F.when(has(k) & ~exact[k], _key_errors(F.lit(k), F.col(f"_{k}"), _KEYS[k])).otherwise(none) for k in objects]
    each = F.coalesce(F.flatten(F.transform(failures, _failure_errors)), none)
    # Without a record only the first list has an error. A condition around all rules would have what they share computed for each of them.
    return read.select(*rows.columns, F.concat(*keys, names_of(rules), each).alias("errors"))
