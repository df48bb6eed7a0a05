"""Identities and names of experiments (HX1-HX3): hashes of canonical JSON, built by hand so that its text is exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that make an experiment, and those that make a trained adapter.
IDENTITY_FIELDS = (
    "arm model role supervision inference dataset split seed teacher train_examples eval_examples epochs selection_checks dev_examples lora_r lora_alpha lora_dropout"
    " learning_rate max_seq_len batch_size grad_accum gradient_checkpointing self_consistency_k max_new_tokens temperature phase"
).split()
TRAINING_FIELDS = (
    "arm model supervision dataset seed teacher train_examples epochs selection_checks dev_examples lora_r lora_alpha lora_dropout learning_rate max_seq_len batch_size grad_accum"
    " gradient_checkpointing"
).split()
#: Fields that are axes of a result table, so a variant is made of the other identity fields.
AXES = ("arm", "model", "dataset", "split", "seed", "role", "supervision", "inference", "phase")


def float_text(x: Column) -> Column:
    """A double as Python and JSON print it: plain between 1e-4 and 1e16, else with a two-digit exponent."""
    s = x.cast("string")
    mantissa, power = F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    positional = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    short = F.regexp_replace(mantissa, r"\.0$", "")
    scientific = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(power.isNull(), s).when((power >= -4) & (power < 16), positional).otherwise(scientific)


def json_value(x: Column, kind: str) -> Column:
    """One JSON value. kind: a Spark type name."""
    if kind in ("double", "float"):
        out = float_text(x.cast("double"))
    elif kind == "string":
        # the driver's fields are ASCII; other characters keep their own form
        out = F.concat(F.lit('"'), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("null"))


def canonical_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """An object with sorted keys, ', ' and ': ' between its parts. fields: name -> (column, type name)."""
    parts = [F.concat(F.lit(f'"{k}": '), json_value(*fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _of(df, names) -> dict[str, tuple[Column, str]]:
    kinds = dict(df.dtypes)
    return {n: (F.col(n), kinds[n]) for n in names}


def experiment_id(df) -> Column:
    """HX1: 12 hex digits over the identity fields of a plan."""
    return F.substring(F.sha1(canonical_json(_of(df, IDENTITY_FIELDS))), 1, 12)


def training_id(df) -> Column:
    """HX1: the id of the adapter that an experiment trains or reuses."""
    return F.substring(F.sha1(canonical_json(_of(df, TRAINING_FIELDS))), 1, 12)


def variant_id(df) -> Column:
    """HX2: 8 hex digits over the identity fields that aren't axes of a result table."""
    return F.substring(F.sha1(canonical_json(_of(df, [f for f in IDENTITY_FIELDS if f not in AXES]))), 1, 8)


def default_name(arm: Column, model: Column, dataset: Column, split: Column, seed: Column, k: Column) -> Column:
    """HX3: arm-model-dataset-split-sN, and -kK for more than one sample."""
    many = F.when(k > 1, F.concat(F.lit("k"), k.cast("string")))
    return F.concat_ws("-", arm, model, dataset, split, F.concat(F.lit("s"), seed.cast("string")), many)


def run_label(arm: Column, model: Column, seed: Column) -> Column:
    """HX3: a run's short label; the seed shows if it isn't 0."""
    return F.concat_ws(" ", arm, model, F.when(F.coalesce(seed, F.lit(0)) != 0, F.concat(F.lit("s"), seed.cast("string"))))
