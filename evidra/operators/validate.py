"""Row rules as data: ordered cascades, violations, whole-page rejection, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """The label of the first rule that holds; the order is part of the contract. A rule that is null does not hold."""
    out = None
    for condition, label in rules:
        out = F.when(F.coalesce(condition, F.lit(False)), label) if out is None else out.when(F.coalesce(condition, F.lit(False)), label)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each rule a row breaks. A rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def all_or_nothing(df: DataFrame, scope: list[str], ok: Column) -> DataFrame:
    """Rows of the scopes in which every row is fine: one bad row rejects its whole page."""
    good = df.groupBy(*scope).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("__good")).where("__good").drop("__good")
    return df.join(good, scope, "left_semi")


def attempt_class(timed_out: Column, disk_unreadable: Column, no_pointer: Column, document: Column, version_ok: Column, status_ok: Column, shape_ok: Column, capability_ok: Column, exit_code: Column, runtime_marker: Column, status: Column) -> Column:
    """What became of an attempt, by the first rule that holds."""
    there = F.coalesce(document, F.lit(False))
    return first_rule([
        (timed_out, "transport_timeout"), (disk_unreadable, "evidence_unreadable"), (no_pointer, "evidence_unlocated"),
        (there & ~version_ok, "unknown_observation_schema"), (there & ~status_ok, "unknown_observation_status"), (there & ~(shape_ok & capability_ok), "contract_violation"),
        (~there & (exit_code == 0), "evidence_unlocated"), (~there & (exit_code == 1) & runtime_marker, "runtime_verification_failed"), (~there & (exit_code == 1), "wrapper_error"), (~there, "transport_error"),
    ], status)


def verified_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per bundle whether its files are exactly those of the manifest, with the same length and digest.

    Columns of both: bundle, name, length, sha256.
    """
    m, f = manifest.select("bundle", "name", F.col("length").alias("m_length"), F.col("sha256").alias("m_sha")), files.select("bundle", "name", F.col("length").alias("f_length"), F.col("sha256").alias("f_sha"))
    both = m.join(f, ["bundle", "name"], "full")
    same = F.coalesce((F.col("m_length") == F.col("f_length")) & (F.col("m_sha") == F.col("f_sha")), F.lit(False))
    return both.groupBy("bundle").agg(F.bool_and(same).alias("verified"))
