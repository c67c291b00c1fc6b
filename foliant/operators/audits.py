"""Constraint audits: rules that give rows (key, severity, code), gates, replays, and checks of packs, files and coverage.

Every audit is one projection over the rows or one combined aggregation; an audit passes when it has no errors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.results import sign_test

ERROR, WARNING = "error", "warning"

#: code -> (severity, condition under which the row fails).
Rules = Mapping[str, tuple[str, Column]]


def issues(df: DataFrame, key: Sequence[str], rules: Rules) -> DataFrame:
    """(key, severity, code) for each rule that a row fails; a null condition does not fail."""
    failed = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for c, (s, bad) in rules.items()]))
    return df.select(*key, F.explode(failed).alias("_i")).select(*key, "_i.severity", "_i.code")


def issue_counts(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return found.groupBy(*by, "severity", "code").agg(F.count("*").alias("n"))


def verdict(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors and warnings, over all or by group, and whether the audit passes. Over all there is one row even without issues."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy(*by).agg(n(ERROR).alias("n_errors"), n(WARNING).alias("n_warnings")).withColumn("passed", F.col("n_errors") == 0)


def required_counts(df: DataFrame, value: Column, least: Mapping[str, int], of: str | None = None) -> DataFrame:
    """(value, n, needed, passed) of each required value: rows that hold it, or distinct values of ``of``; 0 where none does."""
    n = F.count("*") if of is None else F.countDistinct(of)
    held = df.where(value.isin(*least)).groupBy(value.alias("value")).agg(n.alias("n"))
    wanted = df.sparkSession.createDataFrame(sorted(least.items()), "value string, needed long")  # the parameter
    return wanted.join(F.broadcast(held), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), "needed").withColumn("passed", F.col("n") >= F.col("needed"))


#: Gates on the row of a paired comparison, and whether a larger observed value is the better one.
GATES = {
    "min_pairs": True, "min_absolute_improvement": True, "min_relative_improvement": True, "min_win_rate": True,
    "max_losses": False, "max_candidate_mean": False, "min_candidate_mean": True, "max_p_value": False,
}


def _observed() -> dict[str, Column]:
    decided = F.col("wins") + F.col("losses")
    return {
        "min_pairs": F.col("n_pairs"), "min_absolute_improvement": F.col("absolute_improvement"), "min_relative_improvement": F.col("relative_improvement"),
        "min_win_rate": F.when(decided > 0, F.col("wins") / decided), "max_losses": F.col("losses"), "max_candidate_mean": F.col("candidate_mean"),
        "min_candidate_mean": F.col("candidate_mean"), "max_p_value": sign_test(F.col("wins"), F.col("losses")),
    }


def evaluate_gates(compared: DataFrame, key: Sequence[str], thresholds: Mapping[str, float]) -> DataFrame:
    """(key, gate, observed, threshold, passed): one row a gate of each comparison (see ``outcomes``). A null observation fails."""
    unknown = set(thresholds) - set(GATES)
    if unknown:
        raise ValueError(f"unknown gates: {sorted(unknown)}")
    seen = _observed()
    rows = [F.struct(F.lit(g).alias("gate"), seen[g].cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), F.lit(GATES[g]).alias("_up")) for g, t in thresholds.items()]
    got = compared.select(*key, F.explode(F.array(*rows)).alias("_g")).select(*key, "_g.*")
    ok = F.when(F.col("_up"), F.col("observed") >= F.col("threshold")).otherwise(F.col("observed") <= F.col("threshold"))
    return got.withColumn("passed", F.coalesce(ok, F.lit(False))).drop("_up")


def decisions(gates: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, failed, admitted) from the gate rows of each system or model."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("gate"))))  # bounded by the number of gates
    return gates.groupBy(*key).agg(failed.alias("_f")).select(*key, F.array_join("_f", ",").alias("failed"), (F.size("_f") == 0).alias("admitted"))


def missing_evidence(evidence: DataFrame, required: Sequence[tuple[str, str]], system: str, item: str) -> DataFrame:
    """(system, item) that are required and have no row."""
    wanted = evidence.sparkSession.createDataFrame(list(required), f"{system} string, {item} string")
    return wanted.join(evidence.select(system, item).distinct(), [system, item], "left_anti")


def replay(df: DataFrame, key: Sequence[str], computed: Mapping[str, Column]) -> DataFrame:
    """(key, field, stored, computed) where a stored field differs from what is computed again from the row; nulls are equal."""
    pairs = [F.when(~F.col(n).eqNullSafe(c), F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("stored"), c.cast("string").alias("computed"))) for n, c in computed.items()]
    return df.select(*key, F.explode(F.array_compact(F.array(*pairs))).alias("_d")).select(*key, "_d.*")


def completeness(df: DataFrame, by: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Rows, rows that hold each field, and rows that hold all of them."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in fields.items()}
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"with_{n}") for n, c in held.items()], F.count_if(reduce(Column.__and__, held.values())).alias("complete"))


def compare_files(expected: DataFrame, found: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, status): ok, missing, unexpected or changed, of the files on either side, by their hash in any spelling of case."""
    e, f = (d.groupBy(path).agg(F.max(F.lower(F.trim(digest))).alias(n)) for d, n in ((expected, "_e"), (found, "_f")))
    marked = e.withColumn("_in_e", F.lit(True)).join(f.withColumn("_in_f", F.lit(True)), path, "full_outer")
    status = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_e").isNull(), "unexpected").when(F.col("_e").eqNullSafe(F.col("_f")), "ok").otherwise("changed")
    return marked.select(path, status.alias("status"))


def arm_differences(df: DataFrame, arm: str, key: str, arms: Sequence[str]) -> DataFrame:
    """(arms held, n): how many keys each combination of arms shares; equal arms have one row only."""
    held = df.where(F.col(arm).isin(*arms)).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(arm)), ",").alias("arms"))  # bounded by the arms
    return held.groupBy("arms").agg(F.count("*").alias("n"))


def pack_issues(pairs: DataFrame, key: str, source: str, target: str, side: str) -> DataFrame:
    """(code, n): empty texts, pairs without a change, repeated ids, and sources on both sides of the split."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = pairs.agg(F.count_if(blank(source)).alias("empty_source"), F.count_if(blank(target)).alias("empty_target"), F.count_if(F.col(source) == F.col(target)).alias("unchanged"))
    ids = pairs.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_id"))
    both = pairs.where(~blank(source)).groupBy(F.sha2(source, 256).alias("h")).agg(F.min(side).alias("a"), F.max(side).alias("b")).agg(F.count_if(F.col("a") < F.col("b")).alias("source_on_both_sides"))
    long = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in d.columns])).alias("x")).select("x.*")
    return reduce(DataFrame.unionByName, [long(d) for d in (rows, ids, both)])


def rule_issues(rules: DataFrame, no: str, source: str, target: str) -> DataFrame:
    """(rule number, severity, code) of replacement rules: empty source, no change, source of an earlier rule, and target that another rule changes again."""
    per = rules.groupBy(source).agg(F.min(no).alias("_first"))
    chained = rules.select(F.col(source).alias(target)).distinct().withColumn("_again", F.lit(True))
    j = rules.join(per, source).join(chained, target, "left")
    return issues(j, [no], {
        "empty_source": (ERROR, F.trim(source) == ""), "no_change": (ERROR, F.col(source) == F.col(target)),
        "shadowed": (WARNING, F.col(no) > F.col("_first")), "chained": (WARNING, F.col("_again") & (F.col(source) != F.col(target)))})


def codepoint_ranges(ranges: Column) -> Column:
    """All code points of an array of ranges like ``U+0900-U+097F`` (or one point), as sorted integers; ranges that cannot be read are left out."""
    ends = F.transform(ranges, lambda r: F.split(F.regexp_replace(F.upper(r), r"\s|U\+|0X", ""), r"-|–|\.\."))
    good = F.filter(ends, lambda e: F.size(e).between(1, 2) & F.forall(e, lambda x: x.rlike("^[0-9A-F]{1,6}$")))
    numbers = F.transform(good, lambda e: F.transform(e, lambda x: F.conv(x, 16, 10).cast("int")))
    rising = F.filter(numbers, lambda e: F.get(e, F.lit(0)) <= F.element_at(e, -1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(rising, lambda e: F.sequence(F.get(e, F.lit(0)), F.element_at(e, -1))))))


def coverage(required: Column, held: Column) -> Column:
    """Share of the required points that are held; 0 without any required."""
    return F.when(F.size(required) > 0, F.size(F.array_intersect(required, held)) / F.size(required)).otherwise(F.lit(0.0))


def router_collapse(trial: DataFrame, picks: str, pairs: str) -> DataFrame:
    """``trial`` with collapsed: the router always takes the same side."""
    return trial.withColumn("collapsed", (F.col(picks) == 0) | (F.col(picks) == F.col(pairs)))


def profile_sides(df: DataFrame, profile: Column, side: str, expected: Sequence[str]) -> DataFrame:
    """(profile, side counts): each expected profile's rows on every side of a split; missing sides count 0."""
    sides = df.select(side).distinct()
    wanted = df.sparkSession.createDataFrame([(p,) for p in expected], "profile string").join(F.broadcast(sides), how="cross")  # profiles x sides
    n = df.where(profile.isin(*expected)).groupBy(profile.alias("profile"), side).agg(F.count("*").alias("n"))
    return wanted.join(n, ["profile", side], "left").select("profile", side, F.coalesce("n", F.lit(0)).alias("n"))


def contradictions(metadata: Column, signals: Mapping[str, tuple[str, Column]]) -> Column:
    """Names of the claims that the provenance texts of the metadata speak against. signals: name -> (pattern, claim)."""
    text = F.lower(F.array_join(F.array_sort(F.map_values(metadata)), " "))
    return F.array_compact(F.array(*[F.when(text.rlike(p) & claim, F.lit(n)) for n, (p, claim) in signals.items()]))
