"""Incremental secret scans over content-addressed blobs, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import apart, field, laid_out, packed, stored, text_or_empty

SPAN = "struct<start:bigint,end:bigint>"
SPANS = f"array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are findings; ``value_group`` must have ``value_min`` characters."""

    name: str
    version: int
    pattern: str
    value_group: int
    value_min: int


# The kinds, their patterns and least lengths are fixed values. A run of one class of characters of
# a least length is the same as such a run that is found first and dropped if it is too short.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)


def versions_of(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob, text): every stored version of every path under the SHA-256 of its content."""
    rows = packed(docs).select(field(path).alias("path"), text_or_empty().alias("text"))
    return rows.select("path", F.unhex(F.sha2("text", 256)).alias("blob"), "text")


def _spans(rule: Rule, found: Column, text: Column) -> Column:
    """Spans of the matches: each starts where the gaps and matches before it end."""
    gaps = F.split(text, rule.pattern, -1)
    values = (
        found
        if rule.value_group == 0
        else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))
    )
    steps = F.transform(
        F.arrays_zip(found.alias("found"), values.alias("value"), gaps.alias("gap")),
        lambda z: F.struct(
            F.length(z["gap"]).cast("long").alias("gap"),
            F.length(z["found"]).cast("long").alias("size"),
            F.length(z["value"]).alias("value"),
        ),
    )
    spans = laid_out(
        F.slice(steps, F.lit(1), F.size(found)),  # the last gap follows the last match
        lambda s: s["gap"] + s["size"],
        lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("end")),
        lambda s: s["value"] >= rule.value_min,
        SPAN,
    )
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPANS))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Ledger rows (blob, rule, rule_version, spans) of the pairs of blob and rule version not in ``ledger``.

    Without a ledger one shuffle brings together the copies of a text, which are combined before it, so
    a text that most paths share is moved once per task. With one, blob ids alone ask the ledger first,
    and only texts that some rule has not seen are moved: a corpus that is known moves none. A pair
    without a finding is a row with no spans, so that it is not scanned again.
    """
    seen = [f"seen_{k}" for k in range(len(rules))]
    if ledger is None:
        blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
        blobs = blobs.select("blob", "text", *[F.lit(False).alias(s) for s in seen])
    else:
        unseen = _unseen(versions, ledger, rules, seen).withColumnRenamed("blob", "asked")
        moved = versions.select("blob", "text").join(apart(unseen), F.col("blob") == F.col("asked"))
        blobs = moved.groupBy("blob").agg(F.first("text").alias("text"), *[F.max(s).alias(s) for s in seen])
    found = blobs.select(
        "blob",
        "text",
        *seen,
        *[
            F.when(~F.col(s), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(r.name)
            for r, s in zip(rules, seen)
        ],
    )
    pairs = F.array(
        *[
            F.when(
                ~F.col(s),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.version).alias("rule_version"),
                    _spans(r, F.col(r.name), F.col("text")).alias("spans"),
                ),
            )
            for r, s in zip(rules, seen)
        ]
    )
    return found.select("blob", F.explode(F.array_compact(pairs)).alias("p")).select("blob", "p.*")


def _unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], seen: list[str]) -> DataFrame:
    """(blob, one flag per rule) of the blobs that some rule version has not seen."""
    flags = [((F.col("rule") == r.name) & (F.col("rule_version") == r.version)).alias(s) for r, s in zip(rules, seen)]
    known = ledger.select("blob", *flags).groupBy("blob").agg(*[F.max(s).alias(s) for s in seen])
    known = known.withColumnRenamed("blob", "known")
    asked = versions.select("blob").distinct().join(known, F.col("blob") == F.col("known"), "left")
    state = asked.select("blob", *[F.coalesce(s, F.lit(False)).alias(s) for s in seen])
    return state.where(" or ".join(f"not {s}" for s in seen))


def findings(
    versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(path, blob, one column of spans per rule) for every path and version.

    The ledger is cut down to blobs that have findings under the current rule versions before it is
    joined; a blob that many paths share is split by adaptive execution.
    """
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("rule_version") == r.version))
    by_blob = (
        ledger.where(current & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(*[F.first(F.when(F.col("rule") == r.name, F.col("spans")), True).alias(r.name) for r in rules])
        .withColumnRenamed("blob", "found_blob")
    )
    return (
        versions.select("path", "blob")
        .join(apart(by_blob), F.col("blob") == F.col("found_blob"), "left")
        .select(
            "path", "blob", *[F.coalesce(r.name, F.array().cast(SPANS)).alias(r.name) for r in rules]
        )
    )


def scan(docs: DataFrame, ledger_path: str | None = None, path: str = "doc_id") -> DataFrame:
    """Findings of all ``docs``, whose unseen blobs are added to the ledger at ``ledger_path`` first.

    Without a path the ledger is a stored table of this call. A null text is an empty blob. Repeated
    rows and paths each get their row; a null path stays null. Further columns are ignored.
    """
    spark = docs.sparkSession
    versions = versions_of(docs, path)
    if ledger_path is None:
        return findings(versions, stored(scan_unseen(versions), "ledger"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    known = spark.read.parquet(ledger_path) if exists else None
    # Stored first: an append that is computed from the same folder must not see its own rows.
    stored(scan_unseen(versions, known), "unseen").write.mode("append").parquet(ledger_path)
    return findings(versions, spark.read.parquet(ledger_path))


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all kinds, by start and then by the order of ``kinds``, comma-joined."""
    def marked(kind: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    every = F.concat(*[F.transform(k, marked(i)) for i, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(every),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]),
        ),
        ",",
    )
