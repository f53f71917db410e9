"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger remembers which
(blob, rule, rule version) were scanned and what was found; a scan reads the texts of the unseen ones
only, appends them, and findings are joined back to every row that holds the blob. A new version of a
rule is scanned over all blobs again, an old one is kept beside it.

Patterns run in the JVM. A row is tested once per rule; only rows that match are taken apart.

Nulls: a null text is the empty blob; a null id is kept and gets its blob's findings. Equal texts share
one blob however many rows hold them. An empty table gives an empty result and an untouched ledger.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import matches


class Rule(NamedTuple):
    """``pattern`` finds, ``valid`` (matched whole) keeps; a new meaning needs a new version."""

    kind: str
    version: int
    pattern: str
    valid: str


RULES = (
    Rule(
        "assign",
        1,
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""(?is).*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""",
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r".{16,}"),
    # runs shorter than 32 fail anyway, so they need not be matched one by one
    Rule("hex", 1, r"[0-9a-f]{32,}", r".{32,}"),
)

LEDGER = (
    "blob string, kind string, version int, spans array<struct<begin:bigint,end:bigint>>"
)


def blob(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; an empty table where nothing was scanned yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the blobs of ``docs(text)`` that the ledger lacks for a rule and version, and appends them."""
    spark = docs.sparkSession
    seen = read_ledger(spark, ledger).select("blob", "kind", "version")
    texts = docs.select(blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    due = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    known = seen.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("known"))
    texts = texts.groupBy("blob").agg(F.min("text").alias("text")).join(known, "blob", "left")
    texts = texts.withColumn(
        "due", F.array_except(due, F.coalesce("known", F.array().cast("array<struct<kind:string,version:int>>")))
    ).filter(F.size("due") > 0)
    found = []
    for rule in rules:
        hit = F.col("text").rlike(rule.pattern)
        spans = F.transform(
            F.filter(matches(F.col("text"), rule.pattern), lambda m: m["match"].rlike(f"^(?:{rule.valid})$")),
            lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end")),
        )
        found.append(F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("version"),
            F.when(hit, spans).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"),
        ))
    rows = texts.select("blob", "due", F.explode(F.array(*found)).alias("f")).select("blob", "due", "f.*")
    rows = rows.filter(F.array_contains("due", F.struct("kind", "version"))).drop("due")
    rows.write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' rows without ``text``, plus secret_spans array<struct<begin,order,kind,end>> of the given rules.

    A column of docs that is named secret_spans gives way.
    """
    order = {r.kind: k for k, r in enumerate(rules)}
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    rows = read_ledger(docs.sparkSession, ledger).filter(F.array_contains(current, F.struct("kind", "version")))
    rows = rows.filter(F.size("spans") > 0)
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    rows = rows.select(
        "blob",
        F.transform(
            "spans",
            lambda s: F.struct(
                s["begin"].alias("begin"), place[F.col("kind")].alias("order"), F.col("kind").alias("kind"), s["end"].alias("end")
            ),
        ).alias("spans"),
    )
    by_blob = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("secret_spans"))
    # other columns go by number, so that no name of theirs can clash
    others = [c for c in docs.columns if c not in ("text", "secret_spans")]
    keyed = docs.select(blob().alias("blob"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(others)])
    return keyed.join(by_blob, "blob", "left").select(
        *[F.col(f"_{k}").alias(c) for k, c in enumerate(others)],
        F.coalesce("secret_spans", F.array().cast(by_blob.schema["secret_spans"].dataType)).alias("secret_spans"),
    )
