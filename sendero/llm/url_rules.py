"""URL filters by a sort-merge range join of reversed-host keys.

A host's key is its labels from the last to the first, each closed by a mark that sorts below all
other characters, so a host and all its subdomains are one interval of keys. URLs and rules are dealt
to key ranges and sorted; a sweep over each range keeps the stack of rules whose interval is open.
Intervals nest, so the rules that fit a host are the stack, checked from the longest down.

Ranges are cut at keys of a bounded hash sample of the URLs, with the URL's hash as tie-break: a host
with a third of all URLs fills several ranges. A rule is copied to the ranges its interval meets; a
range border lies in at most as many intervals as its host has labels, so copies stay few. No side is
broadcast but the borders, whose number is the number of ranges.

Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule. Repeated rows
are judged each. Rules with equal host and path: the smallest verdict wins (allow before block); a
null in a rule's host, path or verdict drops the rule. Empty tables give empty results or defaults.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import in_arrow

MARK, AFTER = "\x01", "\x02"
BORDERS_PER_RANGE = 50


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? #, ASCII lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(
        F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit("")
    )


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), MARK), F.lit(MARK))
    )


def _borders(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Keys (and tie-breaks) that cut the URLs into about equal ranges, from a bounded sample."""
    sample = urls.select("key", "tie").orderBy("tie", "key").limit(ranges * BORDERS_PER_RANGE)
    # the tie is a hash of id and url: sampling by its order takes no account of the key
    seen = sorted((r["key"], tie_break(r["tie"])) for r in sample.collect())
    step = max(1, len(seen) // ranges)
    return sorted(set(seen[step::step]))


def tie_break(tie: int) -> int:
    """The tie-break that orders equal keys: apart from the one that picks the sample."""
    return (tie * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 63)


def _deal_urls(borders: list[tuple[str, int]]):
    def run(batches):
        for batch in batches:
            keys, ties = batch.column("key").to_pylist(), batch.column("tie").to_pylist()
            part = [bisect_right(borders, (k, tie_break(t))) for k, t in zip(keys, ties, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, "part"]
            )

    return run


def _deal_rules(borders: list[tuple[str, int]]):
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            first = [bisect_right(borders, (k, -1)) for k in keys]
            last = [bisect_left(borders, (k[:-1] + AFTER, -1)) for k in keys]
            counts = np.array(last, np.int64) - np.array(first, np.int64) + 1
            row = np.repeat(np.arange(batch.num_rows), counts)
            part = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)] or [np.zeros(0)])
            copies = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*copies.columns, pa.array(part.astype(np.int32))], [*copies.schema.names, "part"]
            )

    return run


def _sweep(batches):
    """Rows of whole ranges in key order, rules before URLs of the same key."""
    part_now, stack = None, []
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict")}
        rules, verdicts = [], []
        for part, key, kind, host, path, verdict in zip(*cols.values(), strict=True):
            if part != part_now:
                part_now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if stack and stack[-1][0] == key:
                    stack[-1][1].append((len(host) + len(path), host, path, verdict))
                else:
                    stack.append((key, [(len(host) + len(path), host, path, verdict)]))
                rules.append(None)
                verdicts.append(None)
                continue
            fits = [
                (size, len(rule_host), rule_host + rule_path, rule_verdict)
                for _, level in stack
                for size, rule_host, rule_path, rule_verdict in level
                if path.startswith(rule_path) and (host == rule_host or host.endswith("." + rule_host))
            ]
            best = min(fits, key=lambda x: (-x[0], -x[1], x[2], x[3])) if fits else None
            rules.append(best and best[2])
            verdicts.append(best and best[3])
        urls = [k for k, kind in enumerate(cols["kind"]) if kind == 1]
        out = batch.select(["row"]).take(pa.array(urls, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                out.column("row"),
                pa.array([cols["host"][k] for k in urls], pa.string()),
                pa.array([cols["path"][k] for k in urls], pa.string()),
                pa.array([rules[k] for k in urls], pa.string()),
                pa.array([verdicts[k] for k in urls], pa.string()),
            ],
            ["row", "host", "path", "rule", "verdict"],
        )


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", column: str = "url") -> DataFrame:
    """urls' columns but ``column``, then host, path, rule (as host + path, or null) and verdict. Columns of urls of these names give way.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the path starts with
    its path. The longest host and path together win, then the longer host.
    """
    spark = urls.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in urls.columns if c not in (column, "host", "path", "rule", "verdict")]
    host = host_of(F.col(column))
    left = urls.select(
        F.struct(*others).alias("row"), host.alias("host"), path_of(F.col(column)).alias("path"),
        F.xxhash64(*others, column).alias("tie"),
    ).select("row", "host", "path", host_key(F.col("host")).alias("key"), "tie")
    row_type = left.schema["row"].dataType.simpleString()
    borders = _borders(left, ranges)
    dealt = in_arrow(
        left, _deal_urls(borders), f"row {row_type}, host string, path string, key string, tie bigint, part int"
    )
    right = rules.select("host", "path", "verdict").dropna().filter("host <> ''").distinct()
    right = right.select("host", "path", "verdict", host_key(F.col("host")).alias("key"))
    right = in_arrow(right, _deal_rules(borders), "host string, path string, verdict string, key string, part int")
    events = dealt.select(
        "part", "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), "row"
    ).unionByName(
        right.select("part", "key", F.lit(0).alias("kind"), "host", "path", "verdict", F.lit(None).cast(row_type).alias("row"))
    )
    swept = in_arrow(
        events.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind"),
        _sweep,
        f"row {row_type}, host string, path string, rule string, verdict string",
    )
    return swept.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
