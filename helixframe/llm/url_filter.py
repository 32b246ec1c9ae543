"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) fits a URL when its host is the URL's host or a parent
domain and its path is a prefix of the URL's path. Written as
``reversed.host/path`` a rule is the interval of all keys with that prefix,
and a URL is one key for each of its parent domains. Intervals nest or are
apart. Every rule gives an event that opens its interval and one that closes it;
events and keys are dealt out by ranges of the key and sorted, distinct keys once. The sweep keeps the stack
of active rules as running aggregates: the sum of openings and closings is its height,
and the place at each height holds the rule opened there last. A range starts from one carried row, the stack at
its lower border. The rule on top of the stack is the longest that fits.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Rows looked at to place range boundaries; they only steer balance.
BOUNDARY_SAMPLE = 4096
#: A boundary is cut to so many characters.
BOUNDARY_CHARS = 256


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host is A-Z lower-cased and ends at ``/``, ``?`` or ``#``, path at ``?`` or ``#``; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), common.UPPER, common.LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _key(host: Column, path: Column) -> Column:
    """A host holds no ``/``, so the first one ends it."""
    return F.concat(_reversed(host), F.lit("/"), path)


def _worded(rules: DataFrame) -> DataFrame:
    """One row per distinct rule: host, key, and the entry (long, opens, rule, verdict) that the stack holds."""
    worded = rules.select(F.translate(F.coalesce("host", F.lit("")), common.UPPER, common.LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    worded = worded.where("host <> ''").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").cast("int").alias("b"), F.col("verdict").alias("verdict"))).alias("v"))
    key = _key(F.col("host"), F.col("path"))
    entry = F.struct((F.length("host") + F.length("path")).alias("long"), key.alias("opens"), F.concat("host", "path").alias("rule"), F.col("v.verdict").alias("verdict"))
    return worded.select("host", key.alias("key"), entry.alias("entry"))


def _boundaries(keys: DataFrame, n: int) -> list[list[str]]:
    """About n boundaries from a bounded sample in hash order, as a list of sorted runs so that a lookup takes two short scans."""
    rows = keys.select(F.substring("key", 1, BOUNDARY_CHARS).alias("k"), F.xxhash64("key").alias("h")).orderBy("h").limit(BOUNDARY_SAMPLE).collect()
    at = sorted(r.k for r in rows)
    cuts = sorted({at[len(at) * i // n] for i in range(1, n)}) if at else []
    step = max(1, round(len(cuts) ** 0.5))
    return [cuts[i : i + step] for i in range(0, len(cuts), step)]


def _range_of(runs: list[list[str]], below) -> Column:
    """The number of boundaries for which ``below`` holds; they are sorted, so it holds for a leading part."""
    if not runs:
        return F.lit(0)
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    full = F.size(F.filter(strings([r[0] for r in runs]), below))
    inner = F.element_at(F.array(*[strings(r) for r in runs]), F.greatest(full, F.lit(1)))
    return F.when(full == 0, F.lit(0)).otherwise((full - 1) * F.lit(len(runs[0])) + F.size(F.filter(inner, below)))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """Return ``keep`` columns of every row of ``urls`` with host, path, rule (null if none fits) and verdict.

    rules: host, path, verdict (``allow`` or ``block``). The longest fitting
    rule (host and path characters together) wins; of two rules with the same host and path
    ``block`` wins, and of two different rules of the same length the one with
    the greater key. Rules with a null or empty host fit nothing; a null path
    is an empty one. Null URLs, URLs without ``://`` and URLs that no rule fits get ``default``.
    Repeated rows stay; columns not in ``keep`` are not returned, and a kept column of one of the four names gives way to it.
    """
    spark = urls.sparkSession
    worded = common.materialize(_worded(rules), "rules")
    host, path = split_url(F.col(url))
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    rows = urls.select(*keep, host.alias("host"), path.alias("path"))
    deepest = worded.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0

    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    first = F.greatest(F.lit(1), n - F.lit(deepest - 1))
    parents = F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    keys = rows.select("host", "path").where("host <> ''").distinct()
    keys = keys.select("host", "path", F.explode(parents).alias("parent")).join(worded.select(F.col("host").alias("parent")).distinct(), "parent", "left_semi")
    keys = keys.select("host", "path", _key(F.col("parent"), F.col("path")).alias("key"))

    runs = _boundaries(keys, 4 * common.partitions(spark))
    below = lambda b: b <= F.col("key")
    nothing = F.lit(None).cast(worded.schema["entry"].dataType).alias("entry")
    raw = F.col("key").cast("binary")

    def event(range_: Column, at: Column, turn: int, step: int, entry: Column, key: Column | None = None) -> list[Column]:
        return [range_.alias("range"), at.alias("at"), F.lit(turn).alias("turn"), F.lit(step).alias("step"), entry, (F.lit("") if key is None else key).alias("key")]

    low, high = _range_of(runs, below).alias("low"), _range_of(runs, lambda b: below(b) | F.startswith(b, F.col("key"))).alias("high")
    rules_at = worded.select("key", "entry", low, high)
    # no UTF-8 text holds the byte FF: a rule's key with it stands behind all that begin with the key and before all else
    opens = rules_at.select(*event(F.col("low"), raw, 1, 1, F.col("entry")))
    closes = rules_at.select(*event(F.col("high"), F.concat(raw, F.lit(b"\xff")), 0, -1, nothing))
    carried = rules_at.where("high > low").select(F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("range"), "entry")
    carried = carried.groupBy("range").agg(F.sort_array(F.collect_list("entry")).alias("stack")).select("range", F.explode("stack").alias("entry"))
    carried = carried.select(*event(F.col("range"), F.lit(b""), 0, 1, F.col("entry")))
    # each key is swept once, however many URLs have it: the home pages of all hosts below one rule share theirs
    asked = keys.select("key").distinct().select(*event(_range_of(runs, below), raw, 2, 0, nothing, F.col("key")))

    order = ("at", "turn", F.col("entry.long"))
    height = F.sum("step").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = asked.unionByName(opens).unionByName(closes).unionByName(carried).withColumn("height", height).where("step >= 0")
    top = F.last("entry", ignorenulls=True).over(Window.partitionBy("range", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = swept.withColumn("top", top).where("turn = 2 AND top IS NOT NULL")
    tops = common.materialize(met.select("key", "top"), "key-verdicts")  # joined as tables, so that Spark can split a hot key's rows and a hot URL's
    best = common.materialize(keys.join(tops, "key").groupBy("host", "path").agg(F.max("top").alias("best")), "url-verdicts")
    return rows.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
