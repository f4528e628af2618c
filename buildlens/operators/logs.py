"""Log files of failing cases and the statistics of fetching them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.numbers import round_half_even
from buildlens.functions.text import cap_with_marker, has_link, null_to_blank, safe_name, strip, tail_bytes
from buildlens.operators.sizing import cut_lineage, is_small, join_unique


def log_jobs(cases: DataFrame) -> DataFrame:
    """Distinct files to ingest: safe name of the case and its link."""
    return cases.select(safe_name(F.col("name")).alias("key"), F.col("log_url").alias("url")).groupBy("key").agg(
        F.max("url").alias("url")
    )


def pending_logs(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs whose key is not stored yet."""
    return jobs.join(stored.select("key").distinct(), "key", "left_anti")


def cached_logs(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs answered by a stored file; reported as cached."""
    return jobs.join(stored.select("key").distinct(), "key", "left_semi").withColumn("cached", F.lit(True))


def log_texts(files: DataFrame, n_bytes: int = 0) -> DataFrame:
    """Binary log files as text, optionally only the last ``n_bytes`` of each."""
    kept = tail_bytes(F.col("content"), n_bytes)
    return files.select(
        "key",
        "path",
        F.octet_length(kept).cast("long").alias("bytes"),
        F.make_valid_utf8(kept.cast("string")).alias("log_text"),
    )


def attach_logs(cases: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    """Cases with ``log_file`` of a successful fetch, by case key; NULL without one."""
    fetched = files.filter("ok").groupBy("key").agg(F.max("path").alias("log_file"))
    return join_unique(cases, fetched.withColumnRenamed("key", key), [key])


CASE_KEY = ("source", "scenario", "config", "name")


def case_key(cases: DataFrame) -> list[str]:
    """The columns that name a case; a name alone is shared by its configurations."""
    return [c for c in CASE_KEY if c in cases.columns]


def log_requests(cases: DataFrame) -> DataFrame:
    """One job for each linked case and link, all links of a name kept: the case's columns, ``key`` and ``url``.

    The key is the safe name with a mark of the case and the link, so that no two of them share a stored file.
    """
    own = case_key(cases)
    mark = F.lower(F.hex(F.xxhash64(*own, "log_url")))
    linked = cases.filter(has_link(F.col("log_url")))
    return linked.select(*own, F.concat(safe_name(F.col("name")), F.lit("-"), mark).alias("key"), F.col("log_url").alias("url")).distinct()


def attach_fetched(cases: DataFrame, requests: DataFrame, records: DataFrame) -> DataFrame:
    """Cases with ``log_file``, the stored file of a successful fetch of their own link; NULL without one."""
    own = case_key(cases)
    files = requests.join(records.filter("ok").select("key", "path"), "key").groupBy(*own, "url").agg(F.max("path").alias("log_file"))
    asked = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in own}
    known = files.withColumns(asked).select(*asked, F.col("url").alias("_url"), "log_file")
    return join_unique(cases.drop("log_file").withColumns({**asked, "_url": F.col("log_url")}), known, [*asked, "_url"]).drop(*asked, "_url")


def log_candidates(cases: DataFrame) -> DataFrame:
    """Per distinct (name, jira, log_file) the files to try, best first.

    A file attached to the case is the only candidate, looked up by its path if the files have one; else come the safe name, the
    ticket and the safe name with another ending, looked up by file name. A case without a ticket has no file of its ticket here.
    """
    name, jira = safe_name(F.col("name")), null_to_blank(F.col("jira"))
    by_name = F.array(F.concat(name, F.lit(".log")), F.when(jira != "", F.concat(jira, F.lit(".log"))), F.concat(name, F.lit(".txt")))
    given = null_to_blank(F.col("log_file"))
    asked = [F.col("name").alias("_name"), jira.alias("_jira"), given.alias("_log_file")]
    files = F.when(given != "", F.array(given)).otherwise(by_name)
    return (
        cases.select(*asked, files.alias("files"))
        .distinct()
        .select("_name", "_jira", "_log_file", F.posexplode("files").alias("priority", "file"))
        .filter("file IS NOT NULL")
    )


def pick_log(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases with ``picked``: the first candidate that exists among ``files`` (column ``file``, and ``path`` if files are attached by path).

    The one file that every case without a ticket would ask for by that ticket, ``.log``, is looked up once and not joined, as
    all these cases would meet in one key.
    """
    paths = files.select(F.col("path" if "path" in files.columns else "file").alias("file")).distinct()
    names = files.select("file").distinct()
    tried = log_candidates(cases)
    attached = tried.filter(F.col("_log_file") != "").join(paths, "file", "left_semi")
    found = attached.unionByName(tried.filter(F.col("_log_file") == "").join(names, "file", "left_semi"))
    best = found.groupBy("_name", "_jira", "_log_file").agg(F.min_by(F.struct("file", "priority"), "priority").alias("_best"))
    nameless = files.filter(F.col("file") == ".log").limit(1).count() > 0
    # NULL and '' lead to the same candidates, so blanks make the keys joinable.
    asked = {f"_{c}": null_to_blank(F.col(c)) for c in ("name", "jira", "log_file")}
    joined = join_unique(cases.withColumns(asked), best, list(asked))
    blank = F.lit(nameless) & (F.col("_jira") == "") & (F.col("_log_file") == "") & F.coalesce(F.col("_best.priority") > 1, F.lit(True))
    return joined.withColumn("picked", F.when(blank, ".log").otherwise(F.col("_best.file"))).drop(*asked, "_best")


def read_picked(cases: DataFrame, texts: DataFrame, chars: int = V.PROMPT_LOG_CAP) -> DataFrame:
    """``log``: stripped, capped text of the picked file (``texts``: file, text)."""
    capped = texts.select(F.col("file").alias("picked"), cap_with_marker(strip(F.col("text")), chars).alias("log"))
    return join_unique(cases, capped, ["picked"])


def _downloaded() -> Column:
    return F.col("ok") & ~F.col("cached")


def _exact(c: str) -> Column:
    """Seconds as decimals, whose sum does not depend on the order of rows."""
    return F.col(c).try_cast("decimal(28,6)")


def _seconds(total: Column) -> Column:
    return round_half_even(F.coalesce(total.cast("double"), F.lit(0.0)), 3)


def fetch_summary(fetches: DataFrame, by: Sequence[str], wall: Column, workers: Column | None = None) -> DataFrame:
    """Counts over all records; sums and rates over files really downloaded.

    ``wall`` is an aggregate expression giving the wall-clock seconds of a group.
    """
    dl = _downloaded()
    sums = fetches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if("cached").alias("cached"),
        (workers if workers is not None else F.lit(0)).alias("workers"),
        round_half_even(F.coalesce(wall.cast("double"), F.lit(0.0)), 3).alias("wall_s"),
        _seconds(F.sum(F.when(dl, _exact("s")))).alias("sum_s"),
        F.coalesce(F.sum(F.when(dl, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_total"),
        _seconds(F.sum(F.when(dl, _exact("connect_s")))).alias("connect_sum_s"),
        _seconds(F.sum(F.when(dl, _exact("transfer_s")))).alias("transfer_sum_s"),
    )
    wall_s = F.col("wall_s")

    def rate(amount: Column) -> Column:
        return F.when(wall_s > 0, round_half_even(F.try_divide(amount, wall_s), 2)).otherwise(0.0)

    return sums.withColumns({
        "speedup": rate(F.col("sum_s")),
        "throughput_mb_s": rate(F.col("bytes_total") / 1e6),
    })


DIGIT_BITS = 16


def _ordered_bits(v: Column) -> Column:
    """A long whose unsigned order is the order of doubles; zeros are equal and NaN comes last."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int] = (50, 95)) -> DataFrame:
    """min, nearest-rank percentiles, max and mean of a column per group, exactly, whatever the values and the size of a group.

    Equal values are counted first (map-side combined). A rank is found by the digits of an order-preserving integer of the value, the highest
    first: one histogram over the digit, combined before the shuffle, tells the digit of the value at the rank and the rank
    among the values that share it. No task sees more of a group than a histogram. NULL is a group like any other.
    """
    by = list(by)
    key = F.to_json(F.struct(*by)) if by else F.lit("{}")
    counts = cut_lineage(
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, key.alias("_key"), F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bits", _ordered_bits(F.col("v")))
    )
    exact = F.col("v").try_cast("decimal(28,6)") * F.col("n")
    totals = cut_lineage(counts.groupBy(*by, "_key").agg(
        F.sum("n").alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.coalesce(F.when(F.max(F.abs("v")) < 1e15, F.sum(exact).cast("double")), F.sum(F.col("v") * F.col("n"))).alias("sum_v"),
    ))
    ranks = F.array(*[
        F.struct(F.lit(p).alias("p"), F.least(F.col("n") - 1, F.rint(F.lit(p / 100) * (F.col("n") - 1)).cast("long")).alias("rank"))
        for p in percents
    ])
    targets = totals.select("_key", F.explode(ranks).alias("t")).select("_key", "t.p", "t.rank", F.lit(0).cast("long").alias("prefix"))
    few = is_small(targets)
    earlier = W.partitionBy("_key", "p").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        upper = F.lit(0).cast("long") if shift + DIGIT_BITS == 64 else F.shiftrightunsigned("bits", shift + DIGIT_BITS)
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        inside = counts.join(F.broadcast(targets) if few else targets, "_key").filter(upper == F.col("prefix"))
        histogram = inside.groupBy("_key", "p", "rank", "prefix", digit.alias("digit")).agg(F.sum("n").alias("m"), F.max("v").alias("v"))
        rest = F.col("rank") - F.coalesce(F.sum("m").over(earlier), F.lit(0))
        held = histogram.withColumn("rest", rest).filter((F.col("rest") >= 0) & (F.col("rest") < F.col("m")))
        prefix = F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit"))
        targets = cut_lineage(held.select("_key", "p", F.col("rest").alias("rank"), prefix.alias("prefix"), "v"))
        found, targets = targets, targets.drop("v")
    picked = found.groupBy("_key").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])
    return totals.join(picked, "_key").select(
        *by,
        "n",
        round_half_even(F.col("min"), 3).alias("min"),
        *[round_half_even(F.col(f"p{p}"), 3).alias(f"p{p}") for p in percents],
        round_half_even(F.col("max"), 3).alias("max"),
        round_half_even(F.col("sum_v") / F.col("n"), 3).alias("mean"),
    )


def fetch_percentiles(fetches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-file seconds of downloaded files; a group without any gets zeros."""
    by = list(by)
    stats = nearest_rank(fetches.filter(_downloaded()), by, "s")
    own = stats.withColumnsRenamed({c: f"_{c}" for c in by})
    groups = fetches.select(*by).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = groups.join(own, same, "left").drop(*[f"_{c}" for c in by]) if by else stats
    numbers = [c for c in joined.columns if c not in by]
    return joined.na.fill(0.0, numbers).na.fill(0, numbers)


def slowest_files(fetches: DataFrame, n: int = V.SLOWEST_FILES) -> DataFrame:
    """The ``n`` slowest downloads; equal times keep input order (``id`` if there is one)."""
    order = [F.desc("s"), "id" if "id" in fetches.columns else "key"]
    return fetches.filter(_downloaded()).orderBy(*order).limit(n).select("key", "s", "bytes")


def slowest_by(fetches: DataFrame, by: Sequence[str], n: int = V.SLOWEST_FILES) -> DataFrame:
    """The ``n`` slowest downloads of each group."""
    order = [F.desc("s"), "id" if "id" in fetches.columns else "key"]
    ranked = fetches.filter(_downloaded()).withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rn") <= n).select(*by, "rn", "key", "s", "bytes")
